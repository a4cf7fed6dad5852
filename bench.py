"""Time the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and print one JSON line.

Every query runs once unmeasured, so that class loading and code generation are not counted, and once
measured into a sink that keeps every column.
"""

import json
import os
import time

from catalog.queries import registered
from pairloom.session import get_session

QUERIES = ["ngrams", "block_category", "block_tfidf_topk", "block_tfidf_unique", "sim_all", "title_mine", "title_full", "pair_features",
           "rule_2", "rule_3", "automatch_top3", "synthetic_pairs", "standardise_features", "eval_report",
           "training_set", "match_rule"]


def timed(run, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                        spark__sql__adaptive__coalescePartitions__minPartitionSize="64k",
                        spark__ui__showConsoleProgress="false", spark__driver__memory="20g")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in QUERIES:
        timed(registered()[name], spark, sf_dir)
        seconds[name] = round(timed(registered()[name], spark, sf_dir), 3)
    spark.stop()
    print(json.dumps({"metric": "sum of headline query times", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
