"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views
from pairloom import fixed_values as fv
from pairloom.functions import ean, numeric
from pairloom.operators import blocking, evaluate, features, models, ranking, rules, scoring, standardise, synthetic
from pairloom.operators import titles as mining
from pairloom.operators.pairs import drop_supplier_side, rebuild_pairs
from pairloom.plans import match as matching
from pairloom.plans import training as training_plan
from pairloom.session import materialize, new_folder, ship_package, tune
from pairloom.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
_REGISTERED: dict[str, Query] = {}
DIGITS = 6
# what rules, models and the best-match table read of a feature table
MATCH_COLUMNS = ["sup_id", "m_id", "title", "mas_title", "p_id", "cp_id", "wg_sim_score", "price_diff",
                 "ean_match_flag", "size_diff"]
TITLES = ("title", "mas_title")


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(tune(spark))
        return function(spark, sf_dir)

    _REGISTERED[function.__name__] = run
    return run


def registered() -> dict[str, Query]:
    return dict(_REGISTERED)


def rounded(column: str | Column, name: str | None = None, digits: int = DIGITS) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value, digits).alias(name or column)


# -- shared inputs --------------------------------------------------------------------------------

def block_pairs(supplier: DataFrame, master: DataFrame) -> DataFrame:
    """Full rows of all pairs of the same brand and class."""
    pairs = blocking.key_blocking(supplier, master, views.PAIR_KEYS, rows=(supplier, master))
    return rebuild_pairs(pairs, supplier, master)


def title_pairs(supplier: DataFrame, master: DataFrame, rows: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The same as pairs of titles with the given rows of both sides, to be scored before they are laid out."""
    return blocking.key_blocking(supplier, master, views.PAIR_KEYS, rows=rows, titles=TITLES)


def pair_scores(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    supplier, master = views.supplier_items(spark, sf_dir), views.master_items(spark, sf_dir)
    pairs = title_pairs(supplier, master, (supplier.select("sup_id", "title"), master.select("m_id", "mas_title")))
    scored = scoring.score_pairs(pairs, names=names).select("sup_rows", "m_rows", *[rounded(n) for n in names])
    return rebuild_pairs(scored, supplier.select("sup_id"), master.select("m_id")).select("sup_id", "m_id", *names)


def feature_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What depends on one side only, written once: pairs are made from it as often as they are read."""
    return (materialize(features.add_supplier_features(views.supplier_items(spark, sf_dir)), "supplier_features"),
            materialize(features.add_master_features(views.master_items(spark, sf_dir)), "master_features"))


def jaro_features(spark: SparkSession, sf_dir: str, pairs: DataFrame | None = None, lookup: DataFrame | None = None,
                  sides: tuple[DataFrame, DataFrame] | None = None, least_score: float | None = None) -> DataFrame:
    """Feature pairs with Jaro in the place of the token-set ratio, so that SQL can follow.

    Pairs of the same brand and class unless others are given; those take the columns of a ``lookup`` by ``sup_id`` along.
    Pairs of titles below ``least_score`` are scored, but their rows are not laid out.
    """
    supplier, master = views.supplier_items(spark, sf_dir), views.master_items(spark, sf_dir)
    left, right = sides or feature_sides(spark, sf_dir)
    if lookup is not None:
        left = left.join(lookup, "sup_id", "left")
    if pairs is None:
        scored = scoring.score_pairs(title_pairs(supplier, master, (left, right)), names=["jaro", "jwrink"])
        if least_score is not None:
            score = numeric.weighted_score(F.col("jaro"), F.col("jwrink"))
            scored = scored.where(F.round(score, 9) >= least_score)
        scored = rebuild_pairs(scored, left, right)
    else:
        scored = scoring.score_pairs(rebuild_pairs(pairs, left, right), names=["jaro", "jwrink"])
    return (features.add_pair_features(scored.withColumnRenamed("jaro", "lev"))
            .withColumn("wg_sim_score", F.round("wg_sim_score", 9)))


def training_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part with its own supplier row as the matched one."""
    supplier = views.supplier_items(spark, sf_dir).withColumnRenamed("sup_id", "m_id")
    return views.master_items(spark, sf_dir).join(
        supplier.select("m_id", "title", "default_price_cents", "eans", "sup_cat_id"), "m_id")


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = training_plan.training_set(training_master(spark, sf_dir), names=["jwrink", "lev"])
    return made.select("m_id", "iteration", "wg_sim_score", "price_diff", "ean_match_flag", "size_diff", "match")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "labels").select(F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"))


# -- candidates -----------------------------------------------------------------------------------

@query
def ngrams(spark, sf_dir):
    titles = blocking._distinct_titles(views.master_items(spark, sf_dir), "m_id", "mas_title")
    return blocking.term_frequencies(titles, 4)


@query
def gram_idf(spark, sf_dir):
    titles = blocking._distinct_titles(views.master_items(spark, sf_dir), "m_id", "mas_title")
    idf = blocking.inverse_document_frequencies(blocking.term_frequencies(titles, 4), titles)
    return idf.select("gram", "df", rounded("idf"))


@query
def block_category(spark, sf_dir):
    return blocking.key_blocking(views.supplier_items(spark, sf_dir), views.master_items(spark, sf_dir),
                                 views.BLOCK_KEYS)


@query
def block_tfidf_topk(spark, sf_dir):
    found = blocking.tfidf_blocking(views.supplier_items(spark, sf_dir), views.master_items(spark, sf_dir))
    return found.select("sup_id", "m_id", rounded("cos_score"), "rank")


@query
def block_tfidf_unique(spark, sf_dir):
    """The same over titles of which none repeats; scores are left out, their last digits depend on the order of sums."""
    found = blocking.tfidf_blocking(views.unique_titles(views.supplier_items(spark, sf_dir), "sup_id", "title"),
                                    views.unique_titles(views.master_items(spark, sf_dir), "m_id", "mas_title"))
    return found.select("sup_id", "m_id", "rank")


@query
def block_hybrid(spark, sf_dir):
    return blocking.hybrid_blocking(views.supplier_items(spark, sf_dir), views.master_items(spark, sf_dir),
                                    views.PAIR_KEYS)


@query
def pair_rebuild(spark, sf_dir):
    supplier = blocking.drop_missing_titles(views.supplier_items(spark, sf_dir), "title")
    master = drop_supplier_side(views.master_items(spark, sf_dir))
    return block_pairs(supplier, master).select(
        "sup_id", "m_id", "title", "mas_title", "default_price_cents", "mas_dpc", "eans", "p_eans", "p_id", "cp_id")


# -- scores ---------------------------------------------------------------------------------------

@query
def sim_token_set(spark, sf_dir):
    return pair_scores(spark, sf_dir, ["cos", "jacrd"])


@query
def sim_jaro_winkler(spark, sf_dir):
    return pair_scores(spark, sf_dir, ["jaro", "jwrink"])


@query
def sim_hamming(spark, sf_dir):
    return pair_scores(spark, sf_dir, ["hamm"])


@query
def sim_monge_elkan(spark, sf_dir):
    return pair_scores(spark, sf_dir, ["melkan"])


@query
def sim_soft_tfidf(spark, sf_dir):
    return pair_scores(spark, sf_dir, ["stfidf"])


@query
def sim_token_set_ratio(spark, sf_dir):
    return pair_scores(spark, sf_dir, ["lev"])


@query
def sim_damerau(spark, sf_dir):
    return pair_scores(spark, sf_dir, ["dlev"])


@query
def sim_ratcliff(spark, sf_dir):
    return pair_scores(spark, sf_dir, ["ratcliff"])


@query
def sim_all(spark, sf_dir):
    return pair_scores(spark, sf_dir, fv.SCORE_COLUMNS)


# -- titles ---------------------------------------------------------------------------------------

def _mined(spark, sf_dir, tobacco):
    found = mining.add_title_features(views.mining_titles(spark, sf_dir), tobacco=tobacco)
    return found.select("item_id", "brand", "pack_title", "size", "unit", "pieces", "pieces_count")


@query
def title_mine(spark, sf_dir):
    return _mined(spark, sf_dir, False)


@query
def title_mine_tobacco(spark, sf_dir):
    return _mined(spark, sf_dir, True)


def _fully_mined(spark, sf_dir, tobacco):
    found = mining.mine_titles(views.mining_titles(spark, sf_dir), tobacco=tobacco)
    return found.withColumn("size", F.round("size", DIGITS))


@query
def title_full(spark, sf_dir):
    return _fully_mined(spark, sf_dir, False)


@query
def title_full_tobacco(spark, sf_dir):
    return _fully_mined(spark, sf_dir, True)


# -- article numbers and features -----------------------------------------------------------------

@query
def ean_clean(spark, sf_dir):
    eans = ean.ean_list(F.col("eans"))
    return views.supplier_items(spark, sf_dir).select(
        "sup_id", F.array_join(eans, "|").alias("eans"), F.size(eans).alias("n_eans"))


@query
def ean_merge(spark, sf_dir):
    columns = [F.col(c) for c in ("p_eans", "cp_eans", "cp_un_eans")]
    return views.master_items(spark, sf_dir).select(
        "m_id", F.array_join(ean.merged_eans(*columns), "|").alias("merge_eans"),
        F.array_join(ean.merged_eans(*columns, compat=True), "|").alias("digits"))


@query
def ean_match(spark, sf_dir):
    merged = ean.merged_eans(F.col("p_eans"), F.col("cp_eans"), F.col("cp_un_eans"))
    supplier = views.supplier_items(spark, sf_dir).select("sup_id", "sup_brand", "sup_class", ean.ean_list(F.col("eans")).alias("eans"))
    master = views.master_items(spark, sf_dir).select("m_id", "mas_brand", "mas_class", merged.alias("merged"))
    common = ean.common_eans(F.col("merged"), F.col("eans"))
    return block_pairs(supplier, master).select(
        "sup_id", "m_id", common.alias("common_eans"), ean.ean_match_flag(common).alias("ean_match_flag"))


@query
def type_repair(spark, sf_dir):
    """Numbers spelled with thousands commas, blanks and gaps, and back."""
    raw = views.table(spark, sf_dir, "part").select(
        "p_partkey", F.format_number("p_retailprice", 2).alias("mas_dpc"),
        F.when(F.col("p_size") % 5 == 0, "  ").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(",5")))
        .alias("size"),
        F.when(F.col("p_size") % 7 == 0, None).otherwise(F.col("p_size").cast("string")).alias("pieces"))
    return features.repair_types(features.blanks_to_null(raw)).select("p_partkey", "mas_dpc", "size", "pieces")


@query
def pair_features(spark, sf_dir):
    return jaro_features(spark, sf_dir).select(
        "sup_id", "m_id", "brand", rounded("wg_sim_score"), rounded("price_diff"), "common_eans", "ean_match_flag",
        rounded("size_diff"))


@query
def feature_pipeline(spark, sf_dir):
    """The features computed on the pair table itself, with the token-set ratio."""
    rows = views.supplier_items(spark, sf_dir), views.master_items(spark, sf_dir)
    scored = scoring.score_pairs(title_pairs(*rows, rows), names=["jwrink", "lev"])
    return features.feature_pipeline(scored, rows=rows).select(
        "sup_id", "m_id", "brand", "size", "unit", "pieces", "pieces_count", rounded("wg_sim_score"),
        rounded("price_diff"), "ean_match_flag", rounded("size_diff"))


# -- rules and ranking ----------------------------------------------------------------------------

def _rule_pairs(spark, sf_dir):
    """Feature pairs, and a function that makes them once more with a lookup, as they are too many to be written."""
    sides = feature_sides(spark, sf_dir)
    pairs = jaro_features(spark, sf_dir, sides=sides).select(*MATCH_COLUMNS)
    return pairs, lambda lookup: (jaro_features(spark, sf_dir, lookup=lookup, sides=sides)
                                  .select(*MATCH_COLUMNS, *lookup.drop("sup_id").columns))


def _ruled(spark, sf_dir, rule_no):
    pairs, again = _rule_pairs(spark, sf_dir)
    found = rules.classify_by_rule(pairs, rule_no, again)
    return found.select("sup_id", "m_id", rounded("wg_sim_score"), "match_pred")


@query
def rule_1(spark, sf_dir):
    return _ruled(spark, sf_dir, 1)


@query
def rule_2(spark, sf_dir):
    return _ruled(spark, sf_dir, 2)


@query
def rule_3(spark, sf_dir):
    return _ruled(spark, sf_dir, 3)


@query
def rule_features(spark, sf_dir):
    found = rules.add_rule_features(*_rule_pairs(spark, sf_dir))
    prices = F.transform("price_knn", lambda p: p.cast("long").cast("string"))
    return found.select("sup_id", "m_id", rounded("wg_sim_score_max"), F.array_join(prices, "|").alias("price_knn"))


@query
def automatch_top3(spark, sf_dir):
    # rule 1 matches no pair of a lower score
    return ranking.automatch(rules.classify_by_rule(jaro_features(spark, sf_dir, least_score=fv.RULE_1_MIN_SCORE), 1))


# -- training data, scaling, metrics --------------------------------------------------------------

@query
def synthetic_pairs(spark, sf_dir):
    return synthetic.synthetic_pairs(training_master(spark, sf_dir)).select(
        "m_id", "iteration", "mas_cat_id", "title", "default_price_cents", "eans", "sup_cat_id", "match")


@query
def standardise_features(spark, sf_dir):
    pairs = jaro_features(spark, sf_dir).select("sup_id", "m_id", *fv.MODEL_FEATURES)
    scaled = standardise.scaling_stage(standardise.fit_stats(pairs, fv.MODEL_FEATURES)).transform(pairs)
    return scaled.select("sup_id", "m_id", *[rounded(f"z_{c}") for c in fv.MODEL_FEATURES])


@query
def confusion(spark, sf_dir):
    return evaluate.confusion(labelled(spark, sf_dir))


@query
def eval_metrics(spark, sf_dir):
    found = evaluate.class_1_metrics(labelled(spark, sf_dir))
    return found.select(*[rounded(c) for c in found.columns])


@query
def eval_report(spark, sf_dir):
    return evaluate.classification_report(labelled(spark, sf_dir)).select(
        "label", rounded("precision"), rounded("recall"), rounded("f1"), "support")


# -- models and whole jobs ------------------------------------------------------------------------

@query
def training_set(spark, sf_dir):
    return training_rows(spark, sf_dir).withColumn("wg_sim_score", F.round("wg_sim_score", DIGITS))


@query
def ml_train_eval(spark, sf_dir):
    rows = materialize(training_rows(spark, sf_dir), "training")
    _, metrics, *_ = training_plan.train(rows, new_folder(spark, "models"))
    return metrics.select("model", *[rounded(c) for c in ("precision", "recall", "accuracy", "f1")])


@query
def ml_importance(spark, sf_dir):
    rows = materialize(training_rows(spark, sf_dir), "training")
    fitted, _ = models.train_models(rows, training_plan.ROW_KEYS)
    return models.feature_importance(fitted, spark)


@query
def ml_predict(spark, sf_dir):
    """Boosted trees trained, saved, loaded, and used on the pairs of the same brand and class."""
    rows = materialize(training_rows(spark, sf_dir), "training")
    folder = new_folder(spark, "models")
    fitted, _ = models.train_models(rows, training_plan.ROW_KEYS, names=[models.BOOSTED])
    writers.save_models(fitted, folder)
    supplier, master = views.supplier_items(spark, sf_dir), views.master_items(spark, sf_dir)
    pairs = matching.narrow_pairs(supplier, master, keys=views.PAIR_KEYS)
    return models.predict(readers.load_model(f"{folder}/{models.BOOSTED}"), pairs).select(
        "sup_id", "m_id", "match_pred")


@query
def latest_training(spark, sf_dir):
    folder = new_folder(spark, "training_data")
    writers.write_training(training_rows(spark, sf_dir), folder)
    return readers.read_latest_training(spark, folder).withColumn("wg_sim_score", F.round("wg_sim_score", DIGITS))


@query
def csv_round_trip(spark, sf_dir):
    folder = new_folder(spark, "exchange")
    writers.write_table(views.supplier_items(spark, sf_dir).drop("sup_brand", "sup_class"), f"{folder}/supplier.csv")
    back = readers.read_supplier(spark, f"{folder}/supplier.csv")
    return back.withColumn("default_price_cents", numeric.repaired_number(F.col("default_price_cents")))


def in_id_order(master):
    """Rows by ``m_id``, without it, in ranges that become part files in the same order."""
    parts = int(master.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return master.repartitionByRange(parts, "m_id").sortWithinPartitions("m_id").drop("m_id")


@query
def csv_master(spark, sf_dir):
    """Master files without ids: rows get their place in the order of the files, whatever the splits."""
    folder = new_folder(spark, "exchange")
    writers.write_table(in_id_order(views.master_items(spark, sf_dir).drop("mas_brand", "mas_class")), f"{folder}/master.csv")
    return readers.read_master(spark, f"{folder}/master.csv").select("m_id", "mas_title", "p_id")


@query
def match_files(spark, sf_dir):
    """The whole rule-based job with all its scores, from CSV files to CSV files; the best matches are read back."""
    folder = new_folder(spark, "job")
    writers.write_table(views.supplier_items(spark, sf_dir).drop("sup_brand", "sup_class"), f"{folder}/supplier.csv")
    writers.write_table(views.master_items(spark, sf_dir).drop("mas_brand", "mas_class"), f"{folder}/master.csv")
    matching.run(spark, f"{folder}/supplier.csv", f"{folder}/master.csv", f"{folder}/results", matching.RULE_BASED)
    return spark.read.options(header=True, escape='"').csv(f"{folder}/results/{matching.RULE_BASED}_automatch")


@query
def match_rule(spark, sf_dir):
    """The whole rule-based job with the scores its rule reads: best three matches of every item."""
    supplier, master = views.supplier_items(spark, sf_dir), views.master_items(spark, sf_dir)
    # equal scores tie, whatever the last bits of their sums
    pairs = matching.feature_pairs_again(supplier, master, names=["jwrink", "lev"], narrow=True)
    ruled = matching.classified(lambda lookup=None: pairs(lookup).withColumn("wg_sim_score", F.round("wg_sim_score", 9)),
                                matching.RULE_BASED)[matching.RULE_BASED]
    return matching.best_matches(ruled, supplier, master)


@query
def match_rule_jaro(spark, sf_dir):
    """The whole rule-based job with Jaro in the place of the token-set ratio, so that SQL can follow."""
    supplier, master = views.supplier_items(spark, sf_dir), views.master_items(spark, sf_dir)
    left, right = feature_sides(spark, sf_dir)
    pairs = matching.title_candidates(supplier, master, left, right, fv.TOP_CANDIDATES, ["jaro", "jwrink"], False)

    def found(lookup: DataFrame | None = None) -> DataFrame:
        made = features.add_pair_features(pairs(lookup).withColumnRenamed("jaro", "lev"))
        more = [] if lookup is None else lookup.drop("sup_id").columns
        return made.withColumn("wg_sim_score", F.round("wg_sim_score", 9)).select(*MATCH_COLUMNS, *more)

    return matching.match(found, matching.RULE_BASED)[matching.RULE_BASED][1]


@query
def match_both(spark, sf_dir):
    """Both methods over one written feature table; best matches with the method that found them."""
    rows = materialize(training_rows(spark, sf_dir), "training")
    fitted, _ = models.train_models(rows, training_plan.ROW_KEYS, names=[models.BOOSTED])
    supplier, master = views.supplier_items(spark, sf_dir), views.master_items(spark, sf_dir)
    pairs = matching.feature_pairs_again(supplier, master, names=["jwrink", "lev"], narrow=True)
    found = matching.classified(pairs, matching.BOTH, model=fitted[models.BOOSTED])
    best = [matching.best_matches(predictions, supplier, master).withColumn("method", F.lit(name))
            for name, predictions in found.items()]
    return best[0].unionByName(best[1])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registered()["match_rule"](spark, sf_dir)
