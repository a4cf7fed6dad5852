"""Mixing sources to target weights by balanced sampling with the cube method.

Targets: sources in code-point order (null last) weigh 1, 2, 3 and so on in turn and share the total size; a target
stops at ``MOST`` times its source's size and the rest is shared again by weight (solved at once: with sources ordered
by cap over weight, the level is the first that no later cap is below).

Draw: with r = target / source size, each document is taken floor(r) times, and once more with probability
p = r - floor(r). Which documents those are is decided by the cube method. In groups of ``GROUP`` documents of one
source, the vector of probabilities moves along directions of the null space of the balancing constraints (sum of
extra copies, sum of their words), which changes neither sum, until documents reach 0 or 1. The ``LARGEST`` documents of a group are
settled first, for the sum of words alone, each along a direction that all other open ones share, so that what stays open is small. Then
three documents have a direction that keeps both sums, and each move settles at least one of them, so at most two of a group stay
open. Those of all groups of a source meet in groups of the next round, and so on; a round leaves 2 of ``GROUP``. In the last round
at most two documents of a source are open: the landing problem. Their words are moved from one to the other, and the last
one goes to the side that its probability is nearer to, so that a source misses its target by half of that document at most.

Scale: a source may hold any share of the rows, since its groups are dealt by a hash of the document and, of repeated rows, their
number. Rows carry only id, source and size. Targets are solved over one row a source, in one task: right for millions of sources. Each round is written, so a lost executor repeats a part of one round. Random numbers and the
order inside a group come from hashes of the rows: reruns agree.

Defined results: null text has size 0; all rows of a null source are one source; a source of size 0 has target 0 and its
documents are taken once (0 words); repeated rows are separate documents of the same id; an empty table gives no row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.llm.common import WORDS, whole_text
from pairloom.operators.skew import SLICE_ROWS
from pairloom.session import materialize

#: No source, and no document, is taken more often than this.
MOST = 3
#: Documents that one flight settles together.
GROUP = 4096
#: Documents of a group that are settled one by one before the others, the largest first.
LARGEST = 256
SETTLED = 1e-9


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORDS)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, docs, target`` from rows ``source, size``."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    # one row a source from here on
    by = by.withColumn("weight", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("double"))
    by = by.withColumn("cap", F.col("source_size") * float(MOST)).withColumn("breadth", F.col("cap") / F.col("weight"))
    order = Window.orderBy("breadth", F.col("source").asc_nulls_last())
    all_rows = Window.orderBy("breadth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("level", (F.sum("source_size").over(all_rows) - before) / after)
    fits = F.when(F.col("level") <= F.col("breadth"), F.struct("breadth", "level"))
    by = by.withColumn("share", F.min(fits).over(all_rows)["level"])
    target = F.when(F.col("breadth") <= F.col("share"), F.col("cap")).otherwise(F.col("share") * F.col("weight"))
    return by.select("source", "source_size", "docs", target.alias("target"))


def fly(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Moves ``p`` to 0 or 1 with sums of ``p`` and ``p * size`` kept; at most two places stay between."""
    p, n = p.copy(), len(p)
    open_, following, used = [], 0, 0
    while True:
        while len(open_) < 3 and following < n:
            if SETTLED < p[following] < 1 - SETTLED:
                open_.append(following)
            following += 1
        if len(open_) < 2:
            break
        a, b = size[open_[0]], size[open_[1]]
        if len(open_) == 3:
            c = size[open_[2]]
            u = (b - c, c - a, a - b) if not a == b == c else (1.0, -1.0, 0.0)
        elif a == b:
            u = (1.0, -1.0)
        else:
            break
        up = down = np.inf  # how far p can move along u, and against it
        for i, x in zip(open_, u, strict=True):
            if x > 0:
                up, down = min(up, (1 - p[i]) / x), min(down, p[i] / x)
            elif x < 0:
                up, down = min(up, -p[i] / x), min(down, (p[i] - 1) / x)
        move = up if draws[used % len(draws)] * (up + down) < down else -down
        used += 1
        for i, x in zip(open_, u, strict=True):
            p[i] += move * x
        before = len(open_)
        open_ = [i for i in open_ if SETTLED < p[i] < 1 - SETTLED]
        if len(open_) == before:  # rounding kept all of them just inside: settle the nearest
            i = min(open_, key=lambda j: min(p[j], 1 - p[j]))
            p[i] = round(p[i])
            open_.remove(i)
    p[p <= SETTLED] = 0
    p[p >= 1 - SETTLED] = 1
    return p


def settle_largest(p: np.ndarray, size: np.ndarray, draws: np.ndarray, largest: int) -> np.ndarray:
    """Moves the ``largest`` documents of a group to 0 or 1, one after the other, with the sum of ``p * size`` kept.

    A large document can only be weighed up by many smaller ones, so its step spreads over all open ones, in proportion to the words
    that each has room for. It stops where no other is open.
    """
    p, used = p.copy(), 0
    for i in np.argsort(-size, kind="stable")[:largest].tolist():
        while SETTLED < p[i] < 1 - SETTLED:
            room = np.where((p > SETTLED) & (p < 1 - SETTLED), p * (1 - p) * size, 0.0)
            room[i] = 0
            if not size[i] or not room.any():
                break
            u = -room * size[i] / (room * size).sum()
            u[i] = 1
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.where(u > 0, (1 - p) / u, np.where(u < 0, -p / u, np.inf)).min()
                down = np.where(u > 0, p / u, np.where(u < 0, (p - 1) / u, np.inf)).min()
            p += (up if draws[used % len(draws)] * (up + down) < down else -down) * u
            used += 1
            p[p <= SETTLED] = 0
            p[p >= 1 - SETTLED] = 1
    return p


def land(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Settles the last open places of a source: two with their sum of words kept, until the last goes to the nearer side."""
    p, used = p.copy(), 0
    open_ = [i for i in range(len(p)) if SETTLED < p[i] < 1 - SETTLED]
    while len(open_) > 1 and size[open_[0]] * size[open_[1]] > 0:
        i, j = open_[:2]
        u, v = size[j], size[i]  # words that i gains j loses
        up, down = min((1 - p[i]) / u, p[j] / v), min(p[i] / u, (1 - p[j]) / v)
        move = up if draws[used % len(draws)] * (up + down) < down else -down
        used += 1
        p[i] += move * u
        p[j] -= move * v
        nearest = min((i, j), key=lambda x: min(p[x], 1 - p[x]))
        p[nearest] = round(p[nearest])
        open_ = [x for x in open_ if SETTLED < p[x] < 1 - SETTLED]
    for i in open_:
        if not size[i] or abs(p[i] - 0.5) < SETTLED:  # both sides are as near
            p[i] = float(draws[used % len(draws)] < p[i])
            used += 1
    return np.round(p)


def _settle(last: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("mix", "ascending")])
        p, size = table["p"].to_numpy(), table["size"].to_numpy().astype(float)
        rng = np.random.default_rng(zlib.crc32(repr((table["source"][0].as_py(), table["part"][0].as_py(), len(table))).encode()))
        new = fly(settle_largest(p, size, rng.random(len(p) + 1), LARGEST), size, rng.random(len(p) + 1))
        if last:
            new = land(new, size, rng.random(4))
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(new))

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """One row a document: ``id, source, size, source_size, target, copies``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size_of(whole_text(text_col)).alias("size"))
    # repeated rows get numbers, so that they are dealt apart; in slices, as a row may be repeated any number of times
    rows = rows.groupBy("id", "source", "size").agg(F.count("*").alias("rows"))
    rows = rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / SLICE_ROWS))))
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(1), F.least(F.col("rows") - F.col("slice") * SLICE_ROWS, F.lit(SLICE_ROWS)))))
    rows = materialize(rows.select("id", "source", "size", (F.col("nth") + F.col("slice") * SLICE_ROWS).alias("nth")), "mix_sizes")
    by = materialize(targets(rows), "mix_targets")
    ratio = F.when(F.col("source_size") == 0, F.lit(1.0)).otherwise(F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST))))
    by = by.withColumn("ratio", ratio).withColumn("whole", F.floor("ratio").cast("int")).withColumn("p", F.col("ratio") - F.floor("ratio"))
    rows = rows.join(by.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "ratio")
    rows = rows.withColumn("mix", F.xxhash64("id", "size", "nth"))
    most = by.agg(F.max("docs")).first()[0] or 0
    settled, left = None, rows.withColumn("open", F.col("docs"))
    while True:
        last = most <= group
        parts = F.ceil(F.col("open") / F.lit(group))  # at least one
        left = left.withColumn("part", F.pmod(F.xxhash64("mix", F.lit(most)), F.greatest(parts, F.lit(1))))
        flown = left.groupBy("source", "part").applyInArrow(_settle(last), left.schema)
        flown = materialize(flown, "mix_round")
        done = flown.where("p IN (0, 1)")
        settled = done if settled is None else settled.unionByName(done)
        if last:
            break
        # each part leaves two at most; hashing may deal a part a few more than the mean
        most = -(-most // group) * 2
        left = flown.where("p NOT IN (0, 1)").withColumn("open", F.ceil(F.col("open") / F.lit(group)) * 2)
    return settled.select("id", "source", "size", "source_size", "target", (F.col("whole") + F.col("p").cast("int")).alias("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of the mix: each document as often as it is taken, with all its columns."""
    copies = mix(docs).select(F.col("id").alias("mix_id"), F.col("size").alias("mix_size"), F.col("source").alias("mix_source"), F.col("copies").alias("mix_copies"))
    # repeated rows share what they are given, one by one
    copies = copies.groupBy("mix_id", "mix_size", "mix_source").agg(F.sum("mix_copies").alias("given"), F.count("*").alias("rows"))
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").alias("k"), F.col("source").cast("string").alias("s"), size_of(whole_text()).alias("z"))
    rows = rows.join(copies, F.col("k").eqNullSafe(F.col("mix_id")) & (F.col("z") == F.col("mix_size")) & F.col("s").eqNullSafe(F.col("mix_source")))
    single = rows.where(F.col("rows") == 1).withColumn("n", F.col("given"))
    place = F.row_number().over(Window.partitionBy("k", "z", "s").orderBy("row"))
    several = rows.where(F.col("rows") > 1).withColumn("n", F.floor(F.col("given") / F.col("rows")) + (place <= F.col("given") % F.col("rows")).cast("long"))
    out = single.select("row", "n").unionByName(several.select("row", "n")).where("n > 0")
    return out.select("row", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).select("row.*")
