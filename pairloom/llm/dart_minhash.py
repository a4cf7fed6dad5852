"""Near duplicates by DartMinHash signatures in a banded join.

A document is a weighted set of five-word shingles. Darts are thrown at the plane of weight and rank: region by region (both axes
cut at powers of two), a hash of shingle and region tells how many darts fall there (Poisson, one a unit of area) and where.
A dart hits the document if its weight lies below the shingle's weight and its rank below a bound that makes about
``k (ln k + 4)`` darts hit; each dart belongs to one of ``k`` coordinates, and the earliest (least rank) of each is kept. Two
documents share a coordinate's dart with a probability equal to their weighted Jaccard similarity, at a cost of the darts
that hit, not of k a shingle. A document with an empty coordinate gets a larger bound, which leaves the earlier darts as they are.

Weights are 1 (plain Jaccard, the default) or the shingle's count.

Join: documents with equal shingle sets are one node (no pairs among copies). Signatures are cut into ``BANDS`` bands of
``ROWS`` coordinates; documents that share a band are a bucket. At similarity 0.8 a pair misses all bands with a probability of 3e-6. In each bucket every
document is held against the bucket's first one. A bucket whose documents then all are in one component is done: more links
could not change a class. The others hold unlike documents; there all pairs across components are compared in blocks, inside
tasks, which give out one link to each component that a document reaches. Every link is verified on whole shingle sets, and no pair that
shares a bucket goes unseen unless its class is settled. So classes are those of all links, without a cap.

Defined results: null text is empty text. A text of one to four words has one shingle of all its words; texts without words have
the empty set and are one class. Words compare with A-Z in lower case. Repeated rows are one node and have one class. An empty table gives
no row. A class is named by its smallest id (null if all are null).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.bpe_chunks import forget_coders, give_back, slices
from pairloom.llm.common import whole_text
from pairloom.llm.components import components
from pairloom.llm.shingles import mixed, shingle_sets
from pairloom.session import materialize

BANDS, ROWS = 32, 5
SIMILARITY = 0.8
SHINGLE_WORDS = 5
#: Rows of a bucket that meet in one task when all pairs across components are looked at.
BLOCK = 1024


def _poisson_table(area: float) -> np.ndarray:
    """Cumulated probabilities of 0, 1, 2 ... darts."""
    n = int(area + 12 * sqrt(area) + 24)
    p = np.exp(np.arange(n) * log(area) - area - np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n))))))
    return np.cumsum(p)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(float) / (1 << 53)


def darts(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, bound: np.ndarray, n: int, k: int) -> np.ndarray:
    """Earliest darts, (n, k): rank above, the dart's name below; all ones where no dart hit. ``bound``: each text's highest rank."""
    first = np.full(n * k, np.iinfo(np.uint64).max, np.uint64)
    rank_region = 0
    with np.errstate(over="ignore"):
        while True:
            low, wide = (0.0, 1.0) if rank_region == 0 else (2.0 ** (rank_region - 1),) * 2
            within = np.flatnonzero(bound[text] > low)
            if not len(within):
                break
            weight_region = 0
            while True:
                w_low, w_wide = (0.0, 1.0) if weight_region == 0 else (2.0 ** (weight_region - 1),) * 2
                here = within[weight[within] > w_low]
                if not len(here):
                    break
                seed = mixed(shingle[here] + np.uint64(1 + rank_region * 64 + weight_region) * np.uint64(0x9E3779B97F4A7C15))
                count = np.searchsorted(_poisson_table(wide * w_wide), _unit(mixed(seed + np.uint64(1))))
                of = np.repeat(here, count)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                dart = mixed(np.repeat(seed, count) + (nth + 2).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
                rank = low + wide * _unit(dart)
                hit = rank < bound[text[of]]
                name = mixed(dart + np.uint64(7))
                if weight_region or (weight[here] < 1).any():
                    hit &= w_low + w_wide * _unit(mixed(dart + np.uint64(9))) < weight[of]
                of, rank, name = of[hit], rank[hit], name[hit]
                key = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (name & np.uint64(0xFFFFFFFF))
                np.minimum.at(first, text[of] * k + ((name >> np.uint64(32)) % np.uint64(k)).astype(np.int64), key)
                weight_region += 1
            rank_region += 1
    return first.reshape(n, k)


def signatures(texts: list[bytes], k: int, weighted: bool = False, words: int = SHINGLE_WORDS):
    """Signatures (n, k), shingle counts and two hashes of the whole set for each text; texts without shingles get ones."""
    n = len(texts)
    text, shingle, count = shingle_sets(texts, words)
    weight = count.astype(float) if weighted else np.ones(len(text))
    total = np.bincount(text, weight, n)
    size = np.bincount(text, minlength=n)
    bound = np.where(total > 0, k * (log(k) + 4) / np.maximum(total, 1e-9), 0.0)
    out = np.full((n, k), np.iinfo(np.uint64).max, np.uint64)
    todo = np.flatnonzero(size)
    while len(todo):
        number = np.full(n, -1)
        number[todo] = np.arange(len(todo))
        rows = number[text] >= 0
        out[todo] = darts(number[text[rows]], shingle[rows], weight[rows], bound[todo], len(todo), k)
        todo = todo[(out[todo] == np.iinfo(np.uint64).max).any(axis=1)]
        bound[todo] *= 2
    with np.errstate(over="ignore"):
        filled = np.concatenate((shingle, np.zeros(1, np.uint64)))
        starts = np.minimum(np.searchsorted(text, np.arange(n)), len(shingle))
        both = [np.where(size > 0, np.add.reduceat(x, starts), 0) for x in (filled, mixed(filled * np.uint64(3) + np.uint64(5)))]
    return out, size, both[0], both[1]


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.arange(bands, dtype=np.uint64)[None, :] + np.zeros((len(signature), 1), np.uint64)
        cut = signature.reshape(len(signature), bands, rows)
        for j in range(rows):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, j])
    return key.view(np.int64)


def row_key(id_col: str, text_col: str) -> Column:
    """16 bytes that stand for id and text; rows that agree in both are one node."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit("|"), whole_text(text_col)).cast("binary")))


def _signed(docs: DataFrame, bands: int, rows: int, weighted: bool) -> DataFrame:
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_coders()
        for batch in batches:
            for part, texts in slices(batch, 2, 1 << 20):
                signature, size, a, b = signatures(texts, k, weighted)
                keys = band_keys(signature, bands, rows).ravel()
                keys = pa.ListArray.from_arrays(np.arange(0, len(keys) + 1, bands, dtype=np.int32), pa.array(keys))
                columns = [part.column(0), part.column(1), pa.array(size.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), keys]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "size", "set_a", "set_b", "bands"])
        give_back()

    id_type = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"key binary, id {id_type}, size bigint, set_a bigint, set_b bigint, bands array<bigint>")


def _links_in_block(similarity: float):
    """One link, verified on the whole sets, from each document to each other component that it is linked to in the block."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key").combine_chunks()
        keys, side = table["key"].to_pylist(), table["side"].to_numpy()
        part = table["component"].to_pylist()
        number = {c: i for i, c in enumerate(dict.fromkeys(part))}
        comp = np.array([number[c] for c in part])
        sets = table["shingles"].combine_chunks()
        starts = sets.offsets.to_numpy()[:-1] - sets.offsets[0].as_py()
        names, each = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        size = np.diff(np.concatenate((starts, [len(each)])))
        mark = np.zeros(len(names), np.int32)
        same_block = len(np.unique(side)) == 1
        largest = np.bincount(comp).argmax()
        left, right = [], []
        for i in np.flatnonzero(comp != largest):  # each pair across components has such a document
            own = each[starts[i] : starts[i] + size[i]]
            mark[own] = 1
            both = np.add.reduceat(mark[each], starts)
            mark[own] = 0
            linked = (both >= similarity * (size + size[i] - both) - 1e-9) & (comp != comp[i])
            if not same_block:
                linked &= side != side[i]
            hits = np.flatnonzero(linked)
            for j in hits[np.unique(comp[hits], return_index=True)[1]]:
                left.append(keys[i])
                right.append(keys[j])
        return pa.table({"a": pa.array(left, pa.binary()), "b": pa.array(right, pa.binary())})

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch, 1, 1 << 20):
            text, shingle, _ = shingle_sets(texts, SHINGLE_WORDS)
            starts = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(starts, pa.array(shingle.view(np.int64)))], names=["key", "shingles"])


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The shingle sets of the documents in ``wanted`` (``key``), in one pass; a merge join at every size."""
    texts = docs.join(wanted.select("key").distinct().hint("merge"), "key", "left_semi").select("key", "text").dropDuplicates(["key"])
    return materialize(texts.mapInArrow(_shingles, "key binary, shingles array<bigint>"), "near_sets")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets are similar enough."""
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near_pairs")
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    return pairs.join(left, "a").join(right, "b").where(both >= similarity * (F.size("left") + F.size("right") - both) - 1e-9).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS,
                    similarity: float = SIMILARITY, weighted: bool = False, block: int = BLOCK) -> DataFrame:
    """``key, id, class_id, keeper``: the class of each row; ``keeper`` is true for rows equal to the one with the class's smallest id."""
    k = bands * rows
    keyed = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    signed = materialize(_signed(keyed, bands, rows, weighted), "near_signatures")
    nodes = signed.groupBy("set_a", "set_b", "size").agg(F.min("key").alias("node"))
    signed_nodes = signed.join(nodes, ["set_a", "set_b", "size"])
    members = materialize(signed_nodes.select("key", "id", "node"), "near_members")
    single = signed_nodes.where((F.col("key") == F.col("node")) & (F.col("size") > 0)).select("key", "size", "bands").dropDuplicates(["key"])
    single = materialize(single, "near_nodes")
    rows_ = single.select("key", "size", F.explode("bands").alias("band"))
    buckets = materialize(rows_.groupBy("band").agg(F.min("key").alias("lead"), F.count("*").alias("n")).where("n > 1"), "near_buckets")
    placed = materialize(rows_.join(buckets, "band").select("band", "key", "size", "lead", "n"), "near_placed")
    sets = _sets(keyed, placed)  # only documents that share a bucket are read again
    linked = materialize(_verified(placed.where("key <> lead").select(F.col("lead").alias("a"), F.col("key").alias("b")), sets, similarity), "near_links")
    comp = components(linked)
    # buckets that hold several components: all pairs across them, in blocks
    known = placed.where("n > 2").join(comp, F.col("key") == F.col("node"), "left").withColumn("component", F.coalesce("component", "key")).drop("node")
    known = materialize(known, "near_known")
    mixed_ = known.groupBy("band").agg((F.min("component") != F.max("component")).alias("mixed")).where("mixed").select("band")
    rest = materialize(known.join(mixed_, "band").select("band", "key", "component", "n"), "near_rest")
    parts = F.ceil(F.col("n") / block).cast("int")
    placed_ = rest.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j"), (F.col("own") > j).cast("int").alias("side")))
    placed_ = placed_.select("band", "key", "component", F.explode(met).alias("m")).select("band", "key", "component", "m.*")
    placed_ = placed_.join(sets, "key")
    more = placed_.groupBy("band", "i", "j").applyInArrow(_links_in_block(similarity), "a binary, b binary")
    comp = components(linked.unionByName(more))
    classed = members.join(comp.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").withColumn("component", F.coalesce("component", "node"))
    classed = materialize(classed.select("key", "id", "component"), "near_classes")
    first = classed.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), F.col("id").alias("id"), F.col("key").alias("key"))).alias("f"))
    first = first.select("component", F.col("f.id").alias("class_id"), F.col("f.key").alias("keep"))
    return classed.join(first, "component").select("key", "id", "class_id", (F.col("key") == F.col("keep")).alias("keeper"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns."""
    keep = near_duplicates(docs).where("keeper").select(F.col("key").alias("near_key")).distinct()
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), row_key("doc_id", "text").alias("k"))
    kept = rows.join(keep, F.col("k") == F.col("near_key"), "left_semi")
    return kept.dropDuplicates(["k"]).select("row.*")
