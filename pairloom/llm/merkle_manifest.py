"""A Merkle manifest of a dataset, made by time-forward processing.

Every row is a leaf; the leaves of a source, by id, are the first level of its tree. While a level has several nodes, each
three consecutive ones (the last run may have fewer) become the digest of their digests. The sources' roots, by source,
are the leaves of one more tree of the same kind, whose root stands for the whole dataset.

A node's label is (level, number). Nodes are processed in the order of their labels, and a node sends its digest *forward in
time*: into a priority queue, under the label of its parent, which takes it out when its turn comes. The queue is external: it
is a table that Spark shuffles by tree and block of labels and sorts by label, and a task reads it as a stream. A block is
``RUN ** depth`` nodes that have one ancestor ``depth`` levels up, so messages inside a block stay in the task's heap (at most one
block's) and only the block's ancestor is written, for the next sweep. Sweeps shrink by the size of a block; their number is the
logarithm of the largest source. Then the sweeps run once more in *reversed* label order: each node receives its parent's
proof suffix, puts its siblings before it and sends it on to its children, down to the leaves.

Leaves get their number by a range sort and sums over its partitions, so no source is gathered, however large it is. A leaf is
checked by folding its (or the tampered row's) digest with the siblings of its proof.

Defined results: null fields are ``-``; a null source is a tree of its own, before all others; in a tree null ids come first
and rows of one id are ordered by their digest (equal rows are repeated leaves, each with its own proof). A row without id is not
tampered with. An empty table gives no row. Columns other than the five named ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.llm.common import id_crc
from pairloom.session import materialize

RUN = 3
#: Levels that one sweep climbs; a block has 243 nodes.
LEVELS = 5
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
BATCH = 2_000

Folds = tuple  # (left digests, right digests, rest) from a node upwards, or ()


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, tree, digest`` and ``tampered``: the digest of the row after tampering, null where nothing is done to it."""
    rows = docs.select(*FIELDS)
    cut = leaf_digest(text=F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    touched = F.col("doc_id").isNotNull() & (id_crc() % 2 == 0) & F.contains(F.col("text"), F.lit("\n"))
    tree = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))  # null first
    return rows.select("doc_id", tree.alias("tree"), leaf_digest().alias("digest"), F.when(touched, cut).alias("tampered"))


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place in the order inside their key from 0, and ``n``, the number of rows of their key."""
    placed = rows.withColumn("_row", F.monotonically_increasing_id())  # equal rows may stand in any order
    placed = placed.repartitionByRange(key, *order, "_row").sortWithinPartitions(key, *order, "_row").drop("_row")
    placed = materialize(placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "numbered")
    runs = placed.groupBy(key, "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    earlier = F.sum("_rows").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(key, "_part", "_first", F.coalesce(earlier, F.lit(0)).alias("_before"), F.sum("_rows").over(Window.partitionBy(key)).alias("n"))
    return placed.join(runs, [key, "_part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before")


def digest_of(run: list[bytes]) -> bytes:
    """The digest of concatenated digests, all as hex text."""
    return sha256(b"".join(run)).hexdigest().encode()


def levels_of(n: int, depth: int) -> int:
    """Levels above the leaves of a tree that has ``n`` of them, at most ``depth``."""
    up = 0
    while n > 1 and up < depth:
        n, up = -(-n // RUN), up + 1
    return up


def sweep_up(block: list[bytes], levels: int) -> tuple[list[tuple[int, int, list[bytes]]], bytes]:
    """Runs of a block as (level, parent's number, digests) by label, and the digest of the block's ancestor."""
    queue = [(0, i, d) for i, d in enumerate(block)]  # sorted, hence a heap
    runs = []
    while True:
        level, at, digest = heappop(queue)
        if level == levels:
            return runs, digest
        run, parent = [digest], at // RUN
        while queue and queue[0][0] == level and queue[0][1] // RUN == parent:
            run.append(heappop(queue)[2])
        runs.append((level, parent, run))
        heappush(queue, (level + 1, parent, digest_of(run)))


def sweep_down(runs: list[tuple[int, int, list[bytes]]], levels: int, suffix: tuple[bytes, Folds]) -> list[tuple[bytes, Folds]]:
    """What each node of the block receives: all siblings up to the root as one text, and level by level."""
    queue = [(-levels, 0, suffix)]
    for level, parent, run in reversed(runs):
        text, folds = heappop(queue)[2]  # the queue's order is the runs' order reversed
        for i in range(len(run)):
            left, right = b"".join(run[:i]), b"".join(run[i + 1 :])
            heappush(queue, (-level, -(parent * RUN + i), (left + right + text, (left, right, folds))))
    return [heappop(queue)[2] for _ in range(len(queue))][::-1]


def pack(folds: Folds) -> bytes:
    out = []
    while folds:
        left, right, folds = folds
        out.append(bytes([len(left) // 64, len(right) // 64]) + bytes.fromhex((left + right).decode()))
    return b"".join(out)


def unpack(packed: bytes) -> tuple[bytes, Folds]:
    levels, at = [], 0
    while at < len(packed):
        left, right = packed[at], packed[at + 1]
        at += 2
        both = packed[at : at + 32 * (left + right)].hex().encode()
        levels.append((both[: 64 * left], both[64 * left :]))
        at += 32 * (left + right)
    folds: Folds = ()
    for left, right in reversed(levels):
        folds = (left, right, folds)
    return b"".join(left + right for left, right in levels), folds


def fold(digest: bytes, folds: Folds) -> bytes:
    """The root that a leaf's digest and its proof lead to."""
    while folds:
        left, right, folds = folds
        digest = sha256(left + digest + right).hexdigest().encode()
    return digest


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of a stream that is sorted by tree and block, a block at a time."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and (row["block"] != rows[0]["block"] or row["tree"] != rows[0]["tree"]):
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    kept: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), schema.types)], schema=schema)

    for row in rows:
        kept.append(row)
        if len(kept) == BATCH:
            yield batch()
            kept = []
    if kept:
        yield batch()


def _queue(messages: DataFrame, order: list[str]) -> DataFrame:
    """Messages by tree and block in the order of labels: the external priority queue that a sweep reads."""
    parts = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return messages.repartition(parts, "tree", "block").sortWithinPartitions("tree", "block", *order)


def _block(depth: int) -> Column:
    return F.floor(F.col("pos") / F.lit(RUN**depth)).cast("long").alias("block")


UP = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("pos", pa.int64()), ("digest", pa.binary())])
DOWN = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("suffix", pa.binary()), ("root", pa.binary())])


def climb(nodes: DataFrame, depth: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """The node table of every sweep, and the trees' roots (tree, digest), for nodes (tree, n, pos, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def up() -> Iterator[tuple]:
            for rows in _blocks(batches):
                n = rows[0]["n"]
                _, top = sweep_up([r["digest"].hex().encode() for r in rows], levels_of(n, depth))
                yield rows[0]["tree"], -(-n // RUN**depth), rows[0]["block"], bytes.fromhex(top.decode())

        yield from _batched(up(), UP)

    tables, roots = [nodes], None
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        queue = _queue(tables[-1].select("tree", "n", "pos", "digest", _block(depth)), ["pos"])
        done = materialize(queue.mapInArrow(run, "tree string, n bigint, pos bigint, digest binary"), "merkle_up")
        found = done.where("n = 1").select("tree", "digest", F.lit(len(tables) - 1).alias("sweep"))
        roots = roots.unionByName(found) if roots is not None else found
        most = -(-most // RUN**depth)
        if most <= 1:
            return tables, roots
        tables.append(done.where("n > 1"))


def descend(tables: list[DataFrame], tops: DataFrame, finish, schema: pa.Schema, ddl: str, depth: int = LEVELS) -> DataFrame:
    """Rows of ``finish(row, proof text, folds, tree's root)`` for the first table's rows, with all its columns.

    ``tops`` says for each tree its ``root``, the ``sweep`` that ended it and the ``suffix`` of proofs above the root.
    """
    messages = None
    for i in reversed(range(len(tables))):
        last = i == 0

        def run(batches: Iterator[pa.RecordBatch], last: bool = last) -> Iterator[pa.RecordBatch]:
            def down() -> Iterator[tuple]:
                for first, *rows in _blocks(batches):
                    levels = levels_of(rows[0]["n"], depth)
                    runs, _ = sweep_up([r["digest"].hex().encode() for r in rows], levels)
                    for row, (text, folds) in zip(rows, sweep_down(runs, levels, unpack(first["suffix"])), strict=True):
                        yield finish(row, text, folds, first["root"]) if last else (row["tree"], row["pos"], pack(folds), first["root"])

            yield from _batched(down(), schema if last else DOWN)

        ended = tops.where(F.col("sweep") == i).select("tree", F.lit(0).cast("long").alias("block"), "suffix", "root")
        messages = ended if messages is None else ended.unionByName(messages)
        nodes = tables[i].select("*", _block(depth))
        queue = _queue(nodes.unionByName(messages, allowMissingColumns=True), [F.col("pos").asc_nulls_first()])
        messages = queue.mapInArrow(run, ddl if last else "tree string, block bigint, suffix binary, root binary")
        if not last:
            messages = materialize(messages, "merkle_down")
    return messages


def manifest(docs: DataFrame, depth: int = LEVELS) -> DataFrame:
    """One row a document: doc_id, source, leaf, subroot, root, proof_sha256, folded_root and verified; sweeps climb ``depth`` levels."""
    rows = materialize(leaves(docs), "merkle_leaves")
    nodes = materialize(numbered(rows, "tree", ["doc_id", "digest"]), "merkle_nodes")
    tables, subroots = climb(nodes, depth)
    # the sources' roots are the leaves of the last tree
    top = materialize(numbered(subroots.select(F.lit("").alias("all"), F.col("tree").alias("name"), "digest", "sweep"), "all", ["name"])
                      .withColumnRenamed("all", "tree"), "merkle_sources")
    top_tables, top_root = climb(top, depth)
    found = top_root.first()
    root = bytes(found["digest"]) if found else b""
    above = top_root.select("tree", "sweep", F.lit(b"").alias("suffix"), F.col("digest").alias("root"))

    def source_suffix(row: dict, text: bytes, folds: Folds, own_root: bytes) -> tuple:
        return row["name"], row["sweep"], pack(folds), row["digest"]

    suffixes = pa.schema([("tree", pa.string()), ("sweep", pa.int32()), ("suffix", pa.binary()), ("root", pa.binary())])
    tops = materialize(descend(top_tables, above, source_suffix, suffixes, "tree string, sweep int, suffix binary, root binary", depth), "merkle_suffixes")

    def check(row: dict, text: bytes, folds: Folds, own_root: bytes) -> tuple:
        folded = fold((row["tampered"] or row["digest"]).hex().encode(), folds)
        tree = row["tree"]
        return (row["doc_id"], tree[1:] if tree[0] == "s" else None, row["digest"].hex(), own_root.hex(), root.hex(),
                sha256(text).hexdigest(), folded.decode(), folded == root.hex().encode())

    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), *[(c, pa.string()) for c in names], ("verified", pa.bool_())])
    ddl = f"doc_id bigint, source string, {', '.join(c + ' string' for c in names)}, verified boolean"
    return descend(tables, tops, check, schema, ddl, depth)
