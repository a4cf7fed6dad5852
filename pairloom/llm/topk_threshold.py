"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are turned into whole numbers and dealt into blocks. A block keeps one list a dimension, sorted by the component.
For a query, all lists are read from the end that helps (by the sign of the query's component) and in step; rows that turn up are scored
in full, and after each step the threshold, the score of a row that would have in every dimension the component last read, bounds
all rows not yet seen. The query is done with the block when k rows score above the threshold, or score as much and
the lists can't hold a smaller id (a row with the threshold's score may tie, so the bound has to be beaten). Reading
goes in steps that double, with the components of many rows scored by one product.

Every block yields its k best for every query; the best of these, by score and then id, are the answer. Queries are dealt into
blocks as well, and each block of queries meets each block of vectors: the work is (queries x vectors) at worst, the
output k rows a query and block. No side is broadcast. A block of either kind has a fixed number of rows, so equal
vectors, however many, fill blocks like any others; a task holds one pair of blocks.

Defined results: vectors that are null, hold a null or non-finite component, or differ in length from the
most common length (ties: the longer) take no part, and neither do rows with a null id. A query's own row, that is each row with its
id, is no candidate; repeated rows are candidates each; a query row repeated with the same vector is answered once. Scores have to fit 64 bits. Fewer candidates than k give fewer rows. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.session import materialize

VECTORS_A_BLOCK = 8192
QUERIES_A_BLOCK = 1024
FIRST_STEP = 16


def whole_components(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & F.coalesce(~bad, F.lit(False))


class Block:
    """Rows of one block with their sorted lists."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.lists = np.argsort(self.x, axis=0, kind="stable").astype(np.int32).T.copy()  # a row a dimension, ascending
        self.largest = float(np.abs(x).max(initial=0)) * x.shape[1]
        self.values = self.x.astype(float)

    def top(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best rows, and how many rows were scored."""
        n, d = self.x.shape
        seen = np.zeros(n, bool)
        best_id, best = np.empty(0, np.int64), np.empty(0, np.int64)
        use = np.flatnonzero(q)
        depth, step, scored = 0, FIRST_STEP, 0
        lists = self.lists[use]
        up = q[use] > 0
        # products of doubles are exact below 2**53 and much faster than those of integers
        exact = self.largest * float(np.abs(q).max(initial=0)) < 2**53
        values, by = (self.values, q.astype(float)) if exact else (self.x, q)
        while depth < n:
            until = min(n, depth + step)
            new = np.concatenate([(lists[up, n - until : n - depth]).ravel(), lists[~up, depth:until].ravel()]) if len(use) else np.arange(n)
            new = np.unique(new[~seen[new]])
            seen[new] = True
            scored += len(new)
            new = new[self.ids[new] != query_id]
            s = (values[new] @ by).astype(np.int64)
            ids, scores = np.concatenate([best_id, self.ids[new]]), np.concatenate([best, s])
            keep = np.lexsort((ids, -scores))[:k]
            best_id, best = ids[keep], scores[keep]
            depth, step = until, step * 2
            if not len(use):
                break
            last = np.where(up, lists[:, n - depth], lists[:, depth - 1])
            bound = int((self.x[last, use] * q[use]).sum())
            if len(best) == k and best[-1] > bound:
                break
        return best_id, best, scored


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.int64)


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query_id": [], "vector": [], "vec_id": [], "score": [], "scored": []}
        if left.num_rows and right.num_rows:
            vectors = left.combine_chunks()
            d = len(vectors["v"][0])
            block = Block(vectors["id"].to_numpy().astype(np.int64), _matrix(vectors["v"].combine_chunks(), d))
            queries = right.combine_chunks()
            for i, v, q in zip(queries["q_id"].to_pylist(), queries["vector"].to_pylist(), _matrix(queries["q_v"].combine_chunks(), d), strict=True):
                ids, scores, scored = block.top(i, q, k)
                found["query_id"] += [i] * len(ids)
                found["vector"] += [v] * len(ids)
                found["vec_id"] += ids.tolist()
                found["score"] += scores.tolist()
                found["scored"] += [scored] * len(ids)
        return pa.table({name: pa.array(x, pa.int64()) for name, x in found.items()})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024,
          block: int = VECTORS_A_BLOCK, queries: int = QUERIES_A_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` for each row that ``is_query`` holds for, against all rows."""
    vector = F.col(vector_col)
    rows = vectors.where(F.col(id_col).isNotNull() & usable(vector)).select(
        F.col(id_col).cast("long").alias("id"), whole_components(vector, scale).alias("v"), is_query.alias("query"), F.monotonically_increasing_id().alias("row")
    )
    rows = materialize(rows, "topk_vectors")
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = lengths[0].d if lengths else 0
    rows = rows.where(F.size("v") == d)
    asked = rows.where("query").withColumn("vector", F.xxhash64("v")).dropDuplicates(["id", "vector"])
    n, m = rows.count(), asked.count()
    vector_blocks, query_blocks = max(1, -(-n // block)), max(1, -(-m // queries))
    # each block of one kind is copied to each block of the other
    copies = lambda name, count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    dealt = lambda count: F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")
    left = rows.select("id", "v", dealt(vector_blocks).alias("block"), copies("query_block", query_blocks))
    right = asked.select(F.col("id").alias("q_id"), F.col("v").alias("q_v"), "vector", dealt(query_blocks).alias("query_block"), copies("block", vector_blocks))
    found = left.groupBy("block", "query_block").cogroup(right.groupBy("block", "query_block")).applyInArrow(
        _search(k), "query_id bigint, vector bigint, vec_id bigint, score bigint, scored bigint"
    )
    place = F.row_number().over(Window.partitionBy("query_id", "vector").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
