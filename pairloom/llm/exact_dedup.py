"""Exact duplicates by progressive refinement, in DataFrame functions only.

Texts are equal when they agree after each run of ASCII white space became one blank. Groups are narrowed in three
steps: equal length, then equal hash of the first characters, then equal digest of the whole text. A text that is
alone after a step is settled there. The first two steps move a few numbers a row; the digest decides only among
texts that are still in company.

Every count is pre-aggregated before its shuffle and joined back on the group's key, so that one group may hold any
share of the rows: the grouped side has one row a group, the other side is split by adaptive execution.

Defined results: a null text is the empty text; all empty texts are one group. A null id ranks after all others. Rows
with the same id and equal texts are repeated rows: each is reported, one of them is kept. An empty table gives an
empty result. Other columns are not looked at, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import SPACES, free_name, whole_text
from pairloom.session import materialize

#: Characters that the second step hashes. A setting of speed; it can't change a result.
PREFIX_CHARS = 64


def normalised(text):
    return F.regexp_replace(text, SPACES, " ")


def _keyed(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> DataFrame:
    text = normalised(whole_text(text_col))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    return rows.select("id", F.length("t").alias("n"), F.xxhash64(F.substring("t", 1, prefix_chars)).alias("prefix"), "t")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row a document: id, keep_id, group_size, kept and the normalised text's sha256 (``digest``).

    The digest of texts that are settled before the third step is part of the report only; it settles nothing.
    """
    keyed = _keyed(docs, id_col, text_col, prefix_chars)
    # steps one and two: numbers only
    narrow = materialize(keyed.groupBy("id", "n", "prefix").agg(F.count("*").alias("rows")), "dedup_keys")
    lengths = narrow.groupBy("n").agg(F.sum("rows").alias("of_length")).where("of_length > 1").select("n")
    prefixes = narrow.groupBy("n", "prefix").agg(F.sum("rows").alias("of_prefix"))  # before the join: a hot length can be split there
    survivors = prefixes.join(lengths, "n").where("of_prefix > 1").select("n", "prefix", F.lit(True).alias("company"))
    # step three: the digest, compared among survivors only
    read = keyed.select("id", "n", "prefix", F.sha2("t", 256).alias("digest"))
    read = materialize(read.groupBy("id", "n", "prefix", "digest").agg(F.count("*").alias("rows")), "dedup_digests")
    marked = read.join(survivors, ["n", "prefix"], "left")
    groups = (
        marked.where("company").groupBy("n", "prefix", "digest")
        .agg(F.min("id").alias("keep_id"), F.sum("rows").alias("group_size"))
        .where("group_size > 1")
    )
    out = read.join(groups, ["n", "prefix", "digest"], "left")
    alone = F.col("group_size").isNull()
    out = out.select(
        F.col("id"), "digest", "rows",
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
    )
    # repeated rows come back one by one, and only the first of them can stay
    out = out.select("*", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy"))
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return out.select("id", "keep_id", F.col("group_size").cast("long"), stays.alias("kept"), "digest")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the one with the smallest id."""
    digest, key = free_name(docs, "text_digest"), free_name(docs, "text_id")
    gone = duplicate_groups(docs, id_col, text_col).where(~F.col("kept")).select(F.col("id").alias("gone_id"), F.col("digest").alias("gone_digest"), "keep_id").distinct()
    gone = gone.where(~F.col("gone_id").eqNullSafe(F.col("keep_id"))).drop("keep_id")
    rows = docs.withColumn(digest, F.sha2(normalised(whole_text(text_col)), 256)).withColumn(key, F.col(id_col))
    left = rows.join(gone, F.col(key).eqNullSafe(F.col("gone_id")) & (F.col(digest) == F.col("gone_digest")), "left_anti")
    return left.dropDuplicates([key, digest]).drop(key, digest)
