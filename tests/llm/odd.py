"""Rows that operators have to stand: nulls, empty and very long texts, repeated rows, clashing names."""

from pyspark.sql import functions as F, types as T

LONG = " ".join(f"word{i % 977} of{i % 31}, x{i}" for i in range(12_000))
PASSAGE = "The quick brown fox jumps over the lazy dog while seven wizards quietly brew a pot of tea in the garden behind the old mill. " * 5

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
ROWS = [
    (1, PASSAGE, "en", "b", 1), (2, PASSAGE, "en", "a", 1), (3, PASSAGE + "tail", "en", "a", 1), (3, PASSAGE + "tail", "en", "a", 1),
    (4, None, None, None, None), (5, "", "en", "a", 0), (6, " \t\n", "en", "a", 3), (None, "no id here at all", "en", None, 5), (None, "no id here at all", "en", None, 5),
    (7, LONG, "en", "b", 9), (8, LONG + " end", "de", "c", 9), (9, "one", "fr", "c", 1), (10, "a  b\tc", "fr", "c", 1), (11, "a b c", "fr", "b", 1), (12, "<|endoftext|> it's é ́ 日本", "fr", "b", 1),
    (13, "x" * 6_000, "fr", "b", 1), (14, "1 " * 3000, "fr", "b", 1), (15, "é" * 700 + "😀" * 200, "fr", "z", 1),
]
CLASHING = ["ids", "decoded", "score", "offending", "key", "id", "row", "t", "n", "prefix", "digest", "size", "p", "mix", "text_digest", "text_id"]


def odd_documents(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for name in CLASHING:
        docs = docs.withColumn(name, F.lit("taken"))
    return docs


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
