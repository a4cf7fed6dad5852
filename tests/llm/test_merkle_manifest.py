import zlib
from collections import Counter, defaultdict
from hashlib import sha256

from odd import documents, empty_documents, odd_documents
from pairloom.llm import merkle_manifest as mm
from pyspark.sql import functions as F

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
COLUMNS = ["doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [*[row[c] for c in FIELDS[:-1]], text]
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(level):
    """Root and, for each leaf, its path as (left, right) lists."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, p in enumerate(paths):
            run = level[at[i] // 3 * 3 : at[i] // 3 * 3 + 3]
            p.append((run[: at[i] % 3], run[at[i] % 3 + 1 :]))
            at[i] //= 3
        level = [h(level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    root, tops = tree([built[s][0] for s in names])
    for s, above in zip(names, tops):
        for (_, _, own, r), path in zip(sorted(by[s], key=lambda x: x[:3]), built[s][1]):
            path = path + above
            text = r.text
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            folded = leaf(r, text)
            for left, right in path:
                folded = h([*left, folded, *right])
            yield r.doc_id, s, own, built[s][0], root, h(x for left, right in path for x in left + right), folded, folded == root


def same(docs, **options):
    want = Counter(brute(docs.select(*FIELDS).collect()))
    got = Counter(tuple(r) for r in mm.manifest(docs, **options).select(COLUMNS).collect())
    assert got == want
    return got


def test_manifest_equals_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = same(docs)
    assert {v for *_, v in rows} == {True, False}
    same(odd_documents(spark))
    same(docs.limit(1))
    same(docs.withColumn("source", F.lit("one")))
    assert mm.manifest(empty_documents(spark)).count() == 0


def test_repeated_rows_and_a_hot_source(spark):
    rows = spark.range(2300).select(
        F.when(F.col("id") < 1000, F.col("id")).when(F.col("id") < 1300, F.lit(None)).otherwise(5000).alias("doc_id"),
        F.when(F.col("id") % 50 == 0, F.col("id").cast("string")).when(F.col("id") % 7 > 0, "hot").alias("source"),
        F.lit("en").alias("lang"), F.lit(3).alias("n_chars"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("a\n"), F.col("id") % 5)).alias("text"))
    same(rows)


def test_sweeps_of_several_blocks(spark, sf_dir):
    # blocks of nine or three leaves: the trees need several sweeps up and down
    docs = documents(spark, sf_dir)
    same(docs, depth=2)
    same(docs.withColumn("source", F.when(F.col("doc_id") % 5 > 0, "hot").otherwise(F.col("doc_id").cast("string"))), depth=1)


def test_numbers_follow_the_order(spark):
    rows = spark.range(1000).selectExpr("if(id % 3 = 0, 'a', 'b') as k", "id * 7919 % 1000 as v").repartition(5)
    got = mm.numbered(rows, "k", ["v"]).collect()
    for k in "ab":
        own = sorted((r.v, r.pos, r.n) for r in got if r.k == k)
        assert [p for _, p, _ in own] == list(range(len(own))) and {n for *_, n in own} == {len(own)}


def test_packed_proofs_come_back():
    digests = [sha256(bytes([i])).hexdigest().encode() for i in range(7)]
    runs, top = mm.sweep_up(digests, mm.levels_of(7, 5))
    for d, (text, folds) in zip(digests, mm.sweep_down(runs, 2, (b"", ()))):
        assert mm.unpack(mm.pack(folds)) == (text, folds) and mm.fold(d, folds) == top
    assert mm.levels_of(1, 5) == 0 and mm.sweep_up(digests[:1], 0) == ([], digests[0])
