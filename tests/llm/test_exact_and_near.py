import hashlib
import random
import re
from collections import Counter, defaultdict

from odd import ROWS, documents, empty_documents, odd_documents
from pairloom.llm import dart_minhash, exact_dedup
from pairloom.llm.components import components


def brute_groups(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = Counter()
    for t, ids in groups.items():
        keep = min([i for i in ids if i is not None], default=None)
        first = True
        for i in ids:
            out[i, keep, len(ids), i == keep and first, hashlib.sha256(t.encode()).hexdigest()] += 1
            first = first and i != keep
    return out


def test_exact_groups_equal_brute_force(spark, sf_dir):
    for docs in (odd_documents(spark), documents(spark, sf_dir)):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        for prefix in (2, 64):
            got = Counter(tuple(r) for r in exact_dedup.duplicate_groups(docs, prefix_chars=prefix).collect())
            assert got == brute_groups(rows)
    assert exact_dedup.duplicate_groups(empty_documents(spark)).count() == 0


def test_exact_drop_keeps_one_row_with_all_columns(spark):
    docs = odd_documents(spark)
    left = exact_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns
    want = Counter(i for (i, keep, n, kept, d), c in brute_groups([(r[0], r[1]) for r in ROWS]).items() if kept for _ in range(c))
    assert Counter(r.doc_id for r in left.collect()) == want


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_classes(rows, similarity=0.8):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= similarity * len(sets[i] | sets[j]) - 1e-9:
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        ids[find(i)].append(doc)
    names = {r: min([d for d in own if d is not None], default=None) for r, own in ids.items()}
    return Counter((rows[i][0], names[find(i)]) for i in range(len(rows)))


def test_near_classes_equal_brute_force(spark, sf_dir):
    for docs in (odd_documents(spark), documents(spark, sf_dir)):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = dart_minhash.near_duplicates(docs)
        assert Counter((r["id"], r.class_id) for r in got.collect()) == brute_classes(rows)
    assert dart_minhash.near_duplicates(empty_documents(spark)).count() == 0


def test_unlike_documents_in_one_bucket_are_all_compared(spark):
    """Chains of near copies around one passage: the first of a bucket is unlike most, and blocks of two rows meet each other."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for chain in range(4):
        words = base[: 60 + 15 * chain] + [f"c{chain}_{i}" for i in range(40)]
        for step in range(5):
            words = list(words)
            words[rng.randrange(len(words))] = f"s{chain}_{step}"
            rows.append((100 * chain + step, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dart_minhash.near_duplicates(docs, bands=64, rows=2, block=2)
    assert Counter((r["id"], r.class_id) for r in got.collect()) == brute_classes(rows)


def test_near_drop_keeps_one_row_a_class(spark):
    docs = odd_documents(spark)
    left = dart_minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    classes = Counter(c for (_, c), n in brute_classes([(r[0], r[1]) for r in ROWS]).items())
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == sorted((c is None, c or 0) for c in classes)


def test_darts_agree_as_often_as_sets_are_alike():
    texts = [" ".join(f"w{i}" for i in range(a, a + 400)).encode() for a in (0, 40, 133)]
    signature, size, *_ = dart_minhash.signatures(texts, 4000)
    assert (size == 396).all()
    for j, alike in ((1, 356 / 436), (2, 263 / 529)):
        assert abs((signature[0] == signature[j]).mean() - alike) < 0.03
    heavy = [b"a b c d e " * 30 + b"f g h i j", b"a b c d e " * 10 + b"f g h i j"]
    signature, *_ = dart_minhash.signatures(heavy, 4000, weighted=True)
    want = sum(min(x) for x in zip((30, 29, 29, 29, 29, 1, 1, 1, 1, 1), (10, 9, 9, 9, 9, 1, 1, 1, 1, 1))) / 151
    assert abs((signature[0] == signature[1]).mean() - want) < 0.03


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
