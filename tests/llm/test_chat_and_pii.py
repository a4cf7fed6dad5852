import hashlib
import re
from collections import defaultdict

import numpy as np
from odd import LONG, documents, empty_documents, odd_documents
from pairloom.llm import chat_grammar, pii_weak
from pyspark.sql import functions as F

TURNS = [
    (1, 0, "user", "plain"), (1, 1, "assistant", "### user: x</turn>\n### assistant: y</turn>\n"), (1, 2, "assistant", "\\</turn> \\\\ ### \\"),
    (2, 0, "user", None), (2, 0, "user", ""), (2, None, None, "null role and turn"), (3, 1, "a: b\\", "role with a colon"), (3, 2, "assistant", "x" * 40_000 + "</turn>"),
    (4, 0, "assistant", "#### four </turn</turn>"), (4, 0, "assistant", "#### four </turn</turn>"), (None, 5, "assistant", "no id <"), (5, 0, "assistant\n", "###\n### "), (6, 0, "user", "\\### Assistant: </turn> ok"),
]


def test_loss_digest_is_read_under_the_mask(spark):
    turns = spark.createDataFrame([(1, 0, "user", "ask"), (1, 1, "assistant", "a </turn> b"), (1, 2, "assistant", "plain")], "conv_id long, turn long, role string, text string")
    made = chat_grammar.format_conversations(turns)
    right = chat_grammar.digests(made).first()
    assert right.loss_sha256 == hashlib.sha256(b"a </turn> bplain").hexdigest() and right.loss_chars == 16
    moved = F.transform("loss_spans", lambda s: F.struct((s["start"] - 1).alias("start"), (s["end"] - 1).alias("end")))
    wrong = chat_grammar.digests(made.withColumn("loss_spans", moved)).first()
    assert wrong.loss_sha256 != right.loss_sha256 and wrong.turns_sha256 == right.turns_sha256


def test_round_trip_of_hostile_turns(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit("taken")).repartition(4)
    want = defaultdict(list)
    for c, t, role, text in TURNS:
        want[c].append((t is not None, t, role or "", text or ""))
    made = {r.conv_id: r for r in chat_grammar.format_conversations(turns).collect()}
    assert set(made) == set(want)
    for c, own in want.items():
        own.sort()
        r = made[c]
        assert r.round_trip and [(x.role, x.text) for x in r.turns] == [x[2:] for x in own]
        bodies = [r.formatted[s.start : s.end] for s in r.loss_spans]
        assert bodies == [x.body for x in r.turns if x.role == "assistant"]
    digest = {r.conv_id: r for r in chat_grammar.digests(chat_grammar.format_conversations(turns)).collect()}
    for c, own in want.items():
        loss = "".join(text for _, _, role, text in own if role == "assistant")
        assert (digest[c].loss_chars, digest[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert digest[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in own).encode()).hexdigest()
    assert chat_grammar.format_conversations(turns.limit(0)).count() == 0


def test_only_conflicting_turns_are_escaped(spark):
    rows = chat_grammar.format_turns(spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")).collect()
    assert {r.text for r in rows if not r.escaped} == {"plain", "", "null role and turn", "no id <"}


def test_broken_text_is_told(spark):
    rows = spark.createDataFrame([("### user hello</turn>\n",), ("### user: a ### b</turn>\n",), ("",)], "f string")
    assert [r.t for r in rows.select(chat_grammar.parsed(F.col("f")).alias("t")).collect()] == [[None], [None], []]


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(x - 9 if x > 9 else x for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))) % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute_base(text):
    found = sorted((m.start(), i, m.end()) for i, k in enumerate(PATTERNS) for m in re.finditer(PATTERNS[k], text or "") if passes(k, m[0]))
    return [(s, i, e) for s, i, e in found]


TRICKY = [
    "a@b.c_d@e.f g@h", "x.y+z@mail.example.com, @foo a@b é😀 q@r.s-.t", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.0.0.1 1.2.3", "4111 1111 1111 1111-4111111111111111", "+1 (269) 555-3296 4111111111111111",
    "+49 30 1234567 +1", "12-34 5", "+" * 50, "1" * 4_000, ("1 " * 9_000), "a" * 5_000 + "@", "1." * 2000, ("ab." * 9000) + "@c.d", "+1" + "(" * 20_000 + "2", "card 5500 0000 0000 0004.", None, "",
]


def test_base_spans_equal_plain_patterns(spark, sf_dir):
    tricky = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    for docs in (tricky, odd_documents(spark), documents(spark, sf_dir)):
        rows = docs.select("text", pii_weak.base_spans(F.coalesce("text", F.lit(""))).alias("b")).collect()
        for r in rows:
            assert [tuple(x) for x in r.b] == brute_base(r.text), (r.text or "")[:80]


def test_added_spans(spark):
    clean = [(i, f"nothing {i} to see, version 1.2.3 of page 4") for i in range(50)]
    good = [(100 + i, f"write to ann{i}@mail.example.com or 10.0.{i}.7, call +1 (269) 555-32{i:02d} now, card 4111111111111111 ok") for i in range(50)]
    hidden = [(200, "so +1 (269) 555-3296 4111111111111111 there"), (201, "token=4111111111111111x")]
    docs = spark.createDataFrame(clean + good + hidden, "doc_id long, text string").withColumn("base", F.lit("taken"))
    rows = {r["id"]: r for r in pii_weak.personal_data(docs).collect()}
    for i, text in clean + good + hidden:
        base, spans = [tuple(x) for x in rows[i].base], [tuple(x) for x in rows[i].spans]
        assert base == brute_base(text) and set(base) <= set(spans) and spans == sorted(spans)
        if i < 200:
            assert spans == base
    assert [tuple(x) for x in rows[200].spans] == [(3, 3, 20), (21, 2, 37)] and rows[201].spans == rows[201].base
    assert pii_weak.personal_data(empty_documents(spark)).count() == 0
    assert pii_weak.personal_data(odd_documents(spark)).count() == odd_documents(spark).count()


def test_added_spans_give_way_to_base_spans(spark):
    spans = "array<struct<start: int, kind: int, end: int>>"
    rows = spark.createDataFrame([([(5, 0, 10), (20, 2, 30)], [(0, 1, 6), (9, 3, 12), (10, 3, 12), (11, 2, 13), (12, 1, 20), (25, 1, 40), (30, 1, 31)])], f"base {spans}, more {spans}")
    got = rows.select(pii_weak.with_added(F.col("base"), F.col("more")).alias("s")).first().s
    assert [tuple(x) for x in got] == [(5, 0, 10), (10, 3, 12), (12, 1, 20), (20, 2, 30), (30, 1, 31)]


def test_em_finds_unreliable_labelers():
    rng = np.random.default_rng(4)
    truth = rng.random(4000) < 0.4
    right = (0.95, 0.9, 0.85, 0.55)
    votes = np.stack([np.where(rng.random(4000) < r, truth, ~truth).astype(int) for r in right], 1)
    votes[rng.random(votes.shape) < 0.2] = 2
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    p, table = pii_weak.reliabilities(patterns, counts.astype(float))
    at = {tuple(x): q for x, q in zip(patterns, p, strict=True)}

    def best_possible(v):  # the rule that knows share and reliabilities
        odds = 0.4 / 0.6
        for vote, r in zip(v, right, strict=True):
            odds *= {1: r / (1 - r), 0: (1 - r) / r, 2: 1.0}[int(vote)]
        return odds >= 1

    found, best = (np.mean([x == t for x, t in zip(said, truth, strict=True)]) for said in ([at[tuple(v)] >= 0.5 for v in votes], [best_possible(v) for v in votes]))
    assert found > best - 0.005
    assert table[1, 0, 1] > table[1, 2, 1] > table[1, 3, 1]


def test_long_text(spark):
    docs = spark.createDataFrame([(1, LONG + " +1 (269) 555-3296 end")], "doc_id long, text string")
    assert [tuple(x) for x in pii_weak.personal_data(docs).first().base] == brute_base(LONG + " +1 (269) 555-3296 end")
