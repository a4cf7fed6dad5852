r"""Personal data by weak supervision, in DataFrame functions only.

Base: four patterns, leftmost and without overlap per kind, whose matches must pass a check (digits, Luhn, parts). They miss data that
touches other digits, since a match that swallows its neighbour fails as a whole. The method finds what is left.

1. Candidates: tighter patterns per kind, bounded by other characters, including spelled-out "at" and "dot".
2. Labelers vote yes, no or not at all on each candidate: shape (regex), check digit or range, gazetteer (top-level domains, card issuers,
   calling codes), what stands right before and after, and cue words before it.
3. Votes are counted by pattern in Spark: at most 3**6 patterns for each kind reach the driver, however large the table. Expectation-
   maximisation estimates, per kind, each labeler's reliability (how it votes on true and on false candidates) and the probability of each pattern.
4. A logistic classifier of spans, with votes and length as features, is trained on these probabilities, each weighted by its count.
   It scores every candidate by an expression. Those at ``ACCEPT`` or more that pass their check and overlap no base span are added.

Patterns are possessive or anchored at the beginning of a run of characters, so that long runs take linear time and no deep stack; they
match what the plain forms match. One scan of the texts yields base spans and candidates; the rest works on these.

Defined results: null text is empty text. Offsets are code points, end exclusive. Repeated rows are reported each. Without
candidates there is no model and nothing is added. An empty table gives no row. Other columns pass by unread.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.common import whole_text
from pairloom.session import materialize

KINDS = ("email", "ip", "card", "phone")

# Base patterns of the four kinds, as possessive forms.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_AT, _DOT = r"(?:@|\x20?[\[(]at[\])]\x20?|\x20at\x20)", r"(?:\.|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)"
CANDIDATES = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,4}}(?![A-Za-z0-9@])",
    "ip": r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9])",
    "card": r"(?<![A-Za-z0-9])(?:[0-9]{14,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9+])(?:\+?[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![A-Za-z0-9])",
}
CANDIDATE_NEEDS = {
    "email": r"@|[\x20(\[]at[\x20)\]]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]{4}[\x20-]?[0-9]{4}", "phone": r"[0-9][\x20.-][0-9]{3}",
}

# Gazetteers: top-level domains, card issuers' first digits, calling codes.
DOMAINS = r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|ch|at|it|nl)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|36|38|6011|65)"
CALLING = r"^\+?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])(?![0-9]{4})"
CUES = r"(?i)(?:e-?mail|mailto|contact|reach|phone|tel|call|fax|mobile|card|visa|credit|ip|host|server|addr)[^A-Za-z0-9]{0,3}[^.\n]{0,12}$"
SECRETS = r"(?i)(?:token|password|passwd|secret|key|version|isbn|order|sha|hash|id)\W{0,4}$"
LABELERS = ("shape", "check", "gazetteer", "before", "after", "cue")
ACCEPT = 0.5
ROUNDS = 60


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _octets(x: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(x, r"\."), lambda p: F.when(F.length(part(p)) <= 3, F.concat(F.lit("0"), part(p)).cast("int") <= 255).otherwise(False))


def _luhn(x: Column) -> Column:
    n = F.length(_digits(x))
    return (n >= 14) & (n <= 19) & F.call_function("luhn_check", _digits(x))


def _phone_digits(x: Column) -> Column:
    n = F.length(_digits(x))
    return (n >= 10) & (n <= 15)


PASSES = {"email": lambda x: F.lit(True), "ip": _octets, "card": _luhn, "phone": _phone_digits}


def located(text: Column, pattern: str, needs: str, passes=None) -> Column:
    """Array of the pattern's matches that pass: ``match, start, end, before, after``; the latter are neighbouring characters.

    The pieces between matches give the places: there is one piece more than there are matches.
    """
    found = F.when(F.regexp_like(text, F.lit(needs)), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    pieces = F.when(F.regexp_like(text, F.lit(needs)), F.split(text, pattern, -1))
    pairs = F.zip_with(found, F.slice(pieces, 1, F.size(found)), lambda m, p: F.struct(m.alias("match"), F.length(p).alias("skip"), F.substring(p, -24, 24).alias("before")))
    after = F.transform(F.slice(pieces, 2, F.size(found)), lambda p: F.substring(p, 1, 2))  # made once: not per match
    pairs = F.zip_with(pairs, after, lambda x, p: F.struct(x["match"].alias("match"), x["skip"].alias("skip"), x["before"].alias("before"), p.alias("after")))
    kind = "array<struct<match: string, start: int, end: int, before: string, after: string>>"
    none = F.expr(f"CAST(array() AS {kind})")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["skip"]
        end = start + F.length(x["match"])
        hit = F.struct(x["match"].alias("match"), start.alias("start"), end.alias("end"), x["before"].alias("before"), x["after"].alias("after"))
        more = F.concat(state["hits"], F.array(hit))
        # what fails isn't gathered: a text of numbers has very many matches and few cards
        return F.struct(end.alias("at"), (F.when(passes(x["match"]), more).otherwise(state["hits"]) if passes else more).alias("hits"))

    placed = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("hits")), step, lambda s: s["hits"])
    return F.coalesce(placed, none)


def base_spans(text: Column) -> Column:
    """Array of ``(start, kind, end)``, sorted; kind is the place in ``KINDS``."""
    def of(i: int, kind: str) -> Column:
        hits = located(text, BASE[kind], NEEDS[kind], PASSES[kind])
        return F.transform(hits, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end")))

    return F.array_sort(F.concat(*[of(i, kind) for i, kind in enumerate(KINDS)]))


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1 yes, 0 no, 2 none."""
    return (F.when(yes, 1) if no is None else F.when(yes, 1).when(no, 0)).otherwise(2)


def votes(kind: str, x: Column) -> Column:
    """The labelers' votes on a candidate, in the order of ``LABELERS``."""
    text, before, after = x["match"], x["before"], x["after"]
    like = lambda c, p: F.regexp_like(c, F.lit(p))
    shape = {
        "email": _vote(like(text, r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"), like(text, r"\.\.|^[._%+-]")),
        "ip": _vote(like(text, r"^(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}$"), like(text, r"(?:^|\.)0[0-9]")),
        "card": _vote(like(text, r"^(?:[0-9]{15,16}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4})$"), like(text, r"^([0-9])\1+$")),
        "phone": _vote(like(text, r"^\+|\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}$"), ~like(text, r"[+()]")),
    }[kind]
    check = {
        "email": _vote(F.contains(text, F.lit("@")), like(text, r"\x20at\x20") & ~like(text, r"dot")),
        "ip": _vote(_octets(text), ~_octets(text)), "card": _vote(_luhn(text), ~_luhn(text)), "phone": _vote(_phone_digits(text), ~_phone_digits(text)),
    }[kind]
    gazetteer = {
        "email": _vote(like(text, DOMAINS), like(text, r"[0-9]$")),
        "ip": _vote(~like(text, r"^(?:0|255|22[4-9]|23[0-9])\."), like(text, r"^(?:0|255)\.")),
        "card": _vote(like(_digits(text), ISSUERS), ~like(_digits(text), r"^[2-6]")),
        "phone": _vote(F.startswith(text, F.lit("+")) & like(text, CALLING), like(text, r"^0+[^0-9]|^\+0")),
    }[kind]
    left = _vote((F.length(before) == 0) | like(before, r"[\s(,;:<]$"), like(before, r"[=\"'/_#$\\-]$"))
    right = _vote((F.length(after) == 0) | like(after, r"^[\s),;>!?]|^\.(?:\s|$)"), like(after, r"^[=\"'/_#$\\:-]"))
    cue = _vote(like(before, CUES), like(before, SECRETS))
    return F.array(shape, check, gazetteer, left, right, cue)


def candidates(text: Column) -> Column:
    """Array of ``(start, kind, end, votes, size)``; size is a bucket of the length."""
    def of(i: int, kind: str) -> Column:
        hits = located(text, CANDIDATES[kind], CANDIDATE_NEEDS[kind])

        def row(x: Column) -> Column:
            size = F.least(F.floor((x["end"] - x["start"]) / 6), F.lit(5)).cast("int")
            return F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end"), votes(kind, x).alias("votes"), size.alias("size"))

        return F.transform(hits, row)

    return F.concat(*[of(i, kind) for i, kind in enumerate(KINDS)])


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM for one kind: each pattern's probability, and P(vote | class) as (class, labeler, vote).

    ``patterns``: (n, labelers) of 0, 1, 2. It begins at each pattern's share of yes among its votes.
    """
    yes, no = (patterns == 1).sum(1), (patterns == 0).sum(1)
    p = (yes + 0.5) / (yes + no + 1.0)
    hot = np.stack([patterns == v for v in range(3)], 2).astype(float)  # (n, labelers, 3)
    table = np.full((2, patterns.shape[1], 3), 1 / 3)
    for _ in range(rounds):
        for c, weight in enumerate((counts * (1 - p), counts * p)):
            table[c] = (np.einsum("n,nlv->lv", weight, hot) + 0.5) / (weight.sum() + 1.5)
        share = np.clip((counts @ p + 1) / (counts.sum() + 2), 1e-6, 1 - 1e-6)
        odds = np.log(share / (1 - share)) + np.einsum("nlv,lv->n", hot, np.log(table[1]) - np.log(table[0]))
        p = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return p, table


def span_classifier(rows: np.ndarray, counts: np.ndarray, p: np.ndarray, steps: int = 400) -> np.ndarray:
    """Logistic weights of one kind: (labelers, 3) of votes, then 6 of sizes; ``rows``: votes and size of each pattern."""
    width = (rows.shape[1] - 1) * 3 + 6
    x = np.zeros((len(rows), width))
    for j in range(rows.shape[1]):
        x[np.arange(len(rows)), j * 3 + rows[:, j]] = 1
    w, share = np.zeros(width), counts / counts.sum()
    for _ in range(steps):
        q = 1 / (1 + np.exp(-(x @ w)))
        # a Newton step on the weighted cross-entropy with a small ridge
        g = x.T @ (share * (q - p)) + 1e-3 * w
        h = (x.T * (share * q * (1 - q))) @ x + 1e-3 * np.eye(width)
        move = np.linalg.solve(h, g)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return w


def fitted(spans: DataFrame) -> dict[int, np.ndarray]:
    """Weights for each kind that has candidates, from the counts of their vote patterns."""
    each = spans.select(F.explode("candidates").alias("c")).groupBy(F.col("c.kind").alias("kind"), F.col("c.votes").alias("votes"), F.col("c.size").alias("size")).count().collect()
    weights = {}
    for kind in range(len(KINDS)):
        own = sorted(([*r["votes"], r["size"]], r["count"]) for r in each if r["kind"] == kind)
        if own:
            rows, counts = np.array([x for x, _ in own]), np.array([float(n) for _, n in own])
            p, _ = reliabilities(rows[:, :-1], counts)
            weights[kind] = span_classifier(rows, counts, p)
    return weights


def accepted(weights: dict[int, np.ndarray]) -> Column:
    """The candidates whose score reaches ``ACCEPT``, as ``(start, kind, end)``."""
    limit = float(np.log(ACCEPT / (1 - ACCEPT)))
    tables = [[float(x) for x in weights.get(k, np.full(len(LABELERS) * 3 + 6, -9.0))] for k in range(len(KINDS))]
    table = F.array(*[F.array(*[F.lit(x) for x in row]) for row in tables])

    def score(x: Column) -> Column:
        own = F.get(table, x["kind"])
        parts = [F.get(own, F.get(x["votes"], F.lit(j)) + 3 * j) for j in range(len(LABELERS))]
        return sum(parts, F.get(own, x["size"] + 3 * len(LABELERS)))

    check = LABELERS.index("check")  # what fails its check digit or range is never added
    return F.transform(F.filter("candidates", lambda x: (score(x) >= limit) & (F.get(x["votes"], F.lit(check)) != 0)), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def with_added(base: Column, more: Column) -> Column:
    """Base spans and those of ``more`` that overlap neither them nor an earlier one of ``more``; in order of start, then kind."""
    mark = lambda a, b: F.transform(a, lambda x: F.struct(x["start"].alias("start"), F.lit(b).alias("added"), x["kind"].alias("kind"), x["end"].alias("end")))
    both = F.array_sort(F.concat(mark(base, 0), mark(more, 1)))
    kind = "array<struct<start: int, added: int, kind: int, end: int>>"

    def step(state: Column, x: Column) -> Column:
        last = F.element_at(state["kept"], -1)
        # a base span takes the place of an added one that reaches into it
        cut = F.when((F.size(state["kept"]) > 0) & (last["added"] == 1) & (last["end"] > x["start"]), F.slice(state["kept"], F.lit(1), F.size(state["kept"]) - 1)).otherwise(state["kept"])
        reach = F.greatest(state["reach"], x["end"])
        kept = F.when(x["added"] == 0, F.concat(cut, F.array(x))).when(x["start"] >= state["until"], F.concat(state["kept"], F.array(x))).otherwise(state["kept"])
        until = F.when((x["added"] == 0) | (x["start"] >= state["until"]), reach).otherwise(state["until"])
        return F.struct(kept.alias("kept"), until.alias("until"), reach.alias("reach"))

    start = F.struct(F.expr(f"CAST(array() AS {kind})").alias("kept"), F.lit(0).alias("until"), F.lit(0).alias("reach"))
    kept = F.aggregate(both, start, step, lambda s: s["kept"])
    return F.array_sort(F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))


def text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``id, base, spans``; arrays of ``(start, kind, end)``."""
    text = whole_text(text_col)
    found = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("candidates"))
    found = materialize(found, "pii_spans")
    more = accepted(fitted(found))
    return found.select("id", "base", with_added(F.col("base"), more).alias("spans"))
