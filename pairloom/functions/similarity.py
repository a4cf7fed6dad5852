"""String similarities of two columns.

Hamming, Jaro, Jaro-Winkler and the token-set measures are built-in expressions. The other measures with
data-dependent loops share one Arrow UDF, so a batch of pairs crosses to Python once.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from math import sqrt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom import fixed_values as fv
from pairloom.functions.text import tokens

PYTHON_SCORES = ["lev", "dlev", "ratcliff", "melkan", "stfidf"]
# stands where a character has been matched: a code point that is no character, so no text holds it
_USED = "\U0010ffff"


# -- built-in expressions -----------------------------------------------------------------------

def hamming(left: Column, right: Column) -> Column:
    """1 - mismatches / longer length; the length excess counts as mismatch (SIM6)."""
    longest = F.greatest(F.length(left), F.length(right))
    same = F.zip_with(F.split(left, ""), F.split(right, ""), lambda a, b: a.eqNullSafe(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.size(F.filter(same, lambda s: ~s)) / longest)


def _token_measure(left: Column, right: Column, measure) -> Column:
    a, b = F.array_distinct(tokens(left)), F.array_distinct(tokens(right))
    both_empty = (F.size(a) == 0) & (F.size(b) == 0)
    any_empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(both_empty, 1.0).when(any_empty, 0.0).otherwise(measure(a, b))


def token_cosine(left: Column, right: Column) -> Column:
    """Shared tokens / sqrt(tokens * tokens) over token sets (SIM7)."""
    return _token_measure(left, right, lambda a, b: F.size(F.array_intersect(a, b))
                          / F.sqrt((F.size(a) * F.size(b)).cast("double")))


def token_jaccard(left: Column, right: Column) -> Column:
    """Shared tokens / all tokens over token sets (SIM8)."""
    return _token_measure(left, right, lambda a, b: F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: lambdas share no subexpressions."""
    return F.transform(F.array(value), use)[0]


def jaro_column(left: Column, right: Column) -> Column:
    """Jaro similarity (SIM1): one pass over the left characters that carries what is still unused of the right text.

    A character takes the first equal one within reach; that one is overwritten, and the character is put behind the
    text. Null for a null text. The code point U+10FFFF, which no text should hold, equals nothing in a changed text.
    """
    def passed(n_right: Column, reach: Column) -> Column:
        def take(state: Column, i: Column) -> Column:
            char = F.substring(left, i, 1)
            first = F.position(char, state, F.greatest(i - reach, F.lit(1)))
            found = lambda at: (at > 0) & (at <= F.least(i + reach, n_right)) & (char != _USED)
            return _let(first, lambda at: F.when(found(at), F.concat(F.overlay(state, F.lit(_USED), at, F.lit(1)), char))
                        .otherwise(state))

        return F.aggregate(F.sequence(F.lit(1), F.length(left)), F.translate(right, _USED, "\U0010fffe"), take)

    def share(state: Column, n_right: Column) -> Column:
        n_left, common = F.length(left), F.length(state) - n_right
        in_left = F.split(F.substring(state, n_right + 1, common), "")
        in_right = F.filter(F.zip_with(F.split(right, ""), F.split(state, ""), lambda b, s: F.when(s == _USED, b)), F.isnotnull)
        moved = F.size(F.filter(F.zip_with(in_left, in_right, lambda a, b: a != b), lambda differs: differs))
        return F.when(common == 0, 0.0).otherwise(
            (common / n_left + common / n_right + (common - F.floor(moved / 2)) / common) / 3)

    def measured(n_right: Column) -> Column:
        reach = F.greatest(F.floor(F.greatest(F.length(left), n_right) / 2).cast("int") - 1, F.lit(0))
        return _let(_let(reach, lambda r: passed(n_right, r)), lambda state: share(state, n_right))

    return (F.when(left.isNull() | right.isNull(), F.lit(None).cast("double")).when(left == right, 1.0)
            .when((F.length(left) == 0) | (F.length(right) == 0), 0.0).otherwise(_let(F.length(right), measured)))


def with_prefix_column(score: Column, left: Column, right: Column) -> Column:
    """Winkler's bonus for a shared prefix of up to four characters, at any score (SIM2)."""
    prefix = F.lit(0)
    for n in range(1, fv.JARO_WINKLER_PREFIX_LENGTH + 1):
        same = (F.length(left) >= n) & (F.length(right) >= n) & (F.substring(left, 1, n) == F.substring(right, 1, n))
        prefix = F.when(same, n).otherwise(prefix)
    return score + prefix * fv.JARO_WINKLER_PREFIX_WEIGHT * (1 - score)


# -- per-pair helpers of the Arrow UDF ----------------------------------------------------------

def jaro(a: str, b: str) -> float:
    """Jaro similarity of two tokens, for SIM9 and SIM10."""
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    unused, from_a, from_b = list(b), [], []
    for i, char in enumerate(a):
        try:
            at = unused.index(char, max(i - reach, 0), i + reach + 1)
        except ValueError:
            continue
        unused[at] = None
        from_a.append(char)
        from_b.append(at)
    common = len(from_a)
    if not common:
        return 0.0
    swapped = sum(x != b[at] for x, at in zip(from_a, sorted(from_b))) // 2
    return (common / len(a) + common / len(b) + (common - swapped) / common) / 3


def with_prefix(score: float, a: str, b: str) -> float:
    """Winkler's bonus for a shared prefix of up to four characters, at any score."""
    prefix = 0
    for x, y in zip(a[:fv.JARO_WINKLER_PREFIX_LENGTH], b):
        if x != y:
            break
        prefix += 1
    return score + prefix * fv.JARO_WINKLER_PREFIX_WEIGHT * (1 - score)


@lru_cache(maxsize=1 << 16)
def _token_jaro(a: str, b: str) -> float:
    return jaro(a, b)


def _masks(text: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, char in enumerate(text):
        masks[char] = masks.get(char, 0) | 1 << i
    return masks


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one integer as a row of bits."""
    full = (1 << len(a)) - 1
    masks, row = _masks(a), full
    for char in b:
        hits = row & masks.get(char, 0)
        row = (row + hits | row - hits) & full
    return len(a) - row.bit_count()


def _ratio(a: str, b: str) -> int:
    total = len(a) + len(b)
    return round(100 * 2 * common_subsequence(a, b) / total) if total else 100


_NOT_WORD = re.compile(r"\W")
_LATIN_1 = dict.fromkeys(range(128, 256))


def _processed_tokens(text: str) -> set[str]:
    return set(_NOT_WORD.sub(" ", text.translate(_LATIN_1)).lower().split())


def token_set_ratio(a: str, b: str) -> float:
    """Token-set ratio as a share of 1 (SIM3).

    Characters U+0080 to U+00FF are dropped, the rest is lower-cased and cut into token sets; the best
    ratio among shared tokens, and shared tokens with either remainder, counts.
    """
    left, right = _processed_tokens(a), _processed_tokens(b)
    if not left or not right:
        return 0.0
    shared = " ".join(sorted(left & right))
    with_left = f"{shared} {' '.join(sorted(left - right))}".strip()
    with_right = f"{shared} {' '.join(sorted(right - left))}".strip()
    return max(_ratio(shared, with_left), _ratio(shared, with_right), _ratio(with_left, with_right)) / 100


def alignment_distance(a: str, b: str) -> int:
    """Optimal-string-alignment distance: edits and swaps of neighbours, bit-parallel."""
    if not a or not b:
        return max(len(a), len(b))
    masks, full, last = _masks(a), (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, diagonal, before, distance = full, 0, 0, 0, len(a)
    for char in b:
        here = masks.get(char, 0)
        swap = (~diagonal & here) << 1 & before
        diagonal = (swap | ((here & up) + up) ^ up | here | down) & full
        right, left = down | ~(diagonal | up) & full, diagonal & up
        distance += bool(right & last) - bool(left & last)
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down = left | ~(diagonal | right) & full, diagonal & right
        before = here
    return distance


def normalised_distance(a: str, b: str) -> float:
    """Alignment distance / longer length, 0 for equal texts (SIM4)."""
    longest = max(len(a), len(b))
    return alignment_distance(a, b) / longest if longest else 0.0


def longest_block(a: str, b: str, left: tuple[int, int], right: tuple[int, int]) -> tuple[int, int, int]:
    """Start in ``a``, start in ``b`` and length of the longest common block of two ranges, the first one of several.

    A block is only tried where it would be longer than the best so far, so few strings are looked up.
    """
    best = 0, 0, 0
    for i in range(*left):
        while i + best[2] < left[1]:
            j = b.find(a[i:i + best[2] + 1], *right)
            if j < 0:
                break
            best = i, j, best[2] + 1
    return best


def gestalt(a: str, b: str) -> float:
    """Ratcliff/Obershelp similarity (SIM5): the longest common block, then the same on both of its sides."""
    matched, open_ = 0, [((0, len(a)), (0, len(b)))]
    while open_:
        left, right = open_.pop()
        i, j, n = longest_block(a, b, left, right)
        if n:
            matched += n
            open_ += [((left[0], i), (right[0], j)), ((i + n, left[1]), (j + n, right[1]))]
    return 2 * matched / (len(a) + len(b)) if a or b else 1.0


def monge_elkan(a: list[str], b: list[str]) -> float:
    """Mean over the first title's tokens of the best Jaro-Winkler to the second's (SIM9)."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    return sum(max(with_prefix(_token_jaro(x, y), x, y) for y in b) for x in a) / len(a)


def soft_tfidf(a: list[str], b: list[str]) -> float:
    """Soft TF-IDF over Jaro with the two token bags as corpus and idf = 2 / df (SIM10)."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    left, right = Counter(a), Counter(b)

    def weight(token: str, bag: Counter) -> float:
        return bag[token] * 2 / ((token in left) + (token in right))

    total = 0.0
    for token in left:
        best = max(right, key=lambda other: _token_jaro(token, other))
        score = _token_jaro(token, best)
        if score > fv.SOFT_TFIDF_MIN_JARO:
            total += weight(token, left) * weight(best, right) * score
    squares = [sum(weight(t, bag) ** 2 for t in bag) for bag in (left, right)]
    return total / (sqrt(squares[0]) * sqrt(squares[1]))


def _measure(name: str, a: str, b: str) -> float:
    if name == "lev":
        return token_set_ratio(a, b)
    if name == "dlev":
        return normalised_distance(a, b)
    if name == "ratcliff":
        return gestalt(a, b)
    return (monge_elkan if name == "melkan" else soft_tfidf)(a.split(), b.split())


def python_scores(names: list[str], left: Column, right: Column) -> Column:
    """Struct of those of ``PYTHON_SCORES`` that are named, from one Arrow UDF; null for a null text."""

    def score(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [(None,) * len(names) if x is None or y is None else tuple(_measure(n, x, y) for n in names)
                for x, y in zip(a, b)]
        return pd.DataFrame(rows, columns=names, dtype="float64")

    return F.pandas_udf(score, T.StructType([T.StructField(n, T.DoubleType()) for n in names]))(left, right)


def scores(names: list[str], left: Column, right: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    """Columns to be added first, because several scores read them, and each named score as a column."""
    in_python = [n for n in PYTHON_SCORES if n in names]
    first = {"_scores": python_scores(in_python, left, right)} if in_python else {}
    if "jaro" in names or "jwrink" in names:
        first["_jaro"] = jaro_column(left, right)
    made = {"hamm": lambda: hamming(left, right), "cos": lambda: token_cosine(left, right),
            "jacrd": lambda: token_jaccard(left, right), "jaro": lambda: F.col("_jaro"),
            "jwrink": lambda: with_prefix_column(F.col("_jaro"), left, right)}
    return first, {n: F.col(f"_scores.{n}") if n in in_python else made[n]() for n in names}
