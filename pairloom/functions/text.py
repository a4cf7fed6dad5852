"""Text functions over string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom import fixed_values as fv


def normalise_for_ngrams(title: Column) -> Column:
    """Lower case, everything but letters, digits and whitespace blanked (TXT1)."""
    return F.regexp_replace(F.lower(title), "(?U)" + fv.NGRAM_BLANKED, " ")


def ngrams(text: Column, n: int = fv.NGRAM_SIZE) -> Column:
    """All overlapping character n-grams; none where the text is shorter than ``n`` (TXT2)."""
    starts = F.sequence(F.lit(1), F.length(text) - F.lit(n - 1))
    grams = F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, grams).otherwise(F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """Words between runs of whitespace (TXT3)."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def brand(title: Column) -> Column:
    """First blank-separated word (TXT4)."""
    return F.substring_index(title, " ", 1)


def title_case(term: Column) -> Column:
    """Strip, collapse whitespace, capitalise after every character that is no letter (TXT5)."""
    clean = F.trim(F.regexp_replace(term, r"(?U)\s+", " "))
    words = F.split(F.lower(clean), r"(?<=\P{L})")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), "")


def without_commas(text: Column, decimal_comma: bool = False) -> Column:
    """Commas deleted, or read as the decimal mark (TXT6)."""
    return F.regexp_replace(text, ",", "." if decimal_comma else "")


def decimal_size(size: Column) -> Column:
    """Number with a decimal comma or point (TXT7)."""
    return F.regexp_replace(size, ",", ".").try_cast("double")


def normalise_pack_title(pack: Column) -> Column:
    """One delimiter, ``x``, between the two numbers (TXT8)."""
    return F.regexp_replace(pack, fv.PACK_DELIMITER, "x")


def strip(text: Column) -> Column:
    """No whitespace at either end (TXT9)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    """Null for text that is empty or only whitespace (FLT3)."""
    return F.when(text.rlike(r"(?U)^\s*$"), None).otherwise(text)
