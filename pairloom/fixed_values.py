"""Results are only right if these texts and numbers are exactly as given.

Every pattern is applied case-insensitively with Unicode classes. Named groups name the output
column; ``to_jvm`` turns them into the numbered groups that Spark's regular expressions take.
"""

import re

# ---------------------------------------------------------------------------------------------
# blocking
# ---------------------------------------------------------------------------------------------
NGRAM_SIZE = 4
TOP_CANDIDATES = 100
NGRAM_BLANKED = r"[^a-zA-Z0-9\s]"

# ---------------------------------------------------------------------------------------------
# Features, rules, reports
# ---------------------------------------------------------------------------------------------
LEV_WEIGHT = 0.7
JWRINK_WEIGHT = 0.3
RULE_1_MIN_SCORE = 0.80
PRICE_NEIGHBOURS = 10
AUTOMATCH_TOP = 3
SHUFFLE_ITERATIONS = 5
SOFT_TFIDF_MIN_JARO = 0.5
JARO_WINKLER_PREFIX_WEIGHT = 0.1
JARO_WINKLER_PREFIX_LENGTH = 4
SCORE_COLUMNS = ["jaro", "jwrink", "lev", "dlev", "ratcliff", "hamm", "cos", "jacrd", "melkan", "stfidf"]
MODEL_FEATURES = ["wg_sim_score", "price_diff", "ean_match_flag", "size_diff"]
NUMERIC_COLUMNS = ["mas_dpc", "default_price_cents", "mas_pieces", "pieces", "pieces_count", "mas_p_c",
                   "mas_size", "size"]
MASTER_SUPPLIER_COLUMNS = ["title", "default_price_cents", "eans", "sup_cat_id"]
MASTER_EAN_COLUMNS = ["p_eans", "cp_eans", "cp_un_eans"]
TEST_SHARE = 0.25
SPLIT_SEED = 42

# ---------------------------------------------------------------------------------------------
# Title mining, fragments
# ---------------------------------------------------------------------------------------------
_F = {
    "pieces": r"(?P<pieces>\d+)",
    "count": r"(?P<pieces_count>\d+)",
    "by": r"[\*xà]",
    "size": r"(?P<size>\d+(?:[.,]?\d*))",
    "size_with_mark": r"(?P<size>\d+(?:[.,]\d*))",
    "size_decimal": r"(?P<size>\d+[.,]\d+)",
    "unit": r"(?P<unit>liter|litre|ltr|gramm|gr|ml|cl|kg|g|l|Blatt|LT|cm|€|I\b)",
    "items": r"(?P<pieces_count>\d+)\s*(?:Stück|Stck|Stuck|Stueck|Stk|St|Dragees|Drages|Rollen|Dr|Riegel|Stangen|Kaugummis\.?)\b",
    "items_as_pieces": r"(?P<pieces>\d+)\s*(?:Stück|Stck|Stuck|Stueck|Stk|St\.?)\b",
    "bags": r"(?P<pieces>\d+)\s*(?:Beutel|Btl\.?)",
    "er": r"(?P<pieces_count>\d+)\s*[´]*(?:er|Pack\.?)\b",
    "pack": r"(?P<pack_title>\d+\s*[\*xà\/]\s*\d+)",
}

# Title mining, the ordered cascade over the fragments
MINING_CASCADE = [
    r"{pack}\s*{by}\s*{size}\s*{unit}",
    r"{pieces}\s*{by}\s*{count}\s*\/\s*{size}\s*{unit}?.*\b",
    r"{items}\/{size}\s*{unit}",
    r"{pieces}\s*{by}\s*{size}\s*{unit}\s*{er}",
    r"{items_as_pieces}\s*[xà]\s*{size}\s*{unit}",
    r"{size}\s*{unit}\s*{items}",
    r"{size}\s*{unit}\s*{er}",
    r"{items_as_pieces}\s*{size}\s*{unit}",
    r"{pieces}\s*{by}\s*{items}",
    r"{items}",
    r"{pack}\s*{size_with_mark}",
    r"{bags}\s*{size}\s*{unit}",
    r"{pieces}\s*{by}[\s\(]*{count}\s*{by}\s*{size}\s*{unit}?.*\b",
    r"{er}\s*{pieces}\s*{by}\s*{size}\s*{unit}?.*\b",
    r"{pieces}\s*{by}[a-zA-Z\s,]*{count}[a-zA-Z\s]+{size}\s*{unit}?.*\b",
    r"{pieces}\s*{by}\s*{er}",
    r"{pieces}\s*{by}\s*{size}\s*{unit}\b",
    r"{pieces}\s*{by}\s*{size}\s*{unit}?.*\b",
    r"{size}\s*{unit}\s*{by}\s*{pieces}",
    r"{size}\s*{unit}\.*\b",
    r"{er}",
    r"{size}\/{pieces}",
    r"{count}\s*{by}",
    r"{by}\s*{pieces}",
    r"{size_decimal}",
]
# tobacco titles: one more reading of "10x20" before the sized ones, and a bare number at the end
TOBACCO_INSERT_AT = 15
TOBACCO_INSERTED = r"{pieces}\s*{by}\s*{count}"
TOBACCO_LAST = r"{count}"

# Title mining, single patterns
FORMAT_PATTERN = r"\b(?P<format>DS|Dose|Dos|Pet|Glas)\b"
ALCOHOL_PATTERN = r"(?P<alcohol>\d+.?\d*\s*\%)"
PACKAGING_PATTERN = r"\b(?P<packaging>Kar?ton|Kiste)\b"
DEPOSIT_PATTERN = r"\b(?P<dpg>DPG|MW|EW)\b"
RETAIL_PRICE_PATTERN = r"(?P<kvp>\d+[.,]\d+)\s*(?P<kvp_unit>€)?"
PACK_PIECES_PATTERN = r"(?P<pieces_1>\d+)\s*[\*xà\/]\s*(?P<pieces_2>\d+)"
PACK_DELIMITER = r"[\*xà]"

# units
GRAM_SPELLINGS = r"gramm|gram|grm|gr"
LITRE_SPELLINGS = r"litre|liter|ltr|lt|i"
# (units, standard unit, factor), applied one after the other
UNIT_FACTORS = [
    (["ml"], "l", 0.001),
    (["cl"], "l", 0.01),
    (["kg", "kilo"], "g", 1000.0),
    (["m"], "cm", 100.0),
    (["mm"], "cm", 0.1),
]
COMMON_LITRES = [0.02, 0.05, 0.04, 0.1, 0.2, 0.25, 0.3, 0.33, 0.4, 0.5, 0.70, 0.75, 1.00, 1.5]
COMMON_BEVERAGE_SIZES = [0.2, 0.25, 0.3, 0.33, 0.4, 0.5]

_GROUP_NAME = re.compile(r"\(\?P<(\w+)>")


def mining_patterns(tobacco: bool = False) -> list[str]:
    """The cascade in order, fragments filled in."""
    templates = list(MINING_CASCADE)
    if tobacco:
        templates.insert(TOBACCO_INSERT_AT, TOBACCO_INSERTED)
        templates.append(TOBACCO_LAST)
    filled = []
    for template in templates:
        for name, fragment in _F.items():
            template = template.replace("{" + name + "}", fragment)
        filled.append(template)
    return filled


def group_names(pattern: str) -> list[str]:
    """Output columns of a pattern, in group order."""
    return _GROUP_NAME.findall(pattern)


def to_jvm(pattern: str) -> str:
    """Numbered groups, Unicode case folding and classes, and ``.`` stopping at line feeds only."""
    return "(?iuUd)" + _GROUP_NAME.sub("(", pattern)
