"""Similarity scores of a pair table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.functions import similarity as sim
from pairloom.operators.skew import join_back

# which measure each token column holds when the mix-up of labels is wanted as it is
MIXED_LABELS = {"cos": "melkan", "stfidf": "jacrd", "jacrd": "cos", "melkan": "stfidf"}


def add_scores(df: DataFrame, title: str = "title", master_title: str = "mas_title",
               names: list[str] = fv.SCORE_COLUMNS, compat: bool = False) -> DataFrame:
    """Score every row as it comes; the named columns follow the given ones (SIM1-11)."""
    label = MIXED_LABELS if compat else {}
    wanted = [label.get(n, n) for n in names]
    first, score = sim.scores(wanted, F.col(title), F.col(master_title))
    return df.withColumns(first).select(*df.columns, *[score[w].alias(n) for n, w in zip(names, wanted)])


def score_pairs(pairs: DataFrame, title: str = "title", master_title: str = "mas_title",
                names: list[str] = fv.SCORE_COLUMNS, compat: bool = False) -> DataFrame:
    """Score every distinct pair of titles once and join the scores back.

    Scores depend on the two titles only, and titles repeat on both sides. Where they do not,
    ``add_scores`` saves the two shuffles. Rows without a title on either side stay, without scores.
    Pairs that carry their rows in arrays (``key_blocking`` with ``titles``) are distinct pairs of titles of a block
    and are scored where they are.
    """
    titled = F.col(title).isNotNull() & F.col(master_title).isNotNull()
    if "sup_rows" in pairs.columns:
        scored = add_scores(pairs, title, master_title, names, compat)
        return scored.withColumns({n: F.when(titled, F.col(n)) for n in names})
    titles = pairs.select(title, master_title).where(titled).distinct()
    scored = add_scores(titles, title, master_title, names, compat)
    return join_back(pairs, scored, [title, master_title], "left").select(*pairs.columns, *names)


def number_titles(rows: DataFrame, id_col: str, title: str, name: str) -> DataFrame:
    """Add ``name``: the smallest id of all rows with the same title, null where there is no title."""
    smallest = rows.where(F.col(title).isNotNull()).groupBy(title).agg(F.min(id_col).alias(name))
    return join_back(rows, smallest, [title], "left")


def score_numbered(pairs: DataFrame, supplier: DataFrame, master: DataFrame, names: list[str] = fv.SCORE_COLUMNS,
                   compat: bool = False) -> DataFrame:
    """``score_pairs`` for pairs that carry the numbers ``s_title`` and ``m_title`` in place of titles.

    Titles travel once for every distinct pair of them, to be scored; what is joined back is two numbers and the scores.
    """
    distinct = pairs.select("s_title", "m_title").where("s_title is not null and m_title is not null").distinct()
    titles = (distinct.join(supplier.select(F.col("sup_id").alias("s_title"), "title"), "s_title")
              .join(master.select(F.col("m_id").alias("m_title"), "mas_title"), "m_title"))
    scored = add_scores(titles, names=names, compat=compat).select("s_title", "m_title", *names)
    return join_back(pairs, scored, ["s_title", "m_title"], "left").select(*pairs.columns, *names)
