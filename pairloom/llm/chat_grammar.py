r"""Chat formatting whose text parses back to the turns it was made from, in DataFrame functions only.

Grammar, as the parser reads it::

    conversation := turn*
    turn         := "###" mark " " role ": " body "</turn>" newline
    mark         := "" | "\"          with the mark, role and body are escaped
    role         := no bare ":"       body := no "</turn>" and no "### "

Round trip: a turn is first rendered as it is and read back by the parser. Where what comes back is not the turn, its
conflicting content is escaped and the result read back again. Escaping puts a backslash into each control string and
before each backslash (and each ":" of a role), so that the second reading always agrees. A turn begins and ends with
strings that no part of another turn can complete, so turns that read back one by one also do as a whole; the whole
conversation is parsed again all the same, and everything reported comes from that reading.

A conversation is one text and its digest runs over all of it in order, so its turns meet in one row; rendering and
reading back single turns happens before, a row a turn.

Defined results: null role or text is the empty text; null turn comes first; equal turns are ordered by role, then text;
repeated rows are repeated turns; a null conv_id is a conversation of its own; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

END = "</turn>"
OPEN = "### "
#: mark, role and body of one piece that the parser cut at END; possessive, so that long texts need no deep stack
TURN = r"(?s)\A\n?###(\\?) ((?:[^:\\]++|\\.)*+): (.*)\z"


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit(END), F.lit("<\\/turn>"))
    return F.replace(text, F.lit(OPEN), F.lit("#\\## "))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def rendered(role: Column, text: Column, escape: bool) -> Column:
    if escape:
        role, text = F.replace(escaped(role), F.lit(":"), F.lit("\\:")), escaped(text)
    return F.concat(F.lit("###\\ " if escape else OPEN), role, F.lit(": "), text, F.lit(END + "\n"))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text, mark, body); a null element where the grammar is broken."""
    pieces = F.split(formatted, END, -1)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)  # what follows the last END is the last newline

    def turn(piece: Column) -> Column:
        mark, role, body = (F.regexp_extract(piece, TURN, i) for i in (1, 2, 3))
        plain = lambda x: F.when(mark == "\\", unescaped(x)).otherwise(x)
        read = F.struct(plain(role).alias("role"), plain(body).alias("text"), mark.alias("mark"), body.alias("body"))
        return F.when(F.regexp_like(piece, F.lit(TURN)) & ~F.contains(body, F.lit(OPEN)), read)

    return F.transform(turns, turn)


def _returns(formatted: Column, role: Column, text: Column) -> Column:
    """Whether a single rendered turn reads back as the turn it came from."""
    turns = parsed(formatted)
    return F.coalesce((F.size(turns) == 1) & (turns[0]["role"] == role) & (turns[0]["text"] == text), F.lit(False))


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, rendered, escaped``: each turn's text in the template."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("plain", rendered(F.col("role"), F.col("text"), False))
    rows = rows.withColumn("escaped", ~_returns(F.col("plain"), F.col("role"), F.col("text")))
    out = F.when(F.col("escaped"), rendered(F.col("role"), F.col("text"), True)).otherwise(F.col("plain"))
    return rows.select("conv_id", "turn", "role", "text", out.alias("rendered"), "escaped")


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row a conversation: ``conv_id, formatted, turns`` (as read back), ``loss_spans`` and ``round_trip``.

    ``loss_spans`` holds the start and end (exclusive, code points) of each assistant body in ``formatted``.
    """
    made = format_turns(turns)
    rows = made.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "rendered"))).alias("source"))
    rows = rows.withColumn("formatted", F.array_join("source.rendered", ""))
    rows = rows.withColumn("turns", parsed(F.col("formatted")))
    as_source = F.transform("source", lambda x: F.struct(x["role"], x["text"]))
    as_read = F.transform("turns", lambda x: F.struct(x["role"], x["text"]))
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start: int, end: int>>)").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        # a rendered turn without its end is header and body
        last = state["at"] + F.length(turn["rendered"]) - len(END) - 1
        body = F.length(F.element_at(parsed(turn["rendered"]), 1)["body"])
        span = F.array(F.struct((last - body).alias("start"), last.alias("end")))
        spans = F.when(turn["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((last + len(END) + 1).alias("at"), spans.alias("spans"))

    spans = F.aggregate("source", start, step, lambda s: s["spans"])
    return rows.select("conv_id", "formatted", "turns", spans.alias("loss_spans"), F.coalesce(as_read == as_source, F.lit(False)).alias("round_trip"))


def digests(conversations: DataFrame) -> DataFrame:
    """Figures of formatted conversations: the turns as read back, and the formatted text under ``loss_spans``, unescaped.

    A null in ``turns`` (broken grammar) counts as no turn; a span without an assistant turn is taken as it is.
    """
    said = F.filter("turns", lambda x: x["role"] == "assistant")

    def under(span: Column, i: Column) -> Column:
        text = F.substring(F.col("formatted"), span["start"] + 1, span["end"] - span["start"])
        return F.when(F.get(said, i)["mark"] == "\\", unescaped(text)).otherwise(text)

    loss = F.array_join(F.transform("loss_spans", under), "")
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return conversations.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "round_trip",
    )
