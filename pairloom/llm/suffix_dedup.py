"""Repeated passages by column-wise construction of a collection's suffix order and common prefixes.

A byte is removed if a string of ``length`` bytes that covers it starts anywhere else too. Texts are judged as they came.

Where strings can meet. Each string has an anchor: the place, among its first ``length - gram + 1`` ones, where the hash of the next
``gram`` bytes is least (the first, on ties). That depends on the string alone, so equal strings have equal anchors at equal
offsets. A document's strings with one anchor form a run; its bytes are a segment. Two strings can be equal only if their segments have the same
anchor gram, and they stand at the same distance from it. Segments that agree as a whole settle each other by their hash. A
segment whose gram occurs nowhere else has no repeat. What is left, segments of one gram with different bytes, is the
collection to sort.

Column-wise construction. The segments are laid out with their anchors in one column and written, a column after the other, to an
external file that is read backwards: each round inserts one symbol of every segment in front of what is sorted already.
A stable sort by the new symbol turns the order of the suffixes one column to the right into the order of these; the symbols in
sorted order are the column's part of the collection's Burrows-Wheeler transform. Common prefixes are updated along: neighbours
with the same symbol have one more than the least of the old common prefixes between them, others have none. Only
suffixes at the same distance from the anchor are ever compared, so a round is linear in the number of segments, and all
rounds take (segments x columns), whatever the length of the documents. A suffix whose common prefix with a neighbour reaches
``length`` is a repeated string.

Scale: segments are dealt by gram. A gram with more than ``PIECE`` different segments is dealt in pieces; each piece sorts its own and
yields one hash for each different string, and equal hashes across pieces settle the rest. Intervals are merged per document.

Defined results: null text is empty text. A text shorter than ``length`` loses nothing. Rows that agree in id and text are occurrences
of their own: both lose all their strings. An empty table gives no row. Other columns are not looked at.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.bpe_chunks import slices
from pairloom.llm.common import whole_text
from pairloom.llm.dart_minhash import row_key
from pairloom.llm.shingles import mixed
from pairloom.session import materialize

LENGTH = 400
#: Different segments of one gram that are sorted in one piece, and segments that are sorted at once.
PIECE = 20_000
BATCH = 32_768
_PLACE_BITS = 28
_NONE = 255  # never a byte of UTF-8
_BASE = 0x9E3779B97F4A7C15


def gram_of(length: int) -> int:
    return max(1, length * 4 // 25)


class Sums:
    """Hashes of any byte range by prefix sums."""

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            up = np.cumprod(np.full(len(data) + 1, _BASE, np.uint64))
            self.down = np.cumprod(np.full(len(data) + 1, pow(_BASE, -1, 1 << 64), np.uint64))
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def runs_of(texts: list[bytes], length: int) -> dict[str, np.ndarray]:
    """Each text's runs of string starts with one anchor: ``text, s0, s1`` (last start), ``b`` (anchor), ``gram, seg``."""
    gram = gram_of(length)
    window = length - gram + 1
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    n = len(data)
    text = np.repeat(np.arange(len(texts)), np.maximum(sizes - length + 1, 0))
    if not len(text):
        return {k: np.empty(0, np.int64) for k in ("text", "s0", "s1", "b", "gram", "seg")}
    counts = np.maximum(sizes - length + 1, 0)
    s = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + begin[text]
    sums = Sums(data)
    at = np.arange(n - gram + 1)
    key = sums.of(at, at + gram)
    place = np.uint64((1 << _PLACE_BITS) - 1)
    rank = (key & ~place) | at.astype(np.uint64)
    # least of each window: of the suffix of its first block and the prefix of its second one
    padded = np.full(-(-len(rank) // window) * window + window, np.iinfo(np.uint64).max)
    padded[: len(rank)] = rank
    blocks = padded.reshape(-1, window)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    b = (np.minimum(suffix[s], prefix[s + window - 1]) & place).astype(np.int64)
    new = np.ones(len(s), bool)
    new[1:] = (b[1:] != b[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(s)])) - 1
    s0, s1, b, text = s[first], s[last], b[first], text[first]
    with np.errstate(over="ignore"):
        seg = mixed(sums.of(s0, s1 + length) + (b - s0).astype(np.uint64) * np.uint64(1 << 32) + (s1 - s0).astype(np.uint64))
    own = begin[text]
    return {"text": text, "s0": s0 - own, "s1": s1 - own, "b": b - own, "gram": key[b].view(np.int64), "seg": seg.view(np.int64)}


def sort_columns(segments: list[bytes], left: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per column of string starts: its distance to the anchor, the order of the segments' suffixes there, and common prefixes.

    ``left``: bytes of each segment before its anchor. The common prefix at i is that of places i - 1 and i of the order.
    """
    window, m = length - gram_of(length) + 1, len(segments)
    width = window - 1 + length
    rows = np.full((m, width), _NONE, np.uint8)
    for i, x in enumerate(segments):
        at = window - 1 - left[i]
        rows[i, at : at + len(x)] = np.frombuffer(x, np.uint8)
    with tempfile.TemporaryFile() as file:
        file.write(np.ascontiguousarray(rows.T))
        del rows
        order, common = np.arange(m), np.zeros(m + 1, np.int64)
        for column in range(width - 1, -1, -1):
            file.seek(column * m)
            symbol = np.frombuffer(file.read(m), np.uint8)[order]
            moved = np.argsort(symbol, kind="stable")
            symbol = symbol[moved]
            same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] != _NONE)) + 1
            low, high = moved[same - 1] + 1, moved[same]
            least = common[high]
            wide = np.flatnonzero(low < high)
            if len(wide):
                edges = np.stack([low[wide], high[wide] + 1], 1).ravel()
                least[wide] = np.minimum.reduceat(common, edges)[::2]
            common = np.zeros(m + 1, np.int64)
            common[same] = np.minimum(least + 1, length)
            order = order[moved]
            if column < window:
                yield window - 1 - column, order, common[:m]


def _true_runs(flags: np.ndarray) -> np.ndarray:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return edges.reshape(-1, 2)


_FOUND = pa.schema([("key", pa.binary()), ("start", pa.int64()), ("end", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("lone", pa.bool_())])


def _sorted_segments(table: pa.Table, length: int, piece: int) -> pa.RecordBatch:
    """Intervals of repeated strings among the segments of a batch, and a hash a string for grams in several pieces."""
    row = table["row"].to_numpy()
    once = np.sort(np.unique(row, return_index=True)[1])
    table = table.take(pa.array(once))
    keys, segments = table["key"].to_pylist(), table["bytes"].to_pylist()
    s0, b, n, c = (table[x].to_numpy() for x in ("s0", "b", "n", "c"))
    m = len(keys)
    hit = np.zeros((m, length - gram_of(length) + 1), bool)
    hot = c > piece
    sums = Sums(np.frombuffer(b"".join(segments), np.uint8)) if hot.any() else None
    begin = np.cumsum([len(x) for x in segments]) - np.array([len(x) for x in segments])
    out: dict[str, list] = {x: [] for x in _FOUND.names}
    for distance, order, common in sort_columns(segments, b - s0, length):
        again = common >= length
        hit[order[again], distance] = True
        hit[order[np.flatnonzero(again) - 1], distance] = True
        if sums is not None:
            heads = order[~again]  # one of each class of equal strings
            off = b[heads] - distance - s0[heads]
            inside = hot[heads] & (off >= 0) & (off + length <= np.array([len(segments[i]) for i in heads]))
            heads, off = heads[inside], off[inside]
            at = begin[heads] + off
            half = length // 2
            out["key"] += [keys[i] for i in heads]
            out["start"] += (s0[heads] + off).tolist()
            out["h1"] += (sums.of(at, at + half) ^ (sums.of(at + half, at + length) * np.uint64(3))).view(np.int64).tolist()
            out["h2"] += sums.of(at, at + length).view(np.int64).tolist()
            out["lone"] += (~hit[heads, distance] & (n[heads] == 1)).tolist()
    out["end"] = [x + length for x in out["start"]]
    for i in np.flatnonzero((n == 1) & hit.any(axis=1)):
        for x, y in _true_runs(hit[i]):  # distances x to y - 1
            out["key"].append(keys[i])
            out["start"].append(int(b[i] - y + 1))
            out["end"].append(int(b[i] - x + length))
            for name in ("h1", "h2", "lone"):
                out[name].append(None)
    return pa.RecordBatch.from_pydict(out, schema=_FOUND)


def _sort_partition(length: int, piece: int, batch_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(map(len, held)) >= batch_rows:
                table = pa.concat_tables(held).combine_chunks()
                gram, salt = table["gram"].to_numpy(), table["salt"].to_numpy()
                cuts = np.flatnonzero((gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])) + 1
                while len(cuts) and cuts[-1] >= batch_rows // 2:
                    cut = cuts[cuts >= batch_rows // 2]
                    cut = int(cut[cut <= batch_rows][-1]) if (cut <= batch_rows).any() else int(cut[0])
                    yield _sorted_segments(table.slice(0, cut).combine_chunks(), length, piece)
                    table, cuts = table.slice(cut), cuts - cut
                    cuts = cuts[cuts > 0]
                held = [table]
        if held and sum(map(len, held)):
            yield _sorted_segments(pa.concat_tables(held).combine_chunks(), length, piece)

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, piece: int = PIECE, batch_rows: int = BATCH) -> DataFrame:
    """``key, spans`` for each row key with repeated strings: intervals of bytes, not merged, end exclusive."""
    keyed = docs.select(row_key(id_col, text_col).alias("key"), whole_text(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 1, 1 << 20):
                r = runs_of(texts, length)
                columns = [part.column(0).take(pa.array(r["text"])), *[pa.array(r[x].astype(np.int32)) for x in ("s0", "s1", "b")], pa.array(r["gram"]), pa.array(r["seg"])]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "s0", "s1", "b", "gram", "seg"])

    runs = keyed.where(F.octet_length("text") >= length).mapInArrow(scan, "key binary, s0 int, s1 int, b int, gram bigint, seg bigint")
    runs = materialize(runs.withColumn("row", F.monotonically_increasing_id()), "suffix_runs")
    segs = runs.groupBy("gram", "seg").agg(F.count("*").alias("n"), F.min("row").alias("row"))
    grams = segs.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1")
    segs = segs.join(grams, "gram", "left").where("n > 1 OR c IS NOT NULL")
    segs = materialize(segs, "suffix_segments")
    whole = runs.join(segs.where("n > 1").select("gram", "seg"), ["gram", "seg"]).select("key", F.col("s0").cast("long").alias("start"), (F.col("s1") + length).cast("long").alias("end"))
    # bytes of the segments that have to be sorted, one row for each different segment
    wanted = runs.join(segs.where("c IS NOT NULL").select("row", "n", "c"), "row")
    wanted = wanted.groupBy("key").agg(F.collect_list(F.struct("row", "gram", "s0", "s1", "b", "n", "c")).alias("wanted"))
    pieces = keyed.join(wanted, "key").select("key", F.col("text").cast("binary").alias("text"), F.explode("wanted").alias("w")).select("key", "text", "w.*")
    salt = F.pmod(F.xxhash64("row"), F.ceil(F.col("c") / piece)).cast("int")
    pieces = pieces.select("key", "row", "gram", salt.alias("salt"), "s0", "b", "n", "c", F.substring("text", F.col("s0") + 1, F.col("s1") - F.col("s0") + length).alias("bytes"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.repartition(partitions, "gram", "salt").sortWithinPartitions("gram", "salt")
    found = materialize(pieces.mapInArrow(_sort_partition(length, piece, batch_rows), "key binary, start bigint, end bigint, h1 bigint, h2 bigint, lone boolean"), "suffix_found")
    sorted_ = found.where("h1 IS NULL").select("key", "start", "end")
    strings = found.where("h1 IS NOT NULL")
    several = strings.groupBy("h1", "h2").agg(F.count("*").alias("pieces")).where("pieces > 1").select("h1", "h2")
    across = strings.where("lone").join(several, ["h1", "h2"]).select("key", "start", "end")
    spans = whole.unionByName(sorted_).unionByName(across).distinct()
    return spans.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, piece: int = PIECE, batch_rows: int = BATCH) -> DataFrame:
    """One row a document: ``id, n_bytes, removed`` (maximal removed byte ranges) and ``kept`` (the bytes that are left)."""
    spans = materialize(repeated_spans(docs, id_col, text_col, length, piece, batch_rows), "suffix_spans")
    keyed = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    rows = keyed.join(spans, "key", "left").select("id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 1):
                removed, kept = [], []
                for text, spans in zip(texts, part.column(2).to_pylist(), strict=True):
                    own = merged([(x["start"], x["end"]) for x in spans or []])
                    edges = [0, *[x for span in own for x in span], len(text)]
                    kept.append(b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)) if own else text)
                    removed.append([{"start": i, "end": j} for i, j in own])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], names=["id", "n_bytes", "removed", "kept"])

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"id {id_type}, n_bytes bigint, removed array<struct<start: bigint, end: bigint>>, kept binary")
