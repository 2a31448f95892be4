"""Substring dedup: windows of words that start in an earlier document are cut from later ones.

Method: a count-min prefilter and an exact second pass.

1. Every window of ``window`` words has an anchor, the least hash among its sub-windows of ``anchor`` words, so equal
   windows have equal anchors. Each task adds the distinct anchors of each document to a partial count-min sketch;
   the partial sketches are merged cell by cell. A cell's count is never below a window's own count.
2. Only windows whose anchor is estimated to occur in two documents or more are hashed to 128 bits and grouped
   exactly; a window is removed from every document but the one with the smallest doc_id. None is lost: a false
   hit costs a row in the exact pass and changes no result.

The sketch grows with the text, without a bound, so that the share of false hits stays the same. Up to ``broadcast_bits`` (2**28 cells
a line, 32 MB as bits) it is broadcast. A larger one is never gathered: its blocks are written, the anchors of each document are dealt
to the blocks of their cells and looked up there, and the anchors found go back to their documents. Both ways pass the same windows.

Cases: a null text is empty; empty texts and texts under ``window`` words lose nothing; a repeated row (equal doc_id) is not
"smaller" and so removes nothing from its twin; a row with a null doc_id keeps its words and removes nothing; other columns are
not looked at, so clashing names are harmless; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BITS, BLOCKS, bit_at, blocks_of, gathered_bits, longs, merged_bits, saved, slices
from .hashing import BASES, U, Words, distinct, mix, runs, sliding_min

LINES = 2
#: Cells of a line, as a power of two, up to which the sketch is broadcast: 32 MB of bits a line.
BROADCAST_BITS = 28
#: Bytes of text that are hashed at once, and anchors that a task holds before it counts them.
SLICE = 1 << 18
KEYS = 1 << 20
OUT = "doc_id long, n_words long, n_removed long, kept string"


def _anchors(words: Words, window: int, anchor: int):
    """(anchor hash, first word) for every window."""
    n = len(words.hash)
    at = np.arange(max(0, n - window + 1))
    if not len(at):
        return np.zeros(0, np.uint64), at
    sub = np.arange(n - anchor + 1)
    least = sliding_min(runs(words.hash, sub, sub + anchor, BASES[2]), window - anchor + 1)
    keep = words.first[words.text[at] + 1] - at >= window
    return least[keep], at[keep]


def _cells(key: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(key if i == 0 else mix(key + U(i))) >> U(64 - bits) for i in range(LINES)]


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text_col).cast("long")).alias("n")).first()["n"] or 0


def sketch_bits(total: int) -> int:
    """Cells of a line as a power of two, about ten for an anchor: from the bytes of all texts."""
    return max(BLOCK_BITS, int(total / 10).bit_length())


def build_sketch(docs: DataFrame, bits: int, window: int = 50, anchor: int = 26, text_col: str = "text") -> DataFrame:
    """The merged sketch, (line, block, bits): the cells that count two documents or more."""

    schema = pa.schema([("line", pa.int32()), ("block", pa.int64()), ("low", pa.binary()), ("n", pa.binary())])

    def counted(keys):
        key = np.concatenate(keys)
        for line, cells in enumerate(_cells(key, bits)):
            cell, n = np.unique(cells, return_counts=True)
            yield pa.RecordBatch.from_pylist(list(blocks_of(cell, n, line)), schema=schema)

    def partial(batches):
        keys, held = [], 0
        for batch in batches:
            for _, texts in slices(batch, "text", SLICE):
                words = Words(texts)
                key, at = _anchors(words, window, anchor)
                key, _ = distinct(words.text[at], key, len(texts))
                keys.append(key)
                held += len(key)
                if held >= KEYS:
                    yield from counted(keys)
                    keys, held = [], 0
        if held:
            yield from counted(keys)

    texts = docs.select(F.col(text_col).alias("text"))
    return merged_bits(texts.mapInArrow(partial, BLOCKS), 2)


def _by_bitmap(sketch, bits: int, window: int, anchor: int):
    """Estimates with the broadcast sketch the first words of the windows that are repeated."""

    def estimated(batch, start, words):
        key, at = _anchors(words, window, anchor)
        hit = np.ones(len(key), bool)
        for line, cells in enumerate(_cells(key, bits)):
            hit &= bit_at(sketch.value[line], cells) == 1
        return at[hit]

    return estimated


def _by_keys(window: int, anchor: int):
    """The same from the column ``keys``: the anchors of the row that the sketch estimates to be repeated."""

    def estimated(batch, start, words):
        key, at = _anchors(words, window, anchor)
        hit = np.zeros(len(key), bool)
        edge = np.searchsorted(words.text[at], np.arange(len(words.counts) + 1))
        for i, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
            wanted = batch.column(3)[start + i].values
            if wanted is not None and a < b:
                hit[a:b] = np.isin(key[a:b], wanted.to_numpy().view(np.uint64))
        return at[hit]

    return estimated


def _with_keys(docs: DataFrame, sketch: DataFrame, bits: int, window: int, anchor: int) -> DataFrame:
    """(doc_id, text, whole, keys): the rows with their anchors that the sketch estimates to be repeated, looked up block by block."""

    def ask(batches):
        for batch in batches:
            for start, texts in slices(batch, "text", SLICE):
                words = Words(texts)
                key, at = _anchors(words, window, anchor)
                key, n = distinct(words.text[at], key, len(texts))
                text = np.repeat(np.arange(len(texts)), n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(start + text)), batch.column(2).take(pa.array(start + text)), longs(key), *map(longs, _cells(key, bits))],
                    ["doc_id", "whole", "key", *(f"cell{i}" for i in range(LINES))],
                )

    found = docs.where("doc_id is not null").mapInArrow(ask, "doc_id long, whole long, key long, " + ", ".join(f"cell{i} long" for i in range(LINES)))
    for i in range(LINES):
        low = F.col(f"cell{i}").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
        byte = F.conv(F.hex(F.substring("bits", (F.shiftright(low, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        one = F.expr(f"shiftright(128, cast(cell{i} & 7 as int))")
        block = sketch.where(F.col("line") == i).select(F.col("block").alias("at"), "bits")
        found = found.join(block.hint("merge"), F.shiftright(f"cell{i}", BLOCK_BITS) == F.col("at")).where(byte.bitwiseAND(one) != 0).drop("at", "bits", f"cell{i}")
    found = found.groupBy("doc_id", "whole").agg(F.collect_set("key").alias("keys"))
    return saved(docs.join(found, ["doc_id", "whole"], "left").select("doc_id", "text", "whole", "keys"))


def _scan(docs: DataFrame, estimated, window: int, want: str) -> DataFrame:
    """want: "windows", those that may be repeated, (h1, h2, doc_id, whole, at)."""

    def run(batches):
        for batch in batches:
            ids, whole = batch.column(0), batch.column(2)
            for start, texts in slices(batch, "text", SLICE):
                words = Words(texts)
                at = estimated(batch, start, words)
                if len(at):
                    row = pa.array(start + words.text[at])
                    h1, h2 = (runs(words.hash, at, at + window, b) for b in BASES[:2])
                    yield pa.RecordBatch.from_arrays(
                        [longs(h1), pa.array((h2 >> U(32)).astype(np.uint32).view(np.int32)), ids.take(row), whole.take(row), pa.array((at - words.first[words.text[at]]).astype(np.int32))],
                        ["h1", "h2", "doc_id", "whole", "at"],
                    )

    schemas = {"windows": "h1 long, h2 int, doc_id long, whole long, at int"}
    return docs.mapInArrow(run, schemas[want])


def _later(found: DataFrame) -> DataFrame:
    """(doc_id, whole, at): the windows (h1, h2, doc_id, whole, at) that are also in a document with a smaller doc_id.

    Sorted by window and document, the first row of a window has its smallest doc_id; one row is carried to the next batch, so no window fills a task's memory."""

    def run(batches):
        last = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            h1, h2, doc = (batch.column(i).to_numpy() for i in range(3))
            new = np.ones(n, bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new[0] = last is None or last[:2] != (h1[0], h2[0])
            at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            first = np.where(at >= 0, doc[at], last[2] if last else 0)
            last = h1[-1], h2[-1], first[-1]
            yield batch.select(["doc_id", "whole", "at"]).filter(pa.array(doc > first))

    return found.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "doc_id").mapInArrow(run, "doc_id long, whole long, at int")


def substring_dedup(docs: DataFrame, window: int = 50, anchor: int = 26, id_col: str = "doc_id", text_col: str = "text", broadcast_bits: int = BROADCAST_BITS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each row of ``docs`` with the words that stay, joined by one space.

    ``whole`` hashes a row's text, so rows that share a doc_id stay apart. Two scans hash words: one for the sketch, one for the windows that may be repeated."""
    spark = docs.sparkSession
    total = text_bytes(docs, text_col)
    bits = sketch_bits(total)
    sketch = build_sketch(docs, bits, window, anchor, text_col)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("whole"))
    rows = plain
    if bits <= broadcast_bits:
        estimated = _by_bitmap(spark.sparkContext.broadcast(gathered_bits(sketch, LINES, bits)), bits, window, anchor)
    else:
        plain, estimated = _with_keys(plain, saved(sketch), bits, window, anchor), _by_keys(window, anchor)
    found = _scan(plain.where("doc_id is not null"), estimated, window, "windows")
    later = _later(found)
    cut = later.groupBy("doc_id", "whole").agg(F.collect_list("at").alias("cut"))

    def kept(batches):
        for batch in batches:
            n, removed, text_out = [], [], []
            for text, cuts in zip(batch.column(1), batch.column(2)):
                words = (text.as_py() or "").encode().split()
                starts = cuts.as_py()
                n.append(len(words))
                if starts:
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = np.asarray(starts)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed.append(int(gone.sum()))
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                else:
                    removed.append(0)
                text_out.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(text_out, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return rows.join(cut, ["doc_id", "whole"], "left").select("doc_id", "text", "cut").mapInArrow(kept, OUT)
