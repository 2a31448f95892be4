"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may differ by k = floor(error_rate * m) edits. Cut into k + 1 pieces, one of them must occur unchanged
wherever the item does; the pieces of all items are found by one Aho-Corasick scan of each text, and each hit's neighbourhood is
verified by Myers' bit-parallel distance (J. ACM, 1999). Texts and items are compared in lower case with runs of white space as one space.

A benchmark of up to ``block_chars`` characters is broadcast, and each worker builds its automaton. A larger one stays a table: its pieces are
hashed, the hashes make a Bloom filter, one scan of the documents writes those with windows that pass it (they are few, as long as the pieces are
rare in the documents), and joins bring windows, pieces, items and the text around each hit together. No step holds the benchmark in one place. The filter has
48 bits a piece and stops growing at ``FILTER_BITS``, 96 MB: beyond 17 million pieces more windows pass; all are judged by the join. Equal texts are judged once.
Both ways give each item's least distance and, of equally good places, the one that ends first.

Cases: a null or empty text or item matches nothing; equal items or rows are each reported; a null id stays null; other columns are
not looked at; an empty table gives an empty result. An item shorter than ``1 / error_rate`` characters must occur unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BITS, BLOCKS, bit_at, blocks_of, free_name, gathered_bits, longs, merged_bits, saved
from .hashing import BASES, U, mix, runs

#: Lines of the filter, and the cells of a line, as a power of two, beyond which it does not grow.
LINES = 6
FILTER_BITS = 27
#: Characters that are hashed at once, and pieces behind one partial filter.
SLICE = 1 << 18
PIECES = 1 << 20
#: Texts of 40 bytes of key each that may be broadcast (some tens of MB with their hash table).
FEW_TEXTS = 200_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


class Pattern:
    """Myers' scan for one item."""

    def __init__(self, item: str):
        self.m = len(item)
        self.at: dict[str, int] = {}
        for i, c in enumerate(item):
            self.at[c] = self.at.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """The least edit distance of the item to a substring of ``text``, and that one's end."""
        full, high = (1 << self.m) - 1, 1 << (self.m - 1)
        up, down, score, found = full, 0, self.m, (self.m, 0)
        for j, c in enumerate(text):
            eq = self.at.get(c, 0)
            v = eq | down
            h = (((eq & up) + up) ^ up) | eq
            plus = down | (full & ~(h | up))
            minus = up & h
            if plus & high:
                score += 1
            elif minus & high:
                score -= 1
            plus, minus = plus << 1 & full, minus << 1 & full
            up = minus | (full & ~(v | plus))
            down = plus & v
            if score < found[0]:
                found = (score, j + 1)
        return found


class Item:
    """One item: its budget of k edits, its pieces and the verification of places in a text."""

    def __init__(self, text: str, error_rate: float):
        self.text, self.k = text, int(error_rate * len(text))
        self.forward, self.reverse = Pattern(text), Pattern(text[::-1])

    def pieces(self) -> list[tuple[int, int]]:
        """(start, end) of the k + 1 pieces."""
        m, n = len(self.text), self.k + 1
        return [(m * i // n, m * (i + 1) // n) for i in range(n)]

    def window(self, bucket: int) -> tuple[int, int]:
        """What must be looked at for hits that lay the item's start into ``bucket``, of k + 1 characters."""
        start = bucket * (self.k + 1)
        return max(0, start - self.k), start + 2 * self.k + len(self.text)

    def place(self, part: str, low: int) -> tuple[int, int, int] | None:
        """(distance, end, start) of the best place in ``part``, which begins at ``low``, if within the budget."""
        distance, end = self.forward.best(part)
        if distance > self.k:
            return None
        _, back = self.reverse.best(part[max(0, end - len(self.text) - self.k) : end][::-1])
        return distance, low + end, low + end - back


class Finder:
    """Finds items in texts. items: (item id, text)."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.items, self.automaton = [], ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, raw in items:
            text = normal(raw)
            if not text:
                continue
            item = Item(text, error_rate)
            for a, b in item.pieces():
                pieces.setdefault(text[a:b], []).append((len(self.items), b - 1))
            self.items.append((item_id, item))
        for piece, where in pieces.items():
            self.automaton.add_word(piece, where)
        if pieces:
            self.automaton.make_automaton()

    def find(self, raw: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of each item's best place in the normal text; of equally good ones the one that ends first."""
        text, hits = normal(raw), set()
        if not text or not self.items:
            return []
        for end, where in self.automaton.iter(text):
            for n, last in where:
                hits.add((n, (end - last) // (self.items[n][1].k + 1)))
        best: dict[int, tuple[int, int, int]] = {}
        for n, bucket in sorted(hits):
            if n in best and best[n][0] == 0:
                continue
            low, high = self.items[n][1].window(bucket)
            place = self.items[n][1].place(text[low:high], low)
            if place and (n not in best or place < best[n]):
                best[n] = place
        return [(self.items[n][0], distance, start, end) for n, (distance, end, start) in sorted(best.items())]


def _few(items: DataFrame, block_chars: int) -> list | None:
    """The items (id, text) if they have ``block_chars`` characters at most."""
    total = items.agg(F.sum(F.length("text").cast("long")).alias("n")).first()["n"] or 0
    return [(r["id"], r["text"]) for r in items.where("text is not null").collect()] if total <= block_chars else None


def _probe(n: int) -> int:
    """The length that stands for a piece of n characters: the largest of 1, 2, 3, 4, 6, 8, 12, ... that fits."""
    p = 1 << n.bit_length() - 1
    return p + p // 2 if p + p // 2 <= n else p


def _symbols(text: str) -> np.ndarray:
    return mix((np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + U(1)) * U(0x9E3779B97F4A7C15))


def _cell(key: np.ndarray, line: int, bits: int) -> np.ndarray:
    return mix(key + U(line)) >> U(64 - bits)


def _item_tables(items: DataFrame, error_rate: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, item) for each item, (item, item_text) and (hash, length, item, at, m, k) for each piece; ``item`` is a digest of the normal text."""

    def clean(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([normal(t.as_py()) for t in batch.column(1)], pa.string())], ["id", "item_text"])

    def cut(batches):
        schema = pa.schema([("hash", pa.int64()), ("length", pa.int32()), ("item", pa.string()), ("at", pa.int64()), ("m", pa.int64()), ("k", pa.int64())])
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                item = Item(text, error_rate)
                start = np.array([a for a, _ in item.pieces()])
                length = np.array([_probe(b - a) for a, b in item.pieces()])
                n = len(start)
                columns = [longs(runs(_symbols(text), start, start + length, BASES[0])), pa.array(length, pa.int32()), pa.array([key] * n), pa.array(start, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([len(text)] * n, pa.int64()), pa.array([item.k] * n, pa.int64())], schema=schema)

    known = items.where("text is not null").mapInArrow(clean, "id long, item_text string").where("item_text != ''")
    known = saved(known.select("id", F.md5("item_text").alias("item"), "item_text"))
    texts = saved(known.select("item", "item_text").dropDuplicates(["item"]))
    pieces = saved(texts.mapInArrow(cut, "hash long, length int, item string, at long, m long, k long"))
    return known.select("id", "item"), texts, pieces


def _filter(pieces: DataFrame, n: int, bits: int) -> np.ndarray:
    """The Bloom filter of the pieces' hashes."""

    def partial(batches):
        schema = pa.schema([("line", pa.int32()), ("block", pa.int64()), ("low", pa.binary()), ("n", pa.binary())])
        held, size = [], 0

        def counted():
            key = np.concatenate(held)
            for line in range(LINES):
                cell, times = np.unique(_cell(key, line, bits), return_counts=True)
                yield pa.RecordBatch.from_pylist(list(blocks_of(cell, times, line)), schema=schema)

        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            size += len(held[-1])
            if size >= PIECES:
                yield from counted()
                held, size = [], 0
        if size:
            yield from counted()

    merged = merged_bits(pieces.select("hash").mapInArrow(partial, BLOCKS), 1)
    return gathered_bits(merged, LINES, bits)


def _suspects(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """(doc_id, key, normal, at, hash): the texts with windows that pass the filter, and these; ``key`` is a digest of the raw text."""
    spark = docs.sparkSession
    n = pieces.count()
    bits = min(FILTER_BITS, max(BLOCK_BITS, (8 * n).bit_length()))
    lengths = sorted(r["length"] for r in pieces.select("length").distinct().collect())
    shared = spark.sparkContext.broadcast(_filter(pieces, n, bits))

    def passing(texts):
        """(text number, place in it, hash) of the windows that pass, for texts joined by line feeds, which no normal text has."""
        symbols = _symbols("\n".join(texts))
        first = np.cumsum([0] + [len(t) + 1 for t in texts])
        found = []
        for length in lengths:
            at = np.arange(max(0, len(symbols) - length + 1))
            key = runs(symbols, at, at + length, BASES[0])
            for line in range(LINES):
                hit = bit_at(shared.value[line], _cell(key, line, bits)) == 1
                at, key = at[hit], key[hit]
            text = np.searchsorted(first, at, "right") - 1
            found.append((text, at - first[text], key))
        return [np.concatenate(x) for x in zip(*found)]

    def scan(batches):
        for batch in batches:
            clean = [normal(t.as_py()) for t in batch.column(2)]
            i = 0
            while i < len(clean):
                j, size = i, 0
                while j < len(clean) and (j == i or size + len(clean[j]) <= SLICE):
                    size += len(clean[j]) + 1
                    j += 1
                text, at, key = passing(clean[i:j])
                order = np.argsort(text, kind="stable")
                owners, begin = np.unique(text[order], return_index=True)
                at, key = (np.split(x[order], begin[1:]) for x in (at, key.view(np.int64)))
                rows = pa.array(owners + i, pa.int64())
                if len(owners):
                    lists = [pa.array(x, pa.list_(pa.int64())) for x in (at, key)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array([clean[i + o] for o in owners], pa.string()), *lists], ["doc_id", "key", "normal", "at", "hash"])
                i = j

    rows = docs.where("text is not null").select("doc_id", F.md5("text").alias("key"), "text")
    out = saved(rows.mapInArrow(scan, "doc_id long, key string, normal string, at array<long>, hash array<long>"))
    shared.destroy()
    return out


def _joined(docs: DataFrame, items: DataFrame, error_rate: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, item, distance, start, end) for each text and item in it, (id, item) for each item and (doc_id, key) for each row that may have one. docs: (doc_id, text), items: (id, text)."""
    known, texts, pieces = _item_tables(items, error_rate)
    suspects = _suspects(docs, pieces)
    once = saved(suspects.dropDuplicates(["key"]))
    windows = once.select("key", F.explode(F.arrays_zip("at", "hash")).alias("w")).select("key", F.col("w.at").alias("place"), F.col("w.hash").alias("hash"))
    hits = windows.join(pieces, "hash").withColumn("from", F.col("place") - F.col("at"))
    hits = hits.select("key", "item", "m", "k", F.expr("(from - pmod(from, k + 1)) div (k + 1)").alias("bucket")).distinct()
    low, high = "greatest(0L, bucket * (k + 1) - k)", "(bucket * (k + 1) + 2 * k + m)"
    parts = saved(hits).join(once.select("key", "normal"), "key").selectExpr("key", "item", f"{low} as low", f"substring(normal, int({low} + 1), int({high} - {low})) as part")

    def verify(batches):
        name = item = None
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for key, digest, low, part, text in zip(*(c.to_pylist() for c in batch.columns)):
                if digest != name:
                    name, item = digest, Item(text, error_rate)
                place = item.place(part, low)
                if place:
                    for c, v in zip(out, (key, digest, *place)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["key", "item", "distance", "end", "start"])

    parts = parts.join(texts, "item").select("key", "item", "low", "part", "item_text")
    places = parts.mapInArrow(verify, "key string, item string, distance int, end long, start long")
    best = places.groupBy("key", "item").agg(F.min(F.struct("distance", "end", "start")).alias("best"))
    best = saved(best.select("key", "item", "best.distance", "best.start", "best.end"))
    return best, known, suspects.select("doc_id", "key")


def leaks(docs: DataFrame, items: DataFrame, error_rate: float = 0.05, block_chars: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, start, end): each document's benchmark items, with the best place of each in the normal text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_id_col).cast("long").alias("id"), F.col(item_text_col).alias("text"))
    few = _few(items, block_chars)
    if few is None:
        best, known, ids = _joined(rows, items, error_rate)
        return ids.join(best, "key").join(known, "item").select("doc_id", F.col("id").alias("item_id"), "distance", "start", "end")
    shared = docs.sparkSession.sparkContext.broadcast(few)

    def scan(batches):
        finder = Finder(shared.value, error_rate)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                for hit in finder.find(text.as_py()):
                    for c, v in zip(cols, (doc_id.as_py(), *hit)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "distance", "start", "end"])

    return rows.mapInArrow(scan, "doc_id long, item_id long, distance int, start long, end long")


def decontaminated(docs: DataFrame, items: DataFrame, error_rate: float = 0.05, block_chars: int = 2_000_000, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item. Rows keep all their columns."""
    names = docs.columns
    items = items.select(F.col(item_id_col).cast("long").alias("id"), F.col(item_text_col).alias("text"))
    few = _few(items, block_chars)
    if few is None:
        best, _, _ = _joined(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text")), items, error_rate)
        key = free_name(names, "key")
        leaky = best.select(F.col("key").alias(key)).distinct()
        if best.count() <= FEW_TEXTS:  # else both sides are dealt by the digest
            leaky = F.broadcast(leaky)
        return docs.withColumn(key, F.md5(text_col)).join(leaky, key, "left_anti").select(names)
    shared = docs.sparkSession.sparkContext.broadcast(few)

    def scan(batches):
        finder = Finder(shared.value, error_rate)
        for batch in batches:
            clean = [not finder.find(x.as_py()) for x in batch.column(names.index(text_col))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
