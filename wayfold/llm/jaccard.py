"""N-gram Jaccard join: all links between documents whose word-shingle sets are similar enough, and their components.

1. Equal sets are one class, so copies never meet each other; a class is known by 128 bits of its sorted set.
2. Shingles are ordered, the rarest first. The order starts with a part of all shingles, chosen by hash (two and a half times the prefix's share: a quarter for a similarity of 0.9, half for 0.8), whose frequencies
   (of classes) are counted truly: postings are packed by blocks of shingles, dealt once, counted, and sent back packed by blocks of classes.
   The other shingles follow, and those of cells of a fixed table that more than a two-hundredth of all documents fall into (so no block holds more of one shingle).
   Any common order gives all links, a true-to-frequency one gives short lists.
   Only the prefix of ``n - ceil(t * n) + 1`` shingles is joined: two linked sets share one of them. Prefix shingles of one class alone are
   dropped before anything is dealt by shingle, and with them most classes.
3. The classes that share a prefix shingle are compared under the length filter, the positional filter and, instead of
   the suffix filter, one on parity signatures (each set has 512 bits, the parities of its hash classes; sets that differ in d shingles differ in d bits at most). Lists are cut into chunks, so a hot shingle is many groups.
   First round: in each chunk a spanning forest of the pairs that pass is kept, not all pairs; each is verified once against
   the whole sets. Second round: of lists whose classes are not all in one component yet, all passing pairs across components
   (of all chunk pairs) are verified. So every link either is verified or lies inside a component that verified links span.
4. Components by large-star and small-star rounds over tables.

Cases: a null or wordless text has the empty set and is linked with nothing; under ``shingle`` words the whole sequence is
the one shingle; rows with equal sets are linked; rows with a null doc_id are returned with a null component and link nothing;
a doc_id on several rows gives one result row for each; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected
from .common import bit_at, blocks_of, BLOCKS, gathered_bits, lists, longs, merged_bits, saved, slices
from .hashing import BASES, U, Words, distinct, mix, runs

FREQUENCY_BITS = 19
PARITIES = 512
CHUNK = 2048
CANDIDATE_BITS = 27
#: Of the shingles, so many times the prefix's share are counted truly.
COUNTED = 2.5
#: Postings of a block of shingles and classes of a group, as powers of two; shingles that a task holds before it packs them.
POSTINGS_BITS = 20
CLASSES_BITS = 14
FLUSH = 1 << 21
#: So many documents may share a shingle in any case; beyond, only a two-hundredth of all may, or its frequency is not counted.
HOT = 100_000


def shingle_sets(texts: list[bytes], k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after the other, and how many each has."""
    words = Words(texts, lower)
    h, at = words.windows(k, BASES[1])
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    owner = np.concatenate([words.text[at], short])
    return distinct(owner, np.concatenate([h, words.whole(BASES[1])[short]]), len(texts))


def _class_keys(values: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """16 bytes for each set; None for an empty one."""
    first = np.concatenate([[0], np.cumsum(counts)])
    a, b = (runs(mix(values + U(s)), first[:-1], first[1:], base) for s, base in ((1, BASES[0]), (2, BASES[2])))
    raw = np.stack([a, b], 1).astype(">u8").tobytes()
    return [raw[16 * i : 16 * i + 16] if c else None for i, c in enumerate(counts)]


def _prefix_length(n, num: int, den: int):
    return n - -(-n * num // den) + 1


def _overlap(n, num: int, den: int):
    """The least overlap of two sets of n elements together: ceil(t / (1 + t) * n)."""
    return -(-n * num // (num + den))


def _first_half(keys: list[bytes | None]) -> np.ndarray:
    return np.frombuffer(b"".join((x or b"\0" * 8)[:8] for x in keys), ">u8").astype(np.uint64)


def document_sets(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds: a document's (doc_id, n, cls, ref: half of cls, sig, h: a hash of the text), and a task's counts of shingle cells (block, counts)."""

    def scan(batches):
        table = np.zeros(1 << FREQUENCY_BITS, np.int64)
        kinds = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.binary()), ("ref", pa.int64()), ("sig", pa.binary()), ("h", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])
        for batch in batches:
            for start, texts in slices(batch, "text"):
                values, counts = shingle_sets(texts, k)
                table += np.bincount((values >> U(64 - FREQUENCY_BITS)).astype(np.int64), minlength=len(table))
                m = len(texts)
                keys = _class_keys(values, counts)
                owner = np.repeat(np.arange(m), counts)
                odd = np.bincount(owner * PARITIES + (mix(values) % U(PARITIES)).astype(np.int64), minlength=m * PARITIES) & 1
                sig = np.packbits(odd.astype(np.uint8)).tobytes()
                sig = pa.array([sig[PARITIES // 8 * i : PARITIES // 8 * (i + 1)] for i in range(m)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, m), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), longs(_first_half(keys)), sig, batch.column(2).slice(start, m), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], schema=kinds)
        step = 1 << 13
        used = [i for i in range(len(table) // step) if table[i * step : (i + 1) * step].any()]
        m = len(used)
        cells = pa.array([table[i * step : (i + 1) * step].astype("<u4").tobytes() for i in used], pa.binary())
        yield pa.RecordBatch.from_arrays([*(pa.nulls(m, f.type) for f in list(kinds)[:6]), pa.array(used, pa.int32()), cells], schema=kinds)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    return rows.mapInArrow(scan, "doc_id long, n long, cls binary, ref long, sig binary, h long, block int, counts binary")


def _frequencies(rows: DataFrame) -> np.ndarray:
    """The table of counts, of a fixed size, on the driver."""

    def add(key, pdf):
        import pandas as pd

        total = sum(np.frombuffer(x, "<u4").astype(np.int64) for x in pdf["counts"])
        return pd.DataFrame({"block": [key[0]], "counts": [total.astype("<i8").tobytes()]})

    out = np.zeros(1 << FREQUENCY_BITS, np.int64)
    for r in rows.where("block is not null").select("block", "counts").groupBy("block").applyInPandas(add, "block int, counts binary").toLocalIterator():
        got = np.frombuffer(r["counts"], "<i8")
        out[r["block"] * len(got) : (r["block"] + 1) * len(got)] = got
    return out


def _edges(sorted_keys: np.ndarray) -> np.ndarray:
    """The first places of the runs of equal keys, and the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])


def _raw(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def prefix_lists(docs: DataFrame, frequency: np.ndarray, total: int, rows: int, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """(ref, n, pos, token): of the classes that have any, the prefix shingles that other classes have too, with their places in the order.

    frequency: the fixed table's counts; total, rows: shingles and documents of the corpus. Three packed forms are dealt, by blocks of
    shingles (counted there), and then by groups of classes (ordered and cut there); extras, whose frequency is not counted, go to the second alone.
    A shingle is known by its block and 32 bits; if two fall together, a pair more is compared, and places can only come out smaller, which loses nothing."""
    spark = docs.sparkSession
    sample = max(1, int(den / (COUNTED * (den - num)))) if den > num else 4
    blocks = max(1, total // sample >> POSTINGS_BITS)
    groups = max(1, rows >> CLASSES_BITS)
    often = spark.sparkContext.broadcast(np.packbits(frequency > max(HOT, rows // 200)))
    order = spark.sparkContext.broadcast(frequency)

    packed = pa.schema([("block", pa.int64()), ("refs", pa.binary()), ("sizes", pa.binary()), ("cnt", pa.binary()), ("low", pa.binary())])

    def postings(batches):
        seen, held, size = set(), [], 0
        for batch in batches:
            for _, texts in slices(batch, "text"):
                values, counts = shingle_sets(texts, k)
                keys = _class_keys(values, counts)
                new = np.zeros(len(texts), bool)
                for i, key in enumerate(keys):
                    if key is not None and key not in seen:
                        seen.add(key)
                        new[i] = True
                values = values[np.repeat(new, counts)]
                held.append((values, counts[new], _first_half(keys)[new]))
                size += len(values)
                if size >= FLUSH:
                    yield flushed(held)
                    seen, held, size = set(), [], 0
        if size:
            yield flushed(held)

    def flushed(held):
        values, n, ref = (np.concatenate([x[i] for x in held]) for i in range(3))
        owner = np.repeat(np.arange(len(n)), n)
        cell = values >> U(64 - FREQUENCY_BITS)
        counted = (values % U(sample) == 0) & (bit_at(often.value, cell) == 0)
        missing = np.maximum(0, np.minimum(n, _prefix_length(n, num, den)) - np.bincount(owner[counted], minlength=len(n)))
        out = []
        # by blocks; a stable sort keeps the documents' order inside one
        key = values[counted] // U(sample)
        block, who = (key % U(blocks)).astype(np.int64), owner[counted]
        at = np.argsort(block, kind="stable")
        block, who, low = block[at], who[at], ((key[at] // U(blocks)) & U(0xFFFFFFFF)).astype("<u4")
        for a, b in zip((e := _edges(block))[:-1], e[1:]):
            run = _edges(who[a:b])
            some = who[a:b][run[:-1]]
            out.append((int(block[a]), ref[some].astype("<u8").tobytes(), n[some].astype("<u4").tobytes(), np.diff(run).astype("<u4").tobytes(), low[a:b].tobytes()))
        # extras: the first of the other shingles
        if missing.any():
            short = (missing > 0)[owner] & ~counted
            value, who = values[short], owner[short]
            at = np.lexsort((value, order.value[cell[short].astype(np.int64)], who))
            value, who = value[at], who[at]
            first = np.searchsorted(who, np.arange(len(n)))
            keep = np.arange(len(who)) - first[who] < missing[who]
            value, who = value[keep], who[keep]
            group = (ref[who] % U(groups)).astype(np.int64)
            at = np.argsort(group, kind="stable")
            value, who, group = value[at], who[at], group[at]
            for a, b in zip((e := _edges(group))[:-1], e[1:]):
                run = _edges(who[a:b])
                some = who[a:b][run[:-1]]
                out.append((-1 - int(group[a]), ref[some].astype("<u8").tobytes(), n[some].astype("<u4").tobytes(), np.diff(run).astype("<u4").tobytes(), value[a:b].astype("<u8").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), packed)], schema=packed) if out else pa.RecordBatch.from_pylist([], schema=packed)

    back = pa.schema([("grp", pa.int32()), ("block", pa.int64()), ("refs", pa.binary()), ("sizes", pa.binary()), ("lone", pa.binary()), ("cnt", pa.binary()), ("low", pa.binary()), ("freq", pa.binary())])

    def counted(key, got):
        block = key[0].as_py()
        if block < 0:
            m = len(got)
            none = pa.array([b""] * m, pa.binary())
            return pa.Table.from_arrays([pa.array([-1 - block] * m, pa.int32()), got.column("block"), got.column("refs"), got.column("sizes"), none, got.column("cnt"), got.column("low"), none], schema=back)
        refs, sizes, cnt, low = (_raw(got, c, t) for c, t in (("refs", "<u8"), ("sizes", "<u4"), ("cnt", "<u4"), ("low", "<u4")))
        ref, size = np.repeat(refs, cnt), np.repeat(sizes, cnt)
        at = np.lexsort((ref, low))
        ref, size, low = ref[at], size[at], low[at]
        new = np.ones(len(low), bool)
        new[1:] = (ref[1:] != ref[:-1]) | (low[1:] != low[:-1])
        ref, size, low = ref[new], size[new], low[new]
        run = np.diff(_edges(low))
        df = np.repeat(run, run)
        at = np.lexsort((ref, ref % U(groups)))
        ref, size, low, df = ref[at], size[at], low[at], df[at]
        edge = _edges(ref)
        lone = np.add.reduceat(df == 1, edge[:-1])
        more = np.diff(edge) - lone
        group = (ref[edge[:-1]] % U(groups)).astype(np.int64)
        shared = df > 1
        freq = np.minimum(255, np.ceil(8 * np.log2(df))).astype(np.uint8)
        at_shared = np.concatenate([[0], np.cumsum(shared)])
        out = []
        for a, b in zip((e := _edges(group))[:-1], e[1:]):
            first = edge[a:b]
            lo, hi = at_shared[edge[a]], at_shared[edge[b]]
            out.append((int(group[a]), block, ref[first].astype("<u8").tobytes(), size[first].astype("<u4").tobytes(), lone[a:b].astype("<u4").tobytes(), more[a:b].astype("<u4").tobytes(), (lo, hi)))
        low, freq = low[shared], freq[shared]
        out = [(*x[:6], low[x[6][0] : x[6][1]].tobytes(), freq[x[6][0] : x[6][1]].tobytes()) for x in out]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), back)], schema=back)

    def cut(key, got):
        extra = np.array(got.column("block")) < 0
        parts = got.filter(pa.array(~extra)), got.filter(pa.array(extra))
        refs = [_raw(t, "refs", "<u8") for t in parts]
        known, inverse = np.unique(np.concatenate(refs), return_inverse=True)
        n = np.zeros(len(known), np.int64)
        n[inverse] = np.concatenate([_raw(t, "sizes", "<u4") for t in parts])
        one, two = inverse[: len(refs[0])], inverse[len(refs[0]) :]
        lone = np.bincount(one, _raw(parts[0], "lone", "<u4"), len(known)).astype(np.int64)
        who = np.repeat(one, _raw(parts[0], "cnt", "<u4"))
        block = np.repeat(np.array(parts[0].column("block"), np.uint64), [len(x) // 4 for x in parts[0].column("low").to_pylist()])
        token = (_raw(parts[0], "low", "<u4").astype(np.uint64) * U(blocks) + block) * U(2)
        freq = _raw(parts[0], "freq", "u1").astype(np.int64)
        # extras stand after all counted ones, in the order in which they came
        value = _raw(parts[1], "low", "<u8")
        x_who = np.repeat(two, _raw(parts[1], "cnt", "<u4"))
        x_freq = 256 + np.array(order.value)[(value >> U(64 - FREQUENCY_BITS)).astype(np.int64)]
        who, token, freq = np.concatenate([who, x_who]), np.concatenate([token, value | U(1)]), np.concatenate([freq, x_freq])
        at = np.lexsort((token, freq, who))
        who, token = who[at], token[at]
        new = np.ones(len(who), bool)
        new[1:] = (who[1:] != who[:-1]) | (token[1:] != token[:-1])
        who, token = who[new], token[new]
        pos = lone[who] + np.arange(len(who)) - np.searchsorted(who, np.arange(len(known)))[who]
        keep = pos < _prefix_length(n, num, den)[who]
        who, token, pos = who[keep], token[keep], pos[keep]
        edge = _edges(who)
        some = who[edge[:-1]]
        offsets = pa.array(edge.astype(np.int32))
        return pa.Table.from_arrays([longs(known[some]), pa.array(n[some]), pa.ListArray.from_arrays(offsets, pa.array(pos.astype(np.int32))), pa.ListArray.from_arrays(offsets, longs(token))], ["ref", "n", "pos", "token"])

    known = docs.where(F.col(id_col).isNotNull()).select(F.col(text_col).alias("text"))
    dealt = known.mapInArrow(postings, "block long, refs binary, sizes binary, cnt binary, low binary").groupBy("block")
    dealt = dealt.applyInArrow(counted, "grp int, block long, refs binary, sizes binary, lone binary, cnt binary, low binary, freq binary")
    return dealt.groupBy("grp").applyInArrow(cut, "ref long, n long, pos array<int>, token array<long>")


def _candidates(rows: list, forest: bool, num: int, den: int) -> list[tuple[int, int]]:
    """Index pairs of one list that pass the filters. rows: arrays n, pos, side, comp and signatures.

    forest: a spanning forest of the passing pairs of the list. Otherwise all passing pairs of different components
    between the two sides (or inside the one side)."""
    n, pos, sig, side, comp = rows
    out = []

    def passing(i: int, others: np.ndarray) -> np.ndarray:
        need = _overlap(n[i] + n[others], num, den)
        ok = (np.minimum(n[i], n[others]) * den >= np.maximum(n[i], n[others]) * num) & (1 + np.minimum(n[i] - pos[i], n[others] - pos[others]) - 1 >= need)
        others, need = others[ok], need[ok]
        if len(others):
            far = np.bitwise_count(sig[i] ^ sig[others]).sum(1, dtype=np.int64)
            others = others[(n[i] + n[others] - far) // 2 >= need]
        return others

    if forest:
        rest = np.arange(len(n))
        while len(rest) > 1:
            queue, rest = [int(rest[0])], rest[1:]
            while queue and len(rest):
                i = queue.pop(0)
                got = passing(i, rest)
                if len(got):
                    out += [(i, int(j)) for j in got]
                    queue += got.tolist()
                    rest = np.setdiff1d(rest, got, assume_unique=True)
        return out
    for i in range(len(n)):
        others = np.flatnonzero((side == 1) & (comp != comp[i])) if side.any() else np.arange(i + 1, len(n))
        if side.any() and side[i]:
            continue
        others = others[comp[others] != comp[i]]
        if len(others):
            out += [(i, int(j)) for j in passing(i, others)]
    return out


def _lists(rows: DataFrame, keys: list[str], forest: bool, num: int, den: int) -> DataFrame:
    """Candidate pairs (a, b), a < b, of the lists that ``keys`` name; lists come sorted and are never held but one at a time."""
    cols = [*keys, "cls", "n", "pos", "sig", "side", "comp"]
    rows = rows.select(*cols)
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "side", "cls")

    def walk(batches):
        import pandas as pd

        held = None
        for pdf in batches:
            if held is not None and len(held):
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            key = pdf[keys].to_numpy()
            edge = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            if not len(edge):
                held = pdf
                continue
            yield found(pdf.iloc[: edge[-1]], np.concatenate([[0], edge]))
            held = pdf.iloc[edge[-1] :]
        if held is not None and len(held):
            key = held[keys].to_numpy()
            edge = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            yield found(held, np.concatenate([[0], edge, [len(held)]]))

    def found(pdf, edges):
        import pandas as pd

        cls = pdf["cls"].to_numpy()
        n, pos, side = (pdf[c].to_numpy(np.int64) for c in ("n", "pos", "side"))
        sig = np.frombuffer(b"".join(pdf["sig"]), "<u8").reshape(len(pdf), PARITIES // 64)
        comp = pdf["comp"].to_numpy()
        a, b = [], []
        for lo, hi in zip(edges[:-1], edges[1:]):
            if hi - lo > 1:
                for i, j in _candidates([n[lo:hi], pos[lo:hi], sig[lo:hi], side[lo:hi], comp[lo:hi]], forest, num, den):
                    x, y = bytes(cls[lo + i]), bytes(cls[lo + j])
                    a.append(min(x, y))
                    b.append(max(x, y))
        return pd.DataFrame({"a": a, "b": b})

    return rows.mapInPandas(walk, "a binary, b binary").distinct()


def _verified(docs: DataFrame, pairs: DataFrame, texts_of: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs whose whole sets are similar enough. Sets are made anew from one text of each class in question (texts_of: cls, h):
    a bitmap of fixed size over hashes of texts finds these while scanning, the join makes it exact."""
    spark = docs.sparkSession
    nodes = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()

    def cells(batches):
        for batch in batches:
            cell = np.unique(np.array(batch.column(0)).view(np.uint64) >> U(64 - CANDIDATE_BITS))
            yield pa.RecordBatch.from_pylist(list(blocks_of(cell, np.ones(len(cell)), 0)), schema=pa.schema([("line", pa.int32()), ("block", pa.int64()), ("low", pa.binary()), ("n", pa.binary())]))

    hashes = texts_of.join(nodes, "cls", "left_semi").select("h")
    wanted = spark.sparkContext.broadcast(gathered_bits(merged_bits(hashes.mapInArrow(cells, BLOCKS), 1), 1, CANDIDATE_BITS))

    def sets(batches):
        bitmap = wanted.value[0]
        for batch in batches:
            some = batch.filter(pa.array(bit_at(bitmap, np.array(batch.column(1)).view(np.uint64) >> U(64 - CANDIDATE_BITS)) == 1))
            for _, texts in slices(some, "text"):
                values, counts = shingle_sets(texts, k)
                yield pa.RecordBatch.from_arrays([pa.array(_class_keys(values, counts), pa.binary()), lists(values, counts)], ["cls", "shingles"])

    found = docs.where(F.col(id_col).isNotNull()).select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).mapInArrow(sets, "cls binary, shingles array<long>")
    found = found.join(nodes, "cls", "left_semi").dropDuplicates(["cls"])  # dealt out once: both joins read that shuffle
    both = pairs.join(found.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a").join(found.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    return both.where(shared * (num + den) >= (F.size("x") + F.size("y")) * F.lit(num)).select("a", "b")


def similarity_components(docs: DataFrame, shingle: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``docs``. threshold: similarity as numerator and denominator."""
    return similarity_groups(docs, shingle, threshold, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def similarity_groups(docs: DataFrame, shingle: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``similarity_components``, with two columns more: ``text_hash`` (xxhash64 of the text) tells rows of one doc_id apart, and
    ``component`` is the group itself (null for empty sets and null ids), as one doc_id may stand in several groups."""
    num, den = threshold
    spark = docs.sparkSession
    rows = saved(document_sets(docs, shingle, id_col, text_col))
    per_doc = rows.where("block is null")
    with_id = per_doc.where("cls is not null and doc_id is not null")
    classes = with_id.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"))
    size = per_doc.agg(F.sum("n").alias("total"), F.count("*").alias("rows")).first()
    lists_ = saved(prefix_lists(docs, _frequencies(rows), size["total"] or 0, size["rows"], shingle, num, den, id_col, text_col))
    heads = with_id.join(lists_.select("ref"), "ref", "left_semi").groupBy("cls").agg(F.first("ref").alias("ref"), F.first("sig").alias("sig"), F.min("h").alias("h"))
    heads = saved(heads)
    tokens = lists_.select("ref", "n", F.explode(F.arrays_zip("pos", "token")).alias("at")).select("ref", "n", "at.pos", "at.token")
    sizes = tokens.groupBy("token").agg(F.count("*").alias("size")).where("size > 1")
    tokens = tokens.join(sizes, "token").join(heads.select("ref", "cls"), "ref").drop("ref")
    listed = saved(tokens.withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("cls", "token"), F.col("chunks")).cast("int")))
    signatures = heads.select("cls", "sig")  # joined last, so that they are dealt out once

    one = listed.withColumns({"side": F.lit(0), "comp": F.lit(None).cast("binary")})
    tried = saved(_lists(one.join(signatures, "cls"), ["token", "chunk"], True, num, den))
    links = saved(_verified(docs, tried, heads, shingle, num, den, id_col, text_col))
    comps = connected(links)

    # a list of two was compared in full by the first round
    named = listed.where("size > 2").join(comps, listed["cls"] == comps["node"], "left").withColumn("comp", F.coalesce("comp", "cls")).drop("node")
    open_lists = named.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token")
    named = named.join(open_lists, "token", "left_semi")
    # each row goes to every pair of chunks that has its own: with one chunk, to that alone
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, F.col("chunk")).alias("ci"), F.greatest(c, F.col("chunk")).alias("cj")))
    spread = named.withColumn("to", F.explode(pairs)).select("*", "to.ci", "to.cj").drop("to").withColumn("side", (F.col("chunk") != F.col("ci")).cast("int"))
    more = _lists(spread.join(signatures, "cls"), ["token", "ci", "cj"], False, num, den).join(tried, ["a", "b"], "left_anti")
    more = saved(more)
    if more.limit(1).count():
        more_links = saved(_verified(docs, more, heads, shingle, num, den, id_col, text_col))
        if more_links.limit(1).count():
            comps = connected(links.union(more_links))
    joined = classes.join(comps, classes["cls"] == comps["node"], "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = joined.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_class = joined.join(least, "comp").select("cls", "component_id", F.col("comp").alias("component"))
    out = per_doc.select("doc_id", "n", "cls", "h").join(of_class, "cls", "left")
    alone = F.col("cls").isNull() | F.col("doc_id").isNull()
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("h").alias("text_hash"),
        F.when(~alone, F.col("component")).alias("component"),
    )
