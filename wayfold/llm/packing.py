"""Packing: token sequences of a fixed capacity, balanced by an estimated cost.

A document's ids are cut into full sequences and a rest. The rests are assigned in descending length to the open
sequence of least estimated cost (``linear * n + quadratic * n * n`` summed over its pieces, for attention inside each
piece) that still has room. As many sequences are opened as the tokens need; a rest that fits nowhere is
cut at multiples of ``grain`` ids into the largest gaps, and only what no gap takes opens another sequence.

Rests are packed in blocks of about ``block`` documents, chosen by a hash of the document, so no task holds more than
a block's piece lengths; ids never leave the task that made them. Checksums of cut rests come from
checksums of their grains, combined arithmetically.

Cases: a null text is empty, and then only the end id is packed; documents with a null doc_id are packed too; repeated rows are packed
each for itself; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """a * b modulo the CRC-32 polynomial, bit-reflected."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        b = (b >> 1) ^ (_POLY if b & 1 else 0)
        bit >>= 1
    return out


def _shift(n_bytes: int) -> int:
    """x**(8 * n_bytes) modulo the polynomial."""
    out, base, n = 1 << 31, 1 << 30, 8 * n_bytes
    while n:
        if n & 1:
            out = _times(out, base)
        base = _times(base, base)
        n >>= 1
    return out


def crc_join(a: int, b: int, b_bytes: int, _known: dict = {}) -> int:
    """The CRC-32 of x + y from those of x and y."""
    if b_bytes not in _known:
        _known[b_bytes] = _shift(b_bytes)
    return _times(a, _known[b_bytes]) ^ b


def tokenised(docs: DataFrame, tokenizer_json: str, capacity: int = 1024, grain: int = 32, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, total, full crcs, rest grain crcs) for each document; the ids themselves stay in the task."""

    def encode(batches):
        ids_of = encoder(tokenizer_json)
        for batch in batches:
            total, full, rest = [], [], []
            for value in batch.column(1):
                ids = np.append(np.asarray(ids_of(value.as_py() or ""), "<u4"), np.uint32(end_id)).astype("<u4")
                raw = memoryview(ids.tobytes())
                whole = len(ids) // capacity * capacity
                total.append(len(ids))
                full.append([zlib.crc32(raw[4 * a : 4 * (a + capacity)]) for a in range(0, whole, capacity)])
                rest.append([zlib.crc32(raw[4 * a : 4 * (a + grain)]) for a in range(whole, len(ids), grain)])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(full, kind), pa.array(rest, kind)], ["doc_id", "total", "full", "rest"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, total long, full array<long>, rest array<long>")


@lru_cache(maxsize=2)
def encoder(tokenizer_json: str):
    """A function from a text to the ids that ``tokenizers`` gives for it.

    A byte-level BPE file with the GPT-2 split is loaded into the faster ``tiktoken``, which gives the same ids; texts with characters outside long-settled
    Unicode blocks (where the libraries' Unicode versions could differ) or with an added token's string go to ``tokenizers`` itself."""
    import json
    import re

    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer_json)
    slow = lambda text: exact.encode(text, add_special_tokens=False).ids
    spec = json.load(open(tokenizer_json, encoding="utf-8"))
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout")
    if not plain:
        return slow
    # printable stand-ins of the bytes, as byte-level BPE files write them
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    added = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(stand[c] for c in token): k for token, k in model["vocab"].items() if token not in added}
    split = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    try:
        own_ids = tiktoken.Encoding("own", pat_str=split, mergeable_ranks=ranks, special_tokens={})
        fast = lambda text: own_ids.encode_to_numpy(text, disallowed_special=())
    except Exception:  # ranks with gaps are not for tiktoken
        return slow
    odd = re.compile("[^\t-\r -~¡-ɏͰ-ͳΑ-ΡΣ-ҁ‐-‧ぁ-ゖァ-ヺ一-龥]" + "".join(f"|{re.escape(t)}" for t in added))
    return lambda text: slow(text) if odd.search(text) else fast(text)


def pack_block(docs: list[tuple], capacity: int, grain: int, linear: float, quadratic: float, base: int) -> list[tuple]:
    """Pieces of one block; docs: (doc_id, total, full crcs, rest grain crcs)."""
    pieces, open_at = [], base
    rests = []
    for doc_id, total, full, rest in docs:
        for k, crc in enumerate(full):
            pieces.append((doc_id, k * capacity, capacity, crc, total, open_at, 0))
            open_at += 1
        if len(rest):
            rests.append((total - len(full) * capacity, doc_id, total, len(full) * capacity, rest))
    rests.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
    n = -(-sum(r[0] for r in rests) // capacity)
    used, cost = [0] * n, [0.0] * n
    size = 1 << capacity.bit_length()
    by_room: list[list] = [[] for _ in range(size)]
    tree = [(float("inf"), -1)] * (2 * size)

    def push(room: int, item: tuple) -> None:
        heapq.heappush(by_room[room], item)
        lift(room)

    def lift(room: int) -> None:
        heap = by_room[room]
        k = room + size
        tree[k] = heap[0] if heap else (float("inf"), -1)
        while k > 1:
            k //= 2
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def cheapest(room: int) -> tuple:
        """The least (cost, sequence) that has this room at least."""
        best, a, b = (float("inf"), -1), room + size, 2 * size
        while a < b:
            if a & 1:
                best, a = min(best, tree[a]), a + 1
            if b & 1:
                b -= 1
                best = min(best, tree[b])
            a, b = a // 2, b // 2
        return best

    for s in range(n):
        by_room[capacity].append((0.0, s))
    if n:
        lift(capacity)

    def place(s: int, length: int, doc: tuple, start: int, crc: int) -> None:
        if s < len(used) and s >= 0 and used[s] < capacity:
            heap = by_room[capacity - used[s]]
            if heap and heap[0][1] == s:
                heapq.heappop(heap)
            else:
                heap.remove((cost[s], s))
                heapq.heapify(heap)
            lift(capacity - used[s])
        pieces.append((doc[1], start, length, crc, doc[2], open_at + s, used[s]))
        used[s] += length
        cost[s] += linear * length + quadratic * length * length
        if used[s] < capacity:
            push(capacity - used[s], (cost[s], s))

    def checksum(grains, length: int) -> int:
        """Of whole grains but for the last, which may be shorter."""
        out = grains[0]
        for k, g in enumerate(grains[1:], 1):
            out = crc_join(out, g, 4 * min(grain, length - k * grain))
        return out

    top = capacity
    left = []
    for r in rests:
        _, s = cheapest(r[0])
        if s < 0:
            left.append(r)
        else:
            place(s, r[0], r, r[3], checksum(r[4], r[0]))
    for r in left:
        done = 0
        while done < r[0]:
            while top and not by_room[top]:
                top -= 1
            take = min(r[0] - done, top if top >= r[0] - done else top // grain * grain)
            if take <= 0:
                used.append(0)
                cost.append(0.0)
                push(capacity, (0.0, len(used) - 1))
                top = capacity
                continue
            s = by_room[top][0][1]
            place(s, take, r, r[3] + done, checksum(r[4][done // grain : -(-(done + take) // grain)], take))
            done += take
    return pieces


def pack(docs: DataFrame, tokenizer_json: str, capacity: int = 1024, grain: int = 32, block: int = 20_000, linear: float = 1.0, quadratic: float = 1.0 / 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    n = max(1, -(-docs.count() // block))
    rows = tokenised(docs, tokenizer_json, capacity, grain, end_id, id_col, text_col)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "total", "rest"), F.lit(n)))

    def packed(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(["doc_id", "total"], kind="stable")
        ids = [None if pd.isna(x) else int(x) for x in pdf["doc_id"]]
        got = pack_block(list(zip(ids, pdf["total"].tolist(), pdf["full"], pdf["rest"])), capacity, grain, linear, quadratic, int(key[0]) << 32)
        out = pd.DataFrame(got, columns=[x.split()[0] for x in PIECES.split(", ")])
        return out.astype({"doc_id": "Int64"})

    return rows.groupBy("block").applyInPandas(packed, PIECES)
