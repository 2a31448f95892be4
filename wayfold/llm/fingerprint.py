"""Document fingerprints: a digest of improbable features (Roussev, 2010).

A feature is a window of 64 bytes. Its Shannon entropy falls into one of 1,001 classes, and a class is the rarer the fewer windows of the whole corpus it
has. A window that is the rarest (the first of equally rare ones) of at least ``THRESHOLD`` of the 64-window neighbourhoods it lies in is
selected; a text without one gives its rarest window, and a text under 64 bytes gives
all its windows of 8 bytes, or itself. The selected features, without
repeats, go into chained Bloom filters of 2,048 bits, five bits a feature, at most 160 features a filter.

Two filters' overlap is the common bits beyond those expected by chance, over the most there could be beyond chance (0 to 1). Two digests' likeness is the mean over
the filters of the one with fewer features, weighted by features, of each one's best overlap with a filter of the other.

A fingerprint is the filters in order, each ``features:base64``, joined by ``|``; that of an empty text is empty. Empty texts are alike (1) and unlike any other (0).

Cases: a null text is empty; rows are ordered by descending doc_id, then by a hash of the text (so repeated rows
are neighbours), null ids last (dealt by ranges of that hash); other columns are not looked at; one row is its own next; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices
from .hashing import U, mix

WINDOW = 64
SHORT = 8
THRESHOLD = 16
BITS = 2048
PER_FILTER = 160
LEVELS = 1001

# c * log2(c) in units of 2**-32: whole numbers, so a window's entropy does not depend on what is summed before it
_f = np.zeros(WINDOW + 1, np.int64)
_f[1:] = np.rint(np.arange(1, WINDOW + 1) * np.log2(np.arange(1, WINDOW + 1)) * 2.0**32)


def entropy_classes(raw: np.ndarray) -> np.ndarray:
    """The entropy class of every window of ``raw``; counts in a sliding window come from 63 vector comparisons."""
    n = len(raw) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    back = np.ones(len(raw), np.uint8)  # how often raw[i] occurs in the window that ends at i
    fore = np.ones(len(raw), np.uint8)  # and in the one that starts at i
    for d in range(1, WINDOW):
        same = (raw[d:] == raw[:-d]).view(np.uint8)
        back[d:] += same
        fore[:-d] += same
    step = np.diff(_f)
    value = np.empty(n, np.int64)
    value[0] = _f[np.bincount(raw[:WINDOW], minlength=256)].sum()
    # first raw[i] goes, then raw[i + 64] comes
    value[1:] = step[back[WINDOW:] - 1] - step[fore[: n - 1] - 1]
    np.cumsum(value, out=value)
    most = np.int64(WINDOW * np.log2(WINDOW)) << 32
    return (most - value) * (LEVELS - 1) // most


def _joined(texts: list[bytes]):
    """All bytes, and for each window start whether it lies in one text."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    n = max(0, len(raw) - WINDOW + 1)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[:n] == owner[WINDOW - 1 :] if n else np.zeros(0, bool)
    return raw, sizes, begin, owner[:n], inside


def class_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many windows of all texts have each entropy class."""

    def count(batches):
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for _, texts in slices(batch, "text", 1 << 18):
                raw, _, _, _, inside = _joined(texts)
                total += np.bincount(entropy_classes(raw)[inside], minlength=LEVELS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["class", "n"])

    out = np.zeros(LEVELS, np.int64)
    for r in docs.select(F.col(text_col).alias("text")).mapInArrow(count, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        out[r["class"]] = r["n"]
    return out


def features(texts: list[bytes], rarity: np.ndarray) -> list[np.ndarray]:
    """The selected features' hashes of each text, in order, without repeats. rarity: a rank for each entropy class, 0 the rarest."""
    raw, sizes, begin, owner, inside = _joined(texts)
    out = [np.zeros(0, np.uint64)] * len(texts)
    n = len(owner)
    if n:
        rank = rarity[entropy_classes(raw)]
        worst = np.int64(LEVELS)
        key = np.where(inside, rank, worst) << 40 | np.arange(n)
        # neighbourhoods are runs of 64 windows of one text: the least key of each run
        m = key
        for d in (1, 2, 4, 8, 16, 32):
            if len(m) > d:
                m = np.minimum(m[:-d], m[d:])
            else:
                m = m[:0]
        last = begin[owner + 1] - WINDOW  # the last window of the text
        at = np.arange(len(m))
        m = m[at + 63 <= last[: len(m)]] if len(m) else m
        votes = np.bincount(m & (1 << 40) - 1, minlength=n)
        chosen = votes >= THRESHOLD
        have = np.bincount(owner[chosen], minlength=len(texts))
        for d in np.flatnonzero((have == 0) & (sizes >= WINDOW)):
            lo, hi = begin[d], begin[d + 1] - WINDOW + 1
            chosen[lo + np.argmin(key[lo:hi])] = True
        at = np.flatnonzero(chosen)
        words = np.lib.stride_tricks.sliding_window_view(raw, WINDOW)[at].view("<u8")
        odd = mix(np.arange(1, 9, dtype=np.uint64)) | U(1)
        h = mix((mix(words.astype(np.uint64)) * odd).sum(1, dtype=np.uint64))
        edges = np.searchsorted(owner[at], np.arange(len(texts) + 1))
        for d in range(len(texts)):
            got = h[edges[d] : edges[d + 1]]
            if len(got) > 1:
                got = got[np.sort(np.unique(got, return_index=True)[1])]
            out[d] = got
    for d in np.flatnonzero((sizes > 0) & (sizes < WINDOW)):
        pieces = [texts[d][i : i + SHORT] for i in range(max(1, len(texts[d]) - SHORT + 1))]
        out[d] = np.array([int.from_bytes(hashlib.sha256(x).digest()[:8], "little") for x in dict.fromkeys(pieces)], np.uint64)
    return out


def filters(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features in each, filters as rows of bits)."""
    k = -(-len(hashes) // PER_FILTER)
    bits = np.zeros((k, BITS), np.uint8)
    row = np.arange(len(hashes)) // PER_FILTER
    for i in range(5):
        bits[row, ((hashes >> U(11 * i)) & U(BITS - 1)).astype(np.int64)] = 1
    return np.bincount(row, minlength=k), bits


def likeness(a: tuple, b: tuple) -> float:
    (na, fa), (nb, fb) = a, b
    if not len(na) or not len(nb):
        return float(len(na) == len(nb))
    if (na.sum(), len(na)) > (nb.sum(), len(nb)):
        (na, fa), (nb, fb) = (nb, fb), (na, fa)
    common = fa.astype(np.float32) @ fb.astype(np.float32).T
    ones_a, ones_b = fa.sum(1, dtype=np.float64)[:, None], fb.sum(1, dtype=np.float64)[None, :]
    chance = ones_a * ones_b / BITS
    most = np.minimum(ones_a, ones_b)
    over = np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1)
    return float((over.max(1) * na).sum() / na.sum())


def text_form(f: tuple) -> str:
    return "|".join(f"{n}:{base64.b64encode(np.packbits(row)).decode()}" for n, row in zip(*f))


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by as many (or all) of the next document's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _blocks(rows: int, block: int) -> int:
    return max(1, min(rows // block, isqrt(10 * rows)))


def _below(cuts: list[int], value: Column) -> Column:
    """How many of the ascending cuts are less than ``value``, by halving; the cuts are one literal."""
    if not cuts:
        return F.lit(0)
    known = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<long>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(known, low + step - 1) < value, low + step).otherwise(low))


def fingerprints(docs: DataFrame, block: int = 1_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: its own fingerprint, its edited text's, and its likeness to that and to the next document's.

    Rows are dealt by ranges of doc_id into blocks of about ``block`` rows, or of the root of a tenth of all rows if that is more (from ten million
    rows on; blocks and their number then grow alike), sorted inside a task and read in a stream. The first
    row of each block also goes to the block before it, so texts are shuffled once."""
    spark = docs.sparkSession
    counts = class_counts(docs, text_col)
    rarity = np.empty(LEVELS, np.int64)
    rarity[np.lexsort((np.arange(LEVELS), counts))] = np.arange(LEVELS)
    shared = spark.sparkContext.broadcast(rarity)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = rows.select("doc_id").where("doc_id is not null")
    total = ids.count()
    n = _blocks(total, block)
    cuts = sorted(set(ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    cuts = [int(c) for c in cuts]
    rows = rows.withColumn("tie", F.xxhash64("text"))
    nulls = rows.where("doc_id is null").count()
    by_tie = F.floor((F.col("tie") / 2.0**64 + 0.5) * F.lit(_blocks(nulls, block)))
    block_of = F.when(F.col("doc_id").isNull(), by_tie + len(cuts) + 1).otherwise(len(cuts) - _below(cuts, F.col("doc_id")))  # block 0 has the greatest ids; nulls come last
    rows = rows.select("doc_id", "text", block_of.cast("int").alias("block"), "tie")
    heads = rows.groupBy("block").agg(F.min(F.struct(-F.col("doc_id"), F.col("tie"))).alias("h")).collect()
    order = sorted(heads, key=lambda r: r["block"])
    back = {order[i]["block"]: order[i - 1]["block"] for i in range(len(order))}  # the first block's head closes the ring
    small = spark.createDataFrame([(r["block"], -r["h"][0] if r["h"][0] is not None else None, r["h"][1], back[r["block"]]) for r in order], "b int, d long, t long, to int")
    own = rows.withColumn("ghost", F.lit(0))
    if order:
        ghosts = rows.join(F.broadcast(small), (rows["block"] == small["b"]) & rows["doc_id"].eqNullSafe(small["d"]) & (rows["tie"] == small["t"])).select("doc_id", "text", F.col("to").alias("block"), "tie").withColumn("ghost", F.lit(1))
        own = own.union(ghosts)
    dealt = own.repartition(max(len(order), 1), "block").sortWithinPartitions("block", "ghost", F.desc_nulls_last("doc_id"), "tie")

    kinds = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def walk(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                size += len(row[1])
                if size > 1 << 17 and len(held) > 1:
                    yield done(held)
                    held, size = held[-1:], len(held[-1][1])
        if len(held) > 1:
            yield done(held)

    def done(held):
        """Results of all rows but the last, which follows; the pair of a block's last row and what stands for its next one ends the block."""
        rarity = shared.value
        texts = [r[1] for r in held]
        pairs = [i for i in range(len(held) - 1) if held[i][2] == held[i + 1][2] and not held[i][4]]
        changed = [edited(texts[i], texts[i + 1]) for i in pairs]
        raw = [t.encode() for t in texts + changed]
        made = [filters(h) for h in features(raw, rarity)]
        out = [[], [], [], [], [], [], []]
        for k, i in enumerate(pairs):
            e = made[len(texts) + k]
            row = (held[i][0], len(texts[i]), hashlib.sha256(raw[len(texts) + k]).hexdigest(), text_form(made[i]), text_form(e), likeness(made[i], e), likeness(made[i], made[i + 1]))
            for c, v in zip(out, row):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kinds)], schema=kinds)

    return dealt.mapInArrow(walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
