"""Quality classifier: gated attention over a document's passages (multiple-instance learning; Ilse et al., 2018).

A document is a bag of passages of ``PASSAGE`` code points. Each passage is encoded as rates of character classes, word
statistics and a histogram of hashed character pairs. The network is e = tanh(W x), attention softmax of
w . (tanh(V e) * sigmoid(U e)) over the document's passages, and a logistic score of the attended sum; all of it is
learned from document labels alone, by Adam on whole batches from a fixed start.

Training takes at most ``sample`` labelled documents (a documented bound; 6,000) with all their passages, and at most ``passages`` passages altogether (60,000; a bound of the driver's memory): documents
come in the order of a hash of their text, and one whose passages are too many for what is left is passed over. Scoring encodes every passage of every document.

Cases: a null or empty text is one empty passage; without both labels every score is the share of label 1 (1 if there are no labels, so that nothing is
rejected); rows are scored one by one, so ties and repeated rows score alike; a doc_id with several labels counts as 1 if one is 1; null labels are not used;
other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .hashing import BASES, mix, runs
from .toxicity import training_rows

PASSAGE = 512
_SIGNS = ".,!?%&*$#|\"'()-"
_CLASSES = 6 + len(_SIGNS)
_PAIRS = 32
SIZE = _CLASSES + 4 + _PAIRS


@lru_cache(maxsize=1)
def _class_of() -> np.ndarray:
    """0 lower, 1 upper, 2 other letter, 3 digit, 4 space, 5 other, then the signs."""
    out = np.full(1 << 16, 5, np.uint8)
    for c in range(1 << 16):
        kind = unicodedata.category(chr(c))
        out[c] = {"Ll": 0, "Lu": 1}.get(kind, 2 if kind[0] == "L" else 3 if kind[0] == "N" else 5)
        if chr(c).isspace():
            out[c] = 4
    for k, c in enumerate(_SIGNS):
        out[ord(c)] = 6 + k
    return out


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Passage vectors of the texts, one after the other, and how many passages each text has."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate([[0], np.cumsum(counts)])
    total = int(first[-1])
    code = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    begin = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(texts)), sizes)
    passage = first[owner] + (np.arange(len(code)) - begin[owner]) // PASSAGE
    length = np.bincount(passage, minlength=total)
    kind = _class_of()[np.minimum(code, 0xFFFF)]
    n = np.maximum(length, 1)[:, None]
    rates = np.bincount(passage * _CLASSES + kind, minlength=total * _CLASSES).reshape(total, _CLASSES) / n
    same = passage[1:] == passage[:-1]
    pair = mix(code[:-1].astype(np.uint64) << np.uint64(21) | code[1:].astype(np.uint64)) % np.uint64(_PAIRS) if len(code) > 1 else np.zeros(0, np.uint64)
    hist = np.bincount(passage[1:][same] * _PAIRS + pair[same].astype(np.int64), minlength=total * _PAIRS).reshape(total, _PAIRS) / n
    # words: runs outside spaces, cut at passage ends
    gap = kind == 4
    edge = np.concatenate([[True], ~same]) if len(code) else np.zeros(0, bool)
    start = np.flatnonzero(~gap & (edge | np.concatenate([[True], gap[:-1]]))) if len(code) else np.zeros(0, int)
    end = np.flatnonzero(~gap & (np.concatenate([edge[1:], [True]]) | np.concatenate([gap[1:], [True]]))) + 1 if len(code) else start
    word = runs(mix(code.astype(np.uint64) + np.uint64(1)), start, end, BASES[0]) if len(code) else np.zeros(0, np.uint64)
    at = passage[start] if len(code) else start
    words = np.bincount(at, minlength=total)
    order = np.lexsort((word, at))
    new = np.ones(len(word), bool)
    new[1:] = (at[order][1:] != at[order][:-1]) | (word[order][1:] != word[order][:-1])
    kinds = np.bincount(at[order][new], minlength=total)
    next_same = np.bincount(at[1:][(word[1:] == word[:-1]) & (at[1:] == at[:-1])], minlength=total) if len(word) > 1 else np.zeros(total)
    w = np.maximum(words, 1)
    extra = np.stack([kinds / w, next_same / w, np.minimum(length / w, 40) / 20, length / PASSAGE], 1)
    return np.concatenate([rates * 3, extra, hist * 8], 1).astype(np.float32), counts


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(m: dict, x: np.ndarray, first: np.ndarray):
    """first: the first passage of each document."""
    x = (x - m["mean"]) / m["scale"]
    e = np.tanh(x @ m["W"] + m["Wb"])
    t, g = np.tanh(e @ m["V"]), _sigmoid(e @ m["U"])
    z = (t * g) @ m["w"]
    counts = np.diff(np.append(first, len(x)))
    a = np.exp(z - np.repeat(np.maximum.reduceat(z, first), counts))
    a = a / np.repeat(np.add.reduceat(a, first), counts)
    bag = np.add.reduceat(a[:, None] * e, first)
    return _sigmoid(bag @ m["c"] + m["b"]), (x, e, t, g, a, bag, counts)


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, steps: int = 250, rate: float = 0.02, decay: float = 1e-4) -> dict:
    rng = np.random.default_rng(7)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    m = {"W": rng.normal(0, SIZE**-0.5, (SIZE, hidden)), "Wb": np.zeros(hidden), "V": rng.normal(0, 0.2, (hidden, gate)), "U": rng.normal(0, 0.2, (hidden, gate)), "w": rng.normal(0, 0.2, gate), "c": rng.normal(0, 0.2, hidden), "b": np.zeros(1)}
    const = {"mean": x.mean(0), "scale": x.std(0) + 0.05}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.items()}
    for step in range(1, steps + 1):
        p, (xs, e, t, g, a, bag, n) = _forward(m | const, x, first)
        d = (p - y) / len(y)
        grad = {"c": bag.T @ d, "b": np.array([d.sum()])}
        d_bag = np.repeat(d[:, None] * m["c"], n, 0)
        d_a = (d_bag * e).sum(1)
        d_z = a * (d_a - np.repeat(np.add.reduceat(a * d_a, first), n))
        grad["w"] = (t * g).T @ d_z
        d_tg = d_z[:, None] * m["w"]
        d_t, d_g = d_tg * g * (1 - t * t), d_tg * t * g * (1 - g)
        grad["V"], grad["U"] = e.T @ d_t, e.T @ d_g
        d_e = (a[:, None] * d_bag + d_t @ m["V"].T + d_g @ m["U"].T) * (1 - e * e)
        grad["W"], grad["Wb"] = xs.T @ d_e, d_e.sum(0)
        for k in m:
            u, v = moment[k]
            dk = grad[k] + decay * m[k]
            u[...] = 0.9 * u + 0.1 * dk
            v[...] = 0.999 * v + 0.001 * dk * dk
            m[k] = m[k] - rate * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return m | const


def _runs(column, limit: int = 1 << 19):
    run, size = [], 0
    for v in column:
        text = v.as_py() or ""
        if run and size + len(text) > limit:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def train_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = 6_000, passages: int = 60_000, id_col: str = "doc_id", text_col: str = "text") -> dict:
    def vectors(batches):
        for batch in batches:
            got, y = [], batch.column(1).to_pylist()
            for run in _runs(batch.column(0)):
                x, counts = encode(run)
                at = 0
                for c in counts:
                    got.append(x[at : at + c].tobytes())
                    at += c
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), pa.array(y, pa.int32())], ["x", "y"])

    train = saved(training_rows(docs, labels, label_col, sample, id_col, text_col))
    left, last, chosen = passages, None, []
    for r in train.select(F.xxhash64("text").alias("h"), F.greatest(F.lit(1), F.ceil(F.length(F.coalesce("text", F.lit(""))) / PASSAGE)).alias("n")).orderBy("h", "n").collect():  # ``sample`` rows at most
        if r["n"] <= left:
            left -= r["n"]
            if r["h"] != last:
                chosen.append((r["h"],))
            last = r["h"]
    some = docs.sparkSession.createDataFrame(chosen, "h long")
    train = train.withColumn("h", F.xxhash64("text")).join(F.broadcast(some), "h", "left_semi").select("text", "y")
    rows = train.mapInArrow(vectors, "x binary, y int").collect()
    rows = sorted(((bytes(r["x"]), r["y"]) for r in rows))  # the same model whatever task ends first
    y = np.array([float(r[1] == 1) for r in rows])
    if not len(y) or y.min() == y.max():
        return {"share": float(y.mean()) if len(y) else 1.0}
    bags = [np.frombuffer(r[0], np.float32).reshape(-1, SIZE) for r in rows]
    return {"share": float(y.mean()), "net": fit(np.concatenate(bags).astype(np.float64), np.array([len(b) for b in bags]), y)}


def scores_of(texts: list[str], model: dict) -> np.ndarray:
    if "net" not in model:
        return np.full(len(texts), model["share"])
    x, counts = encode(texts)
    return _forward(model["net"], x.astype(np.float64), np.concatenate([[0], np.cumsum(counts)])[:-1])[0]


def score_quality(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])

    def score(batches):
        for batch in batches:
            got = [scores_of(run, shared.value) for run in _runs(batch.column(at))]
            p = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, score_col])

    return docs.mapInArrow(score, schema)
