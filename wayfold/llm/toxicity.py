"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lowers the case, takes compatibility forms and letters without their accents, drops marks and signs without width, maps homoglyphs to Latin letters, digits and signs that stand
for letters to these, and what is no letter to a space.
The lexicon holds word beginnings (stems) of four to ten letters, and whole words of up to three, with the log-odds of documents that have them, learned from labelled rows: all that pass a test of significance.
An entry matches at a word's start (in scripts without spaces, at the start of a run), the longest entry counts, and matches inside an exception phrase don't. Exception phrases are learned too: an entry's word with
the word before or after it, if the two together speak for label 0; the caller can give more. The weights' sum and
the sum for every thousand words (the length normalisation) enter a two-term logistic calibration, fitted on the same rows.

Training takes at most ``sample`` labelled documents, chosen by a hash of doc_id (a documented bound; 20,000); of a doc_id on several rows one text is taken, that with the least hash. Everything is scored.

Cases: a null text is empty, and gets the score of a text without a match; without usable labels every score is the share of label 1
(0 if there is none); rows are scored one by one, so ties and repeated rows score alike; a doc_id with several labels counts as 1 if one is 1; null labels are not used;
other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections import Counter
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

# Look-alike letters, and digits and signs that stand for letters.
HOMOGLYPHS = ("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwabekmhopctyxijsaeiknoptuxabezhikmnoptyx")
SUBSTITUTES = ("013457@$", "oieastas")


class _Fold(dict):
    """A table for str.translate, filled as characters come."""

    def __missing__(self, code: int):
        c = chr(code)
        for old, new in (HOMOGLYPHS, SUBSTITUTES):
            if c in old:
                c = new[old.index(c)]
        c = unicodedata.normalize("NFKD", c).lower()
        if all(unicodedata.category(x) in ("Cf", "Mn", "Me") for x in c):
            out = ""
        else:
            out = "".join(x for x in c if x.isalpha()) or " "
        self[code] = out
        return out


_fold = _Fold()


def fold(text: str | None) -> str:
    return (text or "").translate(_fold)


def stems(text: str, shortest: int = 4, longest: int = 10) -> set[str]:
    """Words' beginnings, and short words as such, with a space behind."""
    out = set()
    for w in set(fold(text).split()):
        if len(w) >= shortest:
            out.update(w[:k] for k in range(shortest, min(len(w), longest) + 1))
        else:
            out.add(w + " ")
    return out


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, sample: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y) of at most ``sample`` labelled documents outside the held-out fifth; so few label rows may be broadcast."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")
    return rows.groupBy("_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "y")


@lru_cache(maxsize=4)
def _automaton(lexicon: tuple, exceptions: tuple):
    import ahocorasick

    a = ahocorasick.Automaton()
    for stem, weight in lexicon:
        a.add_word(" " + stem, (len(stem) + 1, weight))
    for phrase in exceptions:
        phrase = f" {' '.join(fold(phrase).split())} "
        a.add_word(phrase, (len(phrase), None))
    if len(a):
        a.make_automaton()
    return a


def evidence(text: str | None, lexicon: tuple, exceptions: tuple) -> tuple[float, float]:
    """The weights' sum, and that for every thousand words (a text under a hundred words counts as a hundred)."""
    a = _automaton(lexicon, exceptions)
    words = fold(text).split()
    if not len(a) or not words:
        return 0.0, 0.0
    best, free = _matches(a, words)
    total = sum(w for at, w in best.items() if not _inside(free, at))
    return total, 1000.0 * total / max(100, len(words))


def _matches(a, words: list[str]) -> tuple[dict[int, float], tuple[list[int], list[int]]]:
    """Weights by the place of the space before the entry; the starts of the exception phrases, and the furthest end of each and all before it."""
    best, starts = {}, {}
    for end, (n, weight) in a.iter(f" {' '.join(words)} "):
        if weight is None:
            starts[end - n + 1] = max(end, starts.get(end - n + 1, 0))
        else:
            best[end - n + 1] = weight  # a longer entry ends later
    order = sorted(starts)
    return best, (order, list(accumulate((starts[x] for x in order), max)))


def _inside(free: tuple[list[int], list[int]], at: int) -> bool:
    k = bisect_right(free[0], at) - 1
    return k >= 0 and at < free[1][k]


def learn_lexicon(train: DataFrame) -> tuple:
    """((stem, weight), ...), from (text, y): counts of documents, made by each task and added up."""
    totals = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), sum(n for y, n in totals.items() if y != 1)
    if not n1 or not n0:
        return ()

    def count(only=None):
        def run(batches):
            c = Counter()
            for batch in batches:
                for text in batch.column(0):
                    found = stems(text.as_py())
                    c.update(found if only is None else found & only.value)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["stem", "n"])

        return run

    least = max(3, n1 // 1000)
    ones = train.where("y = 1").select("text").mapInArrow(count(), "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    ones = {r["stem"]: r["n"] for r in ones.collect()}
    only = train.sparkSession.sparkContext.broadcast(set(ones))
    zeros = train.where("y <> 1").select("text").mapInArrow(count(only), "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))
    zeros = {r["stem"]: r["n"] for r in zeros.collect()}

    def gain(p: int, q: int) -> float:
        """Twice the log-likelihood ratio of the stem and the label."""
        out = 0.0
        for a, b in ((p, p + q), (n1 - p, n1 + n0 - p - q)):
            for x, share in ((a, n1 / (n1 + n0)), (b - a, n0 / (n1 + n0))):
                if x > 0:
                    out += 2 * x * math.log(x / (b * share))
        return out

    chosen: dict[str, float] = {}
    for stem in sorted(ones, key=lambda s: (len(s), s)):
        p, q = ones[stem], zeros.get(stem, 0)
        weight = math.log((p + 0.5) / (n1 + 1)) - math.log((q + 0.5) / (n0 + 1))
        if weight >= 2.0 and gain(p, q) >= 15.0 and not any(stem[:k] in chosen and chosen[stem[:k]] >= weight - 0.7 for k in range(4, len(stem))):
            chosen[stem] = weight
    return tuple((s, round(chosen[s], 6)) for s in sorted(chosen))


def learn_exceptions(train: DataFrame, lexicon: tuple, least: int = 5) -> tuple:
    """Phrases of an entry's word and a neighbour that ``least`` documents of label 0 or more have, and for which the odds of label 1 are a third of the sample's or less."""
    totals = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), sum(n for y, n in totals.items() if y != 1)
    if not lexicon or not n1 or not n0:
        return ()

    def count(batches):
        a, found = _automaton(lexicon, ()), Counter()
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1)):
                words = fold(text.as_py()).split()
                at = np.cumsum([0, *(len(w) + 1 for w in words)])  # of the space before each word
                phrases = set()
                for place in _matches(a, words)[0]:
                    k = int(np.searchsorted(at, place))
                    phrases.update(" ".join(words[max(0, i) : i + 2]) for i in (k - 1, k) if 0 <= i < len(words) - 1)
                found.update((p, int(y.as_py() == 1)) for p in phrases)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([y for _, y in found], pa.int32()), pa.array(list(found.values()), pa.int64())], ["phrase", "y", "n"])

    by = train.select("text", "y").mapInArrow(count, "phrase string, y int, n long").groupBy("phrase").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("ones"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("zeros"))
    some = by.where((F.col("zeros") >= least) & ((F.col("ones") + 0.5) * 3 * n0 <= (F.col("zeros") + 0.5) * n1))
    return tuple(sorted(r["phrase"] for r in some.collect()))


def _terms(total, rate):
    return np.stack([np.ones_like(total), np.log1p(total), np.log1p(rate)], -1)


def calibrate(total: np.ndarray, rate: np.ndarray, y: np.ndarray, rounds: int = 30) -> list[float]:
    """A ridge logistic regression by Newton steps."""
    x, b = _terms(total, rate), np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        w = p * (1 - p) + 1e-9
        ridge = np.diag([1e-3, 0.1, 0.1])
        b = b + np.linalg.solve(x.T @ (x * w[:, None]) + ridge, x.T @ (y - p) - ridge @ b)
    return b.tolist()


def train_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = 20_000, exceptions: tuple = (), id_col: str = "doc_id", text_col: str = "text") -> dict:
    train = saved(training_rows(docs, labels, label_col, sample, id_col, text_col))
    lexicon = learn_lexicon(train)
    exceptions = (*exceptions, *learn_exceptions(train, lexicon))

    def measure(batches):
        for batch in batches:
            got = np.array([evidence(t.as_py(), lexicon, exceptions) for t in batch.column(0)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1]), batch.column(1)], ["total", "rate", "y"])

    rows = train.mapInArrow(measure, "total double, rate double, y int").toPandas()
    y = (rows["y"] == 1).to_numpy(float)
    if not lexicon:
        share = float(y.mean()) if len(y) else 0.0
        return {"lexicon": (), "exceptions": exceptions, "share": share, "terms": None}
    return {"lexicon": lexicon, "exceptions": exceptions, "share": float(y.mean()), "terms": calibrate(rows["total"].to_numpy(), rows["rate"].to_numpy(), y)}


def score_toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score)."""

    def score(batches):
        for batch in batches:
            got = np.array([evidence(t.as_py(), model["lexicon"], model["exceptions"]) for t in batch.column(1)]).reshape(-1, 2)
            if model["terms"] is None:
                p = np.full(len(got), model["share"])
            else:
                p = 1 / (1 + np.exp(-np.clip(_terms(got[:, 0], got[:, 1]) @ np.array(model["terms"]), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, "doc_id long, score double")
