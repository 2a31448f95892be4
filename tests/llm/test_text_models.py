import random

from brute import documents

from wayfold.llm.quality import encode, score_quality, scores_of, train_quality
from wayfold.llm.toxicity import evidence, fold, learn_exceptions, learn_lexicon, score_toxicity, stems, train_toxicity, training_rows

LABELS = "doc_id long, quality int, toxic int"


def made(n=400):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice(["an", "er", "th", "in", "ou", "re"]) for _ in range(rnd.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(20, 200))]
        toxic, bad = i % 7 == 0, i % 5 == 1
        if toxic:
            for _ in range(2):
                words[rnd.randrange(len(words))] = rnd.choice(["blockhead", "bl0ckhead", "nitwit", "nitw1ts", "NITWIT"])
        text = " ".join(w.upper() + "!!" if bad else w for w in words)
        rows.append((i, text))
        if i % 2 == 0 or toxic:
            labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def held(spark, scored, labels, col, cut):
    import zlib

    truth = {d: (q, t)[col] for d, q, t in labels if zlib.crc32(str(d).encode()) % 5 == 0}
    got = {r["doc_id"]: int(r["score"] >= cut) for r in scored.collect()}
    assert len(truth) > 20
    return sum(got[d] == y for d, y in truth.items()) / len(truth)


def test_held_out_accuracy(spark):
    rows, labels = made()
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, LABELS)
    assert held(spark, score_toxicity(docs, train_toxicity(docs, marks)), labels, 1, 0.5) > 0.95
    assert held(spark, score_quality(docs, train_quality(docs, marks)), labels, 0, 0.3) > 0.95


def test_folding_and_exceptions():
    assert fold("1D10T Ѕсum @ss ＡＢ") == "idiot scum ass ab"
    lexicon = (("clown", 2.0), ("clownish", 3.0), ("scum", 1.0))
    assert evidence("A clown, a CL0WNISH $cum", lexicon, ())[0] == 6.0
    assert evidence("the clown fish and a clown", lexicon, ("clown fish",))[0] == 2.0
    assert evidence("unclown", lexicon, ())[0] == 0.0
    assert evidence(None, lexicon, ()) == (0.0, 0.0)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "x" * 200_000), (3, "x" * 200_000), (None, "a")]
    docs = documents(spark, rows)
    for labels in ([], [(1, 1, 0), (2, None, None), (3, 0, 1), (3, 1, 0)]):
        marks = spark.createDataFrame(labels, LABELS)
        for scored in (score_toxicity(docs, train_toxicity(docs, marks)), score_quality(docs, train_quality(docs, marks))):
            got = scored.collect()
            assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
        assert score_toxicity(documents(spark, []), train_toxicity(documents(spark, []), marks)).collect() == []
        assert score_quality(documents(spark, []), train_quality(documents(spark, []), marks)).collect() == []


def test_passages_are_encoded_apart():
    import numpy as np

    texts = ["", "one two two", "é" * 600, "a b " * 400]
    x, counts = encode(texts)
    assert counts.tolist() == [1, 1, 2, 4]
    at = 0
    for t, c in zip(texts, counts):
        alone, n = encode([t])
        assert n[0] == c and np.allclose(alone, x[at : at + c])
        at += c
    assert scores_of(texts, {"share": 0.5}).tolist() == [0.5] * 4


def test_folding_of_forms_accents_and_hidden_signs():
    for spelling in ("id\u200biot", "\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d", "\u00eddi\u00f6t", "idi\u0301ot", "ID\u00adIOT", "1d10t"):
        assert fold(spelling) == "idiot", spelling
    assert "ass " in stems("an ass") and "an " in stems("an ass") and "idio" in stems("idiots") and "idiots" in stems("idiots")


def plain_evidence(text, lexicon, exceptions):
    """Every entry at every place, every phrase over every place."""
    words = fold(text).split()
    line = f" {' '.join(words)} "
    free = [(i, i + len(p) + 1) for p in exceptions for i in range(len(line)) if line.startswith(f" {p} ", i)]
    total = 0.0
    for i in range(len(line)):
        fits = [(len(s), w) for s, w in lexicon if line.startswith(" " + s, i)]
        if fits and not any(a <= i < b for a, b in free):
            total += max(fits)[1]
    return total, 1000 * total / max(100, len(words)) if words else 0.0


def test_scan_as_brute_force():
    rnd = random.Random(8)
    lexicon = (("ab ", 1.5), ("abab", 2.0), ("ababa", 3.0), ("baba", 0.25), ("cc ", 4.0))
    exceptions = ("abab cc", "cc ab cc", "ab")
    for _ in range(300):
        text = " ".join("".join(rnd.choice("abc") for _ in range(rnd.choice([1, 2, 2, 4, 5, 6]))) for _ in range(rnd.randint(0, 30)))
        text += rnd.choice(["", " abab cc ab", " cc ab cc ab cc"])
        got, want = evidence(text, lexicon, exceptions), plain_evidence(text, lexicon, exceptions)
        assert abs(got[0] - want[0]) < 1e-9 and abs(got[1] - want[1]) < 1e-9


def test_long_texts_take_time_in_proportion():
    import time

    start = time.time()
    assert evidence("clown fish " * 100_000 + "clown", (("clown", 2.0),), ("clown fish",))[0] == 2.0
    assert time.time() - start < 10


def test_exceptions_are_learned(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice(["an", "er", "th", "in", "ou", "re"]) for _ in range(rnd.randint(2, 4)))
    rows, labels = [], []
    for i in range(600):
        words = [word() for _ in range(30)]
        kind = i % 6
        if kind == 0:
            words[3] = "clown"
        elif kind == 1:
            words[5:7] = ["ass", "hat"]
        elif i % 24 == 8:
            words[8:10] = ["clown", "fish"]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(kind < 2)))
    train = training_rows(documents(spark, rows), spark.createDataFrame(labels, LABELS), "toxic", 10_000)
    lexicon = learn_lexicon(train)
    assert any(s.startswith("clow") for s, _ in lexicon) and "ass " in dict(lexicon)
    assert learn_exceptions(train, lexicon) == ("clown fish",)


def test_training_is_bounded(spark):
    """A doc_id on very many rows gives one text; a document whose passages exceed what is left is passed over."""
    rows = [(1, f"text {i}") for i in range(500)] + [(2, "good words " * 30), (3, "BAD!! " * 30), (4, "x" * 100_000)]
    marks = spark.createDataFrame([(i, int(i != 3), 0) for i in (1, 2, 3, 4)], LABELS)
    docs = documents(spark, rows)
    assert training_rows(docs, marks, "quality", 100).count() <= 4
    model = train_quality(docs, marks, passages=10)
    assert "share" in model
    assert score_quality(docs, model).count() == len(rows)
