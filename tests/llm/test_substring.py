import hashlib
import random

import pytest
from brute import documents, without_repeats

from wayfold.llm import substring
from wayfold.llm.substring import substring_dedup

#: Both ways to look anchors up: in the broadcast sketch, and dealt to the blocks of a written one.
WAYS = pytest.mark.parametrize("most", [28, 0], ids=["broadcast", "dealt"])


def got(spark, rows, window, most=28):
    out = substring_dedup(documents(spark, rows), window, broadcast_bits=most).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in out), key=str)


@WAYS
def test_as_brute_force(spark, most):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(40)] + ["é", "x\x0b", "\xa0"]
    passages = [[rnd.choice(vocab) for _ in range(rnd.randint(45, 130))] for _ in range(4)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rnd.randint(0, 4)):
            words += rnd.choice(passages) if rnd.random() < 0.5 else [rnd.choice(vocab) for _ in range(rnd.randint(0, 60))]
        rows.append((i * 7 % 113, rnd.choice([" ", "\n", "  "]).join(words)))
    assert got(spark, rows, 50, most) == sorted(without_repeats(rows, 50), key=str)


@WAYS
def test_edge_cases(spark, most):
    long = " ".join(f"t{i % 997}" for i in range(30000))
    rows = [(3, None), (4, ""), (5, "a b"), (9, long), (8, long), (8, long), (None, long), (7, "q " * 200)]
    assert got(spark, rows, 50, most) == sorted(without_repeats(rows, 50), key=str)
    assert got(spark, [], 50, most) == []


@WAYS
def test_few_false_hits(spark, most, monkeypatch):
    """Of windows that do not repeat, few pass, whichever way they are looked up."""
    rnd = random.Random(5)
    rows = [(i, " ".join(str(rnd.randrange(10**6)) for _ in range(1000))) for i in range(300)]
    seen = []
    scan = substring._scan
    monkeypatch.setattr(substring, "_scan", lambda docs, how, window, want: seen.append((want, scan(docs, how, window, want))) or seen[-1][1])
    substring_dedup(documents(spark, rows), 50, broadcast_bits=most)
    assert dict(seen)["windows"].count() < 0.05 * 300 * 951


def test_the_sketch_grows_with_the_text():
    """Five cells or more for each anchor (one in about 78 bytes), at ten times the broadcast bound and far beyond too."""
    for total in (10**9, 27 * 10**9, 10**14):
        assert 2 ** substring.sketch_bits(total) >= 5 * total / 78


def test_texts_are_hashed_twice_and_windows_sorted_once(spark):
    """One scan for the sketch, one for the windows; then a pass over sorted windows and one over the words that stay."""
    out = substring_dedup(documents(spark, [(i, "a b c " * 30) for i in range(9)]), 50)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 3


def test_later_windows_across_batches(spark):
    rnd = random.Random(7)
    rows = [(rnd.randrange(5), rnd.randrange(2), rnd.randrange(-3, 30), i, i % 7) for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = substring._later(spark.createDataFrame(rows, "h1 long, h2 int, doc_id long, whole long, at int")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    least = {}
    for h1, h2, doc, _, _ in rows:
        least[h1, h2] = min(doc, least.get((h1, h2), doc))
    assert sorted(map(tuple, got)) == sorted((doc, whole, at) for h1, h2, doc, whole, at in rows if doc > least[h1, h2])
