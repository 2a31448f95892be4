import random

import pytest
from brute import documents, similar

from wayfold.llm.jaccard import similarity_components


def got(spark, rows, **more):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in similarity_components(documents(spark, rows), **more).collect()), key=str)


def near_copies(seed, n=260):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    base = [[rnd.choice(vocab) for _ in range(rnd.choice([12, 40, 90]))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            words[rnd.randrange(len(words))] = rnd.choice(vocab + ["Neu", "É"])
        rows.append((i * 3 % 701, " ".join(words)))
    return rows


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_as_brute_force(spark, k, num, monkeypatch):
    import wayfold.llm.jaccard as j

    monkeypatch.setattr(j, "CHUNK", 40)  # several chunks a list
    rows = near_copies(num)
    assert got(spark, rows, shingle=k, threshold=(num, 100)) == sorted(similar(rows, k, num, 100), key=str)


def test_edge_cases(spark):
    rows = [(5, None), (4, ""), (9, "a b"), (3, "A B"), (2, " \t\n"), (None, "x y z"), (8, "x y z"), (7, "x y z"), (7, "x y z"), (1, "word " * 30000)]
    assert got(spark, rows, shingle=3, threshold=(90, 100)) == sorted(similar(rows, 3, 90, 100), key=str)
    assert got(spark, [], shingle=3, threshold=(90, 100)) == []
