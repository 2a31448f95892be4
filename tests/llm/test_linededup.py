import random

import pytest
from brute import documents
from pyspark.sql import functions as F

from wayfold.llm.linededup import interval_levels, later_runs, line_dedup, maximal_runs, repeated_lines


def brute(rows, m):
    seqs = {}
    for d, t in rows:
        if d is not None and t is not None:
            seqs[(d, t)] = [x for x in t.split("\n") if x.strip(" ")]
    first = {}
    for (d, t), s in seqs.items():
        for i in range(len(s) - m + 1):
            w = tuple(s[i : i + m])
            first[w] = min(first.get(w, (d, i, t)), (d, i, t), key=lambda p: p[:2])
    out = []
    for d, t in rows:
        if t is None or d is None:
            out.append((d, t))
            continue
        s, gone = seqs[(d, t)], set()
        for i in range(len(s) - m + 1):
            if first[tuple(s[i : i + m])][:2] != (d, i):
                gone.update(range(i, i + m))
        kept, k, drop = [], 0, False
        for x in t.split("\n"):
            if x.strip(" "):
                drop, k = k in gone, k + 1
            if not drop:
                kept.append(x)
        out.append((d, "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("m", [1, 2, 3])
def test_as_brute_force(spark, m):
    rnd = random.Random(m)
    pool = [f"line {i}" for i in range(12)] + ["", "  "]
    runs = [[rnd.choice(pool) for _ in range(6)] for _ in range(3)]
    rows = []
    for i in range(60):
        s = []
        for _ in range(rnd.randint(0, 4)):
            s += rnd.choice(runs) if rnd.random() < 0.4 else [rnd.choice(pool) if rnd.random() < 0.3 else f"own {rnd.random()}" for _ in range(3)]
        rows.append((i * 7 % 61, "\n".join(s)))
    got = sorted(((r["doc_id"], r["text"]) for r in line_dedup(documents(spark, rows), m).collect()), key=str)
    assert got == brute(rows, m)


def test_edge_cases(spark):
    copy = "a\nb\nc"
    rows = [(1, None), (2, ""), (3, copy), (4, copy), (4, copy), (None, copy), (5, "\n".join(["same"] * 3000)), (6, "x\n" * 2)]
    got = sorted(((r["doc_id"], r["text"]) for r in line_dedup(documents(spark, rows), 2).collect()), key=str)
    assert got == sorted([(1, None), (2, ""), (3, copy), (4, ""), (4, ""), (None, copy), (5, "same"), (6, "x\nx\n")], key=str)
    assert line_dedup(documents(spark, []), 2).collect() == []
    extra = documents(spark, rows).withColumnsRenamed({"lang": "pos", "source": "r"})
    assert line_dedup(extra, 2).columns == [*extra.columns, "n_lines", "n_removed"]


def test_maximal_runs(spark):
    rows = [(1, "a\nb\nc\nx1"), (2, "y\na\nb\nc"), (3, "b\nc\nz\nq1\nq2"), (4, "q1\nq2")]
    got = sorted((r["doc_id"], r["pos"], r["length"]) for r in maximal_runs(documents(spark, rows), 2).collect())
    assert got == [(1, 0, 3), (2, 1, 3), (3, 0, 2), (3, 3, 2), (4, 0, 2)]


def brute_words(rows, m, least):
    """Like ``brute``, for runs of ``m`` lines or of ``least`` words."""
    seqs = {(d, t): [x for x in t.split("\n") if x.strip(" ")] for d, t in rows}
    places = {}
    for (d, t), s in seqs.items():
        for n in range(1, m + 1):
            for i in range(len(s) - n + 1):
                w = tuple(s[i : i + n])
                if n == m or sum(len(x.split()) for x in w) >= least:
                    places.setdefault(w, []).append((d, i, t))
    gone = {key: set() for key in seqs}
    for w, found in places.items():
        for d, i, t in sorted(found)[1:]:
            gone[(d, t)].update(range(i, i + len(w)))
    return sorted((d, "\n".join(x for k, x in enumerate(seqs[(d, t)]) if k not in gone[(d, t)])) for d, t in rows)


@pytest.mark.parametrize("m", [2, 3, 4])
def test_long_lines_as_brute_force(spark, m):
    rnd = random.Random(m)
    pool = [" ".join(f"w{i}" for _ in range(rnd.choice([1, 3, 4, 6, 7, 12]))) for i in range(25)]
    rows = []
    for i in range(60):
        rows.append((i * 7 % 61, "\n".join(rnd.choice(pool) if rnd.random() < 0.5 else f"own {rnd.random()}" for _ in range(rnd.randint(1, 8)))))
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup(documents(spark, rows), m, min_words=7).collect())
    assert got == brute_words(rows, m, 7)
    assert got != brute(rows, m)


def test_pipeline_deletes_long_single_lines(spark):
    import corpus_pipeline

    long, short = " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"a\n{long}\nb\n{short}"), (2, f"c\n{long}\nd\n{short}"), (3, long)]
    got = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in corpus_pipeline.lines(spark, documents(spark, rows), "").collect())
    kept = f"c\nd\n{short}"
    assert [x[:2] for x in got] == [rows[0], (2, kept)] and got[1][2] == len(kept)


def test_runs_reach_the_longest_copy(spark):
    rnd = random.Random(5)
    long = [f"l{i}" for i in range(37)]
    rows = [(1, "\n".join(["a", *long, "b"])), (2, "\n".join(["c", *long[3:30], "d", *long[5:9]])), (3, "\n".join([*long, "e"]))]
    rows += [(10 + i, "\n".join(f"own {rnd.random()}" for _ in range(5))) for i in range(10)]
    docs = documents(spark, rows)
    levels = interval_levels(repeated_lines(docs))
    assert len(levels) == 6  # 1, 2, 4, 8, 16 and 32 lines
    runs = {r["_doc"]: [tuple(x) for x in r["runs"]] for r in later_runs(docs, 2).collect()}
    assert runs == {2: [(1, 27), (29, 4)], 3: [(0, 37)]}
    # every suffix of an interval has the same lines
    text = {d: t.split("\n") for d, t in rows}
    for k, level in enumerate(levels):
        got = {}
        for r in level.collect():
            got.setdefault(r["r"], set()).add(tuple(text[r["_doc"]][r["pos"] : r["pos"] + (1 << k)]))
        assert all(len(x) == 1 for x in got.values()) and len(got) == len(set().union(*got.values()))


def test_clashing_names(spark):
    rows = [(1, "a\nb\nc"), (2, "a\nb\nd"), (2, "a\nb\nd"), (None, "a\nb"), (3, None)]
    extra = documents(spark, rows).withColumnsRenamed({"lang": "_doc", "source": "_cut"}).withColumn("_tie", F.lit(7)).withColumn("N_removed", F.lit("x"))
    out = line_dedup(extra, 2)
    assert out.columns == ["doc_id", "text", "_doc", "_cut", "n_chars", "_tie", "n_lines", "n_removed"]
    assert sorted(((r["doc_id"], r["text"], r["n_removed"], r["_tie"]) for r in out.collect()), key=str) == sorted([(1, "a\nb\nc", 0, 7), (2, "d", 2, 7), (2, "d", 2, 7), (None, "a\nb", 0, 7), (3, None, 0, 7)], key=str)
    assert line_dedup(extra, 2, counts=("x", "y")).columns == [*extra.columns, "x", "y"]
