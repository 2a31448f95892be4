import hashlib
import random
from bisect import bisect_left
from collections import Counter
from math import log2

import numpy as np
from brute import documents

from wayfold.llm.fingerprint import LEVELS, WINDOW, _below, _blocks, edited, entropy_classes, features, filters, fingerprints, likeness


def texts(n=40):
    rnd = random.Random(1)
    return ["".join(rnd.choice("abcdefgh é\n") for _ in range(rnd.choice([0, 1, 5, 30, 63, 64, 65, 200, 5000]))) for _ in range(n)]


def test_entropy_as_defined():
    raw = np.frombuffer("".join(texts()).encode()[:3000], np.uint8)
    got = entropy_classes(raw)
    for i in range(0, len(got), 37):
        c = Counter(raw[i : i + WINDOW].tolist()).values()
        h = log2(WINDOW) - sum(x * log2(x) for x in c) / WINDOW
        assert abs(got[i] - h / log2(WINDOW) * (LEVELS - 1)) <= 1.001


def test_features_do_not_depend_on_the_batch():
    rarity = np.random.default_rng(1).permutation(LEVELS)
    raw = [t.encode() for t in texts()]
    together = features(raw, rarity)
    for t, f in zip(raw, together):
        assert f.tolist() == features([t], rarity)[0].tolist()
        assert (len(f) > 0) == (len(t) > 0)
        assert likeness(filters(f), filters(f)) == 1.0


def test_next_and_edited(spark):
    rows = [(i * 7 % 41 * 10, t) for i, t in enumerate(texts(41))] + [(None, "no id"), (15, None)]
    order = sorted([r for r in rows if r[0] is not None], reverse=True, key=lambda r: r[0]) + [(None, "no id")]
    got = {r["doc_id"]: r for r in fingerprints(documents(spark, rows), block=6).collect()}
    assert len(got) == len(rows)
    for (d, t), (_, following) in zip(order, order[1:] + order[:1]):
        r = got[d]
        assert r["n_chars"] == len(t or "")
        assert r["edited_sha256"] == hashlib.sha256(edited(t or "", following or "").encode()).hexdigest()
    for r in got.values():
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_edge_cases(spark):
    assert fingerprints(documents(spark, [])).collect() == []
    one = fingerprints(documents(spark, [(1, "abc" * 100)])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    same = fingerprints(documents(spark, [(1, "abc" * 100)] * 3 + [(2, "abc" * 100)])).collect()
    assert len(same) == 4 and len({r["fingerprint"] for r in same}) == 1


def plain_digest(text, rarity):
    """Features by the definition: windows that are the rarest of 16 neighbourhoods of 64 windows or more."""
    raw = np.frombuffer(text.encode(), np.uint8)
    rank = rarity[entropy_classes(raw)]
    votes = Counter()
    for i in range(len(rank) - 63):
        votes[min(range(i, i + 64), key=lambda j: (rank[j], j))] += 1
    chosen = sorted(i for i, n in votes.items() if n >= 16) or [min(range(len(rank)), key=lambda j: (rank[j], j))]
    return list(dict.fromkeys(bytes(raw[i : i + WINDOW]) for i in chosen))


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    if (sum(n for n, _ in a), len(a)) > (sum(n for n, _ in b), len(b)):
        a, b = b, a
    best = []
    for n, x in a:
        got = []
        for _, y in b:
            chance, most = len(x) * len(y) / 2048, min(len(x), len(y))
            got.append(max(0.0, min(1.0, (len(x & y) - chance) / max(most - chance, 1e-9))))
        best.append(n * max(got))
    return sum(best) / sum(n for n, _ in a)


def parse(form):
    import base64

    out = []
    for part in form.split("|") if form else []:
        n, bits = part.split(":")
        out.append((int(n), frozenset(np.flatnonzero(np.unpackbits(np.frombuffer(base64.b64decode(bits), np.uint8))).tolist())))
    return out


def test_digests_and_likeness_as_defined(spark):
    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choice("abcdefgh .\n") for _ in range(rnd.choice([70, 400, 3000, 30_000])))) for i in range(10)]
    rows += [(10, rows[3][1][:2000] + rows[4][1]), (11, rows[3][1])]
    docs = documents(spark, rows)
    from wayfold.llm.fingerprint import class_counts

    total = np.zeros(LEVELS, np.int64)
    for _, t in rows:
        total += np.bincount(entropy_classes(np.frombuffer(t.encode(), np.uint8)), minlength=LEVELS)
    assert class_counts(docs).tolist() == total.tolist()
    rarity = np.empty(LEVELS, np.int64)
    rarity[np.lexsort((np.arange(LEVELS), total))] = np.arange(LEVELS)
    got = {r["doc_id"]: r for r in fingerprints(docs).collect()}
    order = sorted(rows, reverse=True)
    for (d, t), (e, _) in zip(order, order[1:] + order[:1]):
        r = got[d]
        own, changed, following = parse(r["fingerprint"]), parse(r["edited_fingerprint"]), parse(got[e]["fingerprint"])
        assert sum(n for n, _ in own) == len(plain_digest(t, rarity))
        assert abs(r["near_edited"] - plain_likeness(own, changed)) < 1e-6 and abs(r["near_next"] - plain_likeness(own, following)) < 1e-6
        want = features([t.encode()], rarity)[0]
        windows = plain_digest(t, rarity)
        assert len(want) == len(windows) == len(set(windows))
    assert got[3]["fingerprint"] == got[11]["fingerprint"]


def test_null_ids_and_other_columns(spark):
    rows = [(None, f"text without an id {i} " * 5) for i in range(50)] + [(None, None), (1, "x"), (1, "x")]
    docs = documents(spark, rows).withColumnsRenamed({"lang": "block", "source": "tie"})
    got = fingerprints(docs, block=8).collect()
    assert len(got) == len(rows) and len({r["edited_sha256"] for r in got}) >= 50


def test_blocks(spark):
    """Blocks of a thousand rows, growing with the root of the rows from ten million on; the lookup halves one folded literal."""
    assert [_blocks(n, 1000) for n in (0, 999, 5000, 10**7, 10**9, 10**11)] == [1, 1, 5, 10**4, 10**5, 10**6]
    rnd = random.Random(4)
    for size in (0, 1, 2, 7, 64, 1000):
        cuts = sorted(rnd.sample(range(-5000, 5000), size))
        ids = spark.createDataFrame([(i,) for i in [-(2**62), 2**62, *cuts[:50], *(rnd.randint(-6000, 6000) for _ in range(100))]], "id long")
        got = ids.withColumn("n", _below(cuts, ids["id"]))
        assert all(r["n"] == bisect_left(cuts, r["id"]) for r in got.collect())
        assert "split(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_any_number_of_blocks(spark):
    docs = documents(spark, list(enumerate(texts(60))))
    one, many = ({r["doc_id"]: tuple(r) for r in fingerprints(docs, block=n).collect()} for n in (1000, 1))
    assert one == many and len(one) == 60
