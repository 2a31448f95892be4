"""Plain forms of the operators, for small inputs."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in rows], DOCS)


def shingles(text, k):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def similar(rows, k, num, den):
    """(doc_id, n_shingles, component_id) of each row."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        if rows[i][0] is not None:
            for x in s:
                where[x].append(i)
    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        shared = collections.Counter(j for x in s for j in where[x] if j < i)
        for j, n in shared.items():
            if n * den >= num * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(s), None if d is None else least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def without_repeats(rows, window):
    """(doc_id, n_words, n_removed, sha256 of the rest)."""
    first = {}
    for d, t in rows:
        words = WORD.findall(t or "")
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if d is not None:
                first[key] = min(d, first.get(key, d))
    out = []
    for d, t in rows:
        words = WORD.findall(t or "")
        gone = set()
        for i in range(len(words) - window + 1):
            if d is not None and first[tuple(words[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
