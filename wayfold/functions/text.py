"""Name functions: normalisation as an expression, and Jaro-Winkler similarity."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType


@lru_cache(maxsize=1)
def _decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition leaves one ASCII letter, digit or space, and those that leave several.

    Blocks that came after Unicode 13 are left out, so that the table does not depend on the version that this Python knows."""
    one, many = {}, {}
    later = {*range(0xA7F2, 0xA7F5), *range(0x10780, 0x107C0), *range(0x1E030, 0x1E090)}
    for code in range(128, 0x110000):
        if 0xD800 <= code < 0xE000 or code in later:
            continue
        c = chr(code)
        form = unicodedata.normalize("NFKD", c)
        if form == c:
            continue
        left = "".join(x for x in form if x.isascii() and (x.isalnum() or x in " \t\n\x0b\f\r"))
        if len(left) == 1:
            one[c] = left
        elif left:
            many[c] = left
    return one, many


def normalize_name(name: Column) -> Column:
    """Compatibility decomposition, without marks and signs, in lower case, white space collapsed.

    A character's decomposition does not depend on its neighbours and all that is not ASCII goes, so it is a map of characters.
    All of the map's characters are outside ASCII, so other names are not held against its long class."""
    one, many = _decompositions()
    table = F.lit(list(many)), F.lit(list(many.values()))
    several = F.aggregate(F.arrays_zip(table[0].alias("a"), table[1].alias("b")), name, lambda acc, x: F.replace(acc, x["a"], x["b"]))
    mapped = F.translate(F.when(name.rlike("[" + "".join(many) + "]"), several).otherwise(name), "".join(one), "".join(one.values()))
    name = F.when(name.rlike(r"[^\x00-\x7F]"), mapped).otherwise(name)
    kept = F.lower(F.regexp_replace(name, r"[^a-zA-Z0-9\s]", ""))
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def split_names(value: Column) -> Column:
    """The parts between semicolons, trimmed, blank ones dropped; null gives none."""
    parts = F.transform(F.split(value, ";"), lambda x: F.trim(x))
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def jaro_winkler_of(a: str, b: str) -> float:
    """Half transpositions count as halves; the boost is a tenth for each of up to four equal first characters, from a Jaro of 0.7."""
    if a == b:
        return 1.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    reach = max(len(long) // 2 - 1, 0)
    used, matched = [False] * len(long), []
    for i, c in enumerate(short):
        for j in range(max(0, i - reach), min(len(long), i + reach + 1)):
            if not used[j] and long[j] == c:
                used[j] = True
                matched.append(c)
                break
    m = len(matched)
    if not m:
        return 0.0
    other = [long[j] for j in range(len(long)) if used[j]]
    moved = sum(x != y for x, y in zip(matched, other)) / 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro < 0.7:
        return jaro
    same = 0
    while same < min(4, len(short)) and a[same] == b[same]:
        same += 1
    return jaro + 0.1 * same * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_of(x, y) for x, y in zip(a, b)], dtype="float64")


def _at_most(a: list[str], b: list[str]) -> np.ndarray:
    """Bounds above the similarities of a[i] and b[i], from the characters that they share, in any order, and their equal first ones."""
    texts, which = np.unique(np.array([*a, *b], object), return_inverse=True)
    size = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32) & 63
    shared = np.zeros((len(texts), 64), np.int32)
    np.add.at(shared, (np.repeat(np.arange(len(texts)), size), codes), 1)
    head = np.array([[ord(c) for c in t[:4]] + [-1] * (4 - len(t[:4])) for t in texts]).reshape(-1, 4)
    x, y = which[: len(a)], which[len(a) :]
    m = np.minimum(shared[x], shared[y]).sum(1)
    jaro = (m / np.maximum(size[x], 1) + m / np.maximum(size[y], 1) + 1) / 3
    same = np.logical_and.accumulate((head[x] == head[y]) & (head[x] >= 0), 1).sum(1)
    return np.where(x == y, 1.0, jaro + 0.1 * same * (1 - jaro))


def jaro_winkler_from(least: float):
    """A function of two columns: whether their similarity is ``least`` or more; no where one is null."""

    @F.pandas_udf(BooleanType())
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        out = (a.notna() & b.notna()).to_numpy()
        one, two = a[out].tolist(), b[out].tolist()
        if one:
            may = _at_most(one, two) > least - 1e-9
            out[out] = [ok and jaro_winkler_of(x, y) >= least for ok, x, y in zip(may.tolist(), one, two)]
        return pd.Series(out)

    return similar


def may_be_similar(a: Column, b: Column) -> Column:
    """Whether a Jaro-Winkler similarity of 0.9 is possible by lengths alone: it needs a Jaro of 5/6, that needs lengths in a ratio of 1/2."""
    return F.least(F.length(a), F.length(b)) * 2 >= F.greatest(F.length(a), F.length(b))
