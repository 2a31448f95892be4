"""Line dedup: repeated runs of lines, by a suffix array over line-ID sequences.

A document is the sequence of its lines that are not blank. Lines that occur once in the corpus end a sequence (they are in no
repeated run), so only the others are sorted. The suffix array is made by distributed prefix doubling: the rank of a suffix's first 2h lines is that of
the pair (rank of its first h lines, rank of the suffix h lines further on). Pairs are counted, sorted by range and numbered in order; no step has a single task or a driver loop over rows.
Doubling goes on until no suffix shares its prefix, so to the longest repeated run; a suffix whose first h lines are no other's has its place and leaves.

Suffixes with equal first lines are neighbours in the array: those of equal rank at a length of ``h`` lines are an interval of longest common prefixes of ``h`` or more.
A common prefix of any length is covered by two intervals of the power of two below it, so the intervals of all lengths, together, cover every maximal repeated run from end to end. Of each interval the first
suffix in (doc_id, line) order stays, and the interval's lines at every other one are deleted, from ``min_lines`` lines on: these are all later copies of maximal repeated runs.
With ``min_words``, a run of fewer than ``min_lines`` lines counts too if it has at least so many words (what stands between white space; a line in a script
without spaces has few): later copies of its lines are deleted in the same way, length by length. Without it, shorter runs stay, however long their lines.
``later_runs`` gives the deleted runs, ``maximal_runs`` the repeated runs themselves, from the common prefixes of neighbours in the whole array.

Blank lines go with the line before them. Cases: a null text stays null and has no lines; empty texts stay; of repeated rows (equal doc_id and text) none is earlier, so they
lose nothing to each other; rows of a null doc_id are left alone and no source of copies; other columns stay as they are, whatever their names, but for such as
are named like the two result columns (``counts``), which these replace; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import free_name, saved

KEY = ["_doc", "_tie"]
WORD = r"[^\x20\x09-\x0D]+"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> list:
    return [F.col(id_col).cast("long").alias("_doc"), F.xxhash64(text_col).alias("_tie")]


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int | None = None) -> DataFrame:
    """(_doc, _tie, pos, a, b): the lines that are not blank; a and b are 128 bits of the line. With ``min_words`` also ``words``, how many the line has."""
    lines = F.filter(F.split(F.col(text_col), "\n", -1), lambda x: F.trim(x) != "")
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(*_keyed(docs, id_col, text_col), F.posexplode(lines).alias("pos", "line"))
    words = [] if min_words is None else [F.regexp_count("line", F.lit(WORD)).alias("words")]
    return rows.select(*KEY, "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit("#"), "line").alias("b"), *words).distinct()


def numbered(keys: DataFrame, *cols: str) -> DataFrame:
    """``keys`` with a number ``r`` that rises in the order of ``cols``: the range a row falls into, then its place there."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(keys.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("r", F.monotonically_increasing_id()))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int | None = None) -> DataFrame:
    """(_doc, _tie, pos, rem, r, and words with ``min_words``): lines that occur twice or more, how many such lines follow at once (itself included), and the line's ID."""
    rows = saved(line_rows(docs, id_col, text_col, min_words))
    ids = numbered(rows.groupBy("a", "b").count().where("count > 1").select("a", "b"), "a", "b")
    rows = rows.join(ids, ["a", "b"]).drop("a", "b")
    by = Window.partitionBy(*KEY)
    rows = rows.withColumn("_run", F.col("pos") - F.row_number().over(by.orderBy("pos")))
    return saved(rows.withColumn("rem", (F.max("pos").over(Window.partitionBy(*KEY, "_run")) - F.col("pos") + 1).cast("int")).drop("_run"))


def _ahead(ranks: DataFrame, rows: DataFrame, by: int, name: str) -> DataFrame:
    """``rows`` with the rank ``by`` lines further on in the same run; -1 beyond its end."""
    there = ranks.select(*KEY, (F.col("pos") - by).alias("pos"), F.col("r").alias(name))
    inside = F.col("rem") > by
    return rows.join(there, [*KEY, "pos"], "left").withColumn(name, F.when(inside, F.col(name)).otherwise(F.lit(-1)))


def suffix_ranks(lines: DataFrame, least: int | None = None) -> list[DataFrame]:
    """Ranks of the suffixes by their first 1, 2, 4, ... lines. Doubling ends at ``least`` lines, by default at the longest run of repeated lines: that is the whole suffix array."""
    levels = [lines]
    h = 1
    if least is None:
        least = lines.agg(F.max("rem")).first()[0] or 0
    while h < least:
        pairs = _ahead(levels[-1], levels[-1], h, "r2")
        keys = numbered(pairs.groupBy("r", "r2").count().drop("count").withColumnsRenamed({"r": "p", "r2": "q"}), "p", "q")
        levels.append(saved(pairs.join(keys, (pairs["r"] == keys["p"]) & (pairs["r2"] == keys["q"])).select(*KEY, "pos", "rem", keys["r"])))
        h *= 2
    return levels


def interval_levels(lines: DataFrame) -> list[DataFrame]:
    """Of the lengths 1, 2, 4, ... up to the longest repeated run: (_doc, _tie, pos, rem, r, first) of the suffixes that share so many first lines with another:
    the interval's rank, and its first place in (doc_id, line) order. The first table has no ``first``."""
    levels, h = [lines], 1
    while True:
        top = levels[-1].select(*KEY, "pos", "rem", "r")
        there = top.select(*KEY, (F.col("pos") - h).alias("pos"), F.col("r").alias("r2"))
        pairs = saved(top.where(F.col("rem") >= 2 * h).join(there, [*KEY, "pos"]))
        shared = pairs.groupBy("r", "r2").agg(F.min(F.struct(*KEY, "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
        keys = numbered(shared.select(F.col("r").alias("p"), F.col("r2").alias("q"), "first"), "p", "q")
        if keys.isEmpty():
            return levels
        level = pairs.join(keys, (pairs["r"] == keys["p"]) & (pairs["r2"] == keys["q"])).select(*KEY, "pos", "rem", keys["r"], "first")
        levels.append(saved(level))
        h *= 2


def later_copies(lines: DataFrame, min_lines: int, min_words: int | None = None) -> DataFrame:
    """(_doc, _tie, pos, n): the ``n`` lines at ``pos`` also start at an earlier place. n is a power of two, or ``min_lines``, or less than that where the lines have ``min_words`` words;
    it is the greatest of these for each place."""
    levels = interval_levels(lines)
    place = F.struct(*KEY, "pos")

    def copies(n: int) -> DataFrame:
        half = 1 << (n.bit_length() - 1)  # the longest ranked prefix within n lines; two of them overlap to cover it
        if n.bit_length() > len(levels):
            return lines.where("false").select(*KEY, "pos", F.lit(n).alias("n"))
        top = levels[n.bit_length() - 1]
        rows = top.where(F.col("rem") >= n)
        if n < min_lines:
            ahead = Window.partitionBy(*KEY).orderBy(F.col("pos").cast("long")).rangeBetween(0, n - 1)
            enough = lines.withColumn("words", F.sum("words").over(ahead)) if n > 1 else lines
            enough = enough.where((F.col("rem") >= n) & (F.col("words") >= min_words))
            rows = rows.join(enough.select(*KEY, "pos"), [*KEY, "pos"], "left_semi") if n > 1 else enough
        if half == n > 1:
            return rows.where(place != F.col("first")).select(*KEY, "pos", F.lit(n).alias("n"))
        if half < n:
            rows = rows.drop("first").join(top.select(*KEY, (F.col("pos") - (n - half)).alias("pos"), F.col("r").alias("r2")), [*KEY, "pos"])
        else:
            rows = rows.withColumn("r2", F.lit(-1))
        first = rows.groupBy("r", "r2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("r").alias("p"), F.col("r2").alias("q"), "first")
        return rows.join(first, (F.col("r") == F.col("p")) & (F.col("r2") == F.col("q"))).where(place != F.col("first")).select(*KEY, "pos", F.lit(n).alias("n"))

    out = copies(min_lines)
    for n in range(1, min_lines if min_words is not None else 1):
        out = out.union(copies(n))
    for k, level in enumerate(levels):
        if 1 << k > min_lines:
            out = out.union(level.where(place != F.col("first")).select(*KEY, "pos", F.lit(1 << k).alias("n")))
    return out.groupBy(*KEY, "pos").agg(F.max("n").alias("n"))


def later_runs(docs: DataFrame, min_lines: int = 2, min_words: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_doc, _tie, runs: array of (pos, length)): what is deleted of each document, as runs of lines that don't touch."""
    cuts = later_copies(repeated_lines(docs, id_col, text_col, min_words), min_lines, min_words)
    found = F.array_sort(F.collect_list(F.struct("pos", F.col("n").cast("int").alias("length"))))

    def grow(acc, x):
        last = acc["last"]
        end = last["pos"] + last["length"]
        longer = F.struct(last["pos"].alias("pos"), F.greatest(last["length"], x["pos"] - last["pos"] + x["length"]).alias("length"))
        joined = F.struct(acc["done"].alias("done"), longer.alias("last"))
        apart = F.struct(F.when(last["length"] > 0, F.concat(acc["done"], F.array(last))).otherwise(acc["done"]).alias("done"), x.alias("last"))
        return F.when((last["length"] > 0) & (x["pos"] <= end), joined).otherwise(apart)

    run = "struct<pos:int,length:int>"
    start = F.struct(F.array().cast(f"array<{run}>").alias("done"), F.struct(F.lit(0).alias("pos"), F.lit(0).alias("length")).cast(run).alias("last"))
    merged = F.aggregate("found", start, grow, lambda acc: F.concat(acc["done"], F.array(acc["last"])))
    return cuts.groupBy(*KEY).agg(found.alias("found")).select(*KEY, merged.alias("runs"))


def maximal_runs(docs: DataFrame, min_lines: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tie, pos, length): repeated runs that can be made longer at neither end; pos counts lines that are not blank.

    A suffix's longest repeated run is its longest common prefix with a neighbour in the suffix array; prefixes are compared level by level, the longest first."""
    lines = repeated_lines(docs, id_col, text_col)
    levels = suffix_ranks(lines)
    last = levels[-1]
    # neighbours that have equal ranks in the end are equal; others are the last of one rank and the first of the next
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = saved(last.repartitionByRange(n, "r", *KEY, "pos").sortWithinPartitions("r", *KEY, "pos").withColumn("at", F.monotonically_increasing_id()))
    here = Window.partitionBy(F.shiftright("at", 33)).orderBy("at")
    who = F.struct(*KEY, "pos")
    near = ordered.withColumn("before", F.lag(who).over(here))
    # the first row of a range has its neighbour in the range before: one row for each range
    heads = near.where("before is null").select("at", *KEY, "pos", "rem", "r")
    tails = ordered.groupBy(F.shiftright("at", 33).alias("range")).agg(F.max(F.struct("at", who.alias("who"))).alias("t")).select("t.at", "t.who")
    heads = heads.join(F.broadcast(tails.select(F.col("at").alias("tail"), "who")), F.col("tail") < F.col("at"), "left").groupBy(*KEY, "pos", "rem").agg(F.max_by("who", "tail").alias("before"))
    pairs = near.where("before is not null").select(*KEY, "pos", "rem", "before").union(heads.where("before is not null").select(*KEY, "pos", "rem", "before"))
    state = pairs.select(*KEY, "pos", "rem", F.col("before._doc").alias("d2"), F.col("before._tie").alias("t2"), F.col("before.pos").alias("p2"), F.lit(0).alias("off"))
    for k in reversed(range(len(levels))):
        level = levels[k].select(F.col("_doc").alias("_d"), F.col("_tie").alias("_t"), F.col("pos").alias("_p"), "r", F.col("rem").alias("_rem"))
        one, two = (level.withColumnsRenamed({c: f"{c}_{s}" for c in level.columns}) for s in "xy")
        state = state.join(one, (F.col("_doc") == F.col("_d_x")) & (F.col("_tie") == F.col("_t_x")) & (F.col("pos") + F.col("off") == F.col("_p_x")) & (F.col("off") < F.col("rem")), "left")
        state = state.join(two, (F.col("d2") == F.col("_d_y")) & (F.col("t2") == F.col("_t_y")) & (F.col("p2") + F.col("off") == F.col("_p_y")), "left")
        grown = F.least(F.col("off") + (1 << k), F.col("rem"))
        state = saved(state.withColumn("off", F.when(F.col("r_x") == F.col("r_y"), grown).otherwise(F.col("off"))).select(*KEY, "pos", "rem", "d2", "t2", "p2", "off"))
    both = state.select(*KEY, "pos", "off").union(state.select("d2", "t2", "p2", "off"))
    longest = both.groupBy(*KEY, "pos").agg(F.max("off").alias("length")).where(F.col("length") >= min_lines)
    left = F.lag(F.struct("pos", "length")).over(Window.partitionBy(*KEY).orderBy("pos"))
    inner = (left["pos"] == F.col("pos") - 1) & (left["length"] > F.col("length"))
    return longest.withColumn("_inner", F.coalesce(inner, F.lit(False))).where("not _inner").select(F.col("_doc").alias("doc_id"), F.col("_tie").alias("tie"), "pos", "length")


def line_dedup(docs: DataFrame, min_lines: int = 2, id_col: str = "doc_id", text_col: str = "text", min_words: int | None = None, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from ``text_col``, and the columns that ``counts`` names: how many lines were there and how many are deleted
    (of lines that are not blank). A run has ``min_lines`` lines, or ``min_words`` words, or more."""
    docs = docs.drop(*counts)
    names = docs.columns
    doc, tie, cut_col = (free_name(names, x) for x in ("_doc", "_tie", "_cut"))
    runs = later_runs(docs, min_lines, min_words, id_col, text_col).toDF(doc, tie, cut_col)
    keyed = docs.withColumns({doc: F.col(id_col).cast("long"), tie: F.xxhash64(text_col)})
    joined = keyed.join(runs, [doc, tie], "left").select(*names, cut_col)
    at = names.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(counts[0], LongType()), StructField(counts[1], LongType())])

    def cut(batches):
        for batch in batches:
            texts, lines, removed = [], [], []
            for text, starts in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                rows = [] if text is None else text.split("\n")
                full = [i for i, x in enumerate(rows) if x.strip(" ")]
                lines.append(len(full))
                if not starts:
                    texts.append(text)
                    removed.append(0)
                    continue
                first, n = (np.asarray([x[c] for x in starts]) for c in ("pos", "length"))
                edge = np.zeros(len(full) + 1, np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + n, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                kept, drop, k = [], False, 0
                for x in rows:
                    if x.strip(" "):
                        drop = bool(gone[k])
                        k += 1
                    if not drop:
                        kept.append(x)
                texts.append("\n".join(kept))
            cols = batch.columns[: len(names)]
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], [*names, *counts])

    return joined.mapInArrow(cut, schema)
