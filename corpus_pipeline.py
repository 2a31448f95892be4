"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Every stage but the last returns the columns of ``documents``, and others that its input has, whatever their names; the last returns the packed pieces.

Cases: null texts and ids pass the classifier as the model scores an empty text, line dedup and the Jaccard join leave them alone; a doc_id on several texts is several documents;
of equal rows (doc_id and text) that have words, the Jaccard join keeps one; empty tables give empty results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import free_name, saved, table
from wayfold.llm.decontaminate import decontaminated
from wayfold.llm.jaccard import similarity_groups
from wayfold.llm.linededup import line_dedup
from wayfold.llm.packing import pack
from wayfold.llm.quality import score_quality, train_quality

#: Rows of 16 bytes that may be broadcast (some tens of MB with their hash table).
FEW_ROWS = 500_000

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.3) go."""
    score = free_name(docs.columns, "score")
    scored = score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")), score_col=score)
    return scored.where(F.col(score) >= 0.3).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of two lines or 50 words go, and documents of which nothing but blanks is left."""
    total, removed = free_name(docs.columns, "n_lines"), free_name(docs.columns, "n_removed")
    out = line_dedup(docs, min_lines=2, min_words=50, counts=(total, removed))
    gone = (F.col(removed) > 0) & (F.col(removed) == F.col(total))
    changed = F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where(~gone).withColumn("n_chars", changed).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of five-word shingles (0.8 or more) join, the one with the smallest doc_id (then the smallest hash of its text) stays; of equal rows, one of them."""
    row = ["doc_id", "text_hash"]
    groups = saved(similarity_groups(docs, shingle=5, threshold=(80, 100)).where("component is not null"))
    first = groups.groupBy("component").agg(F.min(F.struct(*row)).alias("first"))
    several = groups.groupBy("component", *row).agg(F.count("*").alias("n")).join(first, "component")
    later = saved(several.where(F.struct(*row) != F.col("first")).select(*row))
    equal = several.where((F.struct(*row) == F.col("first")) & (F.col("n") > 1)).select(*row)
    at = free_name(docs.columns, "text_hash")
    keyed = docs.withColumn(at, F.xxhash64("text"))
    later = later.withColumnRenamed("text_hash", at)
    if later.count() <= FEW_ROWS:  # else both sides are dealt by row
        later = F.broadcast(later)
    kept = keyed.join(later, ["doc_id", at], "left_anti")
    if not equal.isEmpty():
        equal = saved(equal).withColumnRenamed("text_hash", at)
        once = kept.join(equal, ["doc_id", at], "left_semi").dropDuplicates(["doc_id", at])
        kept = kept.join(equal, ["doc_id", at], "left_anti").unionByName(once)
    return kept.select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark), ("packing", packing)]

#: SQL can't express the classifier, so run() is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
