"""Building the merged-place dataset, the daily metrics and the ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..constants import CITIES, SHARD_LINES, WINDOW_DAYS
from ..functions.time import midnight_ms
from ..operators.metrics import combo_metrics, impressions, merged_days, place_metrics, sessions_before, window
from ..operators.prefix_index import build_index
from ..operators.resolve import resolve
from ..schemas import COMBO_METRICS, MERGED_POI, PLACE_METRICS, PLACE_SELECTION, PREFIX_SEARCH
from ..sources.protocol import fetch_all
from ..tables import saved
from . import snapshot


#: Places of one JSON array document.
ARRAY_PLACES = 10_000


def build_dataset(spark: SparkSession, sources, boxes=tuple(CITIES.values())) -> DataFrame:
    return resolve(fetch_all(spark, sources, list(boxes)))


def write_places(places: DataFrame, path: str, json: bool = False) -> dict:
    """Writes Parquet and, with ``json``, array documents of about ``ARRAY_PLACES`` places under ``<path>_json``; returns counts that the write itself observed."""
    seen = Observation("places")
    places = places.observe(seen, F.count("*").alias("places"), F.count_if(F.size("sources") > 1).alias("from several sources"))
    places.write.mode("overwrite").parquet(path)
    counts = seen.get
    if json:
        n = max(1, -(-counts["places"] // ARRAY_PLACES))
        rows = places.sparkSession.read.schema(MERGED_POI).parquet(path).select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("document"), F.to_json(F.struct("*")).alias("value"))
        documents = rows.groupBy("document").agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ",\n"), F.lit("]")).alias("value"))
        documents.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(f"{path}_json")
    return counts


def read_places(spark: SparkSession, path: str, json: bool = False) -> DataFrame:
    """Parquet, or JSON array documents."""
    reader = spark.read.schema(MERGED_POI)
    return reader.option("multiLine", True).json(path) if json else reader.parquet(path)


def read_events(spark: SparkSession, root: str, kind: str, run_date: str) -> DataFrame:
    """Landed events of the day before ``run_date`` and of its first hour; bad lines are dropped."""
    schema = {"prefix-search": PREFIX_SEARCH, "place-selection": PLACE_SELECTION}[kind]
    rows = spark.read.schema(f"{schema}, event_type string, date string, hour string").option("mode", "DROPMALFORMED").option("basePath", root).json(f"{root}/event_type={kind}")
    day = F.to_date(F.lit(run_date))
    yesterday = F.date_format(F.date_sub(day, 1), "yyyy-MM-dd")
    return rows.where((F.col("date") == yesterday) | ((F.col("date") == run_date) & (F.col("hour") == "00"))).where("sessionId is not null").drop("event_type", "date", "hour")


def collect_metrics(spark: SparkSession, events: str, out: str, run_date: str) -> None:
    """Writes the day's two metric tables; a rerun replaces that day alone."""
    searches, selections = (read_events(spark, events, k, run_date) for k in ("prefix-search", "place-selection"))
    midnight = midnight_ms(F.lit(run_date))
    shown = saved(impressions(searches, selections, sessions_before(searches, selections, midnight)))
    day = F.date_sub(F.to_date(F.lit(run_date)), 1)
    for name, rows in (("combo", combo_metrics(shown)), ("place", place_metrics(shown))):
        rows.withColumn("date", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{out}/{name}")


def rebuild(spark: SparkSession, places: DataFrame, metrics: str, snapshots: str, run_date: str, run_id: str, mode: str = "sum", days: int = WINDOW_DAYS, normalize_prefix: bool = False) -> str:
    """Builds the ranking of the window and publishes it; returns the version."""
    daily = {k: spark.read.schema(f"{s}, date date").parquet(f"{metrics}/{k}") for k, s in (("combo", COMBO_METRICS), ("place", PLACE_METRICS))}
    daily = {k: window(v, run_date, days) for k, v in daily.items()}
    if normalize_prefix:
        from ..functions.text import normalize_name

        daily["combo"] = daily["combo"].withColumn("prefix", normalize_name(F.col("prefix")))
    combos, by_place = merged_days(daily["combo"], ["prefix", "placeId"], mode), merged_days(daily["place"], ["placeId"], mode)
    return snapshot.publish(build_index(places, combos, by_place), snapshots, f"{run_date}-{run_id}", SHARD_LINES)
