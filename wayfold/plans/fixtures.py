"""Places, tags and sessions derived from the driver's tables by arithmetic, as SQL that Spark and DuckDB read alike.

``{div}`` is integer division; names in braces are tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import POI

NAME = "p_name || ' ' || lower(p_type) || ' ' || CAST(p_partkey % 7 AS STRING)"
LAT = "CAST(40.50 AS DOUBLE) + CAST(p_partkey % 40 AS DOUBLE) * CAST(0.01 AS DOUBLE)"
LON = "CAST(-74.25 AS DOUBLE) + CAST((p_partkey {div} 40) % 50 AS DOUBLE) * CAST(0.01 AS DOUBLE)"
SHIFT = "CAST(p_partkey % 9 AS DOUBLE) * CAST(0.0001 AS DOUBLE)"
CATEGORY = "CASE p_partkey % 6 WHEN 0 THEN 'cafe' WHEN 1 THEN 'museum' WHEN 2 THEN 'temple' WHEN 3 THEN 'bar' WHEN 4 THEN 'laundry' ELSE 'university' END"
SIGNALS = "CAST(p_partkey % 50 + 50 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence, CAST(p_partkey % 5 AS INT) AS signals, p_partkey % 11 = 0 AS wiki, p_partkey % 2 = 0 AS web"

PLACES = f"""
SELECT 'OVERTURE:ov-' || CAST(p_partkey AS STRING) AS rid, 'OVERTURE' AS source, p_partkey, {NAME} AS name, {LAT} AS lat, {LON} AS lon, {CATEGORY} AS category, {SIGNALS} FROM {{part}}
UNION ALL
SELECT 'OSM:osm-' || CAST(p_partkey AS STRING), 'OSM', p_partkey,
  CASE p_partkey % 4 WHEN 0 THEN upper({NAME}) || '!' WHEN 1 THEN p_name || ' ' || lower(p_type) WHEN 2 THEN 'zz ' || reverse(p_name) ELSE {NAME} END,
  {LAT} + {SHIFT}, {LON} + {SHIFT}, {CATEGORY}, CAST(1.0 AS DOUBLE), CAST(1 AS INT), p_partkey % 11 = 0, p_partkey % 2 = 0
FROM {{part}} WHERE p_partkey % 3 = 0
"""

TAGS = """
SELECT p_partkey AS id,
  CASE p_partkey % 7 WHEN 0 THEN 'place_of_worship' WHEN 1 THEN 'cafe' WHEN 2 THEN 'bench' WHEN 3 THEN 'townhall' END AS amenity,
  CASE p_partkey % 5 WHEN 0 THEN 'hindu' WHEN 1 THEN 'sikh' END AS religion,
  CASE p_partkey % 3 WHEN 0 THEN 'deli' WHEN 1 THEN 'shoes' END AS shop,
  CASE p_partkey % 11 WHEN 0 THEN 'museum' WHEN 1 THEN 'guest_house' END AS tourism,
  CASE p_partkey % 13 WHEN 0 THEN 'park' END AS leisure,
  CASE p_partkey % 17 WHEN 0 THEN 'station' WHEN 1 THEN 'subway_entrance' END AS railway,
  CASE p_partkey % 2 WHEN 0 THEN 'yes' END AS subway,
  CASE p_partkey % 19 WHEN 0 THEN 'aerodrome' END AS aeroway,
  CASE p_partkey % 23 WHEN 0 THEN 'monument' WHEN 1 THEN 'ruins' END AS historic,
  p_name AS name, p_name || ';  ; ' || p_brand AS alt_name, p_type AS official_name
FROM {part}
"""

H = "(user_id * 17 + {day} * 31)"
SEARCHES = f"""
SELECT 's' || CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS sessionId,
  substr('abcdefgh', 1, CAST(1 + event_id % 6 AS INT)) AS prefix, i AS rank, 'p' || CAST(({H} + event_id % 3 + i) % 40 AS STRING) AS placeId,
  {{ms}} AS timestampMs, CAST(ts AS DATE) AS date
FROM {{events}} CROSS JOIN {{ranks}} WHERE event_type <> 'purchase'
"""
CHOICES = f"""
SELECT 's' || CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS sessionId, 'p' || CAST(({H} + 2) % 40 AS STRING) AS placeId, {{ms}} AS timestampMs, CAST(ts AS DATE) AS date
FROM {{events}} WHERE event_type = 'purchase'
"""

SPARK = {"div": "div", "day": "day(ts)", "ms": "unix_millis(CAST(ts AS TIMESTAMP))", "ranks": "(SELECT explode(sequence(0, 4)) AS i)", "part": "{part}", "events": "{events}"}
DUCK = {"div": "//", "day": "day(ts)", "ms": "epoch_us(ts) // 1000", "ranks": "(SELECT unnest(range(0, 5)) AS i)", "part": "part", "events": "events"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spark_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    sql = sql.format(**SPARK)
    names = [n for n in ("part", "events") if "{" + n + "}" in sql]
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def duck_sql(sql: str) -> str:
    return sql.format(**DUCK)


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``schemas.POI`` rows."""
    rows = _spark_sql(spark, sf_dir, PLACES)
    out = rows.select(
        F.substring_index("rid", ":", -1).alias("source_id"), "name", F.col("name").alias("displayName"), F.array().cast("array<string>").alias("aliases"), "category", "confidence", "lat", "lon", "source",
        F.col("signals").alias("sourceSignalCount"), F.col("wiki").alias("hasWikiEntry"), F.col("web").alias("hasWebPresence"),
    )
    assert out.columns == [c.split()[0] for c in POI.split(", ")]
    return out


def tag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, tags): rows of a tag map without null values."""
    rows = _spark_sql(spark, sf_dir, TAGS)
    tags = F.map_filter(F.create_map(*[x for c in rows.columns[1:] for x in (F.lit(c), F.col(c))]), lambda k, v: v.isNotNull())
    return rows.select("id", tags.alias("tags"))


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type <> 'purchase'")
    h = F.expr(H.format(**SPARK))
    results = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat(F.lit("p"), ((h + F.col("event_id") % 3 + i) % 40).cast("string")))
    return _session(rows).withColumns({"prefix": F.expr("substr('abcdefgh', 1, CAST(1 + event_id % 6 AS INT))"), "resultIds": results, "userLat": F.lit(40.7), "userLng": F.lit(-74.0)}).select("sessionId", "prefix", "resultIds", "userLat", "userLng", "timestampMs", "date")


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    chosen = F.concat(F.lit("p"), ((F.expr(H.format(**SPARK)) + 2) % 40).cast("string"))
    return _session(rows).withColumn("placeId", chosen).select("sessionId", "placeId", "timestampMs", "date")


def _session(rows: DataFrame) -> DataFrame:
    day = F.col("ts").cast("date")
    return rows.withColumns({"sessionId": F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit("-"), day.cast("string")), "timestampMs": F.expr(SPARK["ms"]), "date": day})
