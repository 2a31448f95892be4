
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import AMENITY, BLEND, DESTINATIONS, EARTH_M, LEISURE, NEAR_M, RELIGION, SHOP, TOURISM, USABLE_CATEGORIES
from ..functions.geo import CELL_LAT, CELL_LON, grid_col, grid_row, haversine_m
from ..functions.text import normalize_name
from ..functions.time import midnight_ms
from ..operators import metrics as m
from ..operators import prefix_index as ix
from ..operators import resolve as rs
from ..schemas import REQUEST
from ..sources import osm
from ..sources.overture import places as overture_places
from ..tables import saved, shared_dir
from . import fixtures as fx
from . import serve, snapshot

BOX = (-74.10, 40.55, -73.90, 40.75)
MIDNIGHT = "2024-01-16"
RUN_DATE = "2024-01-31"
REQUESTS = [(1, "a", 5, 40.7, -74.0, "s1"), (2, "Bl", 10, 40.6, -74.2, "s2"), (3, "  GR", 3, 40.55, -74.1, ""), (4, "s", 0, 40.7, -74.0, "s4"), (5, "nothing like it", 5, 40.7, -74.0, "s5"), (6, "st", 100, 40.5, -73.9, "s6")]


def _keyed(spark, d):
    return rs.with_keys(fx.pois(spark, d))


def _r(c, n=6):
    return F.round(c, n)


def scan_poi_bbox(spark: SparkSession, d: str) -> DataFrame:  # C1 C3a C4 C5
    p = fx.pois(spark, d)
    nested = p.select(
        F.col("source_id").alias("id"), F.struct(F.col("name").alias("primary"), F.lit(None).cast("array<struct<language:string,value:string>>").alias("rules")).alias("names"), F.struct(F.col("category").alias("primary")).alias("categories"), "confidence",
        F.struct(F.col("lon").alias("xmin"), F.col("lon").alias("xmax"), F.col("lat").alias("ymin"), F.col("lat").alias("ymax")).alias("bbox"), F.lit(None).cast("array<struct<dataset:string>>").alias("sources"), F.lit(None).cast("array<string>").alias("websites"), F.lit(None).cast("array<string>").alias("socials"), F.lit(None).cast("struct<wikidata:string>").alias("brand"),
    )
    return overture_places(nested, [BOX]).select("source_id", "name", "category", _r("lat").alias("lat"), _r("lon").alias("lon"))


def osm_category_rules(spark, d):  # C7-C9
    rows = fx.tag_rows(spark, d)
    return rows.select("id", osm.category(F.col("tags")).alias("category")).where("category is not null")


def alias_derivation(spark, d):  # C10 I10
    rows = fx.tag_rows(spark, d)
    return rows.select("id", F.posexplode(osm.aliases(F.col("tags"), F.col("tags")["name"])).alias("pos", "alias"))


def normalize_names(spark, d):  # I1
    p = fx.pois(spark, d)
    return p.select("source_id", normalize_name(F.concat(F.lit("Café  "), F.col("name"), F.lit(" L'Ópera-2 "))).alias("norm"))


def grid_cells(spark, d):  # I8
    return fx.pois(spark, d).select("source_id", grid_row(F.col("lat")).alias("grid_row"), grid_col(F.col("lon")).alias("grid_col"))


def haversine_pairs(spark, d):  # I2
    p = _keyed(spark, d)
    return rs.near_pairs(p).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), _r("distance").alias("distance"))


def name_match_pairs(spark, d):  # D1-D3 D11 I9
    p = saved(_keyed(spark, d))
    return rs.matching_pairs(p).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def clusters(spark, d):  # E1
    p = saved(_keyed(spark, d))
    return rs.clusters(p, rs.links(p)).select("rid", "cluster")


def _merged(spark, d):
    return rs.resolve(fx.pois(spark, d))


def merged_pois(spark, d):  # E2
    p = _merged(spark, d)
    return p.select("id", "display_name", F.array_join("normalizedAliases", ";").alias("aliases"), F.array_join("categories", ";").alias("categories"), _r("confidence").alias("confidence"), _r("lat").alias("lat"), _r("lng").alias("lng"), F.array_join("sources", ";").alias("sources"), _r("seedScore").alias("seed_score"))


def prefix_explode(spark, d):  # J1 J7 I11
    return ix.prefixes(_merged(spark, d)).groupBy("prefix").agg(F.count("*").alias("n_places"), _r(F.max("seedScore")).alias("best_seed"))


def prefix_topk_seed(spark, d):  # J3 G2 F4
    rows = ix.prefixes(_merged(spark, d)).withColumn("score", _r("seedScore"))
    return ix.top_places(rows)


def _shown(spark, d, kept=None):
    s, c = fx.searches(spark, d), fx.selections(spark, d)
    kept = kept if kept is not None else m.sessions_before(s, c, F.lit(1 << 62))
    return m.impressions(s, c, kept)


def session_filter(spark, d):  # E3 C21
    kept = m.sessions_before(fx.searches(spark, d), fx.selections(spark, d), midnight_ms(F.lit(MIDNIGHT)))
    return kept.select("sessionId", "startMs")


def combo_metrics(spark, d):  # E4 E5 D8 F1
    return m.combo_metrics(_shown(spark, d)).withColumn("sumReciprocalRank", _r("sumReciprocalRank"))


def place_metrics(spark, d):  # E6 F2 F3 G1
    return m.place_metrics(_shown(spark, d))


def prefix_totals(spark, d):  # E7
    return m.prefix_totals(m.combo_metrics(_shown(spark, d)))


def _daily(spark, d):
    shown = _shown(spark, d).withColumn("date", F.to_date(F.substring_index("sessionId", "-", -3)))
    hit = F.col("placeId") == F.col("chosen")
    return shown.groupBy("prefix", "placeId", "date").agg(F.count("*").alias("impressions"), F.count_if(hit).alias("selections"), F.count_if(F.col("chosen").isNull()).alias("abandonmentCounter"))


def window_merge_sum(spark, d):  # E8 E10 H5
    return m.merged_days(m.window(_daily(spark, d), RUN_DATE, 10), ["prefix", "placeId"])


def window_merge_oldest(spark, d):  # E8 F6
    return m.merged_days(m.window(_daily(spark, d), RUN_DATE, 10), ["prefix", "placeId"], "oldest_day")


def _seeds(spark, d):
    """Forty places p0..p39 for the prefixes of the sessions."""
    ids = spark.range(40).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"), (F.col("id") * 0.5).alias("seedScore"))
    return ids.crossJoin(F.broadcast(spark.range(1, 8).select(F.expr("substr('abcdefgh', 1, CAST(id AS INT))").alias("prefix")))).select("prefix", "id", "seedScore")


def _blended(spark, d):
    shown = saved(_shown(spark, d))
    return ix.blended_scores(_seeds(spark, d), m.combo_metrics(shown), m.place_metrics(shown)).withColumn("score", _r("score"))


def blended_scores(spark, d):  # I5-I7 E9 D4-D6 J2
    return _blended(spark, d).select("prefix", "id", "score")


def prefix_topk_blended(spark, d):  # J2 F4
    return ix.top_places(_blended(spark, d), 10)


def search_prefix(spark, d):  # K1 D9 D10 I3 I4 G4 F5 C18
    places = saved(_merged(spark, d))
    found = serve.search_batch(spark.createDataFrame(REQUESTS, REQUEST), ix.build_index(places), places)
    return found.select("request_id", "rank", "id", "display_name", _r("score").alias("score"))


def place_details(spark, d):  # K2
    places = saved(_merged(spark, d))
    return serve.details_batch(places.select("id"), places).select("id", "display_name", _r("seedScore").alias("seed_score"), F.size("sources").alias("n_sources"))


def event_landing_partitions(spark, d):  # B2 I14 L4 L5
    from ..streaming.landing import to_landed

    rows = fx.searches(spark, d).select(F.lit("prefix-search").alias("event_type"), F.to_json(F.struct("sessionId", "prefix", "timestampMs")).alias("value"))
    more = fx.selections(spark, d).select(F.lit("place-selection").alias("event_type"), F.to_json(F.struct("sessionId", "placeId", "timestampMs")).alias("value"))
    return to_landed(rows.union(more)).groupBy("event_type", "date", "hour").agg(F.count("*").alias("n"))


def landed_stream_counts(spark, d):  # A5-A7 A11 L1-L4 B7
    import uuid

    from ..streaming.landing import emit, file_events, land

    root = f"{shared_dir(spark)}/wayfold/{uuid.uuid4().hex}"
    emit(fx.searches(spark, d).drop("date"), "prefix-search", root=f"{root}/in")
    emit(fx.selections(spark, d).drop("date"), "place-selection", root=f"{root}/in")
    query = land(file_events(spark, f"{root}/in"), f"{root}/out", f"{root}/checkpoint", once=True)
    query.awaitTermination()
    rows = spark.read.schema("sessionId string, event_type string, date string, hour string").option("mode", "DROPMALFORMED").json(f"{root}/out")
    return rows.groupBy("event_type", "date").agg(F.count("*").alias("n"))


def snapshot_roundtrip(spark, d):  # B5 B6 A8 A9 J6 L9
    import uuid

    root = f"{shared_dir(spark)}/wayfold/{uuid.uuid4().hex}"
    rows = ix.prefixes(_merged(spark, d)).withColumn("score", _r("seedScore"))
    snapshot.publish(ix.to_index(ix.top_places(rows)), root, "v1")
    handle = snapshot.IndexHandle(spark, root)
    handle.refresh()
    return handle.current.select("prefix", F.posexplode("places").alias("rank", "p")).select("prefix", (F.col("rank") + 1).alias("rank"), "p.id", "p.score")


def _folder(spark) -> str:
    import uuid

    return f"{shared_dir(spark)}/wayfold/{uuid.uuid4().hex}"


#: The corners of two boxes that meet, one the wrong way round.
BOXES = [(-74.10, 40.55, -73.90, 40.75), (-73.95, 40.85, -74.20, 40.70)]
CITY = "theme=places/type=place"


class _Broken:
    def fetch(self, spark, boxes):
        return spark.read.parquet(f"{_folder(spark)}/nothing")


def source_scan(spark, d):  # A1 A3 C1-C7 C10-C15 H1-H3
    """Two written sources and one that fails: nested Parquet in a partitioned folder, and two extracts of tagged nodes."""
    from ..sources.overture import OvertureSource
    from ..sources.protocol import fetch_all

    root = _folder(spark)
    p = fx.pois(spark, d).withColumn("k", F.substring_index("source_id", "-", -1).cast("long"))
    k, half, text = F.col("k"), F.lit(0.0005), lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    rule = lambda language, value: F.struct(F.lit(language).cast("string").alias("language"), value.alias("value"))
    title = F.when(k % 10 == 9, F.lit(" ")).otherwise(F.col("name"))
    rules = F.array(rule("fr", F.lit("non")), rule(None, text(F.col("name"), "; also ")), rule("en", F.lit("en " ";")), rule("en", F.lit(None).cast("string")))
    nested = p.where("source = 'OVERTURE'").select(
        F.col("source_id").alias("id"), F.struct(title.alias("primary"), F.when(k % 2 == 0, rules).alias("rules")).alias("names"), F.struct(F.col("category").alias("primary")).alias("categories"), F.when(k % 4 > 0, F.col("confidence")).alias("confidence"),
        F.struct(F.col("lon").alias("xmin"), (F.col("lon") + half).alias("xmax"), F.col("lat").alias("ymin"), (F.col("lat") + half).alias("ymax")).alias("bbox"), F.when(k % 5 > 0, F.array_repeat(F.struct(F.lit("x").alias("dataset")), (k % 5).cast("int"))).alias("sources"),
        F.when(k % 2 == 0, F.array().cast("array<string>")).alias("websites"), F.when(k % 3 == 0, F.array(F.lit("s"))).alias("socials"), F.struct(F.when(k % 11 == 0, F.lit("Q1")).alias("wikidata")).alias("brand"),
    )
    nested.write.parquet(f"{root}/ov/{CITY}")
    nested.limit(0).write.parquet(f"{root}/ov/theme=other/type=none")
    tags = F.map_filter(F.create_map(*[x for n, v in {"name": title, "amenity": F.when(k % 4 == 1, F.lit("bar")).when(k % 4 == 2, F.lit("cafe")), "historic": F.when(k % 4 == 3, F.lit("ruins")), "alt_name": text(F.col("name"), "; also"), "wikidata": F.when(k % 11 == 0, F.lit("Q1")), "website": F.when(k % 2 == 0, F.lit("w"))}.items() for x in (F.lit(n), v)]), lambda a, b: b.isNotNull())
    nodes = p.where("source = 'OSM'").select(k.alias("id"), F.when(k % 7 == 3, F.lit("way")).otherwise(F.lit("node")).alias("kind"), "lat", "lon", tags.alias("tags"))
    for part in range(2):
        nodes.where(k % 2 == part).write.parquet(f"{root}/osm{part}")
    sources = [OvertureSource(f"{root}/ov/{CITY}", f"{root}/ov"), _Broken(), osm.OsmSource([f"{root}/osm0", f"{root}/osm1"], "parquet")]
    found = fetch_all(spark, sources, BOXES)
    return found.select("source_id", "name", F.array_join("aliases", "|").alias("aliases"), "category", _r("confidence").alias("confidence"), _r("lat").alias("lat"), _r("lon").alias("lon"), "source", F.col("sourceSignalCount").alias("signals"), F.col("hasWikiEntry").alias("wiki"), F.col("hasWebPresence").alias("web"))


def _landed(spark, d) -> str:
    """The folder of all events, landed by the stream, with a line that is no JSON and a blank one."""
    from ..streaming.landing import emit, file_events, land

    root = _folder(spark)
    emit(fx.searches(spark, d).drop("date"), "prefix-search", root=f"{root}/in")
    emit(fx.selections(spark, d).drop("date"), "place-selection", root=f"{root}/in")
    land(file_events(spark, f"{root}/in"), f"{root}/out", f"{root}/checkpoint", once=True).awaitTermination()
    for kind in ("prefix-search", "place-selection"):
        bad = spark.createDataFrame([("{broken",), ("",)], "value string")
        bad.coalesce(1).write.mode("append").text(f"{root}/out/event_type={kind}/date=2024-01-15/hour=07")
    return root


def _daily_tables(spark, d, days) -> str:
    from . import dataset

    root = _landed(spark, d)
    for run_date in days:
        dataset.collect_metrics(spark, f"{root}/out", f"{root}/metrics", run_date)
    return root


def daily_combo_metrics(spark, d):  # A6 A7 B4 C16 C20 D7 H4 L7 I15 M3
    root = _daily_tables(spark, d, ["2024-01-16"])
    rows = spark.read.parquet(f"{root}/metrics/combo")
    return rows.withColumns({"date": F.col("date").cast("string"), "sumReciprocalRank": _r("sumReciprocalRank")})


def daily_place_metrics(spark, d):  # the same for places, after a rerun of the day (B4)
    root = _daily_tables(spark, d, ["2024-01-15", "2024-01-16", "2024-01-16"])
    return spark.read.parquet(f"{root}/metrics/place").withColumn("date", F.col("date").cast("string"))


def _named_places(spark):
    """Forty merged places p0..p39 whose names begin with the sessions' prefixes."""
    n = F.col("id")
    blank = F.array().cast("array<string>")
    return spark.range(40).select(
        F.concat(F.lit("p"), n.cast("string")).alias("id"), F.concat(F.lit("ABC-def-"), F.chr(F.lit(103) + n % 3)).alias("display_name"), blank.alias("normalizedAliases"), F.array(F.lit("cafe")).alias("categories"), F.lit(1.0).alias("confidence"),
        F.lit(40.7).alias("lat"), F.lit(-74.0).alias("lng"), F.array(F.lit("OSM")).alias("sources"), (n * 0.5).alias("seedScore"),
    )


def rebuild_index(spark, d):  # A4 A9 A13 B1 B5 B6 E10 E13 J4 K4
    from . import dataset

    root = _daily_tables(spark, d, ["2024-01-15", "2024-01-16", "2024-01-17"])
    dataset.write_places(_named_places(spark), f"{root}/places", json=True)
    places = dataset.read_places(spark, f"{root}/places_json", json=True)
    dataset.rebuild(spark, places, f"{root}/metrics", f"{root}/snapshots", "2024-01-17", "r1", days=2)
    handle = snapshot.IndexHandle(spark, f"{root}/snapshots")
    handle.refresh()
    return handle.current.select("prefix", F.explode("places").alias("p")).select("prefix", "p.id", _r(F.col("p.score")).alias("score"))


def seed_bootstrap(spark, d):  # A14: metrics that know nothing yet give capped popularity
    index = ix.bootstrap_index(_named_places(spark))
    return index.select("prefix", F.explode("places").alias("p")).select("prefix", "p.id", _r(F.col("p.score")).alias("score"))


def place_lookup(spark, d):  # A10 B8
    from . import store

    root = _folder(spark)
    store.put(_merged(spark, d), f"{root}/store")
    every = spark.read.parquet(f"{root}/store").select("id")
    ids = every.unionByName(every).unionByName(spark.createDataFrame([("no such place",)], "id string"))
    return store.get_many(ids, f"{root}/store").select("id", "display_name", _r("lat").alias("lat"), _r("lng").alias("lng"), F.array_join("sources", ";").alias("sources"))


def named_functions(spark, d):  # M5
    from ..functions.registry import register

    register(spark)
    fx.pois(spark, d).createOrReplaceTempView("wayfold_pois")
    return spark.sql("SELECT source_id, grid_row(lat) AS grid_row, grid_col(lon) AS grid_col, round(haversine_m(lat, lon, 40.7D, -74.0D), 6) AS metres, is_near(haversine_m(lat, lon, 40.7D, -74.0D)) AS near FROM wayfold_pois")


def queries() -> dict:
    names = "scan_poi_bbox osm_category_rules alias_derivation normalize_names grid_cells haversine_pairs name_match_pairs clusters merged_pois prefix_explode prefix_topk_seed session_filter combo_metrics place_metrics prefix_totals window_merge_sum window_merge_oldest blended_scores prefix_topk_blended search_prefix place_details event_landing_partitions landed_stream_counts snapshot_roundtrip source_scan daily_combo_metrics daily_place_metrics rebuild_index seed_bootstrap place_lookup named_functions"
    return {n: globals()[n] for n in names.split()}


# --- DuckDB SQL ---------------------------------------------------------------


def _case(column: str, mapping: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_NORM = "trim(regexp_replace(lower(regexp_replace(strip_accents({x}), '[^a-zA-Z0-9\\s]', '', 'g')), '\\s+', ' ', 'g'))"
_HAV = f"CAST({2 * EARTH_M} AS DOUBLE) * atan2(sqrt(h), sqrt(1 - h))"
_H = "pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.{lon} - {a}.{lon}) / 2), 2)"

_PLACES = f"places AS ({fx.duck_sql(fx.PLACES)})"
_NEAR = f"""{_PLACES},
keyed AS (SELECT *, {_NORM.format(x="name")} AS norm, CASE source WHEN 'OVERTURE' THEN 0 ELSE 1 END AS prio FROM places),
near AS (SELECT *, {_HAV} AS distance FROM (
  SELECT a.rid AS a, b.rid AS b, a.norm AS na, b.norm AS nb, {_H.format(a="a", b="b", lon="lon")} AS h
  FROM keyed a JOIN keyed b ON a.rid < b.rid AND abs(a.lat - b.lat) < 0.001 AND abs(a.lon - b.lon) < 0.001) WHERE {_HAV} <= {NEAR_M})"""
_MATCH = f"{_NEAR},\nmatched AS (SELECT a, b FROM near WHERE na = nb OR jaro_winkler_similarity(na, nb) >= 0.9)"
_CLUSTER = f"""{_MATCH},
edges AS (SELECT a, b FROM matched UNION ALL SELECT b, a FROM matched),
reach AS (SELECT a AS x, a AS y FROM edges UNION SELECT r.x, e.b FROM reach r JOIN edges e ON r.y = e.a),
comps AS (SELECT k.*, coalesce(c.m, rid) AS cluster FROM keyed k LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) c ON k.rid = c.x)"""
_MERGED = f"""{_CLUSTER},
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY prio, rid) AS k FROM comps),
fused AS (SELECT cluster, sha256(string_agg(rid, '|' ORDER BY rid)) AS id, min(CASE WHEN k = 1 THEN name END) AS display_name, max(confidence) AS confidence, avg(lat) AS lat, avg(lon) AS lng,
  max(confidence) * count(DISTINCT source) + 0.1 * sum(signals) + CASE WHEN bool_or(wiki) THEN 2.0 ELSE 0 END + CASE WHEN bool_or(web) THEN 0.5 ELSE 0 END + CASE WHEN bool_or(category IN {_in(DESTINATIONS)}) THEN 1.5 ELSE 0 END AS seed_score
  FROM ranked GROUP BY cluster),
alias_rows AS (SELECT cluster, norm, min(k) AS k FROM ranked WHERE k > 1 GROUP BY cluster, norm),
alias_of AS (SELECT cluster, string_agg(norm, ';' ORDER BY k) AS aliases FROM alias_rows GROUP BY cluster),
category_rows AS (SELECT cluster, category, min(k) AS k FROM ranked GROUP BY cluster, category),
category_of AS (SELECT cluster, string_agg(category, ';' ORDER BY k) AS categories FROM category_rows GROUP BY cluster),
source_rows AS (SELECT cluster, source, min(k) AS k FROM ranked GROUP BY cluster, source),
source_of AS (SELECT cluster, string_agg(source, ';' ORDER BY k) AS sources, count(*) AS n_sources FROM source_rows GROUP BY cluster),
merged AS (SELECT f.*, coalesce(aliases, '') AS aliases, categories, sources, n_sources FROM fused f LEFT JOIN alias_of USING (cluster) JOIN category_of USING (cluster) JOIN source_of USING (cluster))"""
_PREFIX = f"""{_MERGED},
names AS (SELECT id, seed_score, {_NORM.format(x="display_name")} AS name FROM merged UNION SELECT m.id, m.seed_score, a.norm FROM merged m JOIN alias_rows a USING (cluster)),
prefixes AS (SELECT DISTINCT substr(name, 1, CAST(k AS INT)) AS prefix, id, seed_score FROM (SELECT id, seed_score, name, unnest(range(1, length(name) + 1)) AS k FROM names WHERE name <> '')),
top AS (SELECT * FROM (SELECT prefix, id, round(seed_score, 6) AS score, row_number() OVER (PARTITION BY prefix ORDER BY round(seed_score, 6) DESC, id) AS rank FROM prefixes) WHERE rank <= 100)"""
_SHOWN = f"""searches AS ({fx.duck_sql(fx.SEARCHES)}),
choices AS ({fx.duck_sql(fx.CHOICES)}),
chosen AS (SELECT sessionId, placeId AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY sessionId ORDER BY timestampMs DESC, placeId DESC) AS k FROM choices) WHERE k = 1),
shown AS (SELECT s.*, chosen FROM searches s LEFT JOIN chosen USING (sessionId)),
combos AS (SELECT prefix, placeId, coalesce(sum(CASE WHEN placeId = chosen THEN CAST(1 AS DOUBLE) / (rank + 1) END), 0) AS sumReciprocalRank, count(*) AS impressions,
  CAST(count(*) FILTER (placeId = chosen) AS BIGINT) AS selections, CAST(coalesce(sum(CASE WHEN placeId = chosen THEN rank END), 0) AS BIGINT) AS sumAtSelectionRank, CAST(count(*) FILTER (chosen IS NULL) AS BIGINT) AS abandonmentCounter
  FROM shown GROUP BY prefix, placeId),
ordered AS (SELECT *, length(prefix) AS n, row_number() OVER (PARTITION BY sessionId, placeId ORDER BY timestampMs, prefix, rank) AS k FROM shown),
tops AS (SELECT *, row_number() OVER (PARTITION BY sessionId, placeId ORDER BY timestampMs, prefix, rank) AS k FROM shown WHERE rank = 0),
by_place AS (SELECT o.placeId, CAST(sum(CASE WHEN k = 1 THEN n ELSE 0 END) AS BIGINT) AS sumPrefixLenOnFirstAppearance, CAST(count(*) FILTER (k = 1) AS BIGINT) AS countFirstAppearances,
  CAST(coalesce(any_value(t.s), 0) AS BIGINT) AS sumPrefixLenOnFirstTop, CAST(coalesce(any_value(t.c), 0) AS BIGINT) AS countFirstTop,
  CAST(sum(CASE WHEN placeId = chosen THEN n ELSE 0 END) AS BIGINT) AS sumPrefixLenOnSelection, CAST(count(*) FILTER (placeId = chosen) AS BIGINT) AS countSelections
  FROM ordered o LEFT JOIN (SELECT placeId AS p, sum(length(prefix)) AS s, count(*) AS c FROM tops WHERE k = 1 GROUP BY placeId) t ON o.placeId = t.p GROUP BY o.placeId),
totals AS (SELECT prefix, CAST(sum(abandonmentCounter) AS BIGINT) AS abandonments, CAST(sum(impressions) AS BIGINT) AS shown FROM combos GROUP BY prefix)"""
_DAILY = f"""{_SHOWN},
daily AS (SELECT prefix, placeId, date, count(*) AS impressions, CAST(count(*) FILTER (placeId = chosen) AS BIGINT) AS selections, CAST(count(*) FILTER (chosen IS NULL) AS BIGINT) AS abandonmentCounter FROM shown GROUP BY ALL),
kept AS (SELECT * FROM daily WHERE date BETWEEN DATE '2024-01-21' AND DATE '2024-01-30')"""
_BLENDED = f"""{_SHOWN},
seeds AS (SELECT substr('abcdefgh', 1, CAST(k AS INT)) AS prefix, 'p' || CAST(i AS STRING) AS id, i * CAST(0.5 AS DOUBLE) AS seed FROM (SELECT unnest(range(0, 40)) AS i) CROSS JOIN (SELECT unnest(range(1, 8)) AS k)),
parts AS (SELECT s.prefix, s.id, least(seed / 10, 1.0) AS popularity, c.impressions, c.selections / CAST(c.impressions AS DOUBLE) AS rate, CASE WHEN c.selections > 0 THEN sumReciprocalRank / c.selections ELSE 0 END AS mrr,
  CASE WHEN t.shown > 0 THEN t.abandonments / CAST(t.shown AS DOUBLE) ELSE 0 END AS abandonment, countFirstAppearances AS ca,
  sumPrefixLenOnFirstAppearance / CAST(countFirstAppearances AS DOUBLE) AS first, CASE WHEN countFirstTop > 0 THEN sumPrefixLenOnFirstTop / CAST(countFirstTop AS DOUBLE) ELSE sumPrefixLenOnFirstAppearance / CAST(countFirstAppearances AS DOUBLE) END AS top,
  CASE WHEN countSelections > 0 THEN sumPrefixLenOnSelection / CAST(countSelections AS DOUBLE) ELSE 0 END AS sel
  FROM seeds s LEFT JOIN combos c ON s.prefix = c.prefix AND s.id = c.placeId LEFT JOIN by_place b ON s.id = b.placeId LEFT JOIN totals t ON s.prefix = t.prefix),
scores AS (SELECT prefix, id, round(CASE WHEN coalesce(impressions, 0) = 0 THEN popularity ELSE {BLEND["popularity"]} * popularity + {BLEND["selection"]} * rate + {BLEND["mrr"]} * mrr {BLEND["effort"]} * CASE WHEN ca > 0 THEN least((0.5 * (top - first) + 0.5 * sel) / 20, 1.0) ELSE 0 END {BLEND["abandonment"]} * abandonment END, 6) AS score FROM parts)"""
_REQUESTS = "requests AS (SELECT * FROM (VALUES " + ", ".join(f"({r[0]}, '{r[1]}', {r[2]}, {r[3]}, {r[4]})" for r in REQUESTS) + ") AS v(request_id, prefix, top_k, lat, lng))"


def _of_days(first: str, last: str) -> str:
    """The session tables of the days between, which whole sessions lie in."""
    return _SHOWN.replace("FROM searches s LEFT JOIN", f"FROM (SELECT * FROM searches WHERE date BETWEEN DATE '{first}' AND DATE '{last}') s LEFT JOIN")


_NAMED_SEEDS = "seeds AS (SELECT DISTINCT substr(name, 1, CAST(k AS INT)) AS prefix, id, seed FROM (SELECT 'abcdef' || chr(CAST(103 + i % 3 AS INT)) AS name, 'p' || CAST(i AS STRING) AS id, i * CAST(0.5 AS DOUBLE) AS seed FROM (SELECT unnest(range(0, 40)) AS i)) CROSS JOIN (SELECT unnest(range(1, 8)) AS k))"
_REBUILT = f"{_of_days('2024-01-15', '2024-01-16')},\n{_NAMED_SEEDS},\n" + _BLENDED[_BLENDED.index("parts AS") :]


def _scan_sql() -> str:
    boxes = [(min(a, c), min(b, e), max(a, c), max(b, e)) for a, b, c, e in BOXES]
    inside = lambda wide: "(" + " OR ".join(f"(lon >= CAST({a} AS DOUBLE) AND lon{wide} <= CAST({c} AS DOUBLE) AND lat >= CAST({b} AS DOUBLE) AND lat{wide} <= CAST({e} AS DOUBLE))" for a, b, c, e in boxes) + ")"
    tagged = f"CASE p_partkey % 4 WHEN 1 THEN '{AMENITY['bar']}' WHEN 2 THEN '{AMENITY['cafe']}' WHEN 3 THEN 'landmark_and_historical_building' END"
    return f"""WITH {_PLACES} SELECT split_part(rid, ':', 2) AS source_id, name, CASE p_partkey % 2 WHEN 0 THEN name || '|also|en' ELSE '' END AS aliases, category, CASE WHEN p_partkey % 4 > 0 THEN round(confidence, 6) ELSE 0 END AS confidence,
  round(lat, 6) AS lat, round(lon, 6) AS lon, source, CAST(p_partkey % 5 AS INT) AS signals, p_partkey % 11 = 0 AS wiki, p_partkey % 2 = 0 OR p_partkey % 3 = 0 AS web
  FROM places WHERE source = 'OVERTURE' AND p_partkey % 10 <> 9 AND category IN {_in(USABLE_CATEGORIES)} AND {inside(" + CAST(0.0005 AS DOUBLE)")}
UNION ALL SELECT CAST(p_partkey AS STRING), name, 'also', {tagged}, 1, round(lat, 6), round(lon, 6), source, 1, wiki, web FROM places WHERE source = 'OSM' AND p_partkey % 10 <> 9 AND p_partkey % 7 <> 3 AND p_partkey % 4 <> 0 AND {inside("")}"""


def oracle_sql() -> dict[str, str]:
    a, b, c, e = BOX
    tags = f"tags AS ({fx.duck_sql(fx.TAGS)})"
    parts = "list_filter(list_transform(list_concat(string_split(official_name, ';'), string_split(alt_name, ';')), lambda x: trim(x)), lambda x: x <> '' AND x <> name)"
    top_raw = f"{_PREFIX},\nraw_top AS (SELECT * FROM (SELECT prefix, id, seed_score AS score, row_number() OVER (PARTITION BY prefix ORDER BY seed_score DESC, id) AS k FROM prefixes) WHERE k <= 100)"
    return {
        "scan_poi_bbox": f"WITH {_PLACES} SELECT split_part(rid, ':', 2) AS source_id, name, category, round(lat, 6) AS lat, round(lon, 6) AS lon FROM places WHERE lon >= {a} AND lon <= {c} AND lat >= {b} AND lat <= {e} AND trim(name) <> '' AND category IN {_in(USABLE_CATEGORIES)}",
        "osm_category_rules": f"""WITH {tags}, c AS (SELECT id, CASE WHEN amenity = 'place_of_worship' THEN coalesce({_case("religion", RELIGION)}, 'religious_organization') ELSE coalesce({_case("amenity", AMENITY)}, {_case("shop", SHOP)}, {_case("tourism", TOURISM)}, {_case("leisure", LEISURE)},
  CASE WHEN railway IN ('station', 'subway_entrance') THEN CASE WHEN subway = 'yes' THEN 'subway_station' ELSE 'train_station' END END, CASE WHEN aeroway = 'aerodrome' THEN 'airport' END,
  CASE WHEN historic = 'monument' THEN 'monument' WHEN historic IS NOT NULL THEN 'landmark_and_historical_building' END) END AS category FROM tags) SELECT * FROM c WHERE category IS NOT NULL""",
        "alias_derivation": f"WITH {tags}, l AS (SELECT id, {parts} AS parts FROM tags) SELECT id, CAST(pos - 1 AS INT) AS pos, parts[pos] AS alias FROM (SELECT id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM l)",
        "normalize_names": f"""WITH {_PLACES}, n AS (SELECT rid, 'Café  ' || name || ' L''Ópera-2 ' AS x FROM places) SELECT split_part(rid, ':', 2) AS source_id, {_NORM.format(x="x")} AS norm FROM n""",
        "grid_cells": f"WITH {_PLACES} SELECT split_part(rid, ':', 2) AS source_id, CAST(floor(lat / CAST({CELL_LAT!r} AS DOUBLE)) AS INT) AS grid_row, CAST(floor(lon / CAST({CELL_LON!r} AS DOUBLE)) AS INT) AS grid_col FROM places",
        "haversine_pairs": f"WITH {_NEAR} SELECT a, b, round(distance, 6) AS distance FROM near",
        "name_match_pairs": f"WITH {_MATCH} SELECT a, b FROM matched",
        "clusters": f"WITH RECURSIVE {_CLUSTER} SELECT rid, cluster FROM comps",
        "merged_pois": f"WITH RECURSIVE {_MERGED} SELECT id, display_name, aliases, categories, round(confidence, 6) AS confidence, round(lat, 6) AS lat, round(lng, 6) AS lng, sources, round(seed_score, 6) AS seed_score FROM merged",
        "prefix_explode": f"WITH RECURSIVE {_PREFIX} SELECT prefix, count(*) AS n_places, round(max(seed_score), 6) AS best_seed FROM prefixes GROUP BY prefix",
        "prefix_topk_seed": f"WITH RECURSIVE {_PREFIX} SELECT prefix, id, score, CAST(rank AS INT) AS rank FROM top",
        "session_filter": f"WITH {_SHOWN}, e AS (SELECT sessionId, timestampMs FROM searches UNION ALL SELECT sessionId, timestampMs FROM choices) SELECT sessionId, min(timestampMs) AS startMs FROM e GROUP BY sessionId HAVING min(timestampMs) < epoch_ms(TIMESTAMP '{MIDNIGHT}')",
        "combo_metrics": f"WITH {_SHOWN} SELECT * REPLACE (round(sumReciprocalRank, 6) AS sumReciprocalRank) FROM combos",
        "place_metrics": f"WITH {_SHOWN} SELECT * FROM by_place",
        "prefix_totals": f"WITH {_SHOWN} SELECT * FROM totals",
        "window_merge_sum": f"WITH {_DAILY} SELECT prefix, placeId, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(selections) AS BIGINT) AS selections, CAST(sum(abandonmentCounter) AS BIGINT) AS abandonmentCounter FROM kept GROUP BY prefix, placeId",
        "window_merge_oldest": f"WITH {_DAILY} SELECT prefix, placeId, arg_min(impressions, date) AS impressions, arg_min(selections, date) AS selections, arg_min(abandonmentCounter, date) AS abandonmentCounter FROM kept GROUP BY prefix, placeId",
        "blended_scores": f"WITH {_BLENDED} SELECT prefix, id, score FROM scores",
        "prefix_topk_blended": f"WITH {_BLENDED} SELECT * FROM (SELECT prefix, id, score, CAST(row_number() OVER (PARTITION BY prefix ORDER BY score DESC, id) AS INT) AS rank FROM scores) WHERE rank <= 10",
        "search_prefix": f"""WITH RECURSIVE {top_raw}, {_REQUESTS},
hits AS (SELECT request_id, top_k, m.id, display_name, score AS behaviour, {_H.format(a="r", b="m", lon="lng")} AS h FROM requests r JOIN raw_top t ON {_NORM.format(x="r.prefix")} = t.prefix JOIN merged m ON t.id = m.id),
blend AS (SELECT *, 0.7 * behaviour + 0.3 * exp(-({_HAV}) / 2000) AS score FROM hits)
SELECT request_id, rank, id, display_name, score FROM (SELECT CAST(request_id AS BIGINT) AS request_id, top_k, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, id) AS INT) AS rank, id, display_name, round(score, 6) AS score FROM blend) WHERE rank <= top_k""",
        "place_details": f"WITH RECURSIVE {_MERGED} SELECT id, display_name, round(seed_score, 6) AS seed_score, CAST(n_sources AS INT) AS n_sources FROM merged",
        "event_landing_partitions": "SELECT CASE event_type WHEN 'purchase' THEN 'place-selection' ELSE 'prefix-search' END AS event_type, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour, count(*) AS n FROM events GROUP BY ALL",
        "landed_stream_counts": "SELECT CASE event_type WHEN 'purchase' THEN 'place-selection' ELSE 'prefix-search' END AS event_type, strftime(ts, '%Y-%m-%d') AS date, count(*) AS n FROM events GROUP BY ALL",
        "source_scan": _scan_sql(),
        "daily_combo_metrics": f"WITH {_of_days('2024-01-15', '2024-01-15')} SELECT * REPLACE (round(sumReciprocalRank, 6) AS sumReciprocalRank), '2024-01-15' AS date FROM combos",
        "daily_place_metrics": f"WITH {_of_days('2024-01-14', '2024-01-14')} SELECT *, '2024-01-14' AS date FROM by_place UNION ALL SELECT * FROM (WITH {_of_days('2024-01-15', '2024-01-15')} SELECT *, '2024-01-15' AS date FROM by_place)",
        "rebuild_index": f"WITH {_REBUILT} SELECT prefix, id, score FROM scores",
        "seed_bootstrap": f"WITH {_NAMED_SEEDS} SELECT prefix, id, round(least(seed / 10, 1.0), 6) AS score FROM seeds",
        "place_lookup": f"WITH RECURSIVE {_MERGED} SELECT id, display_name, round(lat, 6) AS lat, round(lng, 6) AS lng, sources FROM merged",
        "named_functions": f"WITH {_PLACES}, here AS (SELECT CAST(40.7 AS DOUBLE) AS lat, CAST(-74.0 AS DOUBLE) AS lon), far AS (SELECT p.*, {_H.format(a="p", b="here", lon="lon")} AS h FROM places p CROSS JOIN here) SELECT split_part(rid, ':', 2) AS source_id, CAST(floor(lat / CAST({CELL_LAT!r} AS DOUBLE)) AS INT) AS grid_row, CAST(floor(lon / CAST({CELL_LON!r} AS DOUBLE)) AS INT) AS grid_col, round({_HAV}, 6) AS metres, {_HAV} <= {NEAR_M} AS near FROM far",
        "snapshot_roundtrip": f"WITH RECURSIVE {_PREFIX} SELECT prefix, CAST(rank AS INT) AS rank, id, score FROM top",
    }
