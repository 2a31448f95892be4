import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from wayfold import schemas
from wayfold.functions.geo import haversine_m
from wayfold.functions.text import jaro_winkler_from, jaro_winkler_of, normalize_name
from wayfold.operators import components
from wayfold.operators import metrics as m
from wayfold.operators import prefix_index as ix
from wayfold.operators import resolve as rs
from wayfold.operators.components import connected
from wayfold.plans import queries, serve, snapshot, store
from wayfold.sources import osm
from wayfold.sources.overture import places as overture_places
from wayfold.sources.protocol import fetch_all, ordered

FAR = (-180.0, -90.0, 180.0, 90.0)


def test_normalize(spark):
    cases = {"Café  Noir!": "cafe noir", "½ Moon": "12 moon", "Straße": "strae", "中文": "", "  ": "", "L'Ópera-2": "lopera2", "ﬁne\tDay": "fine day", "Ⅳ ĳ": "iv ij"}
    rows = spark.createDataFrame(list(cases.items()), "x string, want string")
    for r in rows.select("want", normalize_name(F.col("x")).alias("got"), normalize_name(normalize_name(F.col("x"))).alias("again")).collect():
        assert r["got"] == r["want"] == r["again"]


def test_jaro_winkler():
    assert round(jaro_winkler_of("aadaabb db", "aadbabb db"), 5) == 0.88852
    assert round(jaro_winkler_of("gb eda   ggc", "gb edac  ggc"), 5) == 0.93939
    assert jaro_winkler_of("", "") == 1.0 and jaro_winkler_of("", "a") == 0.0


@pytest.mark.parametrize(
    "tags,want",
    [
        ({"amenity": "place_of_worship", "religion": "sikh", "tourism": "museum"}, "religious_organization"),
        ({"amenity": "bench", "tourism": "museum"}, "museum"),
        ({"railway": "subway_entrance", "subway": "yes"}, "subway_station"),
        ({"railway": "station"}, "train_station"),
        ({"historic": "ruins"}, "landmark_and_historical_building"),
        ({"shop": "shoes"}, None),
    ],
)
def test_category(spark, tags, want):
    row = spark.createDataFrame([(tags,)], "tags map<string,string>")
    assert row.select(osm.category(F.col("tags")).alias("c")).first()["c"] == want


def node(i, name, lat, lon, **tags):
    return (i, "node", lat, lon, {"name": name, "amenity": "cafe"} | tags)


def test_sources(spark):
    rows = spark.createDataFrame([node(1, "Name", 1.0, 2.0, alt_name="A; ;B;Name"), node(2, " ", 1.0, 2.0), (3, "way", 1.0, 2.0, {"name": "x", "amenity": "bar"}), node(4, "Out", 9.0, 2.0)], schemas.OSM)
    got = osm.places(rows, [(3.0, 2.0, 1.0, 0.0)]).collect()
    assert [(r["source_id"], r["aliases"], r["category"]) for r in got] == [("1", ["A", "B"], "cafe")]
    rules = [("fr", "X"), (None, "Y;Name"), ("en", "Z"), ("en", None)]
    over = [("o", ("Name", rules), ("cafe",), None, (2.0, 2.0, 1.0, 1.0), None, [], None, None), ("p", ("No", None), ("laundry",), 0.5, (2.0, 2.0, 1.0, 1.0), None, None, None, None)]
    r = overture_places(spark.createDataFrame(over, schemas.OVERTURE), [FAR]).collect()
    assert len(r) == 1 and r[0]["aliases"] == ["Y", "Name", "Z"] and r[0]["confidence"] == 0.0
    assert r[0]["hasWebPresence"] and not r[0]["hasWikiEntry"] and r[0]["sourceSignalCount"] == 0
    assert ordered((3, 2, 1, 0)) == (1, 0, 3, 2)

    class Bad:
        def fetch(self, spark, boxes):
            return spark.read.parquet("/no/such/path")

    class Good:
        def fetch(self, spark, boxes):
            return osm.places(rows, boxes)

    assert fetch_all(spark, [Bad(), Good()], [FAR]).count() == 2


def poi(i, name, lat, lon=0.0, source="OSM", aliases=(), **more):
    row = dict(source_id=str(i), name=name, displayName=name, aliases=list(aliases), category="cafe", confidence=1.0, lat=lat, lon=lon, source=source, sourceSignalCount=1, hasWikiEntry=False, hasWebPresence=False) | more
    return tuple(row[c.split()[0]] for c in schemas.POI.split(", "))


def merged(spark, *rows):
    return rs.resolve(spark.createDataFrame(list(rows), schemas.POI)).collect()


METRE = 1 / 111_194.93


def test_resolution(spark):
    assert len(merged(spark, poi(1, "中文", 0.0), poi(2, "日本", 10 * METRE))) == 1
    assert len(merged(spark, poi(1, "a", 0.0), poi(2, "a", 49.9 * METRE))) == 1
    assert len(merged(spark, poi(1, "a", 0.0), poi(2, "a", 50.1 * METRE))) == 2
    chain = merged(spark, poi(1, "a", 0.0), poi(2, "a", 40 * METRE), poi(3, "a", 80 * METRE))
    assert len(chain) == 1
    edge = 200 / 111_320
    assert len(merged(spark, poi(1, "a", edge - 7 * METRE, -7 * METRE), poi(2, "a", edge + 7 * METRE, 7 * METRE))) == 1
    got = merged(spark, poi(1, "The Café", 0.0, aliases=["x"]), poi(2, "the cafe!", 0.0, source="OVERTURE", aliases=["Y"], hasWikiEntry=True, confidence=0.5, category="temple"))
    assert got[0]["display_name"] == "the cafe!" and got[0]["normalizedAliases"] == ["y", "the cafe", "x"]
    assert got[0]["categories"] == ["temple", "cafe"] and abs(got[0]["seedScore"] - (1.0 * 2 + 0.2 + 2.0 + 1.5)) < 1e-9
    assert merged(spark) == []


def test_blocking_as_all_pairs(spark):
    rows = [poi(i, "n", (i * 37 % 101) * 13 * METRE, (i * 53 % 97) * 17 * METRE) for i in range(300)]
    p = rs.with_keys(spark.createDataFrame(rows, schemas.POI))
    got = {tuple(sorted((r["a"], r["b"]))) for r in rs.near_pairs(p).collect()}
    q = p.select("rid", "lat", "lon")
    every = q.alias("x").join(q.alias("y"), F.col("x.rid") < F.col("y.rid")).where(haversine_m(F.col("x.lat"), F.col("x.lon"), F.col("y.lat"), F.col("y.lon")) <= 50)
    assert got == {(r[0], r[1]) for r in every.select("x.rid", "y.rid").collect()} and len(got) > 20
    assert rs.near_pairs(p).count() == len(got)


def crowd(spark, n=160):
    """Places with few names, some of them null or without aliases, at few positions, in several copies."""
    rnd = random.Random(3)
    names = ["old mill 1", "old mill 2", "Old Mill!", "red barn", "red bern", "中文", "x", None]
    return rs.with_keys(spark.createDataFrame([poi(i, rnd.choice(names), rnd.choice([0, 20, 45, 80, 4000]) * METRE, rnd.choice([0, 30, -5]) * METRE, aliases=rnd.choice([(), ("mill",), ("x", "red barn")])) for i in range(n)], schemas.POI))


def matches_by_definition(p):
    rows = p.select("rid", "lat", "lon", "norm", "norms").collect()
    alike = lambda x, y: bool({*x["norms"]} & {*y["norms"]} - {None}) or (None not in x["norms"] + y["norms"] and jaro_winkler_of(x["norm"], y["norm"]) >= 0.9)
    near = {(r["a"], r["b"]) for r in rs.near_pairs(p).collect()}
    return {(x["rid"], y["rid"]) for x in rows for y in rows if x["rid"] < y["rid"] and ((x["rid"], y["rid"]) in near or (y["rid"], x["rid"]) in near) and alike(x, y)}


def test_matches_by_definition(spark):
    p = crowd(spark)
    got = [tuple(sorted((r["a"], r["b"]))) for r in rs.matching_pairs(p).collect()]
    assert len(got) == len(set(got)) > 1000 and set(got) == matches_by_definition(p)


def test_links_connect_as_matches_but_are_few(spark):
    p = crowd(spark)
    pairs, few = rs.matching_pairs(p), rs.links(p)
    comps = lambda e: {(r["rid"], r["cluster"]) for r in rs.clusters(p, e).select("rid", "cluster").collect()}
    assert comps(pairs) == comps(few) and len({c for _, c in comps(few)}) > 5
    assert few.count() < pairs.count()


def test_similar_names(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abé") for _ in range(rnd.randint(0, 9))) for _ in range(60)]
    rows = spark.createDataFrame([(a, b) for a in words for b in words] + [(None, "a"), ("a", None)], "a string, b string")
    got = {(r["a"], r["b"]) for r in rows.where(jaro_winkler_from(0.9)("a", "b")).collect()}
    assert got == {(a, b) for a in words for b in words if jaro_winkler_of(a, b) >= 0.9} and len(got) > len({*words})


def test_no_join_of_places_is_broadcast(spark, monkeypatch):
    """Files of repeated values are small, but their rows must not go through the driver."""
    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    for module in (rs, components):
        monkeypatch.setattr(module, "saved", lambda df, f=module.saved: plan(df) or f(df))
    p = crowd(spark, 60)
    for df in (rs.near_pairs(p), rs.matching_pairs(p), rs.clusters(p, rs.links(p)), connected(rs.links(p), few=0)):
        plan(df)
    assert len(plans) > 15 and not [x for x in plans if "Broadcast" in x]


def merged_file(spark, path):
    """Merged places in a file, whose size is known, as those of a build."""
    rows = [("1", "Ab", [], [], 1.0, 0.0, 0.0, [], 1.0), ("2", "abc", ["zed"], [], 1.0, 1.0, 1.0, [], 1.1)]
    spark.createDataFrame(rows, schemas.MERGED_POI).write.parquet(f"file://{path}/merged")
    return spark.read.schema(schemas.MERGED_POI).parquet(f"file://{path}/merged")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_details_are_not_broadcast(spark, tmp_path):
    places = merged_file(spark, tmp_path)
    got = serve.details_batch(places.select("id").union(places.select("id")), places)
    assert "Broadcast" not in plan_of(got) and sorted(r["id"] for r in got.collect()) == ["1", "2"]


def test_looked_up_ids_are_not_broadcast(spark, tmp_path):
    places, root = merged_file(spark, tmp_path), f"file://{tmp_path}/store"
    store.put(places, root)
    got = store.get_many(places.select("id").union(places.select("id")), root)
    assert "Broadcast" not in plan_of(got) and sorted(r["id"] for r in got.collect()) == ["1", "2"]


def test_searched_places_are_not_broadcast(spark, tmp_path):
    places = merged_file(spark, tmp_path)
    requests = spark.createDataFrame([(1, "a", 5, 0.0, 0.0, "s"), (2, "z", 5, 0.0, 0.0, "s")], schemas.REQUEST)
    got = serve.search_batch(requests.hint("merge"), ix.build_index(places), places)
    assert "Broadcast" not in plan_of(got) and sorted((r["request_id"], r["id"]) for r in got.collect()) == [(1, "1"), (1, "2"), (2, "2")]


@pytest.mark.parametrize("name", ["prefix_explode", "prefix_topk_seed", "snapshot_roundtrip"])
def test_no_join_of_a_prefix_query_is_broadcast(spark, monkeypatch, name):
    plans = []
    for module in (rs, components, queries):
        monkeypatch.setattr(module, "saved", lambda df, f=module.saved: plans.append(plan_of(df)) or f(df))
    monkeypatch.setattr(snapshot, "publish", lambda df, *args, f=snapshot.publish: plans.append(plan_of(df)) or f(df, *args))
    plans.append(plan_of(queries.queries()[name](spark, "/root/testdata/sf0.001")))
    assert len(plans) > 5 and not [x for x in plans if "Broadcast" in x]


@pytest.mark.parametrize("name", ["prefix_explode", "prefix_topk_seed", "snapshot_roundtrip"])
def test_no_join_of_a_prefix_query_turns_into_a_broadcast(spark, name):
    """Of the plans as they ran: adaptive execution may broadcast what the first plan deals."""
    store = spark._jsparkSession.sharedState().statusStore()
    began = [store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())]
    queries.queries()[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = [store.executionsList().apply(i) for i in range(store.executionsList().size())]
    plans = [x.physicalPlanDescription() for x in ran if x.executionId() not in began]
    assert len(plans) > 5 and any("SortMergeJoin" in x for x in plans) and not [x for x in plans if "Broadcast" in x]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (300, 200), (5, 5)]
    got = {r["node"]: r["comp"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 200: 100, 300: 100}
    assert got == {r["node"]: r["comp"] for r in connected(spark.createDataFrame(edges, "a long, b long").repartition(5), few=0).collect()}


def blended(spark, combo=(), place=(), seed=5.0):
    rows = spark.createDataFrame([("c", "p", seed)], "prefix string, id string, seedScore double")
    combos, places = spark.createDataFrame(list(combo), schemas.COMBO_METRICS), spark.createDataFrame(list(place), schemas.PLACE_METRICS)
    return ix.blended_scores(rows, combos, places).first()["score"]


def test_blended(spark):
    assert blended(spark, seed=25.0) == 1.0
    assert abs(blended(spark, [("c", "p", 0.0, 10, 0, 0, 0)]) - 0.15) < 1e-9
    assert abs(blended(spark, [("c", "p", 0.0, 10, 0, 0, 0)], [("p", 6, 1, 2, 1, 0, 0)]) - (0.15 + 0.1 * 0.1)) < 1e-9


def search(session, prefix, ids, ts):
    return (session, prefix, ids, 0.0, 0.0, ts)


def test_sessions(spark):
    searches = spark.createDataFrame([search("a", "Cen", ["x", "y"], 10), search("a", "Cent", ["y", "x"], 20), search("b", "c", ["x"], 30), search("late", "c", ["x"], 200), search("n", "c", None, 5), search("other", "c", ["x"], 40)], schemas.PREFIX_SEARCH)
    chosen = spark.createDataFrame([("a", "y", 25), ("only", "x", 50), ("other", "z", 60)], schemas.PLACE_SELECTION)
    shown = m.impressions(searches, chosen, m.sessions_before(searches, chosen, F.lit(100)))
    combos = {(r["prefix"], r["placeId"]): r for r in m.combo_metrics(shown).collect()}
    assert combos[("Cen", "y")]["selections"] == 1 and combos[("Cen", "y")]["sumAtSelectionRank"] == 1 and combos[("Cen", "y")]["sumReciprocalRank"] == 0.5
    assert combos[("c", "x")]["impressions"] == 2 and combos[("c", "x")]["abandonmentCounter"] == 1 and combos[("c", "x")]["selections"] == 0
    by = {r["placeId"]: r for r in m.place_metrics(shown).collect()}
    assert by["y"]["sumPrefixLenOnFirstAppearance"] == 3 and by["y"]["sumPrefixLenOnFirstTop"] == 4 and by["y"]["sumPrefixLenOnSelection"] == 7
    assert by["x"]["countFirstAppearances"] == 3


def test_windows(spark):
    daily = spark.createDataFrame([("c", "p", 3, "2024-01-01"), ("c", "p", 5, "2024-01-02"), ("c", "p", 9, "2024-02-01")], "prefix string, placeId string, impressions long, date string").withColumn("date", F.to_date("date"))
    inside = m.window(daily, "2024-01-31", 30)
    assert m.merged_days(inside, ["prefix", "placeId"]).first()["impressions"] == 8
    assert m.merged_days(inside, ["prefix", "placeId"], "oldest_day").first()["impressions"] == 3
    with pytest.raises(ValueError):
        m.merged_days(inside, ["prefix"], "newest")


def test_serving(spark):
    places = spark.createDataFrame([("1", "Ab", [], [], 1.0, 0.0, 0.0, [], 1.0), ("2", "abc", ["zed"], [], 1.0, 1.0, 1.0, [], 1.1)], schemas.MERGED_POI)
    index = ix.build_index(places)
    found = lambda p, k: [r["id"] for r in serve.search_prefix(spark, index, places, p, 0.0, 0.0, k).collect()]
    assert found(" AB ", 5) == ["1", "2"] and found("z", 5) == ["2"] and found("ab", 1) == ["1"]
    assert found("ab", 0) == [] == found("q", 5)
    assert [r["id"] for r in serve.search_prefix(spark, index, places.where("id = '2'"), "a", 0.0, 0.0, 5).collect()] == ["2"]
    assert serve.get_place_details(places, "2")["aliases"] == ["zed"]
    with pytest.raises(LookupError):
        serve.get_place_details(places, "3")
    assert serve.search_event("Ab", [], 0.0, 0.0, " ", 1) is None and serve.search_event("Ab", ["1"], 0.0, 0.0, "s", 1).prefix == "Ab"


def test_snapshot(spark, tmp_path):
    places = spark.createDataFrame([("1", "ab", [], [], 1.0, 0.0, 0.0, [], 1.0)], schemas.MERGED_POI)
    root = f"file://{tmp_path}"
    handle = snapshot.IndexHandle(spark, root, bootstrap=ix.build_index(places))
    assert not handle.refresh() and handle.current.count() == 2
    snapshot.publish(ix.build_index(places), root, "v1")
    assert handle.refresh() and not handle.refresh() and handle.version == "v1"
    snapshot.publish(ix.build_index(places.limit(0)), root, "v2")
    assert not handle.refresh() and handle.version == "v1" and handle.current.count() == 2


def number(v):
    out = b""
    while v > 127:
        out, v = out + bytes([v & 127 | 128]), v >> 7
    return out + bytes([v])


def message(*parts):
    return b"".join(number(k << 3 | 2) + number(len(v)) + v if isinstance(v, bytes) else number(k << 3) + number(v) for k, v in parts)


def test_pbf(spark, tmp_path):
    zig = lambda v: v << 1 ^ v >> 63
    strings = message(*[(1, s) for s in (b"", b"name", b"Caf\xc3\xa9", b"amenity", b"cafe")])
    dense = message((1, number(zig(7)) + number(zig(1))), (8, number(zig(407000000)) + number(zig(-10))), (9, number(zig(-740000000)) + number(zig(10))), (10, bytes([1, 2, 3, 4, 0, 0])))
    block = message((1, strings), (2, message((2, dense))))
    blob = message((2, len(block)), (3, zlib.compress(block)))
    with open(tmp_path / "x.pbf", "wb") as f:
        for kind, body in ((b"OSMHeader", message((1, b"x"))), (b"OSMData", blob), (b"OSMData", blob)):
            head = message((1, kind), (3, len(body)))
            f.write(struct.pack(">I", len(head)) + head + body)
    got = osm.OsmSource([str(tmp_path / "x.pbf")]).fetch(spark, [FAR]).collect()
    assert [(r["source_id"], r["name"], r["lat"], r["lon"]) for r in got] == [("7", "Café", 40.7, -74.0)] * 2
