import os
import time

import pytest
from pyspark.sql import functions as F
from test_places import poi

from wayfold import schemas, tables
from wayfold.functions.registry import register
from wayfold.functions.time import midnight_ms, utc_date, utc_hour
from wayfold.operators import prefix_index as ix
from wayfold.operators.components import connected
from wayfold.plans import dataset, serve, snapshot, store
from wayfold.streaming import landing

DAY = 86_400_000


@pytest.fixture
def new_york(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", old)


def ms(text):
    import datetime

    return int(datetime.datetime.fromisoformat(text + "+00:00").timestamp() * 1000)


def search(session, prefix, ids, at):
    return (session, prefix, ids, 0.0, 0.0, ms(at))


def test_dates_are_utc(new_york):
    rows = new_york.createDataFrame([(0,), (ms("2024-01-01T01:00:00"),), (-1,), (ms("2024-03-10T07:30:00"),)], "ms long")
    got = [tuple(r) for r in rows.select(utc_date(F.col("ms")), utc_hour(F.col("ms"))).collect()]
    assert got == [("1970-01-01", "00"), ("2024-01-01", "01"), ("1969-12-31", "23"), ("2024-03-10", "07")]
    assert new_york.range(1).select(midnight_ms(F.lit("2024-03-10"))).first()[0] == ms("2024-03-10T00:00:00")
    lines = new_york.createDataFrame([("prefix-search", '{"sessionId":"s","timestampMs":%d}' % ms("2024-01-01T01:00:00")), ("prefix-search", "{broken"), ("prefix-search", '{"sessionId":"t"}')], "event_type string, value string")
    landed = landing.to_landed(lines).collect()
    assert (landed[0]["date"], landed[0]["hour"]) == ("2024-01-01", "01") and len(landed) == 2


def test_days_end_to_end(new_york, tmp_path):
    """Landing, daily metrics with late events and a rerun, the rebuilt index, and a handle that serves it, in a session off UTC."""
    spark, root = new_york, f"file://{tmp_path}"
    searches = [search("a", "x", ["p1", "p2"], "2024-01-14T23:50:00"), search("a", "x", ["p1", "p2"], "2024-01-15T00:10:00"), search("b", "x", ["p1"], "2024-01-15T00:20:00"), search("c", "x", ["p2"], "2024-01-15T12:00:00")]
    chosen = [("a", "p2", ms("2024-01-15T00:11:00"))]
    landing.emit(spark.createDataFrame(searches, schemas.PREFIX_SEARCH), "prefix-search", root=f"{root}/in")
    landing.emit(spark.createDataFrame(chosen, schemas.PLACE_SELECTION), "place-selection", root=f"{root}/in")
    query = landing.land(landing.file_events(spark, f"{root}/in"), f"{root}/out", f"{root}/cp")
    end = time.time() + 60
    while not query.recentProgress and time.time() < end:
        time.sleep(0.2)
    landing.stop(query)
    assert not query.isActive and os.path.isdir(tmp_path / "out/event_type=prefix-search/date=2024-01-15/hour=00")
    for kind in ("prefix-search", "place-selection"):
        spark.createDataFrame([("no json",), ("",)], "value string").write.mode("append").text(f"{root}/out/event_type={kind}/date=2024-01-14/hour=05")
    for run_date in ("2024-01-15", "2024-01-16", "2024-01-15"):
        dataset.collect_metrics(spark, f"{root}/out", f"{root}/metrics", run_date)
    combos = {(str(r["date"]), r["placeId"]): r for r in spark.read.parquet(f"{root}/metrics/combo").collect()}
    # on the 14th: session a with its late search and choice; b began after midnight
    assert combos[("2024-01-14", "p1")]["impressions"] == 2 and combos[("2024-01-14", "p2")]["selections"] == 2
    assert combos[("2024-01-15", "p1")]["impressions"] == 2 and combos[("2024-01-15", "p1")]["abandonmentCounter"] == 1
    assert len(combos) == 4
    places = spark.createDataFrame([("p1", "X one", [], [], 1.0, 0.0, 0.0, ["OSM"], 1.0), ("p2", "x two", [], [], 1.0, 0.0, 0.0, ["OSM", "OVERTURE"], 2.0)], schemas.MERGED_POI)
    assert dataset.write_places(places, f"{root}/places", json=True) == {"places": 2, "from several sources": 1}
    again = dataset.read_places(spark, f"{root}/places_json", json=True)
    assert sorted(again.collect()) == sorted(places.collect()) == sorted(dataset.read_places(spark, f"{root}/places").collect())
    assert dataset.rebuild(spark, again, f"{root}/metrics", f"{root}/snapshots", "2024-01-16", "r1") == "2024-01-16-r1"
    handle = snapshot.IndexHandle(spark, f"{root}/snapshots", bootstrap=ix.bootstrap_index(places))
    assert handle.current.where("prefix = 'x'").first()["places"][0]["score"] == 0.2
    assert handle.refresh() and handle.current.where("prefix = 'x'").first()["places"][0]["id"] == "p2"
    found = serve.answer_search(spark, handle.current, places, "X", 0.0, 0.0, 1, "s", ms("2024-01-16T00:00:00"), root=f"{root}/answers")
    assert [r["id"] for r in found] == ["p2"]
    assert serve.answer_details(spark, places, "p2", "s", 5, root=f"{root}/answers")["display_name"] == "x two"
    assert serve.answer_search(spark, handle.current, places, "X", 0.0, 0.0, 1, " ", 5, root=f"{root}/answers") == found
    assert spark.read.text(f"{root}/answers/event_type=prefix-search").count() == 1 == spark.read.text(f"{root}/answers/event_type=place-selection").count()
    # a sink that fails changes no answer
    (tmp_path / "file").write_text("")
    assert serve.answer_search(spark, handle.current, places, "X", 0.0, 0.0, 1, "s", 5, root=f"{root}/file") == found


def test_snapshot_details(spark, tmp_path):
    root = f"file://{tmp_path}"
    snapshot.write_text(spark, f"{root}/latest", "v1")
    snapshot.write_text(spark, f"{root}/latest", "v2")
    assert snapshot.read_text(spark, f"{root}/latest") == "v2" and not (tmp_path / "latest.new").exists()
    os.makedirs(tmp_path / "v2")
    line = '{"prefix":"a","places":[{"id":"%s","score":1.0}]}\n'
    (tmp_path / "v2/part-0.json").write_text(line % "1" + line % "2")
    (tmp_path / "v2/part-1.json").write_text(line % "3" + line % "4" + line.replace('"a"', '"b"') % "5")
    got = {r["prefix"]: r["places"][0]["id"] for r in snapshot.load(spark, root, "v2").collect()}
    assert got == {"a": "4", "b": "5"}


def test_store(spark, tmp_path):
    places = spark.createDataFrame([(str(i), f"n{i}", [], [], 1.0, 0.0, 0.0, [], 1.0) for i in range(50)], schemas.MERGED_POI)
    path = f"file://{tmp_path}/store"
    store.put(places, path)
    one = store.get(spark, path, "7")
    assert one.collect()[0]["display_name"] == "n7" and store.get(spark, path, "x").count() == 0
    assert len(one.inputFiles()) == 50 or "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().toString()
    ids = spark.createDataFrame([("1",), ("2",), ("2",), ("none",)], "id string")
    assert {r["id"] for r in store.get_many(ids, path).collect()} == {"1", "2"}


def test_named_functions(spark):
    assert "haversine_m" in register(spark)
    r = spark.sql("SELECT haversine_m(0D, 0D, 0D, 1D) AS m, grid_row(0.5D) AS r, name_similarity('abcd', 'abcx') AS s, is_near(50D) AS n").first()
    assert abs(r["m"] - 111_194.93) < 0.01 and r["n"] and 0.8 < r["s"] < 0.95


def test_components_in_rounds_and_in_one_task(spark):
    chain, hub = [(f"c{i:03}", f"c{i + 1:03}") for i in range(150)], [("hub", f"leaf{i}") for i in range(300)]
    edges = spark.createDataFrame(chain + hub + [("x", "x"), ("a", "b"), ("a", "b"), ("b", "a")], "a string, b string")
    one, rounds = ({r["node"]: r["comp"] for r in connected(edges, few).collect()} for few in (10_000, 0))
    assert one == rounds and one["c150"] == "c000" and one["leaf9"] == "hub" and one["b"] == "a" and "x" not in one
    assert connected(edges.where("false")).collect() == []


def test_cluster_needs_a_shared_folder():
    class Spark:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        tables.shared_dir(Spark)


def test_dataset_of_sources(spark):
    class One:
        def fetch(self, spark, boxes):
            return spark.createDataFrame([poi(1, "a", 0.0), poi(2, "A!", 0.0001)], schemas.POI)

    assert dataset.build_dataset(spark, [One()], [(0, 0, 1, 1), (5, 5, 4, 4)]).count() == 1
