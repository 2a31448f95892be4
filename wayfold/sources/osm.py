"""Places from OSM nodes: rows with a tag map, from PBF extracts or Parquet."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ALIAS_TAGS, AMENITY, LEISURE, RELIGION, SHOP, TOURISM, WEB_TAGS, WIKI_TAGS
from ..functions.text import split_names
from ..schemas import OSM
from .protocol import Box, in_any, present


def category(tags: Column) -> Column:
    """The first rule that gives a category; null without one."""
    mapped = lambda table, tag: F.create_map(*[F.lit(x) for x in chain(*table.items())])[tags[tag]]
    station = F.when((tags["station"] == "subway") | (tags["subway"] == "yes"), "subway_station").otherwise("train_station")
    return F.when(tags["amenity"] == "place_of_worship", F.coalesce(mapped(RELIGION, "religion"), F.lit("religious_organization"))).otherwise(
        F.coalesce(
            mapped(AMENITY, "amenity"),
            mapped(SHOP, "shop"),
            mapped(TOURISM, "tourism"),
            mapped(LEISURE, "leisure"),
            F.when(tags["railway"].isin("station", "subway_entrance"), station),
            F.when(tags["aeroway"] == "aerodrome", F.lit("airport")),
            F.when(tags["historic"].isNotNull(), F.when(tags["historic"] == "monument", "monument").otherwise("landmark_and_historical_building")),
        )
    )


def aliases(tags: Column, name: Column) -> Column:
    parts = F.flatten(F.array(*[split_names(tags[t]) for t in ALIAS_TAGS]))
    return F.filter(parts, lambda x: x != name)


def _any_tag(tags: Column, names) -> Column:
    return F.coalesce(*[tags[t] for t in names]).isNotNull()


def places(rows: DataFrame, boxes: list[Box]) -> DataFrame:
    tags, name = F.col("tags"), F.col("tags")["name"]
    rows = rows.where((F.col("kind") == "node") & present(name) & in_any(boxes, F.col("lon"), F.col("lon"), F.col("lat"), F.col("lat")))
    return rows.select(
        F.col("id").cast("string").alias("source_id"),
        name.alias("name"),
        name.alias("displayName"),
        aliases(tags, name).alias("aliases"),
        category(tags).alias("category"),
        F.lit(1.0).alias("confidence"),
        "lat",
        "lon",
        F.lit("OSM").alias("source"),
        F.lit(1).alias("sourceSignalCount"),
        _any_tag(tags, WIKI_TAGS).alias("hasWikiEntry"),
        _any_tag(tags, WEB_TAGS).alias("hasWebPresence"),
    ).where("category is not null")


@dataclass
class OsmSource:
    """One or more extracts; format ``osmpbf`` (see ``pbf``) or ``parquet`` with the columns of ``schemas.OSM``."""

    paths: list[str] = field(default_factory=list)
    format: str = "osmpbf"

    def fetch(self, spark: SparkSession, boxes: list[Box]) -> DataFrame:
        if self.format == "osmpbf":
            from .pbf import OsmPbf

            spark.dataSource.register(OsmPbf)
            out = None
            for path in self.paths:
                rows = spark.read.format("osmpbf").load(path)
                out = rows if out is None else out.union(rows)
        else:
            out = spark.read.schema(OSM).format(self.format).load(self.paths)
        return places(out, boxes)
