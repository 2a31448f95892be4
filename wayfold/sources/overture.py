"""Places from nested Parquet in the Overture layout (``theme=``/``type=`` partitions)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import USABLE_CATEGORIES
from ..functions.text import split_names
from ..schemas import OVERTURE
from .protocol import Box, in_any, present


def places(rows: DataFrame, boxes: list[Box]) -> DataFrame:
    box, name = F.col("bbox"), F.col("names.primary")
    rows = rows.where(in_any(boxes, box["xmin"], box["xmax"], box["ymin"], box["ymax"]) & present(name) & F.col("categories.primary").isin(USABLE_CATEGORIES))
    rules = F.filter(F.coalesce(F.col("names.rules"), F.array().cast("array<struct<language:string,value:string>>")), lambda r: (r["language"].isNull() | (r["language"] == "en")) & r["value"].isNotNull())
    return rows.select(
        F.col("id").alias("source_id"),
        name.alias("name"),
        name.alias("displayName"),
        F.flatten(F.transform(rules, lambda r: split_names(r["value"]))).alias("aliases"),
        F.col("categories.primary").alias("category"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        box["ymin"].alias("lat"),
        box["xmin"].alias("lon"),
        F.lit("OVERTURE").alias("source"),
        F.coalesce(F.size("sources"), F.lit(0)).cast("int").alias("sourceSignalCount"),
        F.col("brand.wikidata").isNotNull().alias("hasWikiEntry"),
        (F.col("websites").isNotNull() | F.col("socials").isNotNull()).alias("hasWebPresence"),
    )


@dataclass
class OvertureSource:
    path: str
    base_path: str | None = None

    def fetch(self, spark: SparkSession, boxes: list[Box]) -> DataFrame:
        reader = spark.read.schema(OVERTURE)
        if self.base_path:
            reader = reader.option("basePath", self.base_path)
        return places(reader.parquet(self.path), boxes)
