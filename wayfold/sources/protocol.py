"""The source plug-in, and the union of several."""

from __future__ import annotations

import logging
from collections.abc import Iterable
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import POI
from ..tables import saved

Box = tuple[float, float, float, float]


class PoiSource(Protocol):
    def fetch(self, spark: SparkSession, boxes: list[Box]) -> DataFrame:
        """Named places in any of the boxes, with the columns of ``schemas.POI``."""


def ordered(box: Box) -> Box:
    """(min lon, min lat, max lon, max lat), whichever corners were given."""
    lon1, lat1, lon2, lat2 = box
    return min(lon1, lon2), min(lat1, lat2), max(lon1, lon2), max(lat1, lat2)


def in_any(boxes: list[Box], x_min, x_max, y_min, y_max):
    """Containment of a feature's box (or point) in one of the boxes, borders included."""
    tests = [(x_min >= a) & (x_max <= c) & (y_min >= b) & (y_max <= d) for a, b, c, d in map(ordered, boxes)]
    return reduce(lambda p, q: p | q, tests)


def fetch_all(spark: SparkSession, sources: Iterable[PoiSource], boxes: list[Box]) -> DataFrame:
    """The union of all sources. Each is written on its own, so a failing one is logged and left out."""
    out = spark.createDataFrame([], POI)
    for source in sources:
        try:
            out = out.unionByName(saved(source.fetch(spark, boxes)))
        except Exception as e:  # any failure of one source leaves the others
            logging.getLogger(__name__).warning("source %s failed: %s", type(source).__name__, e)
    return out


def present(name):
    return name.isNotNull() & (F.trim(name) != "")
