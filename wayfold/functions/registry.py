"""The engine's functions by name, for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..constants import EARTH_M, NEAR_M
from .geo import CELL_LAT, CELL_LON
from .text import jaro_winkler

_H = "pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)"
_SQL = {
    "haversine_m": ("lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE", f"CAST({2 * EARTH_M} AS DOUBLE) * atan2(sqrt({_H}), sqrt(1 - ({_H})))"),
    "grid_row": ("lat DOUBLE", "INT", f"CAST(floor(lat / CAST({CELL_LAT!r} AS DOUBLE)) AS INT)"),
    "grid_col": ("lon DOUBLE", "INT", f"CAST(floor(lon / CAST({CELL_LON!r} AS DOUBLE)) AS INT)"),
    "is_near": ("metres DOUBLE", "BOOLEAN", f"metres <= {NEAR_M}"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; returns their names."""
    for name, (parameters, kind, body) in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")

    spark.udf.register("name_similarity", jaro_winkler)
    return [*_SQL, "name_similarity"]
