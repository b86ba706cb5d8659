"""Tile arithmetic as Spark columns, and as SQL functions for queries written in SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Kilometres per degree of latitude.
KM_PER_DEGREE = 111.32


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.lit(c) if isinstance(c, (int, float)) else F.col(c)


def _scale(zoom) -> Column:
    return F.pow(F.lit(2.0), _col(zoom).cast("double"))


def tile_x(lon, zoom) -> Column:
    """Tile column of a longitude in degrees; truncated, never clamped (lon 180 gives 2^zoom)."""
    return ((_col(lon) + 180.0) / 360.0 * _scale(zoom)).cast("bigint")


def tile_y(lat, zoom) -> Column:
    """Tile row of a latitude in degrees (Web Mercator); truncated toward zero, null beyond the poles."""
    phi = F.radians(_col(lat))
    y = (1.0 - F.ln(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0 * _scale(zoom)
    return F.when(F.abs(_col(lat)) < 90, y.cast("bigint"))


def degrees(micro) -> Column:
    return _col(micro) / 1e6


def micro_degrees(deg) -> Column:
    """Degrees to whole micro-degrees, by truncation."""
    return (_col(deg) * 1000000.0).cast("int")


def linear_index(x, y, x0, y0, width) -> Column:
    """Place of a tile in its row-major grid."""
    return (_col(x) - _col(x0)) + _col(width) * (_col(y) - _col(y0))


def center_bbox(lat, lon, distance_km) -> dict[str, Column]:
    """The box around a centre, rounded to six decimals; the longitude reach grows with latitude."""
    dlat = _col(distance_km) / KM_PER_DEGREE
    dlon = _col(distance_km) / (KM_PER_DEGREE * F.cos(F.radians(_col(lat))))
    return {
        "min_lat": F.round(_col(lat) - dlat, 6),
        "min_lon": F.round(_col(lon) - dlon, 6),
        "max_lat": F.round(_col(lat) + dlat, 6),
        "max_lon": F.round(_col(lon) + dlon, 6),
    }


def tile_of(lat: float, lon: float, zoom: int) -> tuple[int, int]:
    """The same arithmetic on the driver, for headers and boxes."""
    n = 2.0**zoom
    phi = math.radians(lat)
    return int((lon + 180.0) / 360.0 * n), int((1.0 - math.log(math.tan(phi) + 1.0 / math.cos(phi)) / math.pi) / 2.0 * n)


def register_sql(spark: SparkSession) -> None:
    """``tile_x(lon, zoom)`` and ``tile_y(lat, zoom)`` for SQL; plain expressions, no Python at run time."""
    spark.sql("create or replace temporary function tile_x(lon double, zoom int) returns bigint return cast((lon + 180.0D) / 360.0D * power(2.0D, zoom) as bigint)")
    spark.sql(
        "create or replace temporary function tile_y(lat double, zoom int) returns bigint return "
        "if(abs(lat) < 90, cast((1.0D - ln(tan(radians(lat)) + 1.0D / cos(radians(lat))) / pi()) / 2.0D * power(2.0D, zoom) as bigint), null)"
    )
