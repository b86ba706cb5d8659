"""Queries that run as streams over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.streaming.change_stream import changes_per_window, drained, latest_per_key, stream_of
from gridloom.tables import table

_KEY = ["map_id", "from_snap", "to_snap", "si", "tile_x", "tile_y"]


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_of(spark, f"{sf_dir}/mfd_tile_record.parquet", table(spark, sf_dir, "mfd_tile_record").schema)


def stream_latest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current record of each tile change, from the stream of records."""
    return drained(latest_per_key(_records(spark, sf_dir), _KEY, "logged_at", ["flags", "zoom_mask"]), _KEY).drop("logged_at")


def stream_changes_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(changes_per_window(_records(spark, sf_dir), "logged_at", late="3650 days"), ["start"])


QUERIES = {"stream_latest_changes": stream_latest_changes, "stream_changes_per_day": stream_changes_per_day}
ORACLES = {
    "stream_latest_changes": """select map_id, from_snap, to_snap, si, tile_x, tile_y, flags, zoom_mask from mfd_tile_record
 qualify row_number() over (partition by map_id, from_snap, to_snap, si, tile_x, tile_y order by logged_at desc nulls last, flags desc nulls last, zoom_mask desc nulls last) = 1""",
    "stream_changes_per_day": "select (epoch_us(logged_at) // 86400000000 * 86400)::bigint as start, count(*)::bigint n from mfd_tile_record where logged_at is not null group by 1",
}
