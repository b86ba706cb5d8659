"""Change records as a stream: the latest record of every tile, kept up as deliveries arrive."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.session import ensure_checkpoint_dir


def stream_of(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 64) -> DataFrame:
    """New files under ``path`` as a stream; a folder that more deliveries are added to, or one file.

    The path is given as a pattern that matches only itself: a plain path must be a folder.
    """
    pattern = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def latest_per_key(stream: DataFrame, keys: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """Running state: per key the values with the greatest time, ties by the values themselves.

    Records may arrive in any order and more than once; state holds one row per key.
    """
    newest = F.max(F.struct(F.col(at), *values)).alias("newest")
    return stream.groupBy(*keys).agg(newest).select(*keys, F.col(f"newest.{at}").alias(at), *(F.col(f"newest.{v}").alias(v) for v in values))


def without_repeats(stream: DataFrame, keys: Sequence[str], at: str, late: str = "30 days") -> DataFrame:
    """Drops repeated records that arrive within ``late`` of each other; state older than that is let go."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([*keys, at])


def changes_per_window(stream: DataFrame, at: str, width: str = "1 day", late: str = "30 days") -> DataFrame:
    """Number of records per time window (start in Unix seconds); a window is final once the watermark has passed it."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w")).agg(F.count("*").alias("n")).select(F.unix_seconds("w.start").alias("start"), "n")


def drained(stream: DataFrame, keys: Sequence[str], mode: str = "update") -> DataFrame:
    """Runs the stream over all that has arrived and returns the last state written per key.

    Each batch is written to the shared folder under its number, so a batch that is run again after a
    failure replaces its own output and nothing is gathered on the driver.
    """
    folder = f"{ensure_checkpoint_dir(stream.sparkSession).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/b={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("__batch", T.IntegerType())])
    written = stream.sparkSession.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    w = Window.partitionBy(*keys).orderBy(F.desc("__batch"))
    return written.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__batch")
