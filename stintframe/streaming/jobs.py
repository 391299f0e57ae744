"""Incremental ingest and scoring with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.validate import with_errors
from ..sources.tables import latest_delivery, replace_batches


def ingest(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, format: str = "parquet", required: Sequence[str] = ()) -> StreamingQuery:
    """Append the files that are new in ``source``, once each; rows that lack a required value go beside ``target``."""
    rows = spark.readStream.schema(schema).format(format).load(source)

    def store(batch: DataFrame, number: int) -> None:
        checked = with_errors(batch, required)
        # one folder a batch: a batch that is run again replaces its own rows
        checked.filter(F.size("_errors") == 0).drop("_errors").write.mode("overwrite").parquet(f"{target}/batch={number}")
        if required:
            checked.filter(F.size("_errors") > 0).write.mode("overwrite").parquet(f"{target}_rejected/batch={number}")

    return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_corrected(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, by: Sequence[str], format: str = "parquet", folders: bool = False) -> StreamingQuery:
    """Keep the ``by`` partitions of ``target`` as the latest delivery left them: what arrives again replaces what is there.

    A delivery is a file of ``source`` or, with ``folders``, a folder in it that directly holds any number of files.  Deliveries come in
    the order of the time of their last file; where several of one micro-batch hold a partition, the last counts.  A folder of which a
    micro-batch brings some files is read whole, so that one that arrives in parts replaces no part of its own.
    """
    of = F.regexp_replace("_metadata.file_path", "/[^/]*$", "") if folders else F.col("_metadata.file_path")
    marks = [F.col("_metadata.file_modification_time").alias("_when"), of.alias("_source")]
    found = spark.readStream.schema(schema).format(format).option("recursiveFileLookup", folders).load(source)

    def store(batch: DataFrame, number: int) -> None:
        if folders:
            names = [unquote(r[0]) for r in batch.select("_source").distinct().collect()]  # a row a delivery
            if not names:
                return
            batch = batch.sparkSession.read.schema(schema).format(format).option("recursiveFileLookup", True).load(names).select("*", *marks)
        elif batch.isEmpty():
            return
        replace_batches(latest_delivery(batch, by, "_when", "_source").drop("_when", "_source"), target, by)

    return found.select("*", *marks).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scored(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], required: Sequence[str]) -> DataFrame:
    """Score a stream row by row; rows that lack a required value are filtered out."""
    return transform(with_errors(stream, required).filter(F.size("_errors") == 0).drop("_errors"))


def windowed_counts(stream: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and means per window and key; rows later than ``late`` are left out."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select("window.start", "window.end", key, "n", "mean")
