"""Structured Streaming over arriving snapshots: the batch comparison run as data arrives, and running counts by window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from regolith.operators.snapdiff import snapshot_changes


def watch(spark: SparkSession, rows_folder: str, schema: str, manifest: Callable[[], DataFrame], checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Each time snapshot rows arrive, compares the series they belong to and hands the changes to ``sink``.

    ``manifest`` reads the manifest as it stands; only series with new rows are compared, over all their rows.
    """
    stream = spark.readStream.schema(schema).parquet(rows_folder)

    def compare(batch: DataFrame, number: int) -> None:
        known = manifest()
        touched = batch.select("snapshot_id").distinct().join(known, "snapshot_id").select("source_id", "section_no").distinct()
        series = known.join(touched, ["source_id", "section_no"], "left_semi")
        rows = spark.read.schema(schema).parquet(rows_folder).join(series.select("snapshot_id"), "snapshot_id", "left_semi")
        sink(snapshot_changes(series, rows), number)

    return stream.writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(rows: DataFrame, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Rows delivered by source and window, late ones admitted up to the watermark."""
    timed = rows.withColumn("at", F.col("delivered_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "source_id").agg(F.count("*").alias("rows")).select(F.col("window.start").alias("window_start"), "source_id", "rows")
