"""Hourly counts and counters over a file stream.

``run_available`` counts all rows, whenever they come. ``run_windows`` keeps event-time state: an
hour is closed when the watermark has passed it, and rows that come later are late; they are not
counted but written to a side output.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionrank.session import output_path


def file_stream(spark: SparkSession, path: str, like: DataFrame, per_trigger: int = 1000) -> DataFrame:
    """Parquet files at a path or glob as a stream, with the schema of a batch frame."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def run_available(stream: DataFrame, name: str, ts: str, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Aggregates per (keys, hour) of all that has arrived, then stop; the aggregates must be sums or counts.

    Each micro-batch is aggregated alone into its own folder, and the folders are summed. So
    rows count in whatever order and batch they come, none is late, and a batch that is run again
    after a failure replaces its own output.
    """
    spark = stream.sparkSession
    root = output_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        hours = batch.groupBy(*keys, F.date_trunc("hour", ts).cast("timestamp_ntz").alias("ts_hour"))
        hours.agg(*[c.alias(n) for n, c in aggs.items()]).write.mode("overwrite").parquet(f"{root}/data/batch={number}")

    writer = stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{root}/state")
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()
    if not running.recentProgress or not _exists(spark, f"{root}/data"):
        return _nothing(stream, keys, ts, aggs)
    written = spark.read.option("basePath", f"{root}/data").parquet(f"{root}/data/*")
    return written.groupBy(*keys, "ts_hour").agg(*[F.sum(n).alias(n) for n in aggs])


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _nothing(stream: DataFrame, keys: Sequence[str], ts: str, aggs: Mapping[str, Column]) -> DataFrame:
    """The result of a stream without a file."""
    empty = stream.sparkSession.createDataFrame([], stream.schema)
    return empty.groupBy(*keys, F.date_trunc("hour", ts).cast("timestamp_ntz").alias("ts_hour")).agg(*[c.alias(n) for n, c in aggs.items()])


def run_windows(stream: DataFrame, name: str, ts: str, keys: Sequence[str], aggs: Mapping[str, Column], delay: timedelta) -> tuple[DataFrame, DataFrame]:
    """(aggregates per key and hour, late rows) of all that has arrived, with event-time state.

    A row is late when its hour ended at or before the watermark the engine holds against it: the
    greatest time of all batches but this and the one before, minus ``delay`` (the mark of the
    batch before closes hours, and turns rows away one batch later). The state store holds the open hours only. Every batch writes the
    hours it changed, and the newest version of an hour is its result; late rows go to a folder
    of their own, so that nothing is lost unseen. Both follow the same batches: greatest times
    are kept by batch, and a batch that is run again replaces its own output.
    """
    spark, root = stream.sparkSession, output_path(stream.sparkSession, name)
    timed = stream.withColumn("_time", F.col(ts).cast("timestamp"))
    hour = F.window("_time", "1 hour")
    seconds = f"{delay.total_seconds():.3f} seconds"
    ends = hour["end"]

    def tops() -> DataFrame | None:
        return spark.read.option("basePath", f"{root}/tops").parquet(f"{root}/tops/*") if _exists(spark, f"{root}/tops") else None

    def late(batch: DataFrame, number: int) -> None:
        batch.agg(F.max("_time").alias("top")).write.mode("overwrite").parquet(f"{root}/tops/batch={number}")
        mark = tops().where(F.col("batch") < number - 1).agg(F.max("top")).first()[0]
        passed = F.lit(False) if mark is None else F.col("_end") <= F.lit(mark) - F.expr(f"interval {seconds}")
        rows = batch.withColumn("_end", ends).where(passed).drop("_end", "_time")
        rows.write.mode("overwrite").parquet(f"{root}/late/batch={number}")

    def counted(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/data/batch={number}")

    side = timed.writeStream.foreachBatch(late).option("checkpointLocation", f"{root}/late_state").trigger(availableNow=True).start()
    side.awaitTermination()
    windows = timed.withWatermark("_time", seconds).groupBy(*keys, hour.alias("_hour")).agg(*[c.alias(n) for n, c in aggs.items()])
    hours = windows.select(*keys, F.col("_hour.start").cast("timestamp_ntz").alias("ts_hour"), *aggs)
    main = hours.writeStream.outputMode("update").foreachBatch(counted).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    main.awaitTermination()
    if not _exists(spark, f"{root}/data"):
        return _nothing(stream, keys, ts, aggs), spark.createDataFrame([], stream.schema)
    written = spark.read.option("basePath", f"{root}/data").parquet(f"{root}/data/*")
    newest = F.max(F.struct("batch", *aggs)).alias("_newest")
    result = written.groupBy(*keys, "ts_hour").agg(newest).select(*keys, "ts_hour", *[F.col(f"_newest.{n}").alias(n) for n in aggs])
    return result, spark.read.option("basePath", f"{root}/late").parquet(f"{root}/late/*").select(*stream.columns)
