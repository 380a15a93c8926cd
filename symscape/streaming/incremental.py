"""Streams: newest attempts, changed files and windows over events. The batch operators do the work in each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symscape.operators import code, stats
from symscape.sources import repository


def event_windows(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """(window_start, event_type, n, total): counts by windows of event time; rows later than the watermark are dropped. Streaming or not."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).where("ts IS NOT NULL")
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def newest(stream: DataFrame, keys: list[str], order: list[str], target: str, checkpoint: str):
    """Keeps the newest row of each key of a stream in versions of a table under target. A batch that runs again writes its version again, so that nothing counts twice."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = current(spark, target, number)
        both = batch if before is None else before.unionByName(batch)
        stats.latest_by(both, keys, order).write.mode("overwrite").parquet(f"{target}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def current(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The last complete version before a batch, or of all."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(target)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    found = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root) if s.getPath().getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    found = [n for n in found if before is None or n < before]
    return spark.read.parquet(f"{target}/version={max(found)}") if found else None


def changed_files(stream: DataFrame, target: str, checkpoint: str):
    """Declarations of a stream of files (snapshot, path, lang, raw, text): each micro-batch parses just the files that it brings and replaces their rows."""

    def merge(batch: DataFrame, number: int) -> None:
        last = stats.latest_by(batch, ["snapshot", "path"], ["seen"])
        new = code.with_facts(repository.symbols(last)).drop("order")
        before = current(batch.sparkSession, target, number)
        if before is not None:
            new = before.join(last.select("snapshot", F.col("path").alias("file")), ["snapshot", "file"], "left_anti").unionByName(new)
        new.write.mode("overwrite").parquet(f"{target}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
