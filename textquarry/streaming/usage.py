"""Usage of tools as a stream: windowed statistics with a watermark, and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.corpus import events_as_usage


def events_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Rows of an events folder or file as they arrive; the schema is taken from the files that are there."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    raw = reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, path) else reader.parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def usage_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """usage rows of an events folder as they arrive."""
    return events_as_usage(events_stream(spark, path, files_per_trigger))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def windowed_stats(usage: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """tool, start, count, errors, avg_ms by tumbling window; rows later than the watermark are ignored by a stream."""
    by = usage.withWatermark("ts", late).groupBy(F.window("ts", window), "tool")
    return by.agg(F.count(F.lit(1)).alias("count"), F.count_if(~F.col("success")).alias("errors"), F.round(F.avg("duration_ms"), 6).alias("avg_ms")).select("tool", F.col("window.start").alias("start"), "count", "errors", "avg_ms")


def bursts(usage: DataFrame, gap: str = "10 minutes", late: str = "2 hours") -> DataFrame:
    """tool, start, end, count: runs of calls with pauses shorter than gap."""
    return usage.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "tool").agg(F.count(F.lit(1)).alias("count")).select("tool", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "count")


def run_to_memory(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All that is there now through a memory sink, for tests and small reports."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return stream.sparkSession.table(name)
