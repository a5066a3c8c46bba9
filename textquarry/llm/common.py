"""Shared plumbing: the shared folder, staged tables and joins that survive hot keys."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys in a hot list at most, a few MB of broadcast. Every key of more than a slice's rows is in it, unless there are more
#: of these than HOT_KEYS; then a key outside the list has at most 1/(HOT_KEYS+1) of the rows.
HOT_KEYS = 100_000
#: Rows of one hot key that go to one slice.
SLICE_ROWS = 2048
#: Separators of words: space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='textquarry-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/textquarry/{name}-{uuid.uuid4().hex}"


#: With it, the shuffle files of a write go when the write is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Narrow tables (identifiers and counts) are written by one task for so many partitions.
NARROW = 16


def stage(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and lost executors lose nothing.

    narrow: df is cheap to compute and its rows are a few numbers, so fewer, larger files do.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    kept = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        (df.coalesce(max(6, spread(spark) // NARROW)) if narrow else df).write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, kept)
    schema = df.schema
    if not narrow:
        tidy(spark)
    return spark.read.schema(schema).parquet(path)


def gathered(df: DataFrame) -> DataFrame:
    """df computed once and kept by the driver: for tables of one row a file or partition, whose rows don't follow the documents."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files and broadcasts of finished jobs now rather than at the next chance
    collection. It takes a good part of a second, so narrow tables, whose files are small, go without it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def hot_keys(left: DataFrame, key: str, slice_rows: int = SLICE_ROWS, most: int = HOT_KEYS) -> DataFrame:
    """(key, _slices) of the keys with more than slice_rows rows: the `most` largest of them, whatever the input's size."""
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.where(F.col("_n") > slice_rows).orderBy(F.desc("_n"), F.col(key)).limit(most)
    return top.select(key, F.ceil(F.col("_n") / slice_rows).cast("int").alias("_slices"))


def salted_join(left: DataFrame, right: DataFrame, key: str, salt_on: list[str], how: str = "inner", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """left many-to-one right on key. Rows of hot keys are dealt over slices by a hash of salt_on; right's rows of these keys are repeated once a slice.

    The hot list has at most HOT_KEYS rows, so its broadcast is bounded; every other key has at most slice_rows rows (or
    1/(HOT_KEYS+1) of all, if that is more). Null keys match nothing; a left join keeps them, dealt out by the same hash.
    """
    hot = hot_keys(left, key, slice_rows)
    mine = left.join(F.broadcast(hot), key, "left").withColumn("_slice", F.when(F.col("_slices").isNotNull(), F.pmod(F.xxhash64(*salt_on), F.col("_slices"))).when(F.col(key).isNull(), F.xxhash64(*salt_on)).otherwise(F.lit(0)).cast("long")).drop("_slices")
    theirs = right.join(F.broadcast(hot), key, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_slices", F.lit(1)).cast("long") - 1))).drop("_slices")
    return mine.join(theirs, [key, "_slice"], how).drop("_slice")


def spread(spark: SparkSession, least: int = 1) -> int:
    """Partitions for a shuffle of our own making."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
