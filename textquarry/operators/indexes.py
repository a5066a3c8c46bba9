"""Stored indexes: a symbol table in buckets that is brought up to date in place, and trigrams for searches by pattern."""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser as parser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpointed

BUCKETS = 64


def bucket(path: str = "path", buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def write_index(rows: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """rows (path, ...) as a table of files by bucket of the path, in place of what is there."""
    dealt = rows.withColumn("bucket", bucket(buckets=buckets)).repartition(min(buckets, 256), "bucket").sortWithinPartitions("bucket", "path")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(folder)


def read_index(spark: SparkSession, folder: str, paths: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The rows of an index; of a few paths only their buckets are read."""
    rows = spark.read.parquet(folder)
    if paths is not None:
        wanted = spark.createDataFrame([(p,) for p in paths], "path string")
        few = [r[0] for r in wanted.select(bucket(buckets=buckets)).distinct().collect()]
        rows = rows.where(F.col("bucket").isin(few) & F.col("path").isin(paths))
    return rows.drop("bucket")


def update_index(spark: SparkSession, folder: str, changed: DataFrame, removed: DataFrame | None = None, buckets: int = BUCKETS) -> int:
    """Replaces the rows of changed paths by `changed` and drops those of removed ones (path); gives the number of buckets written.

    Only the buckets of these paths are read and written again; the others keep their files. The new rows are written to
    the shared folder before any old file goes.
    """
    fresh = checkpointed(changed.withColumn("bucket", bucket(buckets=buckets)))
    gone = fresh.select("path", "bucket")
    if removed is not None:
        gone = gone.unionByName(removed.select("path").withColumn("bucket", bucket(buckets=buckets)))
    gone = checkpointed(gone.distinct())
    touched = sorted(r[0] for r in gone.select("bucket").distinct().collect())
    if not touched:
        return 0
    old = spark.read.parquet(folder).where(F.col("bucket").isin(touched))
    kept = old.join(gone.select("path"), "path", "left_anti")
    new = checkpointed(kept.unionByName(fresh.select(*kept.columns)))
    left = {r[0] for r in new.select("bucket").distinct().collect()}
    new.repartition(min(buckets, 256), "bucket").sortWithinPartitions("bucket", "path").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
    for b in (b for b in touched if b not in left):  # nothing is left of it
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/bucket={b}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(touched)


def follow(stream: DataFrame, folder: str, extract, checkpoint: str, buckets: int = BUCKETS):
    """A running query that keeps an index up to date with a stream of files (path, content, ...; a null content: removed).

    extract: from files to the index's rows. Of several versions of a path in one batch the one of highest `version` counts.
    """

    def batch(rows: DataFrame, number: int) -> None:
        last = rows.groupBy("path").agg(F.max_by(F.struct(*rows.columns), "version").alias("x")).select("x.*")
        last = checkpointed(last)
        update_index(rows.sparkSession, folder, extract(last.where("content IS NOT NULL")), last.select("path"), buckets)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def trigrams(text):
    """Distinct runs of three characters of a column, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?s)(?=(...))"), F.lit(1)))


def write_trigrams(files: DataFrame, folder: str, key: str = "path", column: str = "content", buckets: int = 256) -> None:
    """(trigram, key) of all texts, in files by bucket of the trigram and in its order."""
    each = files.where(F.col(key).isNotNull()).select(F.explode(trigrams(F.col(column))).alias("trigram"), F.col(key).alias("key"))
    dealt = each.withColumn("bucket", bucket("trigram", buckets)).repartition(min(buckets, 256), "bucket").sortWithinPartitions("bucket", "trigram")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(folder)


def _needed(parts) -> list[set[str]]:
    """Of a parsed expression all choices of trigrams, of which a match holds one choice whole; an empty choice rules nothing out."""
    choices: list[set[str]] = [set()]
    run = ""

    def both(more: list[set[str]]) -> None:
        nonlocal choices
        choices = [a | b for a in choices for b in more] if len(choices) * len(more) <= 64 else choices

    def end() -> None:
        nonlocal run
        both([{run[k : k + 3] for k in range(len(run) - 2)}])
        run = ""

    for op, value in parts:
        if op is C.LITERAL:
            run += chr(value).lower() if len(chr(value).lower()) == 1 else ""
            continue
        if op is C.SUBPATTERN and not (value[1] or value[2]):
            inner = value[3]
            if all(o is C.LITERAL for o, _ in inner):
                run += "".join(chr(c).lower() for _, c in inner)
                continue
            end()
            both(_needed(inner))
        elif op is C.BRANCH:
            end()
            both([c for branch in value[1] for c in _needed(branch)])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] > 0:
            end()
            both(_needed(value[2]))
        else:
            end()
    end()
    return choices


def choices_of(pattern: str, like: bool = False) -> list[set[str]]:
    """Sets of trigrams, of which every text that a regular expression (or a LIKE pattern) matches holds one set whole."""
    if like:
        runs = re.split(r"(?<!\\)[%_]", pattern.lower())
        return [{run[k : k + 3] for run in (r.replace("\\", "") for r in runs) for k in range(len(run) - 2)}]
    return _needed(parser.parse(pattern))


def search_trigrams(files: DataFrame, folder: str, pattern: str, like: bool = False, key: str = "path", column: str = "content", buckets: int = 256) -> tuple[DataFrame, DataFrame]:
    """(files that match, keys that were tried): candidates come from the trigrams, and the pattern is tried on these alone.

    Case counts in the pattern, not in the trigrams. A pattern from which no trigram follows is tried on all files.
    """
    spark = files.sparkSession
    choices = choices_of(pattern, like)
    fits = F.col(column).like(pattern) if like else F.col(column).rlike(pattern)
    if not all(choices):
        return files.where(fits), files.select(F.col(key).alias("key"))
    wanted = spark.createDataFrame([(n, t) for n, c in enumerate(choices) for t in sorted(c)], "choice int, trigram string").withColumn("bucket", bucket("trigram", buckets))
    few = sorted({r[0] for r in wanted.select("bucket").collect()})
    terms = sorted(set().union(*choices))
    lists = spark.read.parquet(folder).where(F.col("bucket").isin(few) & F.col("trigram").isin(terms)).join(F.broadcast(wanted), ["bucket", "trigram"])
    size = F.broadcast(spark.createDataFrame([(n, len(c)) for n, c in enumerate(choices)], "choice int, size int"))
    tried = lists.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).join(size, "choice").where("n = size").select("key").distinct()
    return files.join(tried.withColumnRenamed("key", key), key, "left_semi").where(fits), tried
