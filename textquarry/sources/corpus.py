"""Files and lines from source trees and from other tables.

files: path, language, content. lines: path, line_no (from 1), text; a newline at the end makes one more, empty line.
"""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob_pattern, language_of

# Folders that are not read.
EXCLUDED = ["node_modules", ".git", "dist", "build", "out", ".next", "coverage", "vendor", "target", "bin", "obj", ".cache", "__pycache__", ".venv", "venv"]


def read_tree(spark: SparkSession, root: str, excluded: list[str] | None = None, max_bytes: int | None = None, max_depth: int | None = None, hidden: bool = False, glob: str | None = None) -> DataFrame:
    """files(root, path, language, size, mtime, content) of a folder on any file system Spark reads; path is relative to it.

    Excluded and hidden paths, a glob's misses and, if asked for, files beyond max_bytes are filtered on metadata before
    their content is read; nothing else is left out. Content that isn't UTF-8 has replacement characters.
    """
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = raw.withColumn("path", F.substr("path", F.lit(len(full) + 2)))
    if max_bytes is not None:
        rows = rows.where(F.col("length") <= max_bytes)
    for folder in EXCLUDED if excluded is None else excluded:
        rows = rows.where(~F.concat(F.lit("/"), "path").contains(f"/{folder}/"))
    if glob:
        rows = rows.where(F.col("path").rlike(glob_pattern(glob)))
    if max_depth is not None:
        rows = rows.where(F.size(F.split("path", "/")) <= max_depth)
    if not hidden:
        rows = rows.where(~F.col("path").rlike(r"(^|/)\."))
    return rows.select(F.lit(full.rsplit("/", 1)[-1]).alias("root"), "path", language_of(F.col("path")).alias("language"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("content"))


def allowed(path: str, roots: list[str]) -> str:
    """path if it lies in one of the roots, by whole path components; else a ValueError. Nothing is read."""
    if "\0" in path:
        raise ValueError("a path can't hold a null byte")
    parts: list[str] = []
    for part in PurePosixPath(path if path.startswith("/") else f"{roots[0]}/{path}").parts:
        if part == "..":
            if len(parts) > 1:
                parts.pop()
        else:
            parts.append(part)
    clean = str(PurePosixPath(*parts)) if parts else "/"
    for root in roots:
        top = str(PurePosixPath(root))
        if clean == top or clean.startswith(top.rstrip("/") + "/"):
            return clean
    raise ValueError(f"{path} lies outside of the allowed folders")


def documents_as_files(docs: DataFrame) -> DataFrame:
    return docs.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("language"), F.col("text").alias("content"))


def pages_as_files(pages: DataFrame) -> DataFrame:
    return pages.select(F.concat(F.lit("page/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.lit("html").alias("language"), F.col("html").alias("content"))


def events_as_usage(events: DataFrame) -> DataFrame:
    """usage(tool, ts, duration_ms, success, cached)."""
    return events.select(F.col("event_type").alias("tool"), "ts", F.col("value").alias("duration_ms"), (F.col("event_type") != "error").alias("success"), (F.col("user_id") % 2 == 0).alias("cached"))


def lines_of(files: DataFrame) -> DataFrame:
    """lines(path, line_no, text); map-side only, no shuffle."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1)


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
