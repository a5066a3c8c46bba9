"""Search over lines and reading of ranges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, glob_pattern, is_code
from ..rules.lines import word
from ..sources.corpus import lines_of


def matcher(pattern: str, regex: bool = False, ignore_case: bool = True, whole_word: bool = False) -> str:
    """One Java pattern for all the options."""
    p = pattern if regex else re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", pattern)
    return ("(?i)" if ignore_case else "") + (word(p) if whole_word else p)


def search(files: DataFrame, pattern: str, regex: bool = False, ignore_case: bool = True, whole_word: bool = False, glob: str | None = None, per_file: int | None = None) -> DataFrame:
    """path, line_no, column (of the first match, from 1, in code points), text without white space at its end.

    Files are filtered by path and by content before their lines are made; only a limit per file sorts within files.
    """
    p = matcher(pattern, regex, ignore_case, whole_word)
    plain = not (regex or ignore_case or whole_word)  # no regular expression until the column is asked for
    holds = lambda c: F.col(c).contains(pattern) if plain else F.col(c).rlike(p)
    given = files.where(F.col("path").rlike(glob_pattern(glob))) if glob else files
    hits = lines_of(given.where(holds("content"))).where(holds("text"))
    if per_file is not None:
        hits = hits.withColumn("_k", F.row_number().over(Window.partitionBy("path").orderBy("line_no"))).where(F.col("_k") <= per_file).drop("_k")
    return hits.select("path", "line_no", F.regexp_instr("text", F.lit(p)).cast("long").alias("column"), F.regexp_replace("text", r"[ \t\r]+$", "").alias("text"))


def with_context(files: DataFrame, pattern: str, before: int = 1, after: int = 1, regex: bool = False, ignore_case: bool = True) -> DataFrame:
    """path, line_no, text and the lines around, as one string each (null where there is none)."""
    p = matcher(pattern, regex, ignore_case)
    given = files.where(F.col("content").rlike(p)).withColumn("_all", F.split("content", "\n"))
    hits = given.select("path", "_all", F.posexplode("_all").alias("k", "text")).where(F.col("text").rlike(p))
    start = F.greatest(F.col("k") - before, F.lit(0))
    pick = lambda a, n: F.when(n > 0, F.array_join(F.slice("_all", a, n), "\n"))
    return hits.select("path", (F.col("k") + 1).alias("line_no"), "text", pick(start + 1, F.col("k") - start).alias("before"), pick(F.col("k") + 2, F.least(F.lit(after), F.size("_all") - 1 - F.col("k"))).alias("after"))


def references(files: DataFrame, symbol: str, glob: str | None = None, whole_word: bool = True) -> DataFrame:
    """path, n lines that name the symbol, first line and last line."""
    hits = search(files, symbol, ignore_case=False, whole_word=whole_word, glob=glob)
    return hits.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


def read_range(files: DataFrame, path: str, start: int, end: int) -> DataFrame:
    """Lines start to end of one file, with the file's number of lines."""
    lines = F.split("content", "\n")
    part = F.slice(lines, start, max(0, end - start + 1))
    return files.where(F.col("path") == path).select("path", F.size(lines).alias("total_lines"), F.posexplode(part).alias("k", "text")).select("path", (F.col("k") + start).alias("line_no"), "text", "total_lines")


def read_batch(files: DataFrame, paths: list[str], most: int = 200) -> DataFrame:
    """The first lines of several files."""
    return files.where(F.col("path").isin(paths)).select("path", F.posexplode(F.slice(F.split("content", "\n"), 1, most)).alias("k", "text")).select("path", (F.col("k") + 1).alias("line_no"), "text")


def human_size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(F.format_number(n / 1024, 1), F.lit(" KB"))).otherwise(F.concat(F.format_number(n / 1048576, 1), F.lit(" MB")))


def file_tree(files: DataFrame, max_depth: int = 3) -> DataFrame:
    """dir, name, depth, size in bytes, shown size; ordered names with folders first when sorted by (dir, name)."""
    size = F.octet_length("content").cast("long")
    return files.where(F.size(F.split("path", "/")) <= max_depth).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), basename(F.col("path")).alias("name"), F.size(F.split("path", "/")).cast("long").alias("depth"), size.alias("size"), human_size(size).alias("shown"))


def directories(files: DataFrame) -> DataFrame:
    """Every directory with the number and bytes of the files right in it and below it."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    own = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    each = files.where(F.col("path").contains("/")).select(F.explode(ups).alias("dir"), own.alias("own"), F.octet_length("content").cast("long").alias("size"))
    return each.groupBy("dir").agg(F.count_if(F.col("dir") == F.col("own")).alias("files"), F.count(F.lit(1)).alias("files_below"), F.sum("size").alias("bytes_below"))


def large_files(files: DataFrame, threshold: int = 300) -> DataFrame:
    n = F.size(F.split("content", "\n")).cast("long")
    return files.select("path", "language", n.alias("lines")).where(F.col("lines") > threshold)


def code_files(files: DataFrame) -> DataFrame:
    return files.where(is_code(F.col("language")))
