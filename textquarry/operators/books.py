"""Notebooks of any shape as variants: cells, outputs, functions and code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _lines(v: Column) -> Column:
    """A text that is written as one string or as a list of lines."""
    return F.coalesce(F.array_join(F.try_variant_get(v, "$", "array<string>"), ""), F.try_variant_get(v, "$", "string"))


def cells(files: DataFrame) -> DataFrame:
    """path, cell (from 1), kind, source, execution_count, outputs (their kinds, joined by spaces), error (name and value of
    the first one) of every cell of every notebook.

    A notebook is read as a variant, so cells and outputs may have any shape: what isn't there is null, and an output of an
    unknown kind keeps its place. A text that isn't JSON, or has no list of cells, has no rows.
    """
    v = F.try_parse_json("content")
    each = files.select("path", F.posexplode(F.try_variant_get(v, "$.cells", "array<variant>")).alias("cell", "c"))
    outputs = F.coalesce(F.try_variant_get("c", "$.outputs", "array<variant>"), F.array().cast("array<variant>"))
    text = lambda x, at: F.try_variant_get(x, at, "string")
    failed = F.get(F.filter(outputs, lambda o: text(o, "$.output_type") == "error"), F.lit(0))
    return each.select(
        "path",
        (F.col("cell") + 1).cast("long").alias("cell"),
        F.coalesce(text(F.col("c"), "$.cell_type"), F.lit("unknown")).alias("kind"),
        F.coalesce(_lines(F.try_variant_get("c", "$.source", "variant")), F.lit("")).alias("source"),
        F.try_variant_get("c", "$.execution_count", "bigint").alias("execution_count"),
        F.array_join(F.transform(outputs, lambda o: F.coalesce(text(o, "$.output_type"), F.lit("unknown"))), " ").alias("outputs"),
        F.concat_ws(": ", text(failed, "$.ename"), text(failed, "$.evalue")).alias("error"),
    )


def functions(found: DataFrame) -> DataFrame:
    """path, cell, name of functions and classes that code cells define. found: cells()."""
    names = F.regexp_extract_all("source", F.lit(r"(?m)^\s*(?:async\s+)?(?:def|class|function)\s+(\w+)"), F.lit(1))
    return found.where("kind = 'code'").select("path", "cell", F.explode(F.array_distinct(names)).alias("name"))


def extracted_code(found: DataFrame, numbered: bool = True) -> DataFrame:
    """path, code: the code cells of a notebook one after another, each under a line with its number if numbered. found: cells()."""
    text = F.concat(F.lit("# cell "), F.col("cell").cast("string"), F.lit("\n"), "source") if numbered else F.col("source")
    own = found.where("kind = 'code' AND trim(source) <> ''").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("cell", text.alias("text")))).alias("x"))
    return own.select("path", F.array_join(F.transform("x", lambda c: c["text"]), "\n\n").alias("code"))


def execution_order(found: DataFrame) -> DataFrame:
    """path, cell, execution_count, before: code cells that ran earlier than a cell above them, and the highest count above."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return found.where("kind = 'code' AND execution_count IS NOT NULL").withColumn("before", F.max("execution_count").over(w)).where("execution_count <= before").select("path", "cell", "execution_count", "before")
