"""Chunks, term statistics, concept search and context packing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import expanded, terms, terms_of, token_estimate
from ..rules import changes as R
from ..rules.concepts import CONCEPTS
from ..sources.corpus import lines_of
from .shared import checkpointed

# Lines that begin a definition.
DEFINITION = r"^(?:export\s+)?(?:async\s+)?(?:function|class|def|fn|func|pub\s+fn|pub\s+async\s+fn|module|impl)(?![A-Za-z0-9_])"
METHOD = r"^\s+(?:async\s+)?(?:public|private|protected|static)?\s*(?:function|def|fn)?\s*\w+\s*\("
SOFT, HARD = 5, 50


def chunks(files: DataFrame) -> DataFrame:
    """path, chunk_no, start_line, end_line, chunk: cut before a definition once a chunk has more than SOFT lines, and at HARD lines.

    The cuts are an ordered fold over a file's lines; files stay rows, so nothing is shuffled.
    """
    lines = F.split("content", "\n")
    flags = F.transform(lines, lambda x: F.trim(x).rlike(DEFINITION) | x.rlike(METHOD))

    def step(acc: Column, is_def: Column) -> Column:
        cut = (is_def & (acc["held"] > SOFT)) | (acc["held"] >= HARD)
        return F.struct(F.when(cut, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"]).alias("starts"), F.when(cut, F.lit(1)).otherwise(acc["held"] + 1).alias("held"), (acc["at"] + 1).alias("at"))

    start = F.struct(F.array(F.lit(1)).alias("starts"), F.lit(0).alias("held"), F.lit(1).alias("at"))
    starts = F.aggregate(flags, start, step, lambda a: a["starts"])
    cut = files.select("path", lines.alias("_lines"), starts.alias("_starts"))
    one = cut.select("path", "_lines", "_starts", F.posexplode("_starts").alias("chunk_no", "start_line"))
    end = F.coalesce(F.get("_starts", F.col("chunk_no") + 1) - 1, F.size("_lines"))
    return one.select("path", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("start_line").cast("long").alias("start_line"), end.cast("long").alias("end_line"), F.array_join(F.slice("_lines", F.col("start_line"), end - F.col("start_line") + 1), "\n").alias("chunk"))


def document_frequency(tokens: DataFrame) -> DataFrame:
    """term, df over rows with a `terms` array of distinct terms."""
    return tokens.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def inverse_frequency(tokens: DataFrame) -> DataFrame:
    """term, df, idf = ln(N / (1 + df))."""
    n = tokens.agg(F.count(F.lit(1)).alias("n"))
    return document_frequency(tokens).join(F.broadcast(n)).select("term", "df", F.log(F.col("n") / (1 + F.col("df"))).alias("idf"))


def concept_search(parts: DataFrame, query: str, key: list[str], text: str = "chunk", most: int = 20) -> DataFrame:
    """key, score, matched, snippet of the best `most` rows for a query.

    Terms are distinct within a row, so a score is the sum of the weights of the matched terms, where a weight of 0 counts
    as 1. Only the query's terms leave the scan; the frequency table has a row for each of them at most.
    """
    wanted = expanded(query)
    array = F.array(*[F.lit(w) for w in wanted]) if wanted else F.array().cast("array<string>")
    # without quotes a term is a run of letters and digits of the text, so a text without any of the words need not be taken apart
    some = F.lower(text).rlike("|".join(["['\"`]", *wanted])) if wanted else F.lit(False)
    found = F.when(some, F.array_intersect(terms(F.col(text)), array)).otherwise(F.array().cast("array<string>"))
    own = checkpointed(parts.select(*key, found.alias("terms"), F.when(some, F.array_join(F.slice(F.split(text, "\n"), 1, 5), "\n")).alias("snippet")))
    weights = inverse_frequency(own).select("term", F.when(F.col("idf") == 0, 1.0).otherwise(F.col("idf")).alias("weight"))
    table = F.broadcast(weights.agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("w")))
    scored = own.where(F.size("terms") > 0).join(table).withColumn("score", F.round(F.aggregate("terms", F.lit(0.0), lambda a, t: a + F.element_at("w", t)), 6))
    return scored.where("score > 0").select(*key, "score", F.array_sort("terms").alias("matched"), "snippet").orderBy(F.desc("score"), *key).limit(most)


def relevance(path: Column, content: Column, query: str) -> Column:
    """0 to 1: query words in path and content, source files up, tests, configuration and depth down."""
    low_path, low = F.lower(path), F.lower(content)
    hits = lambda w: (F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)
    if_any = lambda condition, points: F.when(condition, F.lit(points)).otherwise(F.lit(0.0))
    points = [p for w in terms_of(query) for p in (if_any(low_path.contains(w), R.IN_PATH), F.least(hits(w) * R.EACH_HIT, F.lit(R.MOST_HITS)))]
    points.append(if_any(path.rlike(r"\.(ts|tsx|js|jsx|py|go|rs|java)$"), R.SOURCE_FILE))
    points += [if_any(low_path.rlike("test|spec"), R.TEST_FILE), if_any(low_path.rlike("config"), R.CONFIG_FILE)]
    points.append(F.greatest(F.lit(0.0), R.TOP - F.size(F.split(path, "/")) * R.EACH_FOLDER))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), sum(points, F.lit(0.0))))


def merged_regions(regions: DataFrame) -> DataFrame:
    """path, start_line, end_line: regions that overlap or touch become one."""
    w = Window.partitionBy("path").orderBy("start_line", "end_line")
    reach = F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = regions.withColumn("_new", F.when(F.col("start_line") <= reach + 1, 0).otherwise(1))
    run = new.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("path", "_run").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("_run")


def context_pack(files: DataFrame, query: str, max_tokens: int = 8000, max_files: int = 20) -> DataFrame:
    """path, score, tokens, rank of the files that fill a token budget: best first, those that don't fit are skipped.

    The fold runs over at most max_files rows, which is the feature's own limit.
    """
    ranked = files.select("path", F.round(relevance(F.col("path"), F.col("content"), query), 6).alias("score"), token_estimate(F.col("content")).alias("tokens")).where("score > 0.2").orderBy(F.desc("score"), "path").limit(max_files)
    rows = ranked.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "path", "score", "tokens"))).alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["tokens"] <= max_tokens
        return F.struct(F.when(fits, acc["used"] + x["tokens"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))

    kind = "array<struct<o:double,path:string,score:double,tokens:bigint>>"
    kept = F.aggregate("rows", F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(kind).alias("kept")), step, lambda a: a["kept"])
    return rows.select(F.posexplode(kept).alias("k", "x")).select("x.path", "x.score", "x.tokens", (F.col("k") + 1).cast("long").alias("rank"))


def regions_of(files: DataFrame, pattern: str, around: int = 2) -> DataFrame:
    """path, start_line, end_line around lines that match."""
    hits = lines_of(files.where(F.col("content").rlike(pattern))).where(F.col("text").rlike(pattern))
    return hits.select("path", F.greatest(F.lit(1), F.col("line_no") - around).cast("long").alias("start_line"), (F.col("line_no") + around).cast("long").alias("end_line"))


def resolved_import(path: Column, target: Column) -> Column:
    """A relative import's path without its extension, else null."""
    joined = F.concat(F.regexp_extract(path, "^(.*/)?[^/]*$", 1), target)
    parts = F.split(joined, "/")
    step = lambda acc, p: F.when((p == ".") | (p == ""), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    full = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(target.startswith("."), F.regexp_replace(full, r"\.[A-Za-z]+$", ""))


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size."""
    held: list[tuple] = []
    for x in rows:
        held.append(x)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def expanded_queries(queries: DataFrame) -> DataFrame:
    """query, term: the terms of each query and all synonyms of the concepts that they belong to; many queries at once."""
    spark = queries.sparkSession
    concepts = F.broadcast(spark.createDataFrame([(t, synonyms) for c, synonyms in CONCEPTS.items() for t in dict.fromkeys([c, *synonyms])], "term string, synonyms array<string>"))
    own = queries.select("query").distinct().select("query", F.explode(terms(F.col("query"))).alias("term"))
    return own.union(own.join(concepts, "term").select("query", F.explode("synonyms"))).distinct()
