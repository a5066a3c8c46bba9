"""SQL fragments of the oracles, and tables as the queries read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import corpus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents_as_files(table(spark, sf_dir, "documents"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.pages_as_files(table(spark, sf_dir, "pages"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.events_as_usage(table(spark, sf_dir, "events"))


DOCS = "files AS (SELECT source || '/' || doc_id::VARCHAR AS path, lang AS language, text AS content FROM documents)"
PAGES = "files AS (SELECT 'page/' || page_id::VARCHAR || '.html' AS path, 'html' AS language, html AS content FROM pages)"
LINES = "lines AS (SELECT path, generate_subscripts(x, 1) AS line_no, unnest(x) AS text FROM (SELECT path, string_split(content, chr(10)) AS x FROM files))"
USAGE = "usage AS (SELECT event_type AS tool, ts, value AS duration_ms, event_type <> 'error' AS success, user_id % 2 = 0 AS cached FROM events)"
BLANKS = "'^[ \\t\\n\\r\\x0B\\f]+|[ \\t\\n\\r\\x0B\\f]+$'"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, {BLANKS}, '', 'g')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def word_count(x: str, pattern: str) -> str:
    """Matches of a whole ASCII word; RE2's own boundaries are ASCII."""
    return f"len(regexp_extract_all({x}, {quoted(chr(92) + 'b(?:' + pattern + ')' + chr(92) + 'b')}))"


def mark_count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {quoted(pattern)}))"
