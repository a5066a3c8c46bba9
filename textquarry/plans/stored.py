"""Queries that build an index of given tables in the shared folder, bring it up to date and read it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indexes, needles, symbols
from ..operators.shared import shared_folder
from .common import DOCS, PAGES, doc_files, page_files, table
from .tree import PARTS, tree

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, query, sql: str) -> None:
    QUERIES[name] = query
    ORACLES[name] = sql


# documents change three times: each time another tenth has a new text and another tenth goes
def _versions(s, d, n: int):
    docs = doc_files(s, d).join(table(s, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "doc_id"), "path")
    changed = docs.where(F.col("doc_id") % 10 == n).withColumn("content", F.concat("content", F.lit(f" v{n}")))
    return changed, docs.where(F.col("doc_id") % 10 == n + 4).select("path")


def _facts(files):
    return files.select("path", F.length("content").alias("size"), F.sha2("content", 256).alias("sha"))


def _followed(s, d):
    folder = f"{shared_folder(s)}/index"
    indexes.write_index(_facts(doc_files(s, d)), folder)
    for n in (1, 2, 3):
        changed, gone = _versions(s, d, n)
        indexes.update_index(s, folder, _facts(changed), gone)
    return indexes.read_index(s, folder)


register(
    "index_followed",
    _followed,
    f"WITH {DOCS}, t AS (SELECT source || '/' || doc_id::VARCHAR AS path, CASE WHEN doc_id % 10 IN (1, 2, 3) THEN text || ' v' || (doc_id % 10)::VARCHAR ELSE text END AS x FROM documents WHERE doc_id % 10 NOT IN (5, 6, 7)) SELECT path, length(x) AS size, sha256(x) AS sha FROM t",
)
REGEX = r'href="/[a-z]+ing"|<h1>[A-Z]\w+ (the|of) |<title>\w+heen'


def _by_trigrams(s, d):
    folder = f"{shared_folder(s)}/trigrams"
    files = page_files(s, d)
    indexes.write_trigrams(files, folder)
    return indexes.search_trigrams(files, folder, REGEX)[0].select("path")


register("indexed_regex_pages", _by_trigrams, f"WITH {PAGES} SELECT path FROM files WHERE regexp_matches(content, '{REGEX}')")


def _like(s, d):
    folder = f"{shared_folder(s)}/trigrams"
    names = symbols.symbols(tree(s, d)).select("path", "name", "kind", F.concat_ws("\n", "path", "kind", "name").alias("key"))
    indexes.write_trigrams(names, folder, "key", "name")
    return indexes.search_trigrams(names, folder, "LIMIT%\\_1_", True, "key", "name")[0].select("path", "name", "kind")


register("find_symbols_like", _like, f"WITH RECURSIVE {PARTS} SELECT path, name, kind FROM syms WHERE name LIKE 'LIMIT%\\_1_' ESCAPE '\\'")
register(
    "passages_held",
    lambda s, d: needles.holds(doc_files(s, d), table(s, d, "benchmark").select(F.col("item_id").alias("needle_id"), F.col("text").alias("needle"))).select("path", "needle_id"),
    f"WITH {DOCS} SELECT path, item_id AS needle_id FROM files JOIN benchmark b ON contains(content, b.text) WHERE b.text <> ''",
)
# importers of the tree's files by the text of their imports
register(
    "importers_by_text",
    lambda s, d: needles.holds(tree(s, d), table(s, d, "part").select(F.col("p_partkey").alias("needle_id"), F.concat(F.lit("./p"), F.col("p_partkey").cast("string"), F.lit("'")).alias("needle")), by_line=True),
    f"WITH RECURSIVE {PARTS} SELECT path, dst AS needle_id, nth AS line_no, 1 AS n FROM e JOIN part ON p_partkey = dst",
)
