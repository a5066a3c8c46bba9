"""Symbols, imports and what follows from them: calls, cycles, layers, dead code, type flow, the index."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, trimmed
from ..rules import symbols as S
from ..rules.changes import TYPE_USES
from ..rules.lines import LAYER_RULES, word
from ..sources.corpus import lines_of
from .ranking import batches, resolved_import

PATH_END = r"\.[^./]+$"


SYMBOLS = "path string, name string, kind string, line_no long, language string, signature string"
BODIES = "path string, name string, line_no long, params long, content string"


def _rules(kinds: list[str] | None) -> dict[str, list[tuple[str, re.Pattern]]]:
    """Patterns by language, in their order; they see whole texts, and ^ is the begin of a line."""
    out: dict[str, list[tuple[str, re.Pattern]]] = {}
    for lang, kind, pattern in S.RULES:
        if kinds is None or kind in kinds:
            out.setdefault(lang, []).append((kind, re.compile(pattern, re.M | re.ASCII)))
    return out


def places(content: str, rules: list[tuple[str, re.Pattern]]) -> Iterator[tuple[str, str, int, str]]:
    """name, kind, line, signature: the first place of each (name, kind) by pattern order, then by offset.

    A match may cross lines; its line is that of its first character that is no white space, and the signature is that
    line without white space around it, cut at 200 characters.
    """
    feeds = [m.start() for m in re.finditer("\n", content)]
    seen = set()
    for kind, pattern in rules:
        for m in pattern.finditer(content):
            name = m[1]
            if not name or len(name) < 2 or (name, kind) in seen:
                continue
            seen.add((name, kind))
            own = m[0]
            line = bisect_left(feeds, m.start() + len(own) - len(own.lstrip()))
            start, end = feeds[line - 1] + 1 if line else 0, feeds[line] if line < len(feeds) else len(content)
            yield name, kind, line + 1, content[start:end].strip()[:200]


def _of_files(files: DataFrame, kinds: list[str] | None, rows: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """rows(path, language, content, patterns of the language) of each file, in Arrow batches; nothing is shuffled."""
    types = {"string": pa.string(), "long": pa.int64()}
    arrow = pa.schema([(n, types[k]) for n, k in (x.split(" ") for x in schema.split(", "))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _rules(kinds)
        return batches((x for b in it for p, lang, c in zip(*(k.to_pylist() for k in b.columns), strict=True) for x in rows(p, lang, c, by.get(lang, by.get(S.GENERIC, [])) if lang in S.LANGUAGES else by.get(S.GENERIC, []))), arrow)

    return files.where("content IS NOT NULL").select("path", "language", "content").mapInArrow(run, schema)


def symbols(files: DataFrame, kinds: list[str] | None = None, language: str | None = None, directory: str | None = None) -> DataFrame:
    """A row of SYMBOLS for the first place of each (name, kind) of a file; a null content has none."""
    given = files
    if language:
        given = given.where(F.col("language") == language)
    if directory:
        given = given.where(F.col("path").startswith(directory.rstrip("/") + "/"))
    return _of_files(given, kinds, lambda path, lang, content, rules: ((path, name, kind, line, lang, text) for name, kind, line, text in places(content, rules)), SYMBOLS)


def _bodies(path: str, language: str, content: str, rules: list[tuple[str, re.Pattern]]) -> Iterator[tuple]:
    """A body goes to its closing brace; one that a colon opens goes on while lines are indented deeper; one of neither ends before the next definition."""
    lines = content.split("\n")
    found = list(places(content, rules))
    begins = sorted({line - 1 for _, _, line, _ in found})
    for name, _, line, _ in found:
        first, head = line - 1, lines[line - 1]
        after = next((b for b in begins[bisect_right(begins, first) :]), len(lines))
        indent, depth, opened, end = len(head) - len(head.lstrip()), 0, False, first
        by_colon = head.rstrip().endswith(":")
        for k in range(first, len(lines)):
            text = lines[k]
            if by_colon and k > first and text.strip() and len(text) - len(text.lstrip()) <= indent:
                break
            depth += text.count("{") - text.count("}")
            opened = opened or "{" in text
            if not by_colon and not opened and k >= after:
                break
            end = k if not by_colon or text.strip() else end
            if not by_colon and opened and depth <= 0:
                break
        inner = re.search(r"\(([^)]*)\)", head)
        if end - first + 1 >= 3:
            yield path, name, line, inner[1].count(",") + 1 if inner and inner[1].strip() else 0, "\n".join(lines[first : end + 1])


def bodies(files: DataFrame) -> DataFrame:
    """A row of BODIES for each function and class of three lines or more: its text from its line to its end, see _bodies()."""
    return _of_files(files, ["function", "class"], _bodies, BODIES)


def symbol_search(table: DataFrame, name: str, kind: str | None = None, per_kind: int = 100) -> DataFrame:
    """Symbols whose name holds `name`, without regard to case; at most per_kind of a kind."""
    hits = table.where(F.contains(F.lower("name"), F.lit(name.lower())))
    if kind:
        hits = hits.where(F.col("kind") == kind)
    k = F.row_number().over(Window.partitionBy("kind").orderBy("path", "line_no", "name"))
    return hits.withColumn("_k", k).where(F.col("_k") <= per_kind).drop("_k")


def imports(files: DataFrame) -> DataFrame:
    """path, import_path, distinct."""
    found = F.array_distinct(F.concat(*[F.when(F.col("language") == lang, F.regexp_extract_all("content", F.lit("(?m)" + p), F.lit(1))).otherwise(F.array().cast("array<string>")) for lang, p in S.IMPORTS]))
    return files.select("path", F.explode(found).alias("import_path")).where("import_path <> ''")


def dependency_graph(table: DataFrame) -> DataFrame:
    return table.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("import_path")).alias("imports"))


def importers(table: DataFrame, file: str) -> DataFrame:
    """Paths whose imports name a file's base."""
    base = file.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return table.where(F.col("import_path").contains(base) & (F.col("path") != file)).select("path").distinct()


def call_graph(files: DataFrame) -> DataFrame:
    """path, caller, callee, line_no (the last one): the latest definition above a call is its caller, else <module>.

    A definition's own line doesn't count as a call of itself.
    """
    lines = lines_of(files)
    name = F.regexp_extract("text", r"(?:function|def|fn|func)\s+(\w+)", 1)
    carried = F.last(F.when(name != "", name), ignorenulls=True).over(Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    calls = lines.withColumn("_def", name).withColumn("caller", F.coalesce(carried, F.lit("<module>"))).select("path", "caller", "line_no", "_def", F.explode(F.regexp_extract_all("text", F.lit(r"(\w+)\s*\("), F.lit(1))).alias("callee"))
    return calls.where(~F.col("callee").isin(S.NOT_CALLS) & (F.col("callee") != F.col("_def"))).groupBy("path", "caller", "callee").agg(F.max("line_no").cast("long").alias("line_no"))


def import_edges(files: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """src, dst: relative imports between files of the corpus, both without extension."""
    table = imports(files) if table is None else table
    stem = F.regexp_replace("path", PATH_END, "")
    edges = table.select(stem.alias("src"), resolved_import(F.col("path"), F.col("import_path")).alias("dst")).where("dst IS NOT NULL").distinct()
    return edges.join(files.select(stem.alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def on_cycles(edges: DataFrame) -> DataFrame:
    """node, cycle: nodes that lie on a cycle, with the smallest node of their strongly connected part. Self-loops are not cycles."""
    from .graphs import strongly_connected

    return strongly_connected(edges).withColumnRenamed("component", "cycle")


def self_imports(edges: DataFrame) -> DataFrame:
    return edges.where("src = dst").select(F.col("src").alias("node"))


def check_architecture(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, import_path, rule, severity) of forbidden imports and of files on circular imports, and one row: rules_checked,
    files_tested, errors, warnings, passed."""
    table = imports(files)
    circles = on_cycles(import_edges(files, table))
    found = layer_violations(table).unionByName(circles.select(F.col("node").alias("path"), F.col("cycle").alias("import_path"), F.lit("no-circular-imports").alias("rule"), F.lit("error").alias("severity")))
    counts = found.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    tested = files.agg(F.count(F.lit(1)).alias("files_tested"))
    return found, tested.join(F.broadcast(counts)).select(F.lit(len(LAYER_RULES) + 1).cast("long").alias("rules_checked"), "files_tested", "errors", "warnings", (F.col("errors") == 0).alias("passed"))


def layer_violations(table: DataFrame) -> DataFrame:
    """path, import_path, rule, severity; the rules are expressions, so imports are read once."""
    hits = F.array_compact(F.array(*[F.when(F.col("path").contains(layer) & F.exists(F.array(*[F.lit(x) for x in banned]), lambda b: F.contains(F.col("import_path"), b)), F.struct(F.lit(rule).alias("rule"), F.lit(sev).alias("severity"))) for rule, layer, banned, sev in LAYER_RULES]))
    return table.select("path", "import_path", F.inline(hits))


def type_flow(files: DataFrame, name: str) -> DataFrame:
    """path, line_no, kind of each line that names a type; the first kind of rules.changes.TYPE_USES that fits."""
    t = trimmed(F.col("text"))
    fits = lambda patterns: reduce(and_, [t.rlike(p.replace("WORD", word(name)).replace("NAME", name)) for p in patterns])
    kind = F.coalesce(*[F.when(fits(patterns), F.lit(kind)) for kind, patterns in TYPE_USES])
    return lines_of(files.where(F.col("content").contains(name))).where(F.col("text").rlike(word(name))).select("path", "line_no", kind.alias("kind")).where("kind IS NOT NULL")


def imported_names(files: DataFrame) -> DataFrame:
    """name, distinct: names that any file imports."""
    js = F.regexp_extract_all("content", F.lit(r"import\s+(?:\{([^}]+)\}|\w+)\s+from\s+['\"]"), F.lit(1))
    whole = F.regexp_extract_all("content", F.lit(r"import\s+(\w+)\s+from\s+['\"]"), F.lit(1))
    py = F.regexp_extract_all("content", F.lit(r"from\s+\S+\s+import\s+([^\n]+)"), F.lit(1))
    parts = F.flatten(F.transform(F.concat(js, whole, py), lambda x: F.split(x, ",")))
    names = F.transform(parts, lambda x: F.element_at(F.split(trimmed(x), r"\s+as\s+"), 1))
    return files.select(F.explode(F.array_distinct(names)).alias("name")).where("name <> ''").distinct()


def _word_places(files: DataFrame, place: list[str]) -> DataFrame:
    """name, least, most: the two ends of the places (path, or path and line) that hold a word; a common word is one row a task."""
    if place == ["path"]:
        each = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z0-9_]+"), F.lit(0)))).alias("name"))
    else:
        each = lines_of(files).select("path", "line_no", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0)))).alias("name"))
    at = F.struct(*place)
    return each.groupBy("name").agg(F.min(at).alias("least"), F.max(at).alias("most"))


def dead_exports(files: DataFrame) -> DataFrame:
    """path, name, line_no, kind of exported symbols that no file imports and no other file's text holds as a word.

    Words are aggregated by name before the join: a word stands elsewhere if the least or the most of its paths is another.
    """
    source = files.where(~F.col("path").rlike(r"(?i)(test|spec|__test__|\.d\.ts)"))
    exported = symbols(source).where(F.col("signature").rlike(word("export"))).where(~F.lower("name").isin(S.ENTRY_NAMES) & ~F.col("path").rlike(S.ENTRY_PATHS))
    left = exported.join(imported_names(source), "name", "left_anti").join(_word_places(files, ["path"]), "name", "left")
    alone = left.where("least IS NULL OR least.path = path AND most.path = path")
    return alone.groupBy("path", "name").agg(F.min(F.struct("line_no", "kind")).alias("x")).select("path", "name", "x.line_no", "x.kind")


def orphan_files(files: DataFrame) -> DataFrame:
    """path of source files whose base name ends no import, entry points aside: an anti-join on base names."""
    source = files.where(~F.col("path").rlike(r"(?i)(test|spec|\.d\.ts|\.config)") & ~F.col("path").rlike(S.ENTRY_PATHS))
    last = F.regexp_extract(F.regexp_replace("import_path", PATH_END, ""), r"[^/.:]+$", 0)
    named = imports(files).select(last.alias("base")).where("base <> ''").distinct()
    base = F.regexp_replace(basename(F.col("path")), PATH_END, "")
    return source.select("path", base.alias("base")).join(named, "base", "left_anti").select("path")


def find_dead_code(files: DataFrame) -> DataFrame:
    """Exported symbols that are named on no other line than their own."""
    own = symbols(files).where(F.col("signature").rlike(word("export|pub|public"))).join(_word_places(files, ["path", "line_no"]), "name", "left")
    here = lambda end: (F.col(f"{end}.path") == F.col("path")) & (F.col(f"{end}.line_no") == F.col("line_no"))
    return own.where(F.col("least").isNull() | here("least") & here("most")).select("path", "name", "kind", "line_no")


def updated(table: DataFrame, changed: DataFrame, key: str = "path") -> DataFrame:
    """table with the rows of changed keys replaced."""
    return table.join(changed.select(key).distinct(), key, "left_anti").unionByName(changed)


def removed(table: DataFrame, keys: DataFrame, key: str = "path") -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def stale(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """Paths that are new or have another modification time than the index says."""
    old = indexed.select("path", F.col("mtime").alias("_old"))
    return current.join(old, "path", "left").where("_old IS NULL OR mtime <> _old").select("path")


def index_stats(symbol_table: DataFrame) -> DataFrame:
    return symbol_table.agg(F.count(F.lit(1)).alias("symbols"), F.count_distinct("path").alias("files"))
