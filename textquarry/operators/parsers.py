"""Extractors whose matches cross lines: mappers of schemas, routes and documentation."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..rules import web as W
from . import schemas
from .ranking import batches

KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}


def parsed(files: DataFrame, gate: str, parse: Callable[[str, str], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that parse(path, content) yields for files that pass the gate, in Arrow batches; the gate runs before Python."""
    arrow = pa.schema([(n, KINDS[k]) for n, k in (x.split(" ") for x in schema.split(", "))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches((x for b in it for p, c in zip(*(k.to_pylist() for k in b.columns), strict=True) for x in parse(p, c)), arrow)

    return files.where(F.col("content").rlike(gate)).select("path", "content").mapInArrow(run, schema)


COLUMNS = "path string, orm string, table string, column string, type string, nullable boolean, primary boolean, unique boolean, default string, references string"


def _drizzle(path: str, text: str) -> Iterator[tuple]:
    for m in re.finditer(r"(?:pgTable|mysqlTable|sqliteTable)\s*\(\s*['\"](\w+)['\"]\s*,\s*(?:\(\w*\)\s*=>\s*\(?)?\s*\{", text):
        depth, end = 1, m.end()
        while depth and end < len(text):
            depth += (text[end] == "{") - (text[end] == "}")
            end += 1
        for line in text[m.end() : end - 1].split("\n"):
            c = re.match(r"\s*(\w+)\s*:\s*(?:\w+\.)?(\w+)\s*\(", line)
            if c:
                to = re.search(r"references\s*\(\s*\(\s*\)\s*(?::\s*\w+)?\s*=>\s*(\w+)\.", line)
                yield path, "drizzle", m[1], c[1], c[2], ".notNull()" not in line and ".primaryKey" not in line, ".primaryKey" in line, ".unique(" in line, (re.search(r"\.default\(([^()]*(?:\([^()]*\))?)\)", line) or [None, None])[1], to[1] if to else None


# Object-relational mapper, ending of the file, gate, pattern of a table's class or name, pattern of a column with name and type.
MAPPERS: list[tuple[str, str, str, str, str | None]] = [
    ("typeorm", r"\.ts$", r"@Entity", r"@Entity\s*\([^)]*\)\s*(?:export\s+)?class\s+(\w+)", r"@(?:Primary\w*)?Column\s*\([^)]*\)\s*(\w+)[?!]?\s*:\s*(\w+)"),
    ("sequelize", r"\.(js|ts)$", r"sequelize\.define|extends\s+Model", r"sequelize\.define\s*\(\s*['\"](\w+)['\"]", r"(\w+)\s*:\s*\{?\s*(?:type\s*:\s*)?DataTypes\.(\w+)"),
    ("mikroorm", r"\.ts$", r"@mikro-orm", r"@Entity\s*\([^)]*\)\s*(?:export\s+)?class\s+(\w+)", r"@Property\s*\([^)]*\)\s*(\w+)[?!]?\s*:\s*(\w+)"),
    ("knex", r"\.(js|ts)$", r"createTable", r"createTable\s*\(\s*['\"](\w+)['\"]", r"table\.(\w+)\s*\(\s*['\"](\w+)['\"]"),
    ("sqlalchemy", r"\.py$", r"Column\s*\(", r"class\s+(\w+)\s*\([^)]*Base[^)]*\)", r"(\w+)\s*=\s*(?:db\.)?Column\s*\(\s*(?:db\.)?(\w+)"),
    ("django", r"\.py$", r"models\.Model", r"class\s+(\w+)\s*\(\s*models\.Model\s*\)", r"(\w+)\s*=\s*models\.(\w+)\s*\("),
    ("peewee", r"\.py$", r"peewee", r"class\s+(\w+)\s*\(\s*\w*Model\s*\)", r"(\w+)\s*=\s*(\w+Field)\s*\("),
    ("tortoise", r"\.py$", r"tortoise", r"class\s+(\w+)\s*\(\s*(?:models\.)?Model\s*\)", r"(\w+)\s*=\s*fields\.(\w+)\s*\("),
    ("sqlmodel", r"\.py$", r"SQLModel", r"class\s+(\w+)\s*\(\s*SQLModel", r"(?m)^\s+(\w+)\s*:\s*([\w\[\]]+)"),
    ("activerecord", r"\.rb$", r"ApplicationRecord|ActiveRecord::Base", r"class\s+(\w+)\s*<\s*(?:ApplicationRecord|ActiveRecord::Base)", None),
    ("sequel", r"\.rb$", r"Sequel::Model", r"class\s+(\w+)\s*<\s*Sequel::Model", None),
    ("jpa", r"\.(java|kt)$", r"@Entity", r"@Entity[\s\S]{0,200}?class\s+(\w+)", r"private\s+()(\w+)\s+\w+\s*;"),
    ("doctrine", r"\.php$", r"ORM\\", r"class\s+(\w+)", None),
    ("eloquent", r"\.php$", r"extends\s+Model", r"class\s+(\w+)\s+extends\s+Model", None),
    ("entity-framework", r"\.cs$", r"DbSet<", r"DbSet<(\w+)>", None),
    ("gorm", r"\.go$", r"gorm", r"type\s+(\w+)\s+struct\s*\{", r"(?m)^\s+(\w+)\s+([\w.*]+)\s+`"),
    ("diesel", r"\.rs$", r"table!\s*\{|diesel", r"table!\s*\{\s*(\w+)", r"(\w+)\s*->\s*(\w+)"),
    ("sea-orm", r"\.rs$", r"sea_orm", r"table_name\s*=\s*\"(\w+)\"", r"pub\s+(\w+)\s*:\s*(\w+)"),
]


def _mappers(path: str, text: str) -> Iterator[tuple]:
    for orm, ending, gate, table, column in MAPPERS:
        if not re.search(ending, path) or not re.search(gate, text):
            continue
        found = list(re.finditer(table, text))
        for k, m in enumerate(found):
            body = text[m.end() : found[k + 1].start() if k + 1 < len(found) else len(text)]
            columns = list(re.finditer(column, body)) if column else []
            for c in columns:
                name, kind = (c[2], c[1]) if orm == "knex" else (c[1], c[2])
                yield path, orm, m[1], name, kind, None, None, None, None, None
            if not columns:
                yield path, orm, m[1], None, None, None, None, None, None, None


def db_columns(files: DataFrame) -> DataFrame:
    """A row of COLUMNS for each column of each table (without a column where only the table is known)."""

    def parse(path: str, text: str) -> Iterator[tuple]:
        if path.endswith(".sql"):
            yield from ((path, "sql", *x) for x in schemas.sql_columns(text))
        elif path.endswith(".prisma"):
            yield from ((path, "prisma", *x) for x in schemas.prisma_columns(text))
        else:
            yield from _drizzle(path, text)
            yield from _mappers(path, text)

    return parsed(files, r"(?i)create\s+table|model|entity|table|class|struct", parse, COLUMNS).distinct()


def db_tables(columns: DataFrame) -> DataFrame:
    return columns.groupBy("path", "orm", "table").agg(F.count("column").alias("columns"), F.count_if("primary").alias("keys"), F.count("references").alias("foreign_keys"))


def db_relationships(columns: DataFrame) -> DataFrame:
    """source, target, kind, through: foreign keys, and tables of little else than two of them."""
    one = columns.where("references IS NOT NULL").select(F.col("table").alias("source"), F.col("references").alias("target"), F.lit("one-to-many").alias("kind"), F.lit(None).cast("string").alias("through"))
    joins = columns.groupBy("path", "table").agg(F.count("column").alias("n"), F.array_sort(F.collect_set("references")).alias("to")).where((F.size("to") >= 2) & (F.col("n") <= F.size("to") + 2))
    many = joins.select(F.col("to")[0].alias("source"), F.col("to")[1].alias("target"), F.lit("many-to-many").alias("kind"), F.col("table").alias("through"))
    return one.unionByName(many).distinct()


def _crud(source: str, path: str, base: str) -> Iterator[tuple]:
    for method, tail in (("GET", ""), ("POST", ""), ("GET", "/:id"), ("PUT", "/:id"), ("DELETE", "/:id")):
        yield path, source, method, base + tail


def _routes(path: str, text: str) -> Iterator[tuple]:
    for source, ending, gate, prefix, route in W.ROUTES:
        if not re.search(ending, path) or not re.search(gate, text):
            continue
        base = (re.search(prefix, text) or [None, ""])[1] if prefix else ""
        for m in re.finditer(route, text, re.I):
            own = m[2] or ""
            method = m[1].upper()
            if source == "rails" and not own.startswith("/"):
                own = "/" + own
            full = own if prefix is None else "/" + "/".join(x.strip("/") for x in (base, own) if x.strip("/"))
            yield path, source, "ANY" if method in ("ALL", "MATCH", "METHOD") else "GET" if method == "ROUTE" else method, full
        if source == "rails":
            for m in re.finditer(r"resources?\s+:(\w+)", text):
                yield from _crud(source, path, f"/{m[1]}")
        if source == "laravel":
            for m in re.finditer(r"Route::resource\s*\(\s*['\"]([^'\"]+)['\"]", text):
                yield from _crud(source, path, "/" + m[1].strip("/"))
    if re.search(r"\.py$", path):
        for m in re.finditer(r"class\s+(\w+)ViewSet\b([\s\S]*?)(?=\nclass\s|\Z)", text):
            for action, method, tail in (("list", "GET", ""), ("create", "POST", ""), ("retrieve", "GET", "/:id"), ("update", "PUT", "/:id"), ("destroy", "DELETE", "/:id")):
                if re.search(rf"def\s+{action}\b", m[2]):
                    yield path, "django", method, f"/{m[1].lower()}{tail}"
    if re.search(r"server\.route", text):
        for m in re.finditer(r"method\s*:\s*['\"](\w+)['\"]\s*,\s*path\s*:\s*['\"]([^'\"]+)['\"]", text):
            yield path, "hapi", m[1].upper(), m[2]
    if path.endswith((".graphql", ".gql")):
        for m in re.finditer(r"type\s+(Query|Mutation|Subscription)\s*\{([^}]+)\}", text):
            for f in re.finditer(r"(?m)^\s*(\w+)\s*(?:\([^)]*\))?\s*:", m[2]):
                yield path, "graphql", m[1].upper(), f[1]


def api_endpoints(files: DataFrame) -> DataFrame:
    """path, source, method, route of code and GraphQL files; sources whose gates overlap both report."""
    gate = "|".join(f"(?:{r[2]})" for r in W.ROUTES) + r"|ViewSet|server\.route|type\s+(?:Query|Mutation|Subscription)"
    return parsed(files, gate, _routes, "path string, source string, method string, route string").distinct()


def openapi_endpoints(files: DataFrame) -> DataFrame:
    """path, source, method, route of OpenAPI documents in JSON."""
    verbs = ["get", "post", "put", "delete", "patch", "head", "options"]
    doc = F.from_json("content", "struct<openapi: string, swagger: string, paths: map<string, map<string, string>>>")
    given = files.where(F.col("path").endswith(".json") & F.col("content").rlike('"(openapi|swagger)"')).select("path", doc.alias("d")).where("d.openapi IS NOT NULL OR d.swagger IS NOT NULL")
    return given.select("path", F.explode("d.paths").alias("route", "ops")).select("path", "route", F.explode(F.map_keys("ops")).alias("verb")).where(F.col("verb").isin(verbs)).select("path", F.lit("openapi").alias("source"), F.upper("verb").alias("method"), "route")


def method_histogram(endpoints: DataFrame) -> DataFrame:
    return endpoints.groupBy("method").agg(F.count(F.lit(1)).alias("endpoints"), F.count_distinct("source").alias("sources"))


DOCS = "path string, name string, kind string, line_no long, summary string, params long, deprecated boolean"
_NAME = re.compile(r"(?:function|class|def|fn|func|interface|type|struct|enum|trait|const|let|var)\s+(?:\([^)]*\)\s*)?(\w+)|(\w+)\s*\(", re.ASCII)


def _docs(path: str, text: str) -> Iterator[tuple]:
    lines = text.split("\n")

    def named(at: int) -> str | None:
        while at < len(lines) and (not lines[at].strip() or lines[at].strip().startswith(("@", "#["))):
            at += 1
        m = _NAME.search(lines[at]) if at < len(lines) else None
        return (m[1] or m[2]) if m else None

    if path.endswith(".py"):
        for m in re.finditer(r'(?m)^([ \t]*)(?:async\s+)?(def|class)\s+(\w+)[^\n]*:\s*\n\s*(?:"""|\'\'\')([\s\S]*?)(?:"""|\'\'\')', text):
            args = re.search(r"(?:Args|Parameters):\s*\n((?:[ \t]+\S.*\n?)+)", m[4])
            yield path, m[3], "docstring", text.count("\n", 0, m.start()) + 1, m[4].strip().split("\n")[0], len(re.findall(r"(?m)^\s+\w+\s*(?:\([^)]*\))?:", args[1])) if args else 0, "deprecated" in m[4].lower()
        return
    for m in re.finditer(r"/\*\*([\s\S]*?)\*/", text):
        at = text.count("\n", 0, m.end()) + 1
        if name := named(at):
            body = [re.sub(r"^\s*\*\s?", "", x).strip() for x in m[1].split("\n")]
            yield path, name, "block", at, next((x for x in body if x and not x.startswith("@")), ""), sum(x.startswith("@param") for x in body), any(x.startswith("@deprecated") for x in body)
    mark = "///" if path.endswith(".rs") else "//" if path.endswith(".go") else None
    run: list[str] = []
    for i, line in enumerate(lines):
        t = line.strip()
        if mark and t.startswith(mark):
            run.append(t[len(mark) :].strip())
        elif run:
            if t and (name := named(i)):
                yield path, name, "comment", i + 1, run[0], 0, any("deprecated" in x.lower() for x in run)
            run = []


def docs(files: DataFrame, file: str | None = None, symbol: str | None = None) -> DataFrame:
    """Rows of DOCS: documented symbols by block comments, docstrings and line comments; of one file, or of symbols whose name holds a text, if asked for."""
    given = files.where(F.col("path") == file) if file else files
    found = parsed(given, r'/\*\*|"""|\'\'\'|//', _docs, DOCS)
    return found.where(F.contains(F.lower("name"), F.lit(symbol.lower()))) if symbol else found


def undocumented(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Functions, classes, interfaces and types without documentation, private names (leading _) aside."""
    own = symbols.where(F.col("kind").isin("function", "class", "interface", "type") & ~F.col("name").startswith("_"))
    return own.join(docs(files).select("path", "name").distinct(), ["path", "name"], "left_anti").select("path", "name", "kind", "line_no")


def migrations(files: DataFrame) -> DataFrame:
    """path, timestamp (the first 10 to 14 digits of the path, null without), description of SQL files, in the order of their timestamps and names as `nth`."""
    stamp = F.nullif(F.regexp_extract("path", r"(\d{10,14})", 1), F.lit(""))
    each = files.where(F.col("path").endswith(".sql")).select("path", stamp.alias("timestamp"), F.regexp_extract("path", "[^/]*$", 0).alias("description"))
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return each.withColumn("nth", F.row_number().over(Window.partitionBy(folder).orderBy(F.asc_nulls_last("timestamp"), "path")).cast("long"))


def schema_summary(columns: DataFrame) -> DataFrame:
    """One row: tables, columns, relationships and the mappers that were seen. columns: db_columns()."""
    counts = columns.agg(F.count_distinct("path", "table").alias("tables"), F.count("column").alias("columns"), F.array_join(F.array_sort(F.collect_set("orm")), " ").alias("orms"))
    links = db_relationships(columns).agg(F.count(F.lit(1)).alias("relationships"))
    return counts.join(F.broadcast(links)).select("tables", "columns", "relationships", "orms")
