"""Queries over reports, manifests, schemas and pipelines that are written from the given tables by DataFrame functions.

The operators parse the texts; the SQL computes the expected rows from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import books, change, formats, metrics, parsers, project, routers, settings, symbols
from ..rules import web as W
from . import tree as T
from .common import quoted, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, query, sql: str) -> None:
    QUERIES[name] = query
    ORACLES[name] = sql


def _text(*parts):
    """Texts as they stand, and columns, put together."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _joined(column, by: str = "\n"):
    return F.array_join(F.array_sort(F.collect_list(column)), by)


# coverage: a report for each supplier with a record for each of its parts; an order's line is a line, hit if it isn't the first
def _items(s, d) -> DataFrame:
    return table(s, d, "lineitem").select(F.col("l_suppkey").alias("sk"), F.col("l_partkey").alias("pk"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("nr"), "l_returnflag", "l_linestatus")


def _lcov(s, d) -> DataFrame:
    by = _items(s, d).groupBy("sk", "pk").agg(_joined(_text("DA:", F.col("o"), ",", F.col("nr") - 1)).alias("da"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_linestatus") == "F").alias("f"))
    record = _text("SF:src/p", F.col("pk"), ".ts\n", F.col("da"), "\nFNF:", F.col("n"), "\nFNH:", F.col("r"), "\nBRF:", F.col("n"), "\nBRH:", F.col("f"), "\nend_of_record")
    return by.groupBy("sk").agg(_joined(record).alias("content")).select(_text("cov/s", F.col("sk"), "/lcov.info").alias("path"), "content")


def _percent(hit: str, total: str) -> str:
    return f"floor({hit} * 100 / {total} + 0.5)::BIGINT"


COVERED = f"""c AS (SELECT 'cov/s' || l_suppkey::VARCHAR || '/lcov.info' AS path, 'src/p' || l_partkey::VARCHAR || '.ts' AS file, count(DISTINCT l_orderkey) AS lines_total, count(DISTINCT CASE WHEN l_linenumber > 1 THEN l_orderkey END) AS lines_hit,
count(*) AS functions_total, count(*) FILTER (l_returnflag = 'R') AS functions_hit, count(*) AS branches_total, count(*) FILTER (l_linestatus = 'F') AS branches_hit FROM lineitem GROUP BY l_suppkey, l_partkey), cov AS (SELECT *, {_percent('lines_hit', 'lines_total')} AS percent FROM c)"""
register("lcov", lambda s, d: formats.lcov(_lcov(s, d)), f"WITH {COVERED} SELECT * FROM cov")
register("coverage_summary", lambda s, d: formats.coverage_summary(formats.lcov(_lcov(s, d))), f"WITH {COVERED} SELECT count(*) AS files, sum(lines_total)::BIGINT AS lines_total, sum(lines_hit)::BIGINT AS lines_hit, count(*) FILTER (lines_hit = 0) AS untested, {_percent('sum(lines_hit)', 'sum(lines_total)')} AS percent FROM cov")
register("untested_files", lambda s, d: formats.lcov(_lcov(s, d)).where("lines_hit = 0").select("path", "file"), f"WITH {COVERED} SELECT path, file FROM cov WHERE lines_hit = 0")
register("coverage_of_file", lambda s, d: project.file_coverage(formats.lcov(_lcov(s, d)), "/work/src/p7.ts").select("path", "file", "percent"), f"WITH {COVERED} SELECT path, file, percent FROM cov WHERE file = 'src/p7.ts'")
register("coverage_location", lambda s, d: project.report_location(_lcov(s, d)), f"WITH {COVERED} SELECT min(path) AS path, 'lcov' AS format FROM cov")


def _istanbul(s, d) -> DataFrame:
    hits = _items(s, d).groupBy("sk", "pk", "o").agg((F.max("nr") - 1).alias("hits"))
    lines = hits.groupBy("sk", "pk").agg(F.map_from_entries(F.collect_list(F.struct(F.col("o").cast("string"), "hits"))).alias("s"))
    calls = _items(s, d).groupBy("sk", "pk", "l_returnflag").count().groupBy("sk", "pk").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "count"))).alias("f"))
    entry = F.struct(_text("src/p", F.col("pk"), ".ts"), F.struct("s", "f"))
    return lines.join(calls, ["sk", "pk"]).groupBy("sk").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("content")).select(_text("cov/s", F.col("sk"), "/coverage-final.json").alias("path"), "content")


register(
    "istanbul",
    lambda s, d: formats.istanbul(_istanbul(s, d)),
    f"""WITH h AS (SELECT l_suppkey AS sk, l_partkey AS pk, l_orderkey, max(l_linenumber) - 1 AS hits FROM lineitem GROUP BY ALL), s AS (SELECT sk, pk, count(*) AS statements, count(*) FILTER (hits > 0) AS hit FROM h GROUP BY ALL),
    f AS (SELECT l_suppkey AS sk, l_partkey AS pk, count(DISTINCT l_returnflag) AS functions FROM lineitem GROUP BY ALL)
    SELECT 'cov/s' || sk::VARCHAR || '/coverage-final.json' AS path, 'src/p' || pk::VARCHAR || '.ts' AS file, statements, hit, functions, {_percent('hit', 'statements')} AS percent FROM s JOIN f USING (sk, pk)""",
)


def _summaries(s, d) -> DataFrame:
    by = _items(s, d).groupBy("sk", "pk").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("covered"))
    files = F.collect_list(F.struct(_text("src/p", F.col("pk"), ".ts"), F.struct(F.struct("total", "covered").alias("lines"))))
    whole = F.array(F.struct(F.lit("total"), F.struct(F.struct(F.sum("total").alias("total"), F.sum("covered").alias("covered")).alias("lines"))))
    return by.groupBy("sk").agg(F.to_json(F.map_from_entries(F.concat(files, whole))).alias("content")).select(_text("cov/s", F.col("sk"), "/coverage-summary.json").alias("path"), "content")


RETURNED = "t AS (SELECT l_suppkey AS sk, l_partkey AS pk, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY ALL)"
register("istanbul_summary", lambda s, d: formats.istanbul_summary(_summaries(s, d)), f"WITH {RETURNED} SELECT 'cov/s' || sk::VARCHAR || '/coverage-summary.json' AS path, 'src/p' || pk::VARCHAR || '.ts' AS file, n AS lines, r AS hit, {_percent('r', 'n')} AS percent FROM t")


def _cobertura(s, d) -> DataFrame:
    by = _items(s, d).groupBy("sk", "pk").agg((F.count_if(F.col("l_returnflag") == "R") * 100 / F.count(F.lit(1))).cast("int").alias("p"))
    tag = _text('<class name="p" filename="src/p', F.col("pk"), '.ts" line-rate="', F.when(F.col("p") == 100, "1.00").otherwise(_text("0.", F.lpad(F.col("p").cast("string"), 2, "0"))), '">')
    return by.groupBy("sk").agg(_text("<coverage>", _joined(tag), "</coverage>").alias("content")).select(_text("cov/s", F.col("sk"), "/cobertura.xml").alias("path"), "content")


register("cobertura", lambda s, d: formats.cobertura(_cobertura(s, d)), f"WITH {RETURNED} SELECT 'cov/s' || sk::VARCHAR || '/cobertura.xml' AS path, 'src/p' || pk::VARCHAR || '.ts' AS file, r * 100 // n AS percent FROM t")

# lock files: each supplier's parts stand for packages of the advisory table, in versions by size and number
KINDS = [(name, system) for name, system, _, _ in W.ADVISORIES]


def _locks(s, d) -> DataFrame:
    known = s.createDataFrame([(k, *x) for k, x in enumerate(KINDS)], "kind int, name string, system string")
    parts = table(s, d, "part").select(F.col("p_partkey").alias("pk"), (F.col("p_partkey") % len(KINDS)).cast("int").alias("kind"), F.concat_ws(".", (F.col("p_size") % 13).cast("string"), (F.col("p_partkey") % 30).cast("string"), (F.col("p_size") % 40).cast("string")).alias("version"))
    used = _items(s, d).select("sk", "pk").distinct().join(parts, "pk").join(F.broadcast(known), "kind").groupBy("sk", "name", "system").agg(F.max_by("version", "pk").alias("version"))
    npm = F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(_text("node_modules/", F.col("name")), F.struct("version")))).alias("packages")))
    pip, cargo = _joined(_text(F.col("name"), "==", F.col("version"))), _joined(_text('name = "', F.col("name"), '"\nversion = "', F.col("version"), '"'), "\n\n")
    of = lambda system, file, content: used.where(F.col("system") == system).groupBy("sk").agg(content.alias("content")).select(_text("s", F.col("sk"), "/", file).alias("path"), "content")
    return of("npm", "package-lock.json", npm).unionByName(of("pip", "requirements.txt", pip)).unionByName(of("cargo", "Cargo.lock", cargo))


_NAMES, _SYSTEMS = (f"[{', '.join(quoted(x[k]) for x in KINDS)}]" for k in (0, 1))
LOCKED = f"""v AS (SELECT p_partkey AS pk, ({_NAMES})[p_partkey % {len(KINDS)} + 1] AS name, ({_SYSTEMS})[p_partkey % {len(KINDS)} + 1] AS ecosystem, (p_size % 13)::VARCHAR || '.' || (p_partkey % 30)::VARCHAR || '.' || (p_size % 40)::VARCHAR AS version FROM part),
locked AS (SELECT 's' || l_suppkey::VARCHAR || CASE ecosystem WHEN 'npm' THEN '/package-lock.json' WHEN 'pip' THEN '/requirements.txt' ELSE '/Cargo.lock' END AS path, ecosystem, name, arg_max(version, pk) AS version FROM lineitem JOIN v ON pk = l_partkey GROUP BY l_suppkey, ecosystem, name)"""
register("lockfile_dependencies", lambda s, d: formats.locked_dependencies(_locks(s, d)), f"WITH {LOCKED} SELECT * FROM locked")
_KNOWN = ", ".join("(" + ", ".join(map(quoted, row)) + ")" for row in W.ADVISORIES)
_PARTS = "list_concat(string_split({v}, '.')::INT[], [0, 0, 0])[1:3]"
register(
    "dependency_vulnerabilities",
    lambda s, d: formats.vulnerable(formats.locked_dependencies(_locks(s, d))),
    f"WITH {LOCKED}, known(name, ecosystem, safe_from, severity) AS (VALUES {_KNOWN}) SELECT path, ecosystem, name, version, safe_from, severity FROM locked JOIN known USING (name, ecosystem) WHERE {_PARTS.format(v='version')} < {_PARTS.format(v='safe_from')}",
)


# manifests: a package for each supplier that needs those whose lines follow its own in an order, and one large library
def _packages(s, d) -> DataFrame:
    following = F.lead("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax"))
    edges = table(s, d, "lineitem").select(F.col("l_suppkey").alias("sk"), following.alias("to"), "l_discount", "l_tax").where("l_discount = 0 AND l_tax = 0.01 AND to IS NOT NULL").select("sk", "to").distinct()
    needs = edges.groupBy("sk").agg(F.map_from_entries(F.collect_list(F.struct(_text("pkg", F.col("to")), _text("^", F.col("sk") % 3, ".0.0")))).alias("needs"))
    heavy = F.get(F.array(*[F.lit(name) for name, _ in W.HEAVY]), (F.col("sk") % len(W.HEAVY)).cast("int"))
    each = table(s, d, "supplier").select(F.col("s_suppkey").alias("sk"), "s_nationkey").join(needs, "sk", "left")
    more = F.when(F.col("s_nationkey") < 5, F.create_map(F.lit("express"), F.lit("^4.0.0"))).otherwise(F.create_map().cast("map<string,string>"))
    body = F.struct(_text("pkg", F.col("sk")).alias("name"), F.map_concat(F.coalesce("needs", F.create_map().cast("map<string,string>")), more).alias("dependencies"), F.create_map(heavy, F.lit("^4.1.0")).alias("devDependencies"))
    return each.select(_text("s", F.col("sk"), "/package.json").alias("path"), F.lit("json").alias("language"), F.to_json(body).alias("content"))


_HEAVY = ", ".join(f"({quoted(name)}, {kb}, {k})" for k, (name, kb) in enumerate(W.HEAVY))
NEEDS = f"""follow AS (SELECT l_suppkey AS sk, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_discount, l_tax) AS dst, l_discount, l_tax FROM lineitem),
edges AS (SELECT DISTINCT sk, dst FROM follow JOIN supplier ON sk = s_suppkey WHERE l_discount = 0 AND l_tax = 0.01 AND dst IS NOT NULL), large(name, kb, nr) AS (VALUES {_HEAVY}),
needs AS (SELECT sk, 'pkg' || dst::VARCHAR AS name, '^' || (sk % 3)::VARCHAR || '.0.0' AS version FROM edges UNION ALL SELECT s_suppkey, 'express', '^4.0.0' FROM supplier WHERE s_nationkey < 5 UNION ALL SELECT s_suppkey, name, '^4.1.0' FROM supplier JOIN large ON nr = s_suppkey % {len(W.HEAVY)}),
n AS (SELECT 's' || sk::VARCHAR || '/package.json' AS path, 'pkg' || sk::VARCHAR AS package, name, version FROM needs), inner_edges AS (SELECT DISTINCT package AS src, name AS dst FROM n JOIN supplier ON name = 'pkg' || s_suppkey::VARCHAR WHERE package <> name)"""


def _needs(s, d) -> DataFrame:
    return formats.package_dependencies(_packages(s, d))


register("package_dependencies", _needs, f"WITH {NEEDS} SELECT * FROM n")
register("heavy_dependencies", lambda s, d: formats.heavy_dependencies(_needs(s, d)), f"WITH {NEEDS} SELECT path, name, kb::BIGINT AS size_kb, CASE WHEN kb > 500 THEN 'warning' ELSE 'info' END AS severity FROM n JOIN large USING (name)")
register("monorepo_edges", lambda s, d: formats.workspace_edges(_needs(s, d)), f"WITH {NEEDS} SELECT src AS package, dst AS name FROM inner_edges WHERE dst IN (SELECT package FROM n)")
register("version_mismatches", lambda s, d: formats.version_mismatches(_needs(s, d)), f"WITH {NEEDS} SELECT name, count(DISTINCT version) AS versions, array_to_string(list_sort(list_distinct(list(version))), ', ') AS seen FROM n GROUP BY name HAVING count(DISTINCT version) > 1")
register(
    "workspace_cycles",
    lambda s, d: formats.workspace_cycles(formats.workspace_edges(_needs(s, d))),
    f"WITH RECURSIVE {NEEDS}, reach AS (SELECT src, dst FROM inner_edges UNION SELECT r.src, e.dst FROM reach r JOIN inner_edges e ON r.dst = e.src) SELECT a.src AS node, least(a.src, min(a.dst)) AS cycle FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src",
)
register("detect_frameworks", lambda s, d: metrics.frameworks(_packages(s, d)), "SELECT 'Express.js' AS framework, min('s' || s_suppkey::VARCHAR || '/package.json') AS evidence, count(*) AS files FROM supplier WHERE s_nationkey < 5 HAVING count(*) > 0")
register(
    "detect_package_managers",
    lambda s, d: metrics.package_managers(_packages(s, d).select("path").unionByName(_locks(s, d).select("path"))),
    f"WITH {LOCKED}, f AS (SELECT DISTINCT path FROM locked UNION ALL SELECT 's' || s_suppkey::VARCHAR || '/package.json' FROM supplier) SELECT CASE WHEN path LIKE '%/package%' THEN 'npm' WHEN path LIKE '%.txt' THEN 'pip' END AS manager, count(*) AS files FROM f WHERE path NOT LIKE '%/Cargo.lock' GROUP BY 1",
)


def _root(s, d) -> DataFrame:
    part = table(s, d, "part")
    named = lambda c: F.map_from_entries(F.transform(F.array_sort(F.collect_set(c)), lambda x: F.struct(x, F.lit("1.0.0"))))
    manifest = part.agg(F.to_json(F.struct(named("p_name").alias("dependencies"), named("p_brand").alias("devDependencies"))).alias("content")).select(F.lit("package.json").alias("path"), "content")
    lock = part.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.col("p_partkey").cast("string"), F.struct(F.lit("1").alias("version"))))).alias("packages"))).alias("content")).select(F.lit("package-lock.json").alias("path"), "content")
    return manifest.unionByName(lock)


register("dependency_counts", lambda s, d: project.dependency_counts(_root(s, d)), "SELECT count(DISTINCT p_name) + count(DISTINCT p_brand) AS direct, count(*) AS total, true AS lockfile_found FROM part")


def _workspaces(s, d) -> DataFrame:
    globs = table(s, d, "supplier").groupBy("s_nationkey").agg(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda k: _text("packages/s", k, "/*")).alias("globs"))
    return globs.select(_text("n", F.col("s_nationkey"), "/package.json").alias("path"), F.to_json(F.struct(F.lit("root").alias("name"), F.col("globs").alias("workspaces"))).alias("content"))


register("workspaces", lambda s, d: formats.workspaces(_workspaces(s, d)), "SELECT 'n' || s_nationkey::VARCHAR || '/package.json' AS path, 'npm-workspaces' AS tool, string_agg('packages/s' || s_suppkey::VARCHAR || '/*', ' ' ORDER BY 'packages/s' || s_suppkey::VARCHAR || '/*') AS globs FROM supplier GROUP BY s_nationkey")


# profiles and bundles
def _profiles(s, d) -> DataFrame:
    node = F.struct(F.col("n").alias("hitCount"), F.struct(F.col("event_type").alias("functionName"), F.lit("").alias("url")).alias("callFrame"))
    return table(s, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(node).alias("nodes"))).alias("content")).select(_text("u", F.col("user_id"), ".cpuprofile").alias("path"), "content")


register(
    "cpu_profile",
    lambda s, d: formats.cpu_profile(_profiles(s, d)),
    """WITH n AS (SELECT 'u' || user_id::VARCHAR || '.cpuprofile' AS path, event_type AS name, count(*) AS hits FROM events GROUP BY ALL), p AS (SELECT *, round(hits * 100 / sum(hits) OVER (PARTITION BY path), 1) AS percent FROM n)
    SELECT *, CASE WHEN percent > 10 THEN 'critical' WHEN percent > 3 THEN 'warning' ELSE 'info' END AS severity FROM p""",
)


def _bundles(s, d) -> DataFrame:
    asset = F.struct(_text("p", F.col("p_partkey"), ".js").alias("name"), (F.col("p_size") * 10_000 + F.col("p_partkey")).cast("long").alias("size"))
    return table(s, d, "part").groupBy("p_brand").agg(F.to_json(F.struct(F.collect_list(asset).alias("assets"))).alias("content")).select(_text(F.col("p_brand"), "/stats.json").alias("path"), "content")


register(
    "bundle_stats",
    lambda s, d: formats.bundle_stats(_bundles(s, d)),
    "WITH a AS (SELECT p_brand || '/stats.json' AS path, 'p' || p_partkey::VARCHAR || '.js' AS name, p_size * 10000 + p_partkey AS size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size * 10000 + p_partkey DESC) <= 15) SELECT *, CASE WHEN size > 500000 THEN 'critical' WHEN size > 200000 THEN 'warning' ELSE 'info' END AS severity FROM a",
)


# notebooks: a conversation's questions are notes, its answers code; lengths decide what has run, in which order, and what failed
def _notebooks(s, d) -> DataFrame:
    n = F.length("text")
    code = F.col("role") == "assistant"
    source = F.array(_text("import m", F.col("turn"), "\n"), F.lit("x = 1"))
    failed = F.array(F.struct(F.lit("error").alias("output_type"), F.lit("E").alias("ename"), F.lit("v").alias("evalue")))
    count = F.when(code & (n % 5 != 0), F.when(n % 11 == 0, 1).otherwise(F.col("turn") + 1))
    cell = F.struct("turn", F.when(code, "code").otherwise("markdown").alias("cell_type"), F.when(code, source).otherwise(F.array("text")).alias("source"), count.alias("execution_count"), F.when(code & (n % 7 == 0), failed).alias("outputs"))
    cells = F.transform(F.array_sort(F.collect_list(cell)), lambda c: F.struct(*[c[k].alias(k) for k in ("cell_type", "source", "execution_count", "outputs")]))
    book = F.struct(F.struct(F.struct(F.lit("python").alias("language")).alias("kernelspec")).alias("metadata"), cells.alias("cells"))
    return table(s, d, "conversations").groupBy("conv_id").agg(F.to_json(book).alias("content")).select(_text("c", F.col("conv_id"), ".ipynb").alias("path"), "content")


BOOKS = """t AS (SELECT conv_id, turn, role = 'assistant' AS code, length(text) AS len, CASE WHEN role = 'assistant' AND length(text) % 5 <> 0 THEN CASE WHEN length(text) % 11 = 0 THEN 1 ELSE turn + 1 END END AS nr FROM conversations),
books AS (SELECT 'c' || conv_id::VARCHAR || '.ipynb' AS path, 'python' AS language, count(*) AS cells, count(*) FILTER (code) AS code_cells, count(*) FILTER (NOT code) AS markdown_cells,
coalesce(list(nr ORDER BY turn) FILTER (nr IS NOT NULL) = list_sort(list_distinct(list(nr) FILTER (nr IS NOT NULL))), true) AS in_order, coalesce(bool_or(code AND nr IS NULL), false) AS unexecuted, bool_or(code AND len % 7 = 0) AS errors, count(DISTINCT turn) FILTER (code) AS imports FROM t GROUP BY conv_id)"""
register("notebooks", lambda s, d: formats.notebooks(_notebooks(s, d)), f"WITH {BOOKS} SELECT * FROM books")
register(
    "notebook_health",
    lambda s, d: formats.notebook_health(formats.notebooks(_notebooks(s, d))),
    f"WITH {BOOKS} SELECT path, greatest(0, 100 - CASE WHEN unexecuted THEN 10 ELSE 0 END - CASE WHEN in_order THEN 0 ELSE 20 END - CASE WHEN errors THEN 15 ELSE 0 END - CASE WHEN markdown_cells = 0 THEN 10 ELSE 0 END - CASE WHEN code_cells > 30 THEN 10 ELSE 0 END - CASE WHEN imports = 0 AND code_cells > 3 THEN 5 ELSE 0 END)::BIGINT AS score FROM books",
)


# schemas: a table for each region, one for each nation with a column for each supplier, and one that links both
def _schemas(s, d) -> DataFrame:
    regions = table(s, d, "region").select(_text("db/r", F.col("r_regionkey"), ".sql").alias("path"), _text("CREATE TABLE region_", F.col("r_regionkey"), " (\n  id INT PRIMARY KEY,\n  name TEXT UNIQUE\n);").alias("content"))
    columns = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(_joined(_text(",\n  s", F.col("s_suppkey"), " TEXT DEFAULT 0"), "").alias("more"))
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    body = _text("CREATE TABLE nation_", k, " (\n  id INT PRIMARY KEY,\n  region_id INT NOT NULL REFERENCES region_", r, " (id)", F.coalesce("more", F.lit("")), "\n);\nCREATE TABLE in_", k, " (\n  a INT REFERENCES nation_", k, ",\n  b INT REFERENCES region_", r, "\n);")
    return regions.unionByName(table(s, d, "nation").join(columns, "n_nationkey", "left").select(_text("db/n", k, ".sql").alias("path"), body.alias("content")))


def _column(path: str, table_: str, column: str, kind: str, nullable: bool, primary: bool, unique: bool, default: str, to: str, source: str) -> str:
    return f"SELECT {path} AS path, 'sql' AS orm, {table_} AS \"table\", {column} AS \"column\", '{kind}' AS type, {nullable} AS nullable, {primary} AS \"primary\", {unique} AS \"unique\", {default} AS \"default\", {to} AS \"references\" FROM {source}"


_R, _N = "'db/r' || r_regionkey::VARCHAR || '.sql'", "'db/n' || n_nationkey::VARCHAR || '.sql'"
_RT, _NT, _TO = "'region_' || r_regionkey::VARCHAR", "'nation_' || n_nationkey::VARCHAR", "'region_' || n_regionkey::VARCHAR"
COLUMNS = "cols AS (" + " UNION ALL ".join(
    [
        _column(_R, _RT, "'id'", "INT", False, True, False, "NULL::VARCHAR", "NULL::VARCHAR", "region"),
        _column(_R, _RT, "'name'", "TEXT", True, False, True, "NULL", "NULL", "region"),
        _column(_N, _NT, "'id'", "INT", False, True, False, "NULL", "NULL", "nation"),
        _column(_N, _NT, "'region_id'", "INT", False, False, False, "NULL", _TO, "nation"),
        _column(_N, _NT, "'s' || s_suppkey::VARCHAR", "TEXT", True, False, False, "'0'", "NULL", "nation JOIN supplier ON s_nationkey = n_nationkey"),
        _column(_N, "'in_' || n_nationkey::VARCHAR", "'a'", "INT", True, False, False, "NULL", _NT, "nation"),
        _column(_N, "'in_' || n_nationkey::VARCHAR", "'b'", "INT", True, False, False, "NULL", _TO, "nation"),
    ]
) + ")"
register("db_columns", lambda s, d: parsers.db_columns(_schemas(s, d)), f"WITH {COLUMNS} SELECT * FROM cols")
register("db_tables", lambda s, d: parsers.db_tables(parsers.db_columns(_schemas(s, d))), f"WITH {COLUMNS} SELECT path, orm, \"table\", count(*) AS columns, count(*) FILTER (\"primary\") AS keys, count(\"references\") AS foreign_keys FROM cols GROUP BY ALL")
register(
    "db_relationships",
    lambda s, d: parsers.db_relationships(parsers.db_columns(_schemas(s, d))),
    f"WITH {COLUMNS} SELECT DISTINCT \"table\" AS source, \"references\" AS target, 'one-to-many' AS kind, NULL AS through FROM cols WHERE \"references\" IS NOT NULL UNION ALL SELECT {_NT}, {_TO}, 'many-to-many', 'in_' || n_nationkey::VARCHAR FROM nation",
)

# routes: a file for each nation with a route for each customer, the method by market segment
METHODS = {"AUTOMOBILE": "get", "BUILDING": "post", "FURNITURE": "put", "HOUSEHOLD": "delete", "MACHINERY": "patch"}
_METHOD = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in METHODS.items()) + " END"


def _customers(s, d) -> DataFrame:
    return table(s, d, "customer").select("c_nationkey", _text("/c/", F.col("c_custkey")).alias("route"), F.expr(_METHOD).alias("method"))


def _express(s, d) -> DataFrame:
    line = _text("app.", F.col("method"), "('", F.col("route"), "', handler);")
    return _customers(s, d).groupBy("c_nationkey").agg(_text("const express = require('express');\nconst app = express();\n", _joined(line)).alias("content")).select(_text("api/n", F.col("c_nationkey"), ".js").alias("path"), "content")


def _openapi(s, d) -> DataFrame:
    entry = F.struct("route", F.create_map("method", F.struct(F.lit("ok").alias("summary"))))
    return _customers(s, d).groupBy("c_nationkey").agg(F.to_json(F.struct(F.lit("3.0.0").alias("openapi"), F.map_from_entries(F.collect_list(entry)).alias("paths"))).alias("content")).select(_text("api/n", F.col("c_nationkey"), ".json").alias("path"), "content")


_ROUTES = f"SELECT 'api/n' || c_nationkey::VARCHAR || '.{{end}}' AS path, '{{source}}' AS source, upper({_METHOD}) AS method, '/c/' || c_custkey::VARCHAR AS route FROM customer"
register("api_endpoints", lambda s, d: parsers.api_endpoints(_express(s, d)), _ROUTES.format(end="js", source="express"))
register("api_method_histogram", lambda s, d: parsers.method_histogram(parsers.api_endpoints(_express(s, d))), f"SELECT method, count(*) AS endpoints, 1 AS sources FROM ({_ROUTES.format(end='js', source='express')}) GROUP BY method")
register("openapi_endpoints", lambda s, d: parsers.openapi_endpoints(_openapi(s, d)), _ROUTES.format(end="json", source="openapi"))


# infrastructure: a service for each supplier, a bucket for each nation
def _infrastructure(s, d) -> DataFrame:
    service = _text("  s", F.col("s_suppkey"), ":\n    image: shop:", F.when(F.col("s_acctbal") < 0, F.lit("latest")).otherwise(_text("v", F.col("s_suppkey"))), F.when(F.col("s_acctbal") > 9000, "\n    privileged: true").otherwise(""))
    compose = table(s, d, "supplier").groupBy("s_nationkey").agg(_text("services:\n", _joined(service)).alias("content")).select(_text("n", F.col("s_nationkey"), "/docker-compose.yml").alias("path"), "content")
    bucket = _text('resource "aws_s3_bucket" "n', F.col("n_nationkey"), '" {\n  bucket = "b"\n', F.when(F.col("n_nationkey") % 2 == 0, "  versioning = true\n").otherwise(""), "}")
    terraform = table(s, d, "nation").groupBy("n_regionkey").agg(_joined(bucket).alias("content")).select(_text("r", F.col("n_regionkey"), "/main.tf").alias("path"), "content")
    return compose.unionByName(terraform)


FOUND = """found AS (SELECT 'n' || s_nationkey::VARCHAR || '/docker-compose.yml' AS path, 'resource' AS what, 'docker-service' AS type, 's' || s_suppkey::VARCHAR AS name, NULL AS severity, NULL AS detail FROM supplier
UNION ALL SELECT 'n' || s_nationkey::VARCHAR || '/docker-compose.yml', 'issue', 'unpinned-image', 's' || s_suppkey::VARCHAR, 'warning', NULL FROM supplier WHERE s_acctbal < 0
UNION ALL SELECT 'n' || s_nationkey::VARCHAR || '/docker-compose.yml', 'issue', 'privileged', 's' || s_suppkey::VARCHAR, 'error', NULL FROM supplier WHERE s_acctbal > 9000
UNION ALL SELECT 'r' || n_regionkey::VARCHAR || '/main.tf', 'resource', 'aws_s3_bucket', 'n' || n_nationkey::VARCHAR, NULL, 'aws' FROM nation
UNION ALL SELECT 'r' || n_regionkey::VARCHAR || '/main.tf', 'issue', 'no-versioning', 'n' || n_nationkey::VARCHAR, 'info', NULL FROM nation WHERE n_nationkey % 2 = 1)"""
register("iac_resources", lambda s, d: settings.iac(_infrastructure(s, d)).where("what = 'resource'").select("path", "type", "name", "detail"), f"WITH {FOUND} SELECT path, type, name, detail FROM found WHERE what = 'resource'")
register("iac_issues", lambda s, d: settings.iac(_infrastructure(s, d)).where("what = 'issue'").select("path", "type", "name", "severity"), f"WITH {FOUND} SELECT path, type, name, severity FROM found WHERE what = 'issue'")
register("iac_summary", lambda s, d: settings.iac_summary(settings.iac(_infrastructure(s, d))), f"WITH {FOUND} SELECT CASE WHEN path LIKE '%.tf' THEN 'terraform' ELSE 'docker' END AS platform, count(*) FILTER (what = 'resource') AS resources, count(DISTINCT CASE WHEN what = 'resource' THEN type END) AS types, count(*) FILTER (what = 'issue') AS issues FROM found GROUP BY 1")


# pipelines: a workflow for each nation, a job for each supplier that needs the one before it
def _workflows(s, d) -> DataFrame:
    before = F.lag("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    job = _text("  s", F.col("s_suppkey"), ":\n", F.when(F.col("before").isNotNull(), _text("    needs: [s", F.col("before"), "]\n")).otherwise(""), "    runs-on: ubuntu\n    steps:\n      - run: make s", F.col("s_suppkey"), "\n")
    each = table(s, d, "supplier").select("s_nationkey", "s_suppkey", before.alias("before")).select("s_nationkey", F.struct("s_suppkey", job.alias("text")).alias("job"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("job")), lambda j: j["text"]), "")
    return each.groupBy("s_nationkey").agg(_text("name: ci\non:\n  push:\njobs:\n", whole).alias("content")).select(_text(".github/workflows/n", F.col("s_nationkey"), ".yml").alias("path"), "content")


JOBS = """j AS (SELECT '.github/workflows/n' || s_nationkey::VARCHAR || '.yml' AS path, 's' || s_suppkey::VARCHAR AS job, 's' || (lag(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey))::VARCHAR AS needs FROM supplier)"""
register("cicd_jobs", lambda s, d: settings.cicd(_workflows(s, d)).where("what = 'job'").select("path", "platform", "job", F.col("value").alias("runs_on")), f"WITH {JOBS} SELECT path, 'github-actions' AS platform, job, 'ubuntu' AS runs_on FROM j")
register("cicd_needs", lambda s, d: settings.cicd(_workflows(s, d)).where("what = 'needs'").select("path", "job", F.col("value").alias("needs")), f"WITH {JOBS} SELECT path, job, needs FROM j WHERE needs IS NOT NULL")
register(
    "cicd_facts",
    lambda s, d: settings.cicd(_workflows(s, d)),
    f"""WITH {JOBS}, f AS (SELECT path, 'job' AS what, job, 'ubuntu' AS value FROM j UNION ALL SELECT path, 'needs', job, needs FROM j WHERE needs IS NOT NULL UNION ALL SELECT path, 'step', job, 'make ' || job FROM j UNION ALL SELECT DISTINCT path, 'trigger', NULL, 'push' FROM j)
    SELECT path, 'github-actions' AS platform, what, job, value FROM f""",
)


# blame text: a customer's file has a line for each of its orders, in the order of their dates
def _porcelain(s, d) -> DataFrame:
    nr = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    key = F.md5(F.col("o_orderkey").cast("string"))
    orders = table(s, d, "orders").select("o_custkey", nr.alias("nr"), F.concat(key, F.substr(key, F.lit(1), F.lit(8))).alias("hash"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("time"), "o_orderpriority").join(table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    entry = F.struct("nr", _text(F.col("hash"), " ", F.col("nr"), " ", F.col("nr"), " 1\nauthor ", F.col("c_name"), "\nauthor-time ", F.col("time"), "\nsummary s\n\t", F.col("o_orderpriority")).alias("text"))
    return orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"]), "\n").alias("content")).select(_text("c", F.col("o_custkey")).alias("path"), "content")


register(
    "blame",
    lambda s, d: change.blame(_porcelain(s, d)).withColumn("date", F.col("date").cast("string")),
    "SELECT 'c' || o_custkey::VARCHAR AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS line_no, substr(md5(o_orderkey::VARCHAR), 1, 8) AS hash, c_name AS author, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders JOIN customer ON c_custkey = o_custkey",
)


# diffs: an order adds the functions of returned parts, removes those of accepted ones and changes the others
def _patches(s, d) -> DataFrame:
    name = _text("function f", F.col("l_partkey"), "() {")
    lines = F.when(F.col("l_returnflag") == "R", _text("+", name)).when(F.col("l_returnflag") == "A", _text("-", name)).otherwise(_text("-", name, "\n+", name))
    entry = F.struct("l_linenumber", "l_partkey", lines.alias("text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"]), "\n")
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(_text("--- a/src/o.ts\n+++ b/src/o.ts\n", body).alias("content")).select(F.col("l_orderkey").alias("diff_id"), "content")


register(
    "diff_symbols",
    lambda s, d: change.changed_symbols(_patches(s, d)),
    """WITH placed AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos FROM lineitem), n AS (SELECT l_orderkey AS diff_id, 'f' || l_partkey::VARCHAR AS name, count(*) FILTER (l_returnflag = 'R') AS up, count(*) FILTER (l_returnflag = 'A') AS down, count(*) FILTER (l_returnflag NOT IN ('R', 'A')) AS twice, min(pos) AS first FROM placed GROUP BY ALL),
    c AS (SELECT *, CASE WHEN up + down + 2 * twice > 1 THEN 'modified' WHEN up > 0 THEN 'added' ELSE 'removed' END AS change FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY diff_id, change ORDER BY first, name) AS k FROM c),
    pairs AS (SELECT a.diff_id, a.k, a.name AS made, b.name AS gone FROM r a JOIN r b ON a.diff_id = b.diff_id AND a.k = b.k AND a.change = 'added' AND b.change = 'removed')
    SELECT diff_id, 'src/o.ts' AS file, name, change, NULL AS old_name FROM r WHERE change = 'modified' OR (diff_id, k) NOT IN (SELECT diff_id, k FROM pairs) UNION ALL SELECT diff_id, 'src/o.ts', made, 'renamed', gone FROM pairs""",
)


# what a changed file of the tree touches: the first one that another file imports
def _changed(s, d):
    stem = symbols.import_edges(T.tree(s, d)).where("src <> dst").agg(F.min("dst").alias("stem")).where("stem IS NOT NULL")
    file = F.concat("stem", F.lit(".ts"))
    return stem.select(file.alias("path")), stem.select(file.alias("file"), F.concat(F.lit("f"), F.regexp_extract("stem", r"(\d+)$", 1)).alias("name"), F.lit("modified").alias("change"))


def _impact(s, d) -> DataFrame:
    return change.impact(T.tree(s, d), *_changed(s, d))


TOUCHED = f"WITH RECURSIVE {T.PARTS}, ch AS (SELECT min('src/p' || dst::VARCHAR) AS stem FROM e WHERE src <> dst), touched AS (SELECT path, stem, dst FROM e, ch WHERE 'src/p' || dst::VARCHAR = stem AND src <> dst)"
register("change_impact", _impact, f"{TOUCHED} SELECT path, 'imports' AS reason, stem || '.ts' AS what FROM touched UNION ALL SELECT path, 'uses', 'f' || dst::VARCHAR FROM touched")
register("change_risk", lambda s, d: change.risk(_impact(s, d), _changed(s, d)[1]), f"{TOUCHED}, n AS (SELECT count(*) AS affected FROM touched) SELECT affected, 1 AS symbols, 0 AS breaking, CASE WHEN affected > 20 THEN 'high' WHEN affected > 5 THEN 'medium' ELSE 'low' END AS risk FROM n")


def _affected(s, d) -> DataFrame:
    files = T.tree(s, d)
    tests = files.select(F.regexp_replace("path", r"\.ts$", ".test.ts").alias("path"), "language", _text("import { f } from './", F.regexp_extract("path", r"(p\d+)", 1), "';").alias("content"))
    both = files.unionByName(tests)
    changed = _changed(s, d)
    return change.affected_tests(both, change.impact(both, *changed), changed[0])


register("affected_tests", _affected, f"{TOUCHED} SELECT DISTINCT stem || '.test.ts' AS path FROM ch WHERE stem IS NOT NULL")
register("codebase_map", lambda s, d: metrics.codebase_map(T.tree(s, d)), "SELECT count(*) AS total_files, count(*) AS code_files, 1 AS directories, false AS has_tests, false AS has_ci, false AS has_docs, false AS has_docker, 'typescript' AS main_language, CASE WHEN count(*) < 50 THEN 'small' WHEN count(*) < 500 THEN 'medium' WHEN count(*) < 5000 THEN 'large' ELSE 'enterprise' END AS size_class FROM part")


# layers: parts lie in folders by size, and import the parts that follow them
_FOLDER = "CASE WHEN p_size < 15 THEN 'controllers' WHEN p_size < 30 THEN 'utils' ELSE 'models' END"


def _layers(s, d) -> DataFrame:
    of = table(s, d, "part").select(F.col("p_partkey").alias("k"), F.expr(_FOLDER).alias("folder"))
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax"))
    edges = table(s, d, "lineitem").select(F.col("l_partkey").alias("k"), following.alias("dst"), "l_discount").where("l_discount = 0 AND dst IS NOT NULL").select("k", "dst").distinct()
    met = edges.join(of, "k").join(of.select(F.col("k").alias("dst"), F.col("folder").alias("to")), "dst")
    line = _text("import x from '../", F.col("to"), "/p", F.col("dst"), "';")
    return met.groupBy("k", "folder").agg(_joined(line).alias("content")).select(_text("src/", F.col("folder"), "/p", F.col("k"), ".ts").alias("path"), F.lit("typescript").alias("language"), "content")


register(
    "layer_violations",
    lambda s, d: symbols.layer_violations(symbols.imports(_layers(s, d))),
    f"""WITH g AS (SELECT p_partkey AS k, {_FOLDER} AS folder FROM part), x AS (SELECT l_partkey AS k, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_discount, l_tax) AS dst, l_discount FROM lineitem),
    m AS (SELECT DISTINCT 'src/' || a.folder || '/p' || a.k::VARCHAR || '.ts' AS path, '../' || b.folder || '/p' || b.k::VARCHAR AS import_path, a.folder AS f, b.folder AS t FROM x JOIN g a USING (k) JOIN g b ON b.k = x.dst WHERE l_discount = 0)
    SELECT path, import_path, 'no-controller-in-model' AS rule, 'error' AS severity FROM m WHERE f = 'controllers' AND t = 'models' UNION ALL SELECT path, import_path, 'no-upward-dependency', 'warning' FROM m WHERE f = 'utils' AND t = 'controllers'""",
)


# cells of the notebooks, whatever shape their outputs have
def _cells(s, d) -> DataFrame:
    return books.cells(_notebooks(s, d))


CELLS = """cells AS (SELECT 'c' || conv_id::VARCHAR || '.ipynb' AS path, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS cell, turn, role = 'assistant' AS code, text, length(text) AS len,
CASE WHEN role = 'assistant' AND length(text) % 5 <> 0 THEN CASE WHEN length(text) % 11 = 0 THEN 1 ELSE turn + 1 END END AS nr FROM conversations)"""
register(
    "notebook_cells",
    lambda s, d: _cells(s, d).withColumn("source", F.sha2("source", 256)),
    f"""WITH {CELLS} SELECT path, cell, CASE WHEN code THEN 'code' ELSE 'markdown' END AS kind, sha256(CASE WHEN code THEN 'import m' || turn::VARCHAR || chr(10) || 'x = 1' ELSE text END) AS source, nr AS execution_count,
    CASE WHEN code AND len % 7 = 0 THEN 'error' ELSE '' END AS outputs, CASE WHEN code AND len % 7 = 0 THEN 'E: v' ELSE '' END AS error FROM cells""",
)
register(
    "notebook_code",
    lambda s, d: books.extracted_code(_cells(s, d)),
    f"WITH {CELLS} SELECT path, string_agg('# cell ' || cell::VARCHAR || chr(10) || 'import m' || turn::VARCHAR || chr(10) || 'x = 1', chr(10) || chr(10) ORDER BY cell) AS code FROM cells WHERE code GROUP BY path",
)
register(
    "notebook_disorder",
    lambda s, d: books.execution_order(_cells(s, d)),
    f"WITH {CELLS}, w AS (SELECT path, cell, nr AS execution_count, max(nr) OVER (PARTITION BY path ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM cells WHERE nr IS NOT NULL) SELECT * FROM w WHERE execution_count <= before",
)


# routers: an application mounts one for each region, that one for each nation, and that has a route for each customer
def _routers(s, d) -> DataFrame:
    region, nation = table(s, d, "region"), table(s, d, "nation")
    uses = lambda kind, k: _text("const ", kind, k, "Router = require('./", kind, k, "');\napp.use('/", kind, k, "', ", kind, k, "Router);")
    head, tail = "const express = require('express');\nconst app = express.Router();\n", "\nmodule.exports = app;"
    top = region.agg(_text(head, _joined(uses("r", F.col("r_regionkey"))), tail).alias("content")).select(F.lit("web/app.js").alias("path"), "content")
    middle = nation.groupBy("n_regionkey").agg(_text(head, _joined(uses("n", F.col("n_nationkey"))), tail).alias("content")).select(_text("web/r", F.col("n_regionkey"), ".js").alias("path"), "content")
    line = F.when(F.col("method") == "patch", _text("app.route('", F.col("route"), "').get(read).patch(write);")).otherwise(_text("app.", F.col("method"), "('", F.col("route"), "', handler);"))
    leaves = _customers(s, d).groupBy("c_nationkey").agg(_text(head, _joined(line), tail).alias("content")).select(_text("web/n", F.col("c_nationkey"), ".js").alias("path"), "content")
    return top.unionByName(middle).unionByName(leaves)


register(
    "mounted_routes",
    lambda s, d: routers.mounted_routes(_routers(s, d)),
    f"""WITH c AS (SELECT 'web/n' || c_nationkey::VARCHAR || '.js' AS path, {_METHOD} AS method, '/r' || n_regionkey::VARCHAR || '/n' || n_nationkey::VARCHAR || '/c/' || c_custkey::VARCHAR AS route FROM customer JOIN nation ON n_nationkey = c_nationkey)
    SELECT path, upper(method) AS method, route FROM c UNION ALL SELECT path, 'GET', route FROM c WHERE method = 'patch'""",
)


MET = f"""g AS (SELECT p_partkey AS k, {_FOLDER} AS folder FROM part), x AS (SELECT l_partkey AS k, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_discount, l_tax) AS dst, l_discount FROM lineitem),
m AS (SELECT DISTINCT a.k AS src, b.k AS dst, a.folder AS f, b.folder AS t, 'src/' || a.folder || '/p' || a.k::VARCHAR AS stem, 'src/' || b.folder || '/p' || b.k::VARCHAR AS to_stem FROM x JOIN g a USING (k) JOIN g b ON b.k = x.dst WHERE l_discount = 0),
bad AS (SELECT stem, CASE WHEN f = 'controllers' THEN 'error' ELSE 'warning' END AS severity FROM m WHERE f = 'controllers' AND t = 'models' OR f = 'utils' AND t = 'controllers'),
w AS (SELECT stem AS src, to_stem AS dst FROM m WHERE stem <> to_stem AND to_stem IN (SELECT stem FROM m)), reach AS (SELECT src, dst FROM w UNION SELECT r.src, w.dst FROM reach r JOIN w ON r.dst = w.src),
circles AS (SELECT count(DISTINCT a.src) AS n FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst)"""
register(
    "architecture_report",
    lambda s, d: symbols.check_architecture(_layers(s, d))[1],
    f"""WITH RECURSIVE {MET}, e AS (SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM bad)
    SELECT 3 AS rules_checked, (SELECT count(DISTINCT stem) FROM m) AS files_tested, errors + circles.n AS errors, warnings, errors + circles.n = 0 AS passed FROM e, circles""",
)
_UP, _DOWN = "count(*) FILTER (l_returnflag <> 'A') + 1", "count(*) FILTER (l_returnflag <> 'R') + 1"
register(
    "categorize_diff",
    lambda s, d: change.categorised(_patches(s, d)).select("diff_id", "category", "confidence"),
    f"""WITH n AS (SELECT l_orderkey AS diff_id, {_UP} AS up, {_DOWN} AS down FROM lineitem GROUP BY l_orderkey), p AS (SELECT diff_id, CASE WHEN abs(up - down) < greatest(up, down) * 0.3 THEN 3 ELSE 0 END AS refactor, CASE WHEN up > down * 3 THEN 3 ELSE 0 END AS feature FROM n)
    SELECT diff_id, CASE WHEN refactor >= feature THEN 'refactor' ELSE 'feature' END AS category, CASE WHEN refactor + feature > 0 THEN 100 ELSE 0 END AS confidence FROM p""",
)
register(
    "schema_summary",
    lambda s, d: parsers.schema_summary(parsers.db_columns(_schemas(s, d))),
    f"WITH {COLUMNS}, r AS (SELECT count(DISTINCT (\"table\", \"references\")) + (SELECT count(*) FROM nation) AS n FROM cols WHERE \"references\" IS NOT NULL) SELECT count(DISTINCT (path, \"table\")) AS tables, count(*) AS columns, any_value(n) AS relationships, 'sql' AS orms FROM cols, r",
)


# migrations: a file for each nation, stamped by its region and key
def _migrations(s, d) -> DataFrame:
    k = F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    stamp = F.when(F.col("n_regionkey") < 4, F.concat(F.lit("2024010"), F.col("n_regionkey").cast("string"), F.lit("00"), k, F.lit("_"))).otherwise(F.lit(""))
    return table(s, d, "nation").select(F.concat(F.lit("db/migrations/"), stamp, F.lit("n"), k, F.lit(".sql")).alias("path"))


register(
    "migrations",
    lambda s, d: parsers.migrations(_migrations(s, d)),
    """WITH m AS (SELECT lpad(n_nationkey::VARCHAR, 2, '0') AS k, CASE WHEN n_regionkey < 4 THEN '2024010' || n_regionkey::VARCHAR || '00' || lpad(n_nationkey::VARCHAR, 2, '0') END AS timestamp FROM nation),
    f AS (SELECT timestamp, coalesce(timestamp || '_', '') || 'n' || k || '.sql' AS description FROM m)
    SELECT 'db/migrations/' || description AS path, timestamp, description, row_number() OVER (ORDER BY timestamp NULLS LAST, 'db/migrations/' || description) AS nth FROM f""",
)
