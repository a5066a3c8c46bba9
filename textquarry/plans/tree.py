"""Queries over a source tree that is made from the part and lineitem tables: a TypeScript file for each part.

A part's file imports those of the parts that follow it in orders (where its own line has no discount and little tax),
calls their functions, and holds a constant, an interface, a helper that depends on the part's size alone, and, for the
dearer parts, a handler without a statement. The SQL computes the expected rows from the same tables by line numbers.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import category_of, is_code, language_of
from ..operators import metrics, parsers, project, scans, symbols
from ..rules import languages as L
from ..rules.lines import INSECURE_FILES
from .common import quoted, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, query, sql: str) -> None:
    QUERIES[name] = query
    ORACLES[name] = f"WITH RECURSIVE {PARTS} {sql}" if not sql.startswith(",") else f"WITH RECURSIVE {PARTS}{sql}"


#: Lines of a type's use: # is the type's part, @ the file's.
USES = [
    ("import { I", "#", " } from './p", "#", "';"),
    ("export interface J", "#", "_", "@", " extends I", "#", " {}"),
    ("const all", "#", ": Array<I", "#", "> = [];"),
    ("function make", "#", "(): I", "#", " { return all", "#", "[0]; }"),
    ("function take", "#", "(x: I", "#", ") {}"),
    ("let one", "#", ": I", "#", ";"),
    ("// as in I", "#"),
]


def tree(s, d, typed: bool = False):
    """path, language, content of the tree. typed: files end with uses of the interfaces of the parts that they import, and
    of the part that has the number of their size: an import, an extension, a generic, a result, a parameter, a variable, a remark."""
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax"))
    each = table(s, d, "lineitem").select(F.col("l_partkey").alias("k"), following.alias("dst"), "l_discount", "l_tax").where("l_discount = 0 AND l_tax <= 0.03 AND dst IS NOT NULL")
    deps = each.groupBy("k").agg(F.array_sort(F.collect_set("dst")).alias("deps"))
    parts = table(s, d, "part").select(F.col("p_partkey").alias("k"), "p_size", F.col("p_retailprice") > 910).toDF("k", "size", "dear").join(deps, "k", "left")
    own = F.coalesce("deps", F.array().cast("array<bigint>"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    k, size = F.col("k"), F.col("size")
    lines = F.concat(
        F.transform(own, lambda x: text("import { f", x, " } from './p", x, "';")),
        F.array(text("// part ", k), F.lit(""), text("/** Makes part ", k, ". */"), text("export function f", k, "(a, b) {"), F.lit("  if (a > b) {"), F.lit("    return a;"), F.lit("  }")),
        F.transform(own, lambda x: text("  f", x, "(a);")),
        F.array(*map(F.lit, ("  return b;", "}")), text("export const LIMIT_", k, " = ", size, ";"), text("export interface I", k, " {"), *map(F.lit, ("  size: number;", "}", "function helper() {"))),
        F.array(text("  let total = ", size, ";"), *map(F.lit, ("  while (total > 10) {", "    total = total - 10;", "  }", "  return total;", "}"))),
        F.when(F.col("dear"), F.array(*map(F.lit, ("try {", "  helper();", "} catch (e) {", "}")))).otherwise(F.array().cast("array<string>")),
    )
    if typed:
        uses = lambda x: F.array(*[text(*[x if w == "#" else k if w == "@" else w for w in line]) for line in USES])
        lines = F.concat(lines, F.flatten(F.transform(F.array_union(own, F.array(size.cast("long"))), uses)))
    return parts.select(text("src/p", k, ".ts").alias("path"), F.lit("typescript").alias("language"), F.array_join(lines, "\n").alias("content"))


#: Parts with their files' paths, the parts that they import (ascending) and their number; edges: one row an import.
PARTS = """follow AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_discount, l_tax) AS dst, l_discount, l_tax FROM lineitem),
edges AS (SELECT DISTINCT src, dst FROM follow JOIN part ON src = p_partkey WHERE l_discount = 0 AND l_tax <= 0.03 AND dst IS NOT NULL),
p AS (SELECT p_partkey AS k, p_size AS size, p_retailprice > 910 AS dear, 'src/p' || p_partkey::VARCHAR || '.ts' AS path, coalesce(n, 0) AS n FROM part LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY src) ON src = p_partkey),
e AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS nth FROM edges JOIN p ON k = src),
syms AS (SELECT path, 'f' || k::VARCHAR AS name, unnest(['function', 'export']) AS kind, n + 4 AS line_no, 'export function f' || k::VARCHAR || '(a, b) {' AS signature FROM p
  UNION ALL SELECT path, 'LIMIT_' || k::VARCHAR, unnest(['constant', 'export']), 2 * n + 10, 'export const LIMIT_' || k::VARCHAR || ' = ' || size::VARCHAR || ';' FROM p
  UNION ALL SELECT path, 'I' || k::VARCHAR, unnest(['interface', 'export']), 2 * n + 11, 'export interface I' || k::VARCHAR || ' {' FROM p
  UNION ALL SELECT path, 'helper', 'function', 2 * n + 14, 'function helper() {' FROM p)"""

_ROWS = "path, name, kind, line_no"
register("symbols", lambda s, d: symbols.symbols(tree(s, d)), "SELECT path, name, kind, line_no, 'typescript' AS language, signature FROM syms")
register("symbol_search", lambda s, d: symbols.symbol_search(symbols.symbols(tree(s, d)), "f1", per_kind=50).select(*_ROWS.split(", ")), f"SELECT {_ROWS} FROM syms WHERE contains(lower(name), 'f1') QUALIFY row_number() OVER (PARTITION BY kind ORDER BY path, line_no, name) <= 50")
register("symbols_of_language", lambda s, d: symbols.symbols(tree(s, d), kinds=["function"], language="typescript").select(*_ROWS.split(", ")), f"SELECT {_ROWS} FROM syms WHERE kind = 'function'")
register("index_stats", lambda s, d: symbols.index_stats(symbols.symbols(tree(s, d))), "SELECT count(*) AS symbols, count(DISTINCT path) AS files FROM syms")
register("imports", lambda s, d: symbols.imports(tree(s, d)), "SELECT path, './p' || dst::VARCHAR AS import_path FROM e")
register(
    "dependency_graph",
    lambda s, d: symbols.dependency_graph(symbols.imports(tree(s, d))).select("path", "n", F.array_join("imports", " ").alias("imports")),
    "SELECT path, count(*) AS n, string_agg('./p' || dst::VARCHAR, ' ' ORDER BY './p' || dst::VARCHAR) AS imports FROM e GROUP BY path",
)
register("importers", lambda s, d: symbols.importers(symbols.imports(tree(s, d)), "src/p12.ts"), "SELECT DISTINCT path FROM e WHERE contains('./p' || dst::VARCHAR, 'p12') AND path <> 'src/p12.ts'")
register("import_edges", lambda s, d: symbols.import_edges(tree(s, d)), "SELECT 'src/p' || src::VARCHAR AS src, 'src/p' || dst::VARCHAR AS dst FROM e JOIN p t ON t.k = dst")
register("self_imports", lambda s, d: symbols.self_imports(symbols.import_edges(tree(s, d))), "SELECT 'src/p' || src::VARCHAR AS node FROM e WHERE src = dst")
register(
    "circular_imports",
    lambda s, d: symbols.on_cycles(symbols.import_edges(tree(s, d))),
    """, w AS (SELECT 'src/p' || src::VARCHAR AS src, 'src/p' || dst::VARCHAR AS dst FROM edges WHERE src <> dst), reach AS (SELECT src, dst FROM w UNION SELECT reach.src, w.dst FROM reach JOIN w ON reach.dst = w.src)
    SELECT a.src AS node, least(a.src, min(a.dst)) AS cycle FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src""",
)
register(
    "call_graph",
    lambda s, d: symbols.call_graph(tree(s, d)),
    "SELECT path, 'f' || k::VARCHAR AS caller, 'f' || dst::VARCHAR AS callee, n + 7 + nth AS line_no FROM e UNION ALL SELECT path, 'helper', 'helper', 2 * n + 22 FROM p WHERE dear",
)
register(
    "dead_exports",
    lambda s, d: symbols.dead_exports(tree(s, d)),
    "SELECT path, name, line_no, min(kind) AS kind FROM syms WHERE name <> 'helper' AND name NOT IN (SELECT 'f' || dst::VARCHAR FROM edges) GROUP BY ALL",
)
register("orphan_files", lambda s, d: symbols.orphan_files(tree(s, d)), "SELECT path FROM p WHERE k NOT IN (SELECT dst FROM edges)")
register("find_dead_code", lambda s, d: symbols.find_dead_code(tree(s, d)), f"SELECT {_ROWS} FROM syms WHERE name <> 'helper' AND name NOT IN (SELECT 'f' || dst::VARCHAR FROM edges)")
_LINES = "2 * n + 20 + CASE WHEN dear THEN 4 ELSE 0 END"
register("line_types", lambda s, d: metrics.line_types(tree(s, d)), f"SELECT path, 'typescript' AS language, {_LINES} AS lines, {_LINES} - 3 AS code, 2 AS comment, 1 AS blank FROM p")
register(
    "code_metrics",
    lambda s, d: metrics.code_metrics(tree(s, d)),
    f"SELECT path, 'typescript' AS language, {_LINES} AS lines, {_LINES} - 3 AS code, 2 AS comment, 1 AS blank, 3 + CASE WHEN dear THEN 1 ELSE 0 END AS complexity, round(2 / ({_LINES} - 1), 6) AS comment_ratio FROM p",
)
register("empty_catches", lambda s, d: scans.empty_handlers(tree(s, d)), "SELECT path, 2 * n + 23 AS line_no, 'braces' AS style FROM p WHERE dear")
register("long_functions", lambda s, d: scans.long_functions(tree(s, d), 7), "SELECT path, 'f' || k::VARCHAR AS name, n + 4 AS start_line, 2 * n + 9 AS end_line, n + 6 AS lines FROM p WHERE n + 6 > 7")
register(
    "duplicate_functions",
    lambda s, d: scans.duplicate_functions(tree(s, d)),
    """, b AS (SELECT path, 'function helper() { let total = ' || size::VARCHAR || '; while (total > 10) { total = total - 10; } return total; }' AS body FROM p
      UNION ALL SELECT path, 'export function f' || k::VARCHAR || '(a, b) { if (a > b) { return a; } ' || coalesce((SELECT string_agg('f' || dst::VARCHAR || '(a);', ' ' ORDER BY dst) FROM edges WHERE src = k) || ' ', '') || 'return b; }' FROM p)
    SELECT md5(substr(body, 1, 200)) AS key, count(*) AS n, count(DISTINCT path) AS n_paths, min(path) AS first_path FROM b GROUP BY substr(body, 1, 200) HAVING count(DISTINCT path) >= 2""",
)
register("undocumented", lambda s, d: parsers.undocumented((t := tree(s, d)), symbols.symbols(t)), f"SELECT {_ROWS} FROM syms WHERE kind = 'interface' OR name = 'helper'")
_DOC = "SELECT path, 'f' || k::VARCHAR AS name, 'block' AS kind, n + 3 AS line_no, 'Makes part ' || k::VARCHAR || '.' AS summary, 0 AS params, false AS deprecated FROM p"
register("code_docs", lambda s, d: parsers.docs(tree(s, d)), _DOC)
register("symbol_docs", lambda s, d: parsers.docs(tree(s, d), symbol="f12").select("path", "name", "summary", "deprecated"), f"SELECT path, name, summary, deprecated FROM ({_DOC}) WHERE contains(name, 'f12')")
register(
    "type_flow",
    lambda s, d: symbols.type_flow(tree(s, d, typed=True), "I7"),
    f""", used AS (SELECT src AS k, dst AS x, 0 AS last FROM edges UNION ALL SELECT k, size, 1 FROM p WHERE (k, size) NOT IN (SELECT src, dst FROM edges)),
    u AS (SELECT path, x, {_LINES} + 7 * (row_number() OVER (PARTITION BY k ORDER BY last, x) - 1) AS above FROM used JOIN p USING (k))
    SELECT path, 2 * n + 11 AS line_no, 'definition' AS kind FROM p WHERE k = 7
    UNION ALL SELECT path, above + i, kind FROM u, (VALUES (1, 'import'), (2, 'extends'), (3, 'generic'), (4, 'return-type'), (5, 'parameter'), (6, 'variable')) AS v(i, kind) WHERE x = 7""",
)
_LOOP = ("Waiting loop", "style", "low", r"while \(total", False)
register(
    "plugin_rules",
    lambda s, d: scans.security_scan(tree(s, d), rules=[_LOOP]).where("rule = 'Waiting loop'"),
    "SELECT path, 2 * n + 16 AS line_no, 'Waiting loop' AS rule, 'style' AS category, 'low' AS severity, 'while (total > 10) {' AS snippet FROM p",
)


# an index of the tree's files: the older state lacks parts of the smallest sizes, and knows the dearer ones by another time
def _index(s, d):
    parts = table(s, d, "part").select(F.format_string("src/p%d.ts", "p_partkey").alias("path"), F.col("p_size").cast("long").alias("mtime"), "p_retailprice")
    return parts.where("mtime > 5").select("path", F.when(F.col("p_retailprice") > 910, F.col("mtime") - 1).otherwise(F.col("mtime")).alias("mtime")), parts.select("path", "mtime")


_OLD = ", old AS (SELECT path, size - CASE WHEN dear THEN 1 ELSE 0 END AS mtime FROM p WHERE size > 5), cur AS (SELECT path, size AS mtime FROM p)"
register("index_stale", lambda s, d: symbols.stale(*_index(s, d)), f"{_OLD} SELECT path FROM cur LEFT JOIN old USING (path) WHERE old.mtime IS DISTINCT FROM cur.mtime")
register("index_update", lambda s, d: symbols.updated(_index(s, d)[0], _index(s, d)[1].where("mtime < 20")), f"{_OLD} SELECT path, mtime FROM cur WHERE mtime < 20 UNION ALL SELECT path, mtime FROM old WHERE path NOT IN (SELECT path FROM cur WHERE mtime < 20)")
register("index_remove", lambda s, d: symbols.removed(_index(s, d)[0], _index(s, d)[1].where("mtime < 20")), f"{_OLD} SELECT path, mtime FROM old WHERE path NOT IN (SELECT path FROM cur WHERE mtime < 20)")
register("test_files", lambda s, d: project.test_files(table(s, d, "part").select(F.concat_ws("/", F.lower("p_type"), F.concat(F.regexp_replace("p_name", " ", "_"), F.when(F.col("p_size") < 10, ".test.ts").when(F.col("p_size") < 20, "_spec.rb").otherwise(".ts"))).alias("path"))), f"SELECT DISTINCT lower(p_type) || '/' || replace(p_name, ' ', '_') || CASE WHEN p_size < 10 THEN '.test.ts' ELSE '_spec.rb' END AS path FROM part WHERE p_size < 20")


# functions of the tree by heat: each body has one branch and two levels of braces, so only its length tells them apart
_HEAT = "floor(round((least(100.0::DOUBLE, 2 / 30 * 100) * 0.3::DOUBLE + least(100.0::DOUBLE, 2 / 50 * 100) * 0.3::DOUBLE + least(100.0::DOUBLE, 2 / 8 * 100) * 0.2::DOUBLE + least(100.0::DOUBLE, loc / 500 * 100) * 0.2::DOUBLE), 9) + 0.5)::BIGINT"
register(
    "heatmap_functions",
    lambda s, d: metrics.heatmap_functions(tree(s, d)),
    f""", b AS (SELECT path, 'f' || k::VARCHAR AS name, n + 4 AS line_no, 2 AS params, n + 6 AS loc FROM p UNION ALL SELECT path, 'helper', 2 * n + 14, 0, 7 FROM p)
    SELECT path, name, line_no, params, 2 AS cyclomatic, 2 AS cognitive, 2 AS nesting, loc, {_HEAT} AS score, 'A' AS grade FROM b ORDER BY score DESC, path, line_no, name LIMIT 20""",
)
#: Ends of paths: all extensions and special names that are known, and names that neither decides; every other round of them in capitals.
_NAMES = [*L.LANGUAGE_OF, *(f"/{name}" for name, _ in L.SPECIAL_NAMES), "/dockerfile.dev", "/x.cabal", ".unknown", ".tar.gz", "/noext", "/.env", "/.github/workflows/ci.yml", "/id_rsa", ".", ""]


def _named(key):
    end = F.get(F.array(*map(F.lit, _NAMES)), (key % len(_NAMES)).cast("int"))
    return F.concat(F.lit("src/p"), key.cast("string"), F.when(F.floor(key / len(_NAMES)) % 2 == 1, F.upper(end)).otherwise(end))


_SPECIAL = " ".join(f"WHEN low LIKE {quoted('%' + name)} THEN {quoted(language)}" for name, language in L.SPECIAL_NAMES)
_CATEGORIES = ", ".join(f"CASE WHEN language IN ({', '.join(map(quoted, members))}) THEN {quoted(name)} END" for name, members in L.CATEGORIES.items())
register(
    "detect_language",
    lambda s, d: table(s, d, "part").select(_named(F.col("p_partkey")).alias("path")).select("path", (language := language_of(F.col("path"))).alias("language"), is_code(language).alias("code"), category_of(language).alias("category")),
    f""", ext(ending, language) AS (VALUES {', '.join(f"({quoted(e)}, {quoted(x)})" for e, x in L.LANGUAGE_OF.items())}),
    named AS (SELECT p_partkey AS k, ([{', '.join(map(quoted, _NAMES))}])[p_partkey % {len(_NAMES)} + 1] AS name FROM part),
    paths AS (SELECT 'src/p' || k::VARCHAR || CASE WHEN k // {len(_NAMES)} % 2 = 1 THEN upper(name) ELSE name END AS path, lower('src/p' || k::VARCHAR || name) AS low FROM named),
    told AS (SELECT path, CASE WHEN low LIKE '%dockerfile.%' THEN 'dockerfile' {_SPECIAL} ELSE coalesce(ext.language, 'unknown') END AS language FROM paths LEFT JOIN ext ON ending = '.' || string_split(low, '.')[-1] AND contains(low, '.'))
    SELECT path, language, language NOT IN ('unknown', {', '.join(map(quoted, L.NOT_CODE))}) AS code, coalesce(nullif(concat_ws(', ', {_CATEGORIES}), ''), 'General') AS category FROM told""",
)
register(
    "insecure_files",
    lambda s, d: scans.insecure_files(table(s, d, "part").select(F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.lit("/"), F.get(F.array(*map(F.lit, [*INSECURE_FILES, "env.ts", "x.npmrc"])), (F.col("p_size") % 7).cast("int"))).alias("path"))),
    f"SELECT 'src/p' || p_partkey::VARCHAR || '/' || ({INSECURE_FILES})[p_size % 7 + 1] AS path, 'high' AS severity, 'secrets' AS category FROM part WHERE p_size % 7 < 5",
)
