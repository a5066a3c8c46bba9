"""Reports and manifests with a grammar of their own: coverage, notebooks, lock files, profiles, packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import half_up, trimmed
from ..rules import web as W
from ..sources.corpus import lines_of


def _percent(covered: Column, total: Column) -> Column:
    return F.when(total > 0, half_up(covered * 100 / total)).otherwise(F.lit(0).cast("long"))


def lcov(reports: DataFrame) -> DataFrame:
    """path, file, line/function/branch totals and hits; a record's number is the count of SF lines so far."""
    t = trimmed(F.col("text"))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines_of(reports).select("path", "line_no", t.alias("t")).withColumn("rec", F.sum(F.when(F.col("t").startswith("SF:"), 1).otherwise(0)).over(w)).where("rec > 0")
    da = F.when(F.col("t").startswith("DA:"), F.split(F.substr("t", F.lit(4)), ","))
    after = lambda tag: F.max(F.when(F.col("t").startswith(tag), F.regexp_extract("t", r":(\d+)", 1).cast("long")))
    out = rows.groupBy("path", "rec").agg(
        F.max(F.when(F.col("t").startswith("SF:"), F.substr("t", F.lit(4)))).alias("file"),
        F.count_distinct(da[0]).alias("lines_total"),
        F.count_distinct(F.when(da[1].cast("long") > 0, da[0])).alias("lines_hit"),
        F.coalesce(after("FNF:"), F.lit(0)).alias("functions_total"),
        F.coalesce(after("FNH:"), F.lit(0)).alias("functions_hit"),
        F.coalesce(after("BRF:"), F.lit(0)).alias("branches_total"),
        F.coalesce(after("BRH:"), F.lit(0)).alias("branches_hit"),
        F.coalesce(F.bool_or(F.col("t") == "end_of_record"), F.lit(False)).alias("_ended"),
    )
    return out.where("_ended").drop("rec", "_ended").withColumn("percent", _percent(F.col("lines_hit"), F.col("lines_total")))


def istanbul(reports: DataFrame) -> DataFrame:
    """path, file, statements, hit, percent of a coverage map: file -> {s: {id: hits}, ...}."""
    files = F.from_json("content", "map<string, struct<s: map<string, bigint>, f: map<string, bigint>>>")
    return reports.select("path", F.explode(files).alias("file", "x")).select("path", "file", F.size("x.s").cast("long").alias("statements"), F.size(F.filter(F.map_values("x.s"), lambda v: v > 0)).cast("long").alias("hit"), F.size("x.f").cast("long").alias("functions")).withColumn("percent", _percent(F.col("hit"), F.col("statements")))


def istanbul_summary(reports: DataFrame) -> DataFrame:
    """path, file, lines, hit, percent of a summary: file -> {lines: {total, covered}}; the total is left out."""
    files = F.from_json("content", "map<string, struct<lines: struct<total: bigint, covered: bigint>>>")
    return reports.select("path", F.explode(files).alias("file", "x")).where("file <> 'total'").select("path", "file", F.col("x.lines.total").alias("lines"), F.col("x.lines.covered").alias("hit")).withColumn("percent", _percent(F.col("hit"), F.col("lines")))


def cobertura(reports: DataFrame) -> DataFrame:
    """path, file, percent of the classes of a Cobertura report."""
    tags = F.regexp_extract_all("content", F.lit(r"<class\s[^>]*>"), F.lit(0))
    return reports.select("path", F.explode(tags).alias("tag")).select("path", F.regexp_extract("tag", r'filename="([^"]+)"', 1).alias("file"), half_up(F.regexp_extract("tag", r'line-rate="([^"]+)"', 1).cast("double") * 100).alias("percent"))


def coverage_summary(records: DataFrame) -> DataFrame:
    """One row of totals over lcov()."""
    total = records.agg(F.count(F.lit(1)).alias("files"), F.sum("lines_total").alias("lines_total"), F.sum("lines_hit").alias("lines_hit"), F.count_if(F.col("lines_hit") == 0).alias("untested"))
    return total.withColumn("percent", _percent(F.col("lines_hit"), F.col("lines_total")))


def notebooks(files: DataFrame) -> DataFrame:
    """path, language, cells, code_cells, markdown_cells, in_order, unexecuted, errors, imports."""
    cell = "struct<cell_type: string, source: string, execution_count: bigint, outputs: array<struct<output_type: string, ename: string, evalue: string>>>"
    book = F.from_json("content", f"struct<metadata: struct<kernelspec: struct<language: string>>, cells: array<{cell}>>")
    one = files.select("path", book.alias("b"))
    cells = F.coalesce("b.cells", F.array())
    code = F.filter(cells, lambda c: c["cell_type"] == "code")
    counts = F.filter(F.transform(code, lambda c: c["execution_count"]), lambda n: n.isNotNull())
    order = F.aggregate(counts, F.struct(F.lit(0).cast("long").alias("last"), F.lit(True).alias("ok")), lambda a, n: F.struct(F.when(n == 0, a["last"]).otherwise(n).alias("last"), (a["ok"] & (n > a["last"])).alias("ok")), lambda a: a["ok"])
    text = F.transform(code, lambda c: F.when(c["source"].startswith("["), F.array_join(F.from_json(c["source"], "array<string>"), "")).otherwise(c["source"]))
    lines = F.flatten(F.transform(text, lambda t: F.transform(F.split(t, "\n"), trimmed)))
    imports = F.array_distinct(F.filter(lines, lambda x: x.rlike(r"^(?:import |from |require\(|const .+ = require)")))
    errors = F.exists(cells, lambda c: F.exists(F.coalesce(c["outputs"], F.array()), lambda o: o["output_type"] == "error"))
    size = lambda x: F.size(x).cast("long")
    return one.select(
        "path", F.coalesce("b.metadata.kernelspec.language", F.lit("unknown")).alias("language"), size(cells).alias("cells"), size(code).alias("code_cells"),
        size(F.filter(cells, lambda c: c["cell_type"] == "markdown")).alias("markdown_cells"), order.alias("in_order"),
        F.exists(code, lambda c: c["execution_count"].isNull()).alias("unexecuted"), errors.alias("errors"), size(imports).alias("imports"),
    )


def notebook_health(books: DataFrame) -> DataFrame:
    """path, score: 100 less fixed penalties, 0 at least."""
    loss = (
        F.when(F.col("unexecuted"), 10).otherwise(0) + F.when(~F.col("in_order"), 20).otherwise(0) + F.when(F.col("errors"), 15).otherwise(0)
        + F.when(F.col("markdown_cells") == 0, 10).otherwise(0) + F.when(F.col("code_cells") > 30, 10).otherwise(0) + F.when((F.col("imports") == 0) & (F.col("code_cells") > 3), 5).otherwise(0)
    )
    return books.select("path", F.greatest(F.lit(0), 100 - loss).cast("long").alias("score"))


def locked_dependencies(files: DataFrame) -> DataFrame:
    """path, ecosystem, name, version of lock files and manifests."""
    name = F.regexp_extract("path", "[^/]*$", 0)
    npm = files.where(name == "package-lock.json").select("path", F.from_json("content", "struct<packages: map<string, struct<version: string>>, dependencies: map<string, struct<version: string>>>").alias("x"))
    entries = F.concat(*[F.transform(F.map_entries(F.coalesce(f"x.{k}", F.create_map().cast("map<string, struct<version: string>>"))), lambda e: F.struct(F.regexp_replace(e["key"], "^.*node_modules/", "").alias("name"), e["value"]["version"].alias("version"))) for k in ("packages", "dependencies")])
    npm = npm.select("path", F.lit("npm").alias("ecosystem"), F.inline(F.array_distinct(entries))).where("name <> ''")
    pairs = lambda c, a, b: F.arrays_zip(F.regexp_extract_all("content", F.lit(c), F.lit(a)).alias("name"), F.regexp_extract_all("content", F.lit(c), F.lit(b)).alias("version"))
    crate = r'(?m)^name = "([^"]+)"\s+version = "([^"]+)"'
    cargo = files.where(name == "Cargo.lock").select("path", F.lit("cargo").alias("ecosystem"), F.inline(pairs(crate, 1, 2)))
    pinned = r"(?m)^([A-Za-z0-9_.-]+)\s*==\s*([0-9][^\s;#]*)"
    pip = files.where(name == "requirements.txt").select("path", F.lit("pip").alias("ecosystem"), F.inline(pairs(pinned, 1, 2))).withColumn("name", F.lower("name"))
    pipfile = F.from_json("content", "struct<`default`: map<string, struct<version: string>>>")["default"]
    pipenv = files.where(name == "Pipfile.lock").select("path", F.lit("pip").alias("ecosystem"), F.explode(pipfile).alias("name", "v")).select("path", "ecosystem", F.lower("name").alias("name"), F.regexp_replace("v.version", "^==", "").alias("version"))
    sums = r"(?m)^(\S+)\s+v([^\s/]+)\s"
    go = files.where(name == "go.sum").select("path", F.lit("go").alias("ecosystem"), F.inline(pairs(sums, 1, 2)))
    out = npm
    for x in (cargo, pip, pipenv, go):
        out = out.unionByName(x)
    return out.distinct()


def version_parts(v: Column) -> Column:
    """Three numbers of a version, after marks like ^ or ~."""
    parts = F.transform(F.split(F.regexp_replace(v, "^[~^>=<v ]+", ""), r"\."), lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"^(\d+)", 1), F.lit("")).cast("int"), F.lit(0)))
    return F.slice(F.concat(parts, F.array(F.lit(0), F.lit(0), F.lit(0))), 1, 3)


def vulnerable(dependencies: DataFrame) -> DataFrame:
    """path, ecosystem, name, version, safe_from, severity: a broadcast join with the fixed advisory table and a range test."""
    table = F.broadcast(dependencies.sparkSession.createDataFrame(W.ADVISORIES, "name string, ecosystem string, safe_from string, severity string"))
    return dependencies.join(table, ["name", "ecosystem"]).where(version_parts(F.col("version")) < version_parts(F.col("safe_from"))).select("path", "ecosystem", "name", "version", "safe_from", "severity")


def package_dependencies(files: DataFrame) -> DataFrame:
    """path, package, name, version of every package.json."""
    x = F.from_json("content", "struct<name: string, dependencies: map<string, string>, devDependencies: map<string, string>>")
    empty = F.create_map().cast("map<string, string>")
    given = files.where(F.regexp_extract("path", "[^/]*$", 0) == "package.json").select("path", x.alias("x"))
    each = F.array_distinct(F.concat(F.map_entries(F.coalesce("x.dependencies", empty)), F.map_entries(F.coalesce("x.devDependencies", empty))))
    return given.select("path", F.col("x.name").alias("package"), F.inline(each)).select("path", "package", F.col("key").alias("name"), F.col("value").alias("version"))


def heavy_dependencies(dependencies: DataFrame) -> DataFrame:
    table = F.broadcast(dependencies.sparkSession.createDataFrame(W.HEAVY, "name string, size_kb int"))
    return dependencies.join(table, "name").select("path", "name", F.col("size_kb").cast("long").alias("size_kb"), F.when(F.col("size_kb") > 500, "warning").otherwise("info").alias("severity"))


def workspace_edges(dependencies: DataFrame) -> DataFrame:
    """package, name: dependencies on other packages of the same workspace."""
    own = dependencies.select(F.col("package").alias("name")).distinct()
    return dependencies.join(own, "name", "left_semi").select("package", "name").where("package <> name").distinct()


def version_mismatches(dependencies: DataFrame) -> DataFrame:
    return dependencies.groupBy("name").agg(F.count_distinct("version").alias("versions"), F.array_join(F.array_sort(F.collect_set("version")), ", ").alias("seen")).where("versions > 1")


def cpu_profile(files: DataFrame, most: int = 20) -> DataFrame:
    """path, name, hits, percent of the hottest functions of each profile."""
    x = F.from_json("content", "struct<nodes: array<struct<hitCount: bigint, callFrame: struct<functionName: string, url: string>>>>")
    nodes = files.select("path", F.inline(F.from_json(F.to_json(x), "struct<nodes: array<struct<hitCount: bigint, callFrame: struct<functionName: string, url: string>>>>")["nodes"])).where("hitCount > 0 AND callFrame IS NOT NULL")
    w = Window.partitionBy("path")
    rows = nodes.select("path", F.coalesce(F.nullif(F.col("callFrame.functionName"), F.lit("")), F.lit("(anonymous)")).alias("name"), F.col("hitCount").alias("hits"))
    rows = rows.withColumn("percent", F.round(F.col("hits") * 100 / F.sum("hits").over(w), 1)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("hits"), "name")))
    level = F.when(F.col("percent") > 10, "critical").when(F.col("percent") > 3, "warning").otherwise("info")
    return rows.where(F.col("rank") <= most).select("path", "name", "hits", "percent", level.alias("severity"))


def bundle_stats(files: DataFrame, most: int = 15) -> DataFrame:
    """path, name, size, severity of the largest assets."""
    x = F.from_json("content", "struct<assets: array<struct<name: string, size: bigint>>>")
    rows = files.select("path", F.inline(x["assets"])).withColumn("_k", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("size"), "name"))).where(F.col("_k") <= most)
    return rows.select("path", "name", "size", F.when(F.col("size") > 500_000, "critical").when(F.col("size") > 200_000, "warning").otherwise("info").alias("severity"))


# Tool, ending of the file that shows it, text that the file must hold, pattern of its globs within the part that the text begins.
WORKSPACE_FILES: list[tuple[str, str, str | None, str | None]] = [
    ("npm-workspaces", "package.json", r'"workspaces"\s*:', r'"([^"{}\[\]:]+)"'),
    ("pnpm-workspaces", "pnpm-workspace.yaml", r"packages\s*:", r"-\s*['\"]?([^'\"\s]+)"),
    ("cargo-workspaces", "Cargo.toml", r"\[workspace\]", r'"([^"]+)"'),
    ("lerna", "lerna.json", None, None),
    ("nx", "nx.json", None, None),
    ("turborepo", "turbo.json", None, None),
]


def workspaces(files: DataFrame) -> DataFrame:
    """path, tool, globs (sorted, joined by spaces) of the files that make a tree a monorepo."""
    name, found = F.regexp_extract("path", "[^/]*$", 0), []
    for tool, ending, begins, glob in WORKSPACE_FILES:
        part = F.regexp_extract("content", rf"(?s){begins}\s*(?:\{{[^\[]*)?(?:members\s*=\s*)?(\[[^\]]*\]|(?:\s*-[^\n]*)+)", 1) if begins else F.lit("")
        globs = F.regexp_extract_all(part, F.lit(glob), F.lit(1)) if glob else F.array().cast("array<string>")
        shows = (name == ending) & (F.col("content").rlike(begins) if begins else F.lit(True))
        found.append(F.when(shows, F.struct(F.lit(tool).alias("tool"), F.array_join(F.array_sort(globs), " ").alias("globs"))))
    return files.select("path", F.explode(F.array_compact(F.array(*found))).alias("x")).select("path", "x.*")


def workspace_cycles(edges: DataFrame) -> DataFrame:
    """node, cycle: packages of a workspace that need one another. edges: workspace_edges()."""
    from .symbols import on_cycles

    return on_cycles(edges.toDF("src", "dst", *edges.columns[2:]).select("src", "dst"))
