"""Routes of Express applications through routers that are mounted on one another, in one file or across files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import resolved_import
from .shared import checkpointed

# Patterns of an application's routers, mounts, routes and what a name stands for.
CREATED = r"(?:const|let|var)\s+(\w+)\s*=\s*(?:express(?:\.Router)?|Router)\s*\("
MOUNTED = r"(\w+)\.use\s*\(\s*['\"`]([^'\"`]+)['\"`]\s*,\s*(\w+)\s*\)"
ROUTED = r"(\w+)\.(get|post|put|delete|patch|all)\s*\(\s*['\"`]([^'\"`]+)['\"`]"
CHAINED = r"(\w+)\.route\s*\(\s*['\"`]([^'\"`]+)['\"`]\s*\)((?:\s*\.(?:get|post|put|delete|patch|all)\s*\([^()]*\))+)"
BY_NAME = r"(\w+)\.(get|post|put|delete|patch|all)\s*\(\s*(\w+Path)\b"
PATHS = r"(?:const|let|var)\s+(\w+Path)\s*=\s*['\"`]([^'\"`]+)['\"`]"
REQUIRED = r"(?:const|let|var)\s+(\w+)\s*=\s*require\s*\(\s*['\"](\.[^'\"]+)['\"]\s*\)|import\s+(\w+)\s+from\s+['\"](\.[^'\"]+)['\"]"
EXPORTED = r"(?:module\.exports\s*=|export\s+default)\s*(\w+)"
#: Mounts along one way beyond which it is taken for a cycle's.
DEEPEST = 32


def _zipped(pattern: str, *names: str):
    groups = [F.regexp_extract_all("content", F.lit(pattern), F.lit(k + 1)).alias(n) for k, n in enumerate(names)]
    return F.inline(F.arrays_zip(*groups))


def _stem(path):
    return F.regexp_replace(path, r"\.[A-Za-z]+$", "")


def direct_routes(files: DataFrame) -> DataFrame:
    """path, router, method, route: routes as they are written on a router: by method, in chains, by a name for the path."""
    code = files.where(F.col("path").rlike(r"\.(js|ts|mjs|cjs)$") & F.col("content").rlike(r"\.(get|post|put|delete|patch|all|route)\s*\("))
    plain = code.select("path", _zipped(ROUTED, "router", "method", "route"))
    chains = code.select("path", _zipped(CHAINED, "router", "route", "rest")).select("path", "router", F.explode(F.regexp_extract_all("rest", F.lit(r"\.(\w+)\s*\("), F.lit(1))).alias("method"), "route")
    names = code.select("path", _zipped(PATHS, "name", "route")).groupBy("path", "name").agg(F.min("route").alias("route"))
    named = code.select("path", _zipped(BY_NAME, "router", "method", "name")).join(names, ["path", "name"]).select("path", "router", "method", "route")
    every = plain.unionByName(chains).unionByName(named)
    own = code.select("path", F.explode(F.concat(F.regexp_extract_all("content", F.lit(CREATED), F.lit(1)), F.array(F.lit("app"), F.lit("router")))).alias("router")).distinct()
    template = F.regexp_replace("route", r"\$\{[^}]+\}", "*")
    return every.join(own, ["path", "router"], "left_semi").select("path", "router", F.when(F.lower("method") == "all", "ANY").otherwise(F.upper("method")).alias("method"), template.alias("route")).distinct()


def mounts(files: DataFrame) -> DataFrame:
    """path, router, prefix, to_path, to_router: a router that another one is mounted on, and that one, which may be the
    default export of another file."""
    code = files.where(F.col("path").rlike(r"\.(js|ts|mjs|cjs)$"))
    used = code.where(F.col("content").rlike(r"\.use\s*\(")).select("path", _zipped(MOUNTED, "router", "prefix", "name"))
    required = code.select("path", _zipped(REQUIRED, "a", "b", "c", "d")).select("path", F.when(F.col("a") != "", F.col("a")).otherwise(F.col("c")).alias("name"), F.when(F.col("a") != "", F.col("b")).otherwise(F.col("d")).alias("target"))
    required = required.select("path", "name", resolved_import(F.col("path"), F.col("target")).alias("_stem")).distinct()
    exports = code.select(F.col("path").alias("to_path"), _stem(F.col("path")).alias("_stem"), F.explode(F.regexp_extract_all("content", F.lit(EXPORTED), F.lit(1))).alias("to_router"))
    other = used.join(required, ["path", "name"]).join(exports, "_stem").select("path", "router", "prefix", "to_path", "to_router")
    here = used.join(required, ["path", "name"], "left_anti").select("path", "router", "prefix", F.col("path").alias("to_path"), F.col("name").alias("to_router"))
    return other.unionByName(here).distinct()


def joined_path(*parts):
    """Parts of a route as one path of single slashes, without one at its end."""
    return F.regexp_replace(F.regexp_replace(F.concat(*parts), "/+", "/"), "(?<=.)/$", "")


def mounted_routes(files: DataFrame) -> DataFrame:
    """path, method, route: each route with the prefixes of all ways on which its router is mounted; a router that nothing mounts begins a way.

    Prefixes are composed level by level from the routers that nothing mounts; a way that comes back to a router on it
    ends there, so cycles are cut. A router that only a cycle leads to has its routes as they are written.
    """
    edges = checkpointed(mounts(files))
    routes = checkpointed(direct_routes(files))
    node = lambda p, r: F.concat(p, F.lit("\n"), r)
    edges = edges.select(node("path", "router").alias("src"), node("to_path", "to_router").alias("dst"), "prefix")
    known = routes.select(node("path", "router").alias("node")).union(edges.select("src")).union(edges.select("dst")).distinct()
    level = checkpointed(known.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").select("node", F.lit("").alias("base"), F.array("node").alias("way")))
    levels = [level]
    while not level.isEmpty() and len(levels) < DEEPEST:
        down = level.join(edges, F.col("node") == F.col("src")).where(~F.array_contains("way", F.col("dst")))
        level = checkpointed(down.select(F.col("dst").alias("node"), joined_path("base", F.lit("/"), "prefix").alias("base"), F.concat("way", F.array("dst")).alias("way")))
        levels.append(level)
    bases = levels[0]
    for more in levels[1:]:
        bases = bases.unionByName(more)
    own = routes.withColumn("node", node("path", "router")).join(bases.select("node", "base").distinct(), "node", "left")
    return own.select("path", "method", joined_path(F.coalesce("base", F.lit("")), F.lit("/"), "route").alias("route")).distinct()
