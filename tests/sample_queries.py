"""Operators over small sample trees, and the rows that are expected of them (tests/sample_rows.py)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import sample_trees as samples
from sample_rows import ROWS

from textquarry.functions.text import category_of, is_code, language_of
from textquarry.operators import change, formats, metrics, parsers, project, scans, settings, symbols

Make = Callable[[SparkSession], DataFrame]


def code(s: SparkSession) -> DataFrame:
    return s.createDataFrame(samples.CODE, "path string, language string, content string")


def pairs(s: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return s.createDataFrame(rows, "path string, content string")


def paths(s: SparkSession) -> DataFrame:
    return pairs(s, samples.PATHS).withColumn("language", language_of(F.col("path")))


def report(s: SparkSession, name: str) -> DataFrame:
    return pairs(s, [(name, samples.REPORTS[name])])


def diffs(s: SparkSession) -> DataFrame:
    return s.createDataFrame(samples.DIFFS, "diff_id int, content string")


def _changed(s: SparkSession) -> tuple[DataFrame, DataFrame]:
    return s.createDataFrame([("src/types.ts",)], "path string"), s.createDataFrame([("src/types.ts", "Job", "modified")], "file string, name string, change string")


def _impact(s: SparkSession) -> DataFrame:
    return change.impact(code(s), *_changed(s))


def _edges(s: SparkSession) -> DataFrame:
    return symbols.import_edges(code(s))


def _imports(s: SparkSession) -> DataFrame:
    return symbols.imports(code(s))


def _index(s: SparkSession) -> tuple[DataFrame, DataFrame]:
    schema = "path string, mtime long"
    return s.createDataFrame([("a.ts", 1), ("b.ts", 2), ("c.ts", 3)], schema), s.createDataFrame([("a.ts", 1), ("b.ts", 5), ("d.ts", 4)], schema)


def _plugin_rules(s: SparkSession) -> DataFrame:
    """A plugin's rule is a row more in the rule table."""
    rule = ("Loose comparison", "style", "low", r"while \(true\)", False)
    return scans.security_scan(code(s), rules=[rule])


MAKE: dict[str, Make] = {
    "detect_language": lambda s: paths(s).select("path", "language", is_code(F.col("language")).alias("code"), category_of(F.col("language")).alias("category")),
    "codebase_map": lambda s: metrics.codebase_map(paths(s)),
    "detect_frameworks": lambda s: metrics.frameworks(paths(s)),
    "detect_package_managers": lambda s: metrics.package_managers(paths(s)),
    "insecure_files": lambda s: scans.insecure_files(paths(s)),
    "symbols": lambda s: symbols.symbols(code(s)),
    "symbol_search": lambda s: symbols.symbol_search(symbols.symbols(code(s)), "run").select("path", "name", "kind", "line_no"),
    "symbols_of_language": lambda s: symbols.symbols(code(s), kinds=["function"], language="python").select("path", "name", "kind", "line_no"),
    "imports": _imports,
    "dependency_graph": lambda s: symbols.dependency_graph(_imports(s)).select("path", "n", F.array_join("imports", " ").alias("imports")),
    "importers": lambda s: symbols.importers(_imports(s), "src/types.ts"),
    "call_graph": lambda s: symbols.call_graph(code(s)),
    "import_edges": _edges,
    "circular_imports": lambda s: symbols.on_cycles(_edges(s)),
    "self_imports": lambda s: symbols.self_imports(_edges(s)),
    "layer_violations": lambda s: symbols.layer_violations(_imports(s)),
    "type_flow": lambda s: symbols.type_flow(code(s), "Job"),
    "dead_exports": lambda s: symbols.dead_exports(code(s)),
    "orphan_files": lambda s: symbols.orphan_files(code(s)),
    "find_dead_code": lambda s: symbols.find_dead_code(code(s)),
    "index_stale": lambda s: symbols.stale(*_index(s)),
    "index_update": lambda s: symbols.updated(*_index(s)),
    "index_remove": lambda s: symbols.removed(*_index(s)),
    "index_stats": lambda s: symbols.index_stats(symbols.symbols(code(s))),
    "line_types": lambda s: metrics.line_types(code(s)),
    "code_metrics": lambda s: metrics.code_metrics(code(s)),
    "empty_catches": lambda s: scans.empty_handlers(code(s)),
    "long_functions": lambda s: scans.long_functions(code(s), 5),
    "duplicate_functions": lambda s: scans.duplicate_functions(code(s)).select("n", "n_paths", "first_path"),
    "security_scan_code": lambda s: scans.security_scan(code(s)),
    "plugin_rules": _plugin_rules,
    "diff_symbols": lambda s: change.changed_symbols(diffs(s)),
    "categorize_diff": lambda s: change.categorised(diffs(s)).drop("indicators"),
    "change_impact": _impact,
    "affected_tests": lambda s: change.affected_tests(code(s), _impact(s), s.createDataFrame([("src/runner.ts",)], "path string")),
    "change_risk": lambda s: change.risk(_impact(s), _changed(s)[1]),
    "lcov": lambda s: formats.lcov(report(s, "lcov.info")),
    "coverage_summary": lambda s: formats.coverage_summary(formats.lcov(report(s, "lcov.info"))),
    "untested_files": lambda s: formats.lcov(report(s, "lcov.info")).where("lines_hit = 0").select("file"),
    "istanbul": lambda s: formats.istanbul(report(s, "coverage-final.json")),
    "istanbul_summary": lambda s: formats.istanbul_summary(report(s, "coverage-summary.json")),
    "cobertura": lambda s: formats.cobertura(report(s, "cobertura.xml")),
    "notebooks": lambda s: formats.notebooks(pairs(s, samples.NOTEBOOKS)),
    "notebook_health": lambda s: formats.notebook_health(formats.notebooks(pairs(s, samples.NOTEBOOKS))),
    "lockfile_dependencies": lambda s: formats.locked_dependencies(pairs(s, samples.LOCKS)),
    "dependency_vulnerabilities": lambda s: formats.vulnerable(formats.locked_dependencies(pairs(s, samples.LOCKS))),
    "package_dependencies": lambda s: formats.package_dependencies(paths(s)),
    "heavy_dependencies": lambda s: formats.heavy_dependencies(formats.package_dependencies(paths(s))),
    "monorepo_edges": lambda s: formats.workspace_edges(formats.package_dependencies(paths(s))),
    "version_mismatches": lambda s: formats.version_mismatches(formats.package_dependencies(paths(s))),
    "workspaces": lambda s: formats.workspaces(pairs(s, samples.WORKSPACES)),
    "workspace_cycles": lambda s: formats.workspace_cycles(formats.workspace_edges(formats.package_dependencies(paths(s)))),
    "iac_summary": lambda s: settings.iac_summary(settings.iac(pairs(s, samples.IAC))),
    "heatmap_functions": lambda s: metrics.heatmap_functions(code(s).where("path = 'src/runner.ts'")),
    "cpu_profile": lambda s: formats.cpu_profile(pairs(s, samples.PROFILES)),
    "bundle_stats": lambda s: formats.bundle_stats(pairs(s, samples.BUNDLES)),
    "db_columns": lambda s: parsers.db_columns(pairs(s, samples.SCHEMAS)),
    "db_tables": lambda s: parsers.db_tables(parsers.db_columns(pairs(s, samples.SCHEMAS))),
    "db_relationships": lambda s: parsers.db_relationships(parsers.db_columns(pairs(s, samples.SCHEMAS))),
    "api_endpoints": lambda s: parsers.api_endpoints(pairs(s, samples.APIS)),
    "openapi_endpoints": lambda s: parsers.openapi_endpoints(pairs(s, samples.APIS)),
    "api_method_histogram": lambda s: parsers.method_histogram(parsers.api_endpoints(pairs(s, samples.APIS))),
    "iac_resources": lambda s: settings.iac(pairs(s, samples.IAC)).where("what = 'resource'").select("path", "type", "name", "detail"),
    "iac_issues": lambda s: settings.iac(pairs(s, samples.IAC)).where("what = 'issue'").select("path", "type", "name", "severity"),
    "cicd_jobs": lambda s: settings.cicd(pairs(s, samples.PIPELINES)).where("what = 'job'").select("path", "platform", "job", F.col("value").alias("runs_on")),
    "cicd_needs": lambda s: settings.cicd(pairs(s, samples.PIPELINES)).where("what = 'needs'").select("path", "job", F.col("value").alias("needs")),
    "cicd_facts": lambda s: settings.cicd(pairs(s, samples.PIPELINES)),
    "code_docs": lambda s: parsers.docs(code(s)),
    "symbol_docs": lambda s: parsers.docs(code(s), symbol="run").select("path", "name", "summary", "deprecated"),
    "dependency_counts": lambda s: project.dependency_counts(paths(s)),
    "coverage_location": lambda s: project.report_location(pairs(s, [("lcov.info", ""), ("a/b/lcov.info", ""), ("coverage/coverage-final.json", "{}"), ("coverage/coverage-summary.json", "{}")])),
    "coverage_of_file": lambda s: project.file_coverage(formats.lcov(report(s, "lcov.info")), "/work/src/a.ts").select("file", "percent"),
    "test_files": lambda s: project.test_files(pairs(s, [*((p, "") for p, _, _ in samples.CODE), *((p, "") for p, _ in samples.PATHS), ("node_modules/x.test.js", ""), ("lib/spec_a.rb", "")])),
    "undocumented": lambda s: parsers.undocumented(code(s), symbols.symbols(code(s))),
    "blame": lambda s: change.blame(pairs(s, [("f", samples.BLAME)])).withColumn("date", F.col("date").cast("string")),
}

SQL_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE"}


def _literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def _values(columns: list[tuple[str, str]], rows: list[tuple]) -> str:
    names = [f"c{k}" for k in range(len(columns))]
    casts = ", ".join(f'CAST({n} AS {SQL_TYPES[kind]}) AS "{name}"' for n, (name, kind) in zip(names, columns, strict=True))
    return f"SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


ORACLES = {name: _values(*ROWS[name]) for name in MAKE if name in ROWS}
