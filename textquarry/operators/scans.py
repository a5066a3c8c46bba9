"""Rule scans: security findings, quality rules, empty handlers, long functions and duplicates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, trimmed
from ..rules import lines as R
from ..sources.corpus import lines_of
from .ranking import batches

RuleRow = tuple[str, str, str, str, bool]


def severity_rank(severity: Column) -> Column:
    """0 for the worst."""
    out = F.lit(len(R.SEVERITIES))
    for k, s in reversed(list(enumerate(R.SEVERITIES))):
        out = F.when(severity == s, k).otherwise(out)
    return out


def security_scan(files: DataFrame, rules: list[RuleRow] | None = None, severity: str | None = None, category: str | None = None) -> DataFrame:
    """path, line_no, rule, category, severity, snippet of every rule that a line breaks.

    Lines that begin as comments are skipped. All rules are one array expression, so each line is read once; rules of
    plugins are rows added to `rules`. A rule's pattern is tried only on files and lines that hold one of its literals
    (rules.lines.LITERALS), and files that no rule matches at all leave before their lines are made.
    """
    used = [r for r in rules or R.SECURITY if (severity is None or r[2] == severity) and (category is None or r[1] == category)]
    p = lambda r: ("(?i)" if r[4] else "") + r[3]
    t = trimmed(F.col("text"))

    def breaks(r: RuleRow, text: Column) -> Column:
        literals, own = R.LITERALS.get(r[0], []), F.lower(text) if r[4] else text
        held = F.lit(not literals)
        for x in literals:
            held = held | F.contains(own, F.lit(x))
        return held & text.rlike(p(r))

    hits = F.array_compact(F.array(*[F.when(breaks(r, F.col("text")), F.struct(F.lit(r[0]).alias("rule"), F.lit(r[1]).alias("category"), F.lit(r[2]).alias("severity"))) for r in used]))
    any_rule = F.lit(False)
    for r in used:
        any_rule = any_rule | breaks(r, F.col("content"))
    found = lines_of(files.where(any_rule)).where(~t.rlike(r"^(//|#|\*)")).select("path", "line_no", F.explode(hits).alias("x"), F.substr(t, F.lit(1), F.lit(120)).alias("snippet"))
    return found.select("path", "line_no", "x.rule", "x.category", "x.severity", "snippet")


def severity_histogram(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("path").alias("files")).withColumn("rank", severity_rank(F.col("severity")).cast("long"))


def insecure_files(files: DataFrame) -> DataFrame:
    return files.where(basename(F.col("path")).isin(R.INSECURE_FILES)).select("path", F.lit("high").alias("severity"), F.lit("secrets").alias("category"))


def line_rule(files: DataFrame, pattern: str) -> DataFrame:
    """path, line_no, text of lines that match without regard to case."""
    p = "(?i)" + pattern
    return lines_of(files.where(F.col("content").rlike(p))).where(F.col("text").rlike(p))


def hook_preview(files: DataFrame) -> DataFrame:
    """secrets, debug logs and todos on the lines of the given files, as one row."""
    n = lambda p: F.count_if(F.col("text").rlike("(?i)" + p))
    return lines_of(files).agg(n(R.SECRETS).alias("secrets"), n(R.DEBUG_LOGS).alias("debug_logs"), n(R.TODOS).alias("todos"))


def _block(text: str, at: int) -> int:
    """Index after the brace that closes the one at `at`, or -1."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if not depth:
            return i + 1
    return -1


def _empty_handlers(path: str, content: str) -> Iterator[tuple]:
    line = lambda at: content.count("\n", 0, at) + 1
    if path.endswith(".py"):
        yield from ((path, line(m.start()), "python") for m in re.finditer(r"except\s*(?:\([^)]+\))?\s*:\s*pass", content))
    elif path.endswith(".rb"):
        yield from ((path, line(m.start()), "ruby") for m in re.finditer(r"rescue\s*(?:=>\s*nil|;?\s*end)", content))
    else:
        for m in re.finditer(r"catch\s*\([^)]*\)\s*\{", content):
            end = _block(content, m.end() - 1)
            if end > 0 and not re.sub(r"//[^\n]*|/\*[\s\S]*?\*/", "", content[m.end() : end - 1]).strip():
                yield path, line(m.start()), "braces"


def empty_handlers(files: DataFrame) -> DataFrame:
    """path, line_no, style of exception handlers without a statement; they cross lines, so whole files go to Arrow batches."""
    schema = pa.schema([("path", pa.string()), ("line_no", pa.int64()), ("style", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches((x for b in it for p, c in zip(*(k.to_pylist() for k in b.columns), strict=True) for x in _empty_handlers(p, c)), schema)

    return files.where(F.col("content").rlike("catch|except|rescue")).select("path", "content").mapInArrow(run, "path string, line_no long, style string")


FUNCTION = re.compile(r"^\s*(?:export\s+)?(?:pub\s+)?(?:async\s+)?(?:function|def|fn|func)\s+(\w+)", re.ASCII)


def function_extents(path: str, content: str) -> Iterator[tuple]:
    """(path, name, start line, end line, braced): by braces, or by indentation where a definition ends in a colon."""
    lines = content.split("\n")
    for i, text in enumerate(lines):
        m = FUNCTION.match(text)
        if not m:
            continue
        if text.rstrip().endswith(":"):
            own, end = len(text) - len(text.lstrip()), i
            for j in range(i + 1, len(lines)):
                if lines[j].strip():
                    if len(lines[j]) - len(lines[j].lstrip()) <= own:
                        break
                    end = j
            yield path, m[1], i + 1, end + 1, False
        else:
            depth, seen, end = 0, False, i
            for j in range(i, len(lines)):
                depth += lines[j].count("{") - lines[j].count("}")
                seen = seen or "{" in lines[j]
                end = j
                if seen and depth <= 0 or not seen and j > i and FUNCTION.match(lines[j]):
                    break
            if seen:
                yield path, m[1], i + 1, end + 1, True


def functions_of(files: DataFrame) -> DataFrame:
    """path, name, start_line, end_line, lines, body (white space normalised)."""
    schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("start_line", pa.int64()), ("end_line", pa.int64()), ("lines", pa.int64()), ("body", pa.string())])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in it:
            for path, content in zip(*(k.to_pylist() for k in b.columns), strict=True):
                lines = content.split("\n")
                for p, name, a, z, _ in function_extents(path, content):
                    yield p, name, a, z, z - a + 1, " ".join(" ".join(lines[a - 1 : z]).split())

    given = files.where(F.col("content").rlike(r"(?:function|def|fn|func)\s")).select("path", "content")
    return given.mapInArrow(lambda it: batches(rows(it), schema), "path string, name string, start_line long, end_line long, lines long, body string")


def long_functions(files: DataFrame, threshold: int = 50) -> DataFrame:
    return functions_of(files).where(F.col("lines") > threshold).select("path", "name", "start_line", "end_line", "lines")


def duplicates(keyed: DataFrame, key: str, least: int = 2) -> DataFrame:
    """key, n, n_paths, first_path of keys in `least` or more paths; a partial aggregation, so a hot key is one row a task."""
    return keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("n_paths"), F.min("path").alias("first_path")).where(F.col("n_paths") >= least)


def duplicate_functions(files: DataFrame, min_lines: int = 5) -> DataFrame:
    body = functions_of(files).where((F.col("lines") >= min_lines) & (F.length("body") > 50)).select("path", F.substr("body", F.lit(1), F.lit(200)).alias("key"))
    return duplicates(body, "key").select(F.md5("key").alias("key"), "n", "n_paths", "first_path")


def duplicate_texts(files: DataFrame) -> DataFrame:
    """Whole texts of more than 50 characters that are equal but for white space."""
    key = F.regexp_replace(F.col("content"), r"[ \t\r\n\x0B\f]+", " ")
    return duplicates(files.where(F.length("content") > 50).select("path", F.md5(key).alias("key")), "key")


def exact_duplicates(files: DataFrame) -> DataFrame:
    return duplicates(files.select("path", F.sha2("content", 256).alias("key")), "key")
