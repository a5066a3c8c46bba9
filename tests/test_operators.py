from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.operators import change, metrics, ranking, scans, search, symbols
from textquarry.sources import corpus
from textquarry.streaming import usage as stream

FILES = "path string, language string, content string"


def files(spark, *rows):
    return spark.createDataFrame(list(rows), FILES)


def test_usage_of_two_tools(spark):
    rows = [("test_tool", 100.0, True, False), ("test_tool", 200.0, False, False), ("other_tool", 50.0, True, True)]
    df = spark.createDataFrame(rows, "tool string, duration_ms double, success boolean, cached boolean")
    got = {r["tool"]: tuple(r)[1:] for r in metrics.usage_stats(df).collect()}
    assert got == {"test_tool": (2, 1, 150.0), "other_tool": (1, 0, 50.0)}


@pytest.mark.parametrize(("content", "n"), [("no newline", 1), ("\n\n\n", 4), ("a\r\nb\rc\n", 3), ("x" * 10_000, 1), ("", 1)])
def test_lines_of_odd_files(spark, content, n):
    assert corpus.lines_of(files(spark, ("a", "text", content))).count() == n


@pytest.mark.parametrize("pattern", ["a b", "\t", "$(rm -rf)", "[1]", "' OR '1'='1", "100%Complete", "my_special", "foo$bar", "O'Reilly"])
def test_literal_patterns_are_literal(spark, pattern):
    df = files(spark, ("a", "text", f"x{pattern}y"), ("b", "text", "nothing of the kind"))
    assert [r["path"] for r in search.search(df, pattern).collect()] == ["a"]


def test_search_in_binary_like_text(spark):
    df = files(spark, ("a", "text", "\x00\x01�needle\x00"))
    assert search.search(df, "needle").first()["column"] == 4


def test_context_at_the_edges(spark):
    df = files(spark, ("a", "text", "x\ny\nx"))
    rows = sorted(tuple(r) for r in search.with_context(df, "x").collect())
    assert rows == [("a", 1, "x", None, "y"), ("a", 3, "x", "y", None)]


def test_ascii_word_boundaries_next_to_other_letters(spark):
    df = files(spark, ("a", "javascript", "édo\ndo\nundo"))
    assert df.select(metrics.complexity(F.col("content")).alias("n")).first()["n"] == 3


def test_cycles_of_two_and_three_and_none(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("x", "x"), ("p", "q"), ("q", "a")], "src string, dst string")
    got = {r["node"]: r["cycle"] for r in symbols.on_cycles(e).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "c"}
    assert symbols.on_cycles(e.limit(0)).count() == 0


def test_long_cycle(spark):
    n = 60
    e = spark.createDataFrame([(f"n{k:03d}", f"n{(k + 1) % n:03d}") for k in range(n)], "src string, dst string")
    assert symbols.on_cycles(e).where("cycle = 'n000'").count() == n


def test_nesting_seven_deep(spark):
    df = files(spark, ("a", "javascript", "}}\n" + "if (x) {\n" * 7 + "}\n" * 7))
    assert df.select(metrics.max_nesting(F.col("content")).alias("n")).first()["n"] == 7
    assert metrics.nesting_by_line(corpus.lines_of(df)).agg(F.max("depth"), F.min("depth")).first()[:] == (7, 0)


def test_chunks_cover_every_line_once(spark):
    text = "\n".join(["def f(x):" if k % 9 == 0 else f"  line {k}" for k in range(140)])
    rows = ranking.chunks(files(spark, ("a", "python", text))).orderBy("chunk_no").collect()
    assert rows[0]["start_line"] == 1 and rows[-1]["end_line"] == 140
    assert all(b["start_line"] == a["end_line"] + 1 for a, b in zip(rows, rows[1:], strict=False))
    assert "\n".join(r["chunk"] for r in rows) == text
    assert all(r["end_line"] - r["start_line"] < 50 for r in rows)


def test_pack_skips_what_does_not_fit(spark):
    df = files(spark, ("license/a", "t", "license " * 5), ("license/b", "t", "license" + "x" * 40_000), ("license/c", "t", "license " * 4))
    assert {r["path"] for r in ranking.context_pack(df, "license", 1000).collect()} == {"license/a", "license/c"}


def test_rename_keeps_one_row(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha string")
    new = spark.createDataFrame([("a", "1"), ("c", "2"), ("d", "3")], "path string, sha string")
    assert sorted(tuple(r) for r in change.compare(old, new).collect()) == [("c", "R", "b"), ("d", "A", None)]


def test_severities_order_from_worst(spark):
    df = spark.createDataFrame([(s,) for s in ("info", "critical", "low", "high", "medium")], "s string")
    assert [r["s"] for r in df.orderBy(scans.severity_rank(F.col("s"))).collect()] == ["critical", "high", "medium", "low", "info"]


@pytest.mark.parametrize("path", ["../etc/passwd", "/root/repository/x", "a\0b", "x/../../y"])
def test_paths_outside_are_refused(path):
    with pytest.raises(ValueError):
        corpus.allowed(path, ["/root/repo"])


def test_paths_inside_are_allowed():
    assert corpus.allowed("src/../a.ts", ["/root/repo"]) == "/root/repo/a.ts"
    assert corpus.allowed("/root/repo/" + "d/" * 300 + "é", ["/root/repo"]).endswith("é")


def test_reading_a_tree(spark, tmp_path):
    for name, text in {"a.py": "x = 1\n", "node_modules/m.js": "no", ".hidden": "no", "deep/er/b.ts": "let y\n", "sp ace[1].md": "# t"}.items():
        p = tmp_path / "proj" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    rows = {r["path"]: (r["language"], r["content"]) for r in corpus.read_tree(spark, str(tmp_path / "proj")).collect()}
    assert rows == {"a.py": ("python", "x = 1\n"), "deep/er/b.ts": ("typescript", "let y\n"), "sp ace[1].md": ("markdown", "# t")}
    assert corpus.read_tree(spark, str(tmp_path / "proj"), max_depth=1).count() == 2


def test_terms_on_both_sides_agree(spark):
    text = "getUserName 'quoted away' snake_case HTTPServer of the class"
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(T.terms(F.col("x"))).first()[0] == T.terms_of(text)


def test_a_thousand_files_and_removal(spark):
    index = spark.range(1000).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.col("id").alias("mtime"))
    assert index.count() == 1000
    assert symbols.removed(index, index.where("path = 'f7'")).count() == 999


def test_stream_equals_batch(spark, small):
    path = f"{small}/events.parquet"
    batch = corpus.events_as_usage(spark.read.parquet(path))
    got = stream.run_to_memory(stream.windowed_stats(stream.usage_stream(spark, path)), "usage_windows")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in stream.windowed_stats(batch).collect()}


def test_empty_inputs(spark):
    none = files(spark).limit(0)
    for df in (search.search(none, "x"), scans.security_scan(none), metrics.line_types(none), symbols.symbols(none), symbols.imports(none), scans.functions_of(none), ranking.chunks(none), ranking.concept_search(none, "license", ["path"], text="content")):
        assert df.count() == 0


@pytest.mark.parametrize("name", ["app", "c++", "a.b (1)"])
def test_paths_of_a_tree_whose_name_comes_twice(spark, tmp_path, name):
    root = tmp_path / name / "x" / name
    (root / name).mkdir(parents=True)
    (root / "a.py").write_text("1")
    (root / name / "b.py").write_text("22")
    got = {r["path"]: (r["root"], r["size"]) for r in corpus.read_tree(spark, str(root)).collect()}
    assert got == {"a.py": (name, 1), f"{name}/b.py": (name, 2)}
    assert [r["path"] for r in corpus.read_tree(spark, str(root), glob="a.*").collect()] == ["a.py"]
    assert corpus.read_tree(spark, str(root), max_bytes=1).count() == 1


def test_symbols_over_lines(spark):
    """Matches that cross lines, as hand-derived; names once for each kind, at their first place."""
    files = spark.createDataFrame(
        [
            ("a.c", "c", "int\nmain(int argc,\n     char **argv)\n{\n}\n\nvoid f0(int x)\n{\n}\n"),
            ("b.py", "python", "__all__ = [\n  'one']\n\nasync def run(\n    x):\n    pass\n\ndef run(): pass\n"),
            ("c.java", "java", "class A {\n\n  public int\n  size() { }\n}\n"),
            ("n", "python", None),
            ("e", "python", ""),
        ],
        "path string, language string, content string",
    )
    got = {(r["path"], r["name"], r["kind"], r["line_no"]) for r in symbols.symbols(files).collect()}
    assert {("a.c", "main", "function", 1), ("a.c", "f0", "function", 7), ("b.py", "run", "function", 4), ("c.java", "size", "function", 3)} <= got
    assert sum(x[:3] == ("b.py", "run", "function") for x in got) == 1 and not any(x[0] in ("n", "e") for x in got)


def test_cycles_far_apart(spark):
    n = 70
    e = spark.createDataFrame([(k, (k + 1) % n) for k in range(n)] + [(n - 1, 100), (100, 101), (101, 100), (101, 200), (7, 7), (None, 1)], "src long, dst long")
    got = {r["node"]: r["cycle"] for r in symbols.on_cycles(e).collect()}
    assert got == dict.fromkeys(range(n), 0) | {100: 100, 101: 100}
