from __future__ import annotations

import re
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textquarry.operators import indexes, needles

FILES = "path string, content string"


def files_of(folder: str) -> dict[str, set]:
    return {p.name: {f.name for f in p.iterdir() if f.suffix == ".parquet"} for p in Path(folder).iterdir() if p.is_dir()}


def test_only_touched_buckets_are_written(spark, tmp_path):
    folder = str(tmp_path / "index")
    rows = spark.createDataFrame([(f"f{k}", f"v{k}") for k in range(300)], FILES)
    indexes.write_index(rows, folder, 16)
    before = files_of(folder)
    n = indexes.update_index(spark, folder, spark.createDataFrame([("f1", "new"), ("f1", "twice"), ("fresh", "x")], FILES), spark.createDataFrame([("f2",), ("nowhere",)], "path string"), 16)
    after = files_of(folder)
    assert n <= 4 and sum(after[b] != before[b] for b in before) <= n
    got = sorted(tuple(r) for r in indexes.read_index(spark, folder, buckets=16).collect())
    assert got == sorted([(f"f{k}", f"v{k}") for k in range(300) if k not in (1, 2)] + [("f1", "new"), ("f1", "twice"), ("fresh", "x")])
    assert sorted(r["content"] for r in indexes.read_index(spark, folder, ["f1", "f3", "no"], 16).collect()) == ["new", "twice", "v3"]
    assert indexes.update_index(spark, folder, rows.limit(0), None, 16) == 0
    indexes.update_index(spark, folder, rows.limit(0), indexes.read_index(spark, folder, buckets=16).where("path <> 'f9'"), 16)
    assert [r["path"] for r in indexes.read_index(spark, folder, buckets=16).collect()] == ["f9"]


def test_an_index_follows_a_stream(spark, tmp_path):
    schema = "path string, content string, version long"
    folder = str(tmp_path / "index")
    extract = lambda files: files.select("path", F.length("content").alias("size"))
    indexes.write_index(extract(spark.createDataFrame([("a", "1", 0), ("b", "22", 0), ("c", "333", 0)], schema)), folder, 8)
    for k, rows in enumerate([[("a", "4444", 2), ("a", "x", 1), ("d", "55555", 1)], [("b", None, 3)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        indexes.follow(stream, folder, extract, str(tmp_path / "checkpoint"), 8).awaitTermination()
    assert {tuple(r) for r in indexes.read_index(spark, folder, buckets=8).collect()} == {("a", 4), ("c", 3), ("d", 5)}


PATTERNS = ["abc", "ab+cd", "(abc|bcd)x?", "a.c", "abcd{2}", "[ab]bca", "(?:ab)c+ba", "ABC", "^abca$", "ab(?=c)ca", "(abca)*b"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdAB", max_size=12), st.sampled_from(PATTERNS))
def test_matches_hold_a_choice_of_trigrams(text, pattern):
    low = text.lower()
    held = {low[k : k + 3] for k in range(len(low) - 2)}
    if re.search(pattern, text):
        assert any(c <= held for c in indexes.choices_of(pattern))


@pytest.mark.parametrize(("pattern", "like"), [("TOD[OA] later", False), ("x.y", False), ("%odo l%", True), ("%\\%%", True), ("(alpha|beta)-gamma", False)])
def test_search_by_trigrams_is_a_scan(spark, tmp_path, pattern, like):
    texts = ["TODO later", "todo later", "TODA later", "x-y", "100% alpha-gamma", "beta-gamma beta", "alpha", "", None]
    files = spark.createDataFrame([(f"f{k}", t) for k, t in enumerate(texts)] + [(None, "TODO later")], FILES)
    indexes.write_trigrams(files, str(tmp_path / "t"))
    got, tried = indexes.search_trigrams(files.where("path IS NOT NULL"), str(tmp_path / "t"), pattern, like)
    want = files.where("path IS NOT NULL").where(F.col("content").like(pattern) if like else F.col("content").rlike(pattern))
    assert sorted(r["path"] for r in got.collect()) == sorted(r["path"] for r in want.collect())
    assert tried.count() < 9 or not all(indexes.choices_of(pattern, like))


def test_needles_by_line_and_in_several_passes(spark, monkeypatch):
    files = spark.createDataFrame([("a", "one two\ntwo one\naaaa"), ("b", "none"), ("c", None), ("d", "tw\no")], FILES)
    asked = spark.createDataFrame([(1, "two"), (2, "one"), (3, "aa"), (4, ""), (5, None), (6, "two"), (7, "w\no"), (None, "one")], "needle_id long, needle string")
    for size in (1 << 20, 4):
        monkeypatch.setattr(needles, "AUTOMATON_BYTES", size)
        assert {tuple(r) for r in needles.holds(files, asked).collect()} == {("a", 1, 2), ("a", 6, 2), ("a", 2, 2), ("a", 3, 3), ("b", 2, 1), ("d", 7, 1)}
        assert {tuple(r) for r in needles.holds(files, asked, True).where("path = 'a'").collect()} == {("a", 1, 1, 1), ("a", 1, 2, 1), ("a", 6, 1, 1), ("a", 6, 2, 1), ("a", 2, 1, 1), ("a", 2, 2, 1), ("a", 3, 3, 3)}
    assert needles.holds(files, asked.limit(0)).count() == 0


def test_bodies_end_where_they_end(spark):
    from textquarry.operators import symbols

    python = "\n".join(f"def f{k}(a, b):\n    x = {{1: a}}\n\n    return x\n" for k in range(300))
    script = "function aa(x) {\n  if (x) {\n    y();\n  }\n}\nconst g = 1;\nfunction bb()\n{\n  z();\n}\n"
    files = spark.createDataFrame([("m.py", "python", python), ("s.js", "javascript", script)], "path string, language string, content string")
    found = symbols.bodies(files).where("path = 'm.py'").collect()
    assert len(found) == 300 and all(r["content"].count("\n") == 3 and r["content"].endswith("return x") and r["params"] == 2 for r in found)
    js = {r["name"]: r["content"] for r in symbols.bodies(files).where("path = 's.js'").collect()}
    assert js["aa"].endswith("}\n}") and js["aa"].count("\n") == 4
