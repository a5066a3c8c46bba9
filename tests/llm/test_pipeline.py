from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_llm import DOCS, brute_classes, check_packing, corpus_rows  # noqa: E402

from textquarry.llm import common  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = common.table(spark, FOLDER, "documents")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality rules", "n-gram Jaccard join", "pseudonyms", "mixing sources to target weights", "best-fit packing"]
    good = common.stage(steps["quality rules"](spark, docs, FOLDER), "p1")
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    clean = common.table(spark, FOLDER, "labels").where("quality = 1 AND toxic = 0").join(docs, "doc_id")
    assert clean.join(good, "doc_id", "left_semi").count() >= 0.85 * clean.count()
    once = common.stage(steps["n-gram Jaccard join"](spark, good, FOLDER), "p2")
    classes = brute_classes([(r["doc_id"], r["text"]) for r in good.collect()])
    assert Counter(r["doc_id"] for r in once.collect()) == Counter({c for _, _, c in classes})
    hidden = common.stage(steps["pseudonyms"](spark, once, FOLDER), "p3")
    assert hidden.columns == docs.columns and hidden.count() == once.count()
    assert hidden.where(F.col("text").rlike(r"@mail\d")).count() == 0
    mixed = common.stage(steps["mixing sources to target weights"](spark, hidden, FOLDER), "p4")
    assert 0 < mixed.count() < hidden.count() and mixed.join(hidden, "doc_id", "left_anti").count() == 0
    check_packing(steps["best-fit packing"](spark, mixed, FOLDER).collect(), [(r["doc_id"], r["text"]) for r in mixed.collect()])


def test_odd_rows_go_through(spark, tmp_path):
    docs = spark.createDataFrame(corpus_rows(), DOCS)
    for name, rows in (("some", docs), ("none", docs.limit(0))):
        folder = str(tmp_path / name)
        rows.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (101, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        assert bool(out) == (name == "some")


def test_columns_named_like_results_come_out_as_they_went_in(spark, tmp_path):
    rows = [(*r, "mine", -1.5, f"s{k}") for k, r in enumerate(corpus_rows()[:40])]
    docs = spark.createDataFrame(rows, f"{DOCS}, kept string, factor double, class string")
    spark.createDataFrame([(1, 1, 0), (101, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = common.stage(step(spark, docs, str(tmp_path)), "clash")
        assert docs.columns == [*(c.split()[0] for c in DOCS.split(", ")), "kept", "factor", "class"], name
        got = docs.collect()
        assert got and {(r["kept"], r["factor"]) for r in got} == {("mine", -1.5)} and len({r["class"] for r in got}) == len(got)
