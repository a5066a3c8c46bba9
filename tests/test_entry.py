from __future__ import annotations

import importlib
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_entry_has_rows(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("left", [True, False])
def test_the_rest_works_without_the_training_part(tmp_path, left):
    """Both folders are gone, and corpus_pipeline.py with them or not: the entry imports and its queries run."""
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if left else ["corpus_pipeline.py"])))
    code = f"""
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
found = e.queries()
print(len(found), len(e.oracle_sql()), any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in found), e.entry(spark).count(), found["usage_stats"](spark, "/root/testdata/sf0.001").count())
"""
    import os

    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, check=False)
    assert out.returncode == 0, out.stderr[-800:]
    n, oracles, training, rows, stats = out.stdout.split()
    assert int(n) > 120 and int(oracles) > 120 and training == "False" and int(rows) > 0 and int(stats) > 0
