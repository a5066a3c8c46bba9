"""What the queries over the tree of parts bring up."""

from __future__ import annotations

from textquarry import registry
from textquarry.rules import languages as L
from textquarry.rules.changes import TYPE_USES


def test_type_flow_has_all_kinds_in_many_files(spark, small):
    rows = registry.QUERIES["type_flow"](spark, small).collect()
    assert {r["kind"] for r in rows} == {kind for kind, _ in TYPE_USES}
    assert len({r["path"] for r in rows}) > 5


def test_languages_of_all_names(spark):
    rows = registry.QUERIES["detect_language"](spark, "/root/testdata/sf0.01").collect()
    assert {r["language"] for r in rows} == {*L.LANGUAGE_OF.values(), *(x for _, x in L.SPECIAL_NAMES), "unknown"}
    assert {r["language"] for r in rows if not r["code"]} == {*L.NOT_CODE, "unknown"}
    assert {c for r in rows for c in r["category"].split(", ")} == {*L.CATEGORIES, "General"}
    of = {r["path"]: (r["language"], r["category"]) for r in rows}
    assert of["src/p0.js"] == ("javascript", "Web Frontend") and ("python", "Web Backend, Data/ML") in of.values()
    assert any(p.endswith("/DOCKERFILE.DEV") and x == ("dockerfile", "DevOps") for p, x in of.items())
    assert any(p.endswith("/noext") and x == ("unknown", "General") for p, x in of.items())
