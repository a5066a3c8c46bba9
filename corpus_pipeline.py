"""The corpus pipeline: quality rules, near-duplicate removal, pseudonyms, mixing to target weights, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns the columns of
documents, but for the last, which returns the packed pieces. Between stages the rows are written as Parquet to the
shared folder and read again. Rows with a null doc_id go through every stage on their own; texts are worked on whole,
however long; an empty table goes through to no pieces. Further columns come out of a stage as they went in, also those
that are named like a result of a stage: they have other names while a stage runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import jaccard, mixing, packing, pii, quality
from textquarry.llm.common import stage, table

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _columns_kept(step: Stage) -> Stage:
    """step with all columns but those of documents renamed while it runs."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in DOCUMENT else f"_given{k}" for k, c in enumerate(docs.columns)}
        out = step(spark, docs.toDF(*names.values()), sf_dir)
        given = {new: old for old, new in names.items()}
        return out.toDF(*[given.get(c, c) for c in out.columns])

    return run


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one of smallest doc_id stays, once.

    Rows that share a doc_id are one document: it goes if any of them is linked with a smaller doc_id, else it stays as
    its row of smallest text. Rows without a doc_id all stay.
    """
    found = stage(jaccard.classes(docs), "classes")
    gone = stage(found.where("doc_id <> component_id").select("doc_id").distinct(), "near-duplicates")
    left = docs.join(F.broadcast(gone) if gone.count() <= jaccard.BROADCAST_ROWS else gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    if found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return left
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = left.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(F.col("text"), whole.alias("row"))).alias("x")).select("x.row.*")
    return once.unionByName(left.where("doc_id IS NULL"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to pseudonyms; n_chars follows the new text."""
    return pii.pseudonymise(docs, pii.KEY).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(*docs.columns)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the raked probabilities draw stay."""
    return mixing.mix(docs).where("sampled").select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", _columns_kept(quality_rules)),
    ("n-gram Jaccard join", _columns_kept(near_duplicates)),
    ("pseudonyms", _columns_kept(pseudonyms)),
    ("mixing sources to target weights", _columns_kept(mixing_weights)),
    ("best-fit packing", _columns_kept(best_fit_packing)),
]

#: Training, set joins over hashes and tokenization have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name.replace(" ", "-"))
    return docs
