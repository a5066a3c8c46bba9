"""Resampling of documents towards a target text, by hashed n-gram importance.

1. `buckets`: one scan of each text. A ring keeps the running CRC-32 states of the last n starts; each word extends every
   state by a space and itself and opens a new one, so a run of words is hashed without being put together. The
   remainders are the features' buckets; of each text its distinct buckets and their counts are staged.
2. `totals`: counts of each bucket over all documents and over all target texts: `width` numbers each, added up by tasks.
3. A bucket's gain is the scaled logarithm of its smoothed share in the target over that in the documents; a document's
   weight is the sum of its features' gains, read from the staged counts.
4. Gumbel noise from a hash of the identifier is added, and of the documents with enough words the highest scores are
   drawn. They are ranked by a range partitioning and the counts of its parts, never in one task.

Cases: null and empty texts have no features and weight 0; a null doc_id counts in the totals but has no score and is
never drawn; rows that share a doc_id have the same noise and are drawn each by itself, equal scores and identifiers in
order of n_features; an empty table gives no rows; empty target texts leave all gains to the smoothing; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import spread, stage, table

#: Words of lower-cased UTF-8: digits, letters and all that isn't ASCII.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Features that are held before they are folded into counts, so a very long text takes bounded memory.
FOLD = 1 << 20
FEATURES = "doc_id long, n_words long, n_features long, slots binary, counts binary"


def ring(text: bytes, n: int) -> Iterator[list[int]]:
    """For each word of a lower-cased text the CRC-32 of the runs of 1 to n words that end with it, shortest first."""
    states: list[int] = []
    for found in WORDS.finditer(text):
        word = found[0]
        longer = b" " + word
        states = [crc32(word), *(crc32(longer, s) for s in states[: n - 1])]
        yield states


def folded(text: bytes, n: int, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(words, distinct buckets, their counts) of a lower-cased text."""
    words, held, slots, counts = 0, [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    for states in ring(text, n):
        words += 1
        held += states
        if len(held) >= FOLD:
            slots, counts = _added(slots, counts, held, width)
            held = []
    return words, *_added(slots, counts, held, width)


def _added(slots: np.ndarray, counts: np.ndarray, crcs: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts with those of more features."""
    found, at = np.unique(np.concatenate((slots, np.array(crcs, np.int64) % width)), return_inverse=True)
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, at[: len(slots)], counts)
    return found, sums + np.bincount(at[len(slots) :], minlength=len(found))


def buckets(texts: DataFrame, n: int = 1, width: int = 10_000) -> DataFrame:
    """FEATURES of (doc_id, text): distinct buckets and counts as little-endian arrays of _kind(width) and of u8."""
    kind = _kind(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in K.chunks(batch.column(1)):
                raw, out = K.lower(buf).tobytes(), []
                for d in range(hi - lo):
                    words, slots, counts = folded(raw[offs[d] : offs[d + 1]], n, width)
                    out.append((words, int(counts.sum()), slots.astype(kind).tobytes(), _packed(counts)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary())))], ["doc_id", "n_words", "n_features", "slots", "counts"])

    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FEATURES)


def _kind(width: int) -> str:
    return "<u2" if width <= 1 << 16 else "<u4"


def _packed(counts: np.ndarray) -> bytes:
    """Counts as bytes, or as 8 bytes each where one is beyond a byte; the length tells which."""
    return counts.astype("<u1" if counts.max(initial=0) < 256 else "<i8").tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u1" if len(raw) == n else "<i8").astype(np.int64)


def totals(features: DataFrame, width: int) -> np.ndarray:
    """Count of each bucket over all texts: `width` numbers, whatever the input's size."""
    kind = _kind(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for slots, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = np.frombuffer(slots, kind)
                total[at] += _unpacked(counts, len(at))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    found = features.select("slots", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(width, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of a bucket's smoothed share in the target over that in the source), in doubles."""
    width, s_all, t_all = len(source), float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((target[b] + 1.0) * s_all / ((source[b] + 1.0) * t_all))) for b in range(width)], np.int64)


def noise(doc_id: int, seed: str) -> int:
    """floor(1000 * a Gumbel draw) from the first 32 bits of a SHA-256 of seed and identifier."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(features: DataFrame, gain: np.ndarray, seed: str) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of FEATURES."""
    kind, shared = _kind(len(gain)), features.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = []
            for slots, counts in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                at = np.frombuffer(slots, kind)
                weights.append(int((shared.value[at] * _unpacked(counts, len(at))).sum()))
            score = [None if k is None else w + noise(k, seed) for k, w in zip(batch.column(0).to_pylist(), weights, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weights, pa.int64()), pa.array(score, pa.int64())], ["doc_id", "n_words", "n_features", "weight", "score"])

    return features.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, n: int = 1, width: int = 10_000, percent: int = 10, min_words: int = 20, seed: str = "2024") -> DataFrame:
    """Per document: doc_id, n_words, n_features, weight, score, rank (null if not drawn).

    docs: doc_id, text; target: text. Of the documents with min_words words `percent` in 100 are drawn, rounded down.
    """
    spark = docs.sparkSession
    features = stage(buckets(docs, n, width), "bucket-counts")
    wanted = stage(buckets(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n, width), "target-counts", narrow=True)
    gain = gains(totals(features, width), totals(wanted, width))
    every = scored(features, gain, seed).withColumn("_fit", F.col("score").isNotNull() & (F.col("n_words") >= min_words))
    ordered = every.where("_fit").repartitionByRange(spread(spark), F.desc("score"), F.col("doc_id"), F.col("n_features")).sortWithinPartitions(F.desc("score"), "doc_id", "n_features")
    ordered = stage(ordered.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    sizes = ordered.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()  # a row a partition
    drawn = percent * sum(r["n"] for r in sizes) // 100
    base, before = [], 0
    for r in sizes:
        base.append((r["_part"], before))
        before += r["n"]
    first = spark.createDataFrame(base, "_part long, _before long")
    at = F.col("_before") + F.col("_at").bitwiseAND(F.lit(2**33 - 1)) + 1
    ranked = ordered.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(first), "_part").withColumn("rank", F.when(at <= drawn, at))
    names = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(*names).unionByName(every.where("NOT _fit").withColumn("rank", F.lit(None).cast("long")).select(*names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")
