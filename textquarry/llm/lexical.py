"""Ranked lexical search by a two-level quantised index.

The index is built once for all documents and serves any queries:

1. `statistics`: one pass over the bytes counts the documents with terms and all their terms.
2. `build`: tasks gather texts into shards of about SHARD bytes and write, for each term of a shard, a row with the places
   of its documents (upper level: the term's impact on each of them as one byte, rounded up), and its occurrences (lower
   level). Nothing is shuffled, and memory is that of a shard (a shard has one text at least).
3. `search`: the queries' terms are looked up in all shards, and their counts of documents give the weights. Shard by
   shard the bytes alone give each document an upper and a lower bound of its score; a document whose upper bound
   reaches the query's k-th best score or lower bound so far is rescored exactly from its occurrences, and the best k of
   what tasks report are the answer. What a task keeps of a query from shard to shard is k numbers.

A query's score is a sum of w * impact over its terms, where impact = (10**9 * tf) div (1000 * tf + 20 * m) lies below
10**6. A byte b says that the impact is above (b - 1) * STEP and at most b * STEP.

Cases: null and empty texts and texts without terms are no documents of the statistics and are never found; rows with a
null doc_id take no part; rows that share a doc_id are documents of their own, and of those with equal scores the order
is open; queries without terms, and those with a null item_id, give no rows; queries that share an item_id are one with
the terms of all; an empty table gives no rows; other columns are ignored. Numbers beyond 64 bits are an error.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import spread, stage, table

TERMS = re.compile(rb"[0-9a-z\x80-\xff]+")
_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Bytes of text in a shard.
SHARD = 8 << 20
#: An impact lies below TOP; STEP of it are one unit of the upper level.
TOP, STEP = 1_000_000, 3922
#: Distinct terms of the queries that are looked up at a time.
BLOCK_TERMS = 200_000
POSTINGS = "shard long, term string, df long, places binary, impacts binary, occurrences binary"


def statistics(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms of all documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            for _, _, buf, offs in K.chunks(batch.column(0)):
                size = _sizes(buf, offs)
                n, total = n + int((size > 0).sum()), total + int(size.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])

    found = docs.where("doc_id IS NOT NULL").select("text").mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return found[0] or 0, found[1] or 0


def _sizes(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Terms of each text."""
    solid = np.zeros(len(buf) + 1, bool)
    solid[:-1] = _TERM[buf]
    before = np.concatenate(([False], solid[:-1]))
    before[offs[:-1]] = False
    return K.per_text((solid & ~before)[:-1].astype(np.int64), offs)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def lengths_weight(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of documents of n terms."""
    if int(n.max(initial=0)) * documents * 50 >= 2**62:
        raise ValueError("50 * n * N of these documents doesn't fit 64 bits")
    return 100 - 50 + (50 * n * documents) // total


def build(docs: DataFrame, shard_bytes: int | None = None) -> tuple[DataFrame, int, int]:
    """(index, documents, terms): the index has POSTINGS, and for each shard a row with a null term whose places are the
    documents' identifiers and whose occurrences are their m."""
    documents, total = statistics(docs)
    size = shard_bytes or SHARD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, ids, n = TaskContext.get().partitionId(), 0, 0, [], []
        terms: list[bytes] = []
        counts: list[int] = []
        distinct: list[int] = []

        def out() -> Iterator[pa.RecordBatch]:
            shard = part << 32 | seq
            m = lengths_weight(np.array(n, np.int64), documents, total)
            places, tf = np.repeat(np.arange(len(ids)), distinct), np.array(counts, np.int64)
            names = sorted(set(terms))
            number = {t: k for k, t in enumerate(names)}
            of = np.fromiter(map(number.__getitem__, terms), np.int64, len(terms))
            order = np.argsort(of, kind="stable")
            places, tf = places[order], tf[order]
            high = -(-impact(tf, m[places]) // STEP)
            cut = np.searchsorted(of[order], np.arange(len(names) + 1))
            raw = [x.tobytes() for x in (places.astype("<u4"), high.astype("<u1"), tf.astype("<u4"))]
            for lo in range(0, len(names), 5000):
                some = range(lo, min(lo + 5000, len(names)))
                sides = [pa.array([x[w * cut[k] : w * cut[k + 1]] for k in some], pa.binary()) for x, w in zip(raw, (4, 1, 4), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), shard)), pa.array([names[k].decode() for k in some]), pa.array(np.diff(cut)[lo : lo + len(some)]), *sides], ["shard", "term", "df", "places", "impacts", "occurrences"])
            own = [pa.array([x.tobytes()], pa.binary()) for x in (np.array(ids, "<i8"), np.zeros(0), m.astype("<i8"))]
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.nulls(1, pa.string()), pa.array([len(ids)]), *own], ["shard", "term", "df", "places", "impacts", "occurrences"])

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for lo, hi, buf, offs in K.chunks(batch.column(1)):
                raw = K.lower(buf).tobytes()
                for d in range(hi - lo):
                    found = TERMS.findall(raw[offs[d] : offs[d + 1]])
                    if not found:
                        continue
                    own = Counter(found)
                    ids.append(doc_ids[lo + d])
                    n.append(len(found))
                    distinct.append(len(own))
                    terms += own.keys()
                    counts += own.values()
                    held += int(offs[d + 1] - offs[d])
                    if held >= size:
                        yield from out()
                        seq, held = seq + 1, 0
                        for x in (ids, n, terms, counts, distinct):
                            x.clear()
        if ids:
            yield from out()

    given = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stage(given.mapInArrow(run, POSTINGS), "lexical-index"), documents, total


def terms_of(queries: DataFrame) -> DataFrame:
    """Distinct (item_id, term)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, buf, offs in K.chunks(batch.column(1)):
                raw = K.lower(buf).tobytes()
                for d in range(hi - lo):
                    found = sorted(set(TERMS.findall(raw[offs[d] : offs[d + 1]])))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([ids[lo + d]] * len(found), pa.int64()), pa.array([t.decode() for t in found])], ["item_id", "term"])

    return queries.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, term string").distinct()


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Shard:
    """The wanted terms of one shard: per term its places and bounds, and what exact scores need."""

    def __init__(self, weights: dict[str, int]) -> None:
        self.weights, self.terms = weights, {}
        self.ids = self.m = np.zeros(0, np.int64)

    def add(self, term: str | None, places: bytes, impacts: bytes, occurrences: bytes) -> None:
        if term is None:
            self.ids, self.m = np.frombuffer(places, "<i8"), np.frombuffer(occurrences, "<i8")
            return
        w, high = self.weights[term], np.frombuffer(impacts, np.uint8).astype(np.int64)
        self.terms[term] = (np.frombuffer(places, "<u4"), w * (high * STEP), w * np.maximum((high - 1) * STEP + (high > 0), 0), w, np.frombuffer(occurrences, "<u4"))

    def bounds(self, terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all documents' scores, from the bytes alone."""
        low, high = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), np.int64)
        for t in terms:
            places, up, down, _, _ = self.terms[t]
            high[places] += up
            low[places] += down
        return low, high

    def exact(self, terms: list[str], which: np.ndarray) -> np.ndarray:
        """Scores of the documents at places `which`, ascending."""
        score = np.zeros(len(which), np.int64)
        for t in terms:
            places, _, _, w, tf = self.terms[t]
            at = np.minimum(np.searchsorted(places, which), len(places) - 1)
            hit = places[at] == which
            score[hit] += w * impact(tf[at[hit]].astype(np.int64), self.m[which[hit]])
        return score


def _best(found: np.ndarray, k: int) -> np.ndarray:
    return found if len(found) <= k else np.partition(found, len(found) - k)[-k:]


def search(index: tuple[DataFrame, int, int], queries: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: of each query the k documents of highest score above 0; index as build() gives it.

    Queries are taken in blocks of about BLOCK_TERMS terms (a query is never split), whose terms are broadcast.
    """
    postings, documents, _ = index
    spark = postings.sparkSession
    asked = stage(terms_of(queries), "query-terms", narrow=True)
    blocks = max(1, -(-asked.count() // BLOCK_TERMS))
    dealt = asked.withColumn("_block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    every = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for b in range(blocks if documents else 0):
        every = every.unionByName(_search_block(postings, documents, dealt.where(F.col("_block") == b).select("item_id", "term"), k))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _search_block(postings: DataFrame, documents: int, asked: DataFrame, k: int) -> DataFrame:
    """(item_id, doc_id, score) of documents that can be among the best k of a query."""
    spark = postings.sparkSession
    wanted = postings.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    df = {r["term"]: r["df"] for r in wanted.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # a block's terms at most
    weights = {t: weight(n, documents) for t, n in df.items()}
    items: dict[int, list[str]] = {}
    for r in asked.collect():
        if r["term"] in weights:
            items.setdefault(r["item_id"], []).append(r["term"])
    shared = spark.sparkContext.broadcast((weights, items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, items = shared.value
        best: dict[int, np.ndarray] = {}

        def out(shard: Shard) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            for item, terms in items.items():
                own = [t for t in terms if t in shard.terms]
                if not own:
                    continue
                low, high = shard.bounds(own)
                before = best.get(item, np.zeros(0, np.int64))
                sure = _best(np.concatenate((before, _best(low[low > 0], k))), k)
                at = np.flatnonzero(high >= max(1, int(sure.min()) if len(sure) == k else 1))
                if not len(at):
                    continue
                score = shard.exact(own, at)
                best[item] = _best(np.concatenate((before, score[score > 0])), k)
                keep = score >= max(1, int(best[item].min()) if len(best[item]) == k else 1)
                rows.append((np.full(int(keep.sum()), item), shard.ids[at[keep]], score[keep]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[c] for r in rows])) for c in range(3)], ["item_id", "doc_id", "score"])

        of, shard = None, None
        for batch in batches:
            for number, *row in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if number != of:
                    if shard:
                        yield from out(shard)
                    of, shard = number, Shard(weights)
                shard.add(*row)
        if shard:
            yield from out(shard)

    rows = wanted.unionByName(postings.where("term IS NULL")).select("shard", "term", "places", "impacts", "occurrences")
    dealt = rows.repartition(spread(spark), "shard").sortWithinPartitions("shard")
    return stage(dealt.mapInArrow(run, "item_id long, doc_id long, score long"), "found", narrow=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM documents WHERE doc_id IS NOT NULL),
tfs AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY ALL),
lens AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id),
stats AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM lens),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, stats GROUP BY term, docs),
m AS (SELECT doc_id, 100 - 50 + (50 * n * docs) // total AS m FROM lens, stats),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN tfs USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50"""
