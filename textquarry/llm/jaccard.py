"""Exact n-gram Jaccard join with set-relation skipping, reported as the classes that its links form.

A text's set is its distinct 5-word shingles (64-bit hashes). The steps:

1. `sets`: size, fingerprint, min-hashes and a 128-cell histogram of each set, and the shingles that are frequent within
   any COUNTED shingles in a row, with their counts. Texts with equal fingerprints are one node.
2. Star links: in each min-hash bucket every node is compared with the bucket's pivot only. These are verified links.
   They give classes of highly similar sets, and each linked set keeps its difference from its pivot.
3. The index: rare-first prefixes (order: frequency class, then hash) give inverted lists, with one entry a class, not
   a set. Lists of one class are dropped as they stream by. The entries of the others meet their class's box (the least
   and most of each histogram cell over its members); long lists are dealt over tasks by pairs of slices. In a task a
   list is ordered by size and cut into blocks, and a pair of blocks is skipped where the sizes or positions of the
   blocks rule every pair out; pairs of entries that the boxes rule out don't leave the task.
4. Of a candidate pair of classes, pairs of members that the histogram bound admits are asked for, the nearest first; if
   they link, the classes are one and their other pairs need no answer.
5. A set's answers are derived from its pivot's: for a set z the overlap with the pivot P is computed once, and that of
   a set of P's star is |P & z| - |(P - a) & z| + |(a - P) & z|, which touches the differing shingles only.

No pair is lost: equal sets aside, a link needs a common prefix shingle (step 3), compatible sizes and positions, and a
histogram distance of at most (|x|+|y|)/9, all of which are necessary conditions of 100*|x&y| >= 80*|x|y|.

Cases: null and empty texts and texts without words have an empty set and link with nothing; a null doc_id gets a
null component and links with nothing; repeated rows get equal results; rows that share a doc_id with other texts are
judged by their own text, but two sets whose smallest doc_id is the same are one node; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import SLICE_ROWS, hot_keys, salted_join, spread, stage, table
from .components import components

CELLS = 128
#: Cells of the table of frequency classes.
BUCKETS = 1 << 21
#: Shingles that are counted together; those that occur FREQUENT times among them are frequent.
COUNTED = 4_000_000
FREQUENT = 3
MINHASHES = 4
BLOCK = 64
#: A side of at most so many rows of a few integers is broadcast after it has been counted; beyond that it is shuffled.
BROADCAST_ROWS = 100_000
#: Rows of postings that are combined before they are shuffled.
COMBINE = 1_000_000
#: Entries of one list that are compared by one task; a longer list is dealt over pairs of slices.
LIST_ROWS = 512
#: Lists of shingles of this frequency class (1,024 occurrences within COUNTED) or more are dealt over HOT_SLICES while they are sifted.
HOT_CLASS, HOT_SLICES = 21, 64
#: Sets that are compared with one text by one task.
ANSWERS = 128
SETS = "doc_id long, n_shingles long, fp binary, mins array<long>, hist binary, frequent array<long>, counts array<long>"
_SEEDS = np.random.default_rng(11).integers(1, 2**63, MINHASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _percent(threshold: float) -> int:
    return round(100 * threshold)


def sets(docs: DataFrame, n: int = 5) -> DataFrame:
    """A row of SETS for each document, and rows without doc_id that hold frequent shingles and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary()), ("mins", pa.list_(pa.int64())), ("hist", pa.binary()), ("frequent", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
        held: list[np.ndarray] = []

        def counted() -> Iterator[pa.RecordBatch]:
            which, count = np.unique(np.concatenate(held), return_counts=True)
            which, count = which[count >= FREQUENT].view(np.int64), count[count >= FREQUENT]
            if len(which):
                cuts = [slice(k, k + 50_000) for k in range(0, len(which), 50_000)]
                none = [pa.nulls(len(cuts), f.type) for f in list(schema)[:5]]
                yield pa.RecordBatch.from_arrays([*none, pa.array([which[c] for c in cuts], pa.list_(pa.int64())), pa.array([count[c] for c in cuts], pa.list_(pa.int64()))], schema=schema)

        for batch in batches:
            for lo, hi, buf, offs in K.chunks(batch.column(1)):
                sh, first = K.shingles(buf, offs, n)
                size, rows = np.diff(first), hi - lo
                held.append(sh)
                if sum(map(len, held)) >= COUNTED:
                    yield from counted()
                    held.clear()
                doc = np.repeat(np.arange(rows), size)
                full = size > 0
                mins, prints = np.zeros((rows, MINHASHES), np.int64), np.zeros((rows, 2), np.uint64)
                if full.any():
                    at = first[:-1][full]
                    for k, seed in enumerate(_SEEDS):
                        mins[full, k] = np.minimum.reduceat(K.mix(sh * seed), at).view(np.int64)
                    for k in range(2):
                        prints[full, k] = np.add.reduceat(K.mix(sh + np.uint64(0x9E3779B97F4A7C15 * (k + 3) & (2**64 - 1))), at)
                hist = np.bincount(doc * CELLS + (sh >> np.uint64(57)).astype(np.int64), minlength=rows * CELLS).reshape(rows, CELLS)
                hist = np.minimum(hist, 255).astype(np.uint8)
                raw, cells = prints.tobytes(), hist.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, rows), pa.array(size), pa.array([raw[16 * d : 16 * d + 16] for d in range(rows)], pa.binary()), pa.array(list(mins), pa.list_(pa.int64())), pa.array([cells[CELLS * d : CELLS * (d + 1)] for d in range(rows)], pa.binary()), pa.nulls(rows, pa.list_(pa.int64())), pa.nulls(rows, pa.list_(pa.int64()))],
                    schema=schema,
                )
        if held:
            yield from counted()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SETS)


def frequency_classes(made: DataFrame) -> np.ndarray:
    """For each of BUCKETS cells a class from 0 (nothing frequent) to 63 that grows with the count of its most frequent shingle.

    The result has BUCKETS bytes and the driver gets BUCKETS rows at most, whatever the input's size.
    """
    each = made.where("frequent IS NOT NULL").select(F.inline(F.arrays_zip(F.col("frequent").alias("s"), F.col("counts").alias("n"))))
    cells = each.groupBy("s").agg(F.sum("n").alias("n")).groupBy(F.col("s").bitwiseAND(F.lit(BUCKETS - 1)).alias("cell")).agg(F.max("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.uint8)
    out[cells["cell"].to_numpy()] = np.minimum(63, 1 + 2 * np.log2(cells["n"].to_numpy().astype(np.float64)))
    return out


def histograms_admit(h1: np.ndarray, n1: np.ndarray, h2: np.ndarray, n2: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the distance of histograms leaves room for a link, and the distance (a lower bound of |x ^ y|)."""
    far = np.abs(h1.astype(np.int16) - h2.astype(np.int16)).sum(-1, dtype=np.int64)
    return far * (100 + percent) <= (n1 + n2) * (100 - percent), far


def _stars(nodes: DataFrame, percent: int) -> DataFrame:
    """(a, p): in each min-hash bucket, each node with the bucket's pivot, where sizes and histograms admit a link."""
    entry = lambda k: F.struct((F.col("node") if k % 2 == 0 else F.xxhash64("node", F.lit(k))).alias("o"), "node", "n", "hist")
    every = nodes.select("node", "n", "hist", F.explode(F.array(*[F.struct(F.xxhash64(F.lit(k), F.col("mins")[k]).alias("bucket"), entry(k).alias("e")) for k in range(MINHASHES)])).alias("x")).select("x.bucket", "x.e")
    every = stage(every, "star-entries", narrow=True)
    pivots = every.groupBy("bucket").agg(F.min("e").alias("p"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    met = salted_join(every, pivots, "bucket", ["e.node"]).where("e.node <> p.node AND least(e.n, p.n) * 100 >= greatest(e.n, p.n) * %d" % percent)
    met = met.select(F.col("e.node").alias("a"), F.col("p.node").alias("p"), F.col("e.n").alias("n1"), F.col("p.n").alias("n2"), F.col("e.hist").alias("h1"), F.col("p.hist").alias("h2"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n1, n2 = (b.column(k).to_numpy() for k in (2, 3))
                h1, h2 = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, CELLS) for k in (4, 5))
                ok, _ = histograms_admit(h1, n1, h2, n2, percent)
                yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(ok)) for k in (0, 1)], ["a", "p"])

    return met.mapInArrow(near, "a long, p long").distinct()


def sized_join(docs: DataFrame, small: DataFrame, rows: int) -> DataFrame:
    """docs with small on doc_id: small is broadcast if it has been counted and is small, else both are shuffled."""
    return docs.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small.hint("merge"), "doc_id")


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """|x & y| of ascending arrays without repeats."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if not len(small):
        return 0
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return int((large[at] == small).sum())


def _linked(n1: int, n2: int, both: int, percent: int) -> bool:
    return both > 0 and 100 * both >= percent * (n1 + n2 - both)


def _with_texts(need: DataFrame, docs: DataFrame, more: DataFrame | None, n: int) -> DataFrame:
    """(z, slice, pivot, role, a, minus, plus, text), the rows of a slice together and in order of pivot and role."""
    need = stage(need, "needed-texts", narrow=True)
    texts = sized_join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), need, need.count())
    none = F.lit(None).cast("binary")
    ready = texts.select("z", "slice", "pivot", "role", F.col("doc_id").alias("a"), none.alias("minus"), none.alias("plus"), "text")
    if more is not None:
        ready = ready.unionByName(more.select("z", "slice", "pivot", F.lit(2).alias("role"), "a", "minus", "plus", F.lit(None).cast("string").alias("text")))
    return ready.repartition(spread(docs.sparkSession), "z", "slice").sortWithinPartitions("z", "slice", "pivot", "role")


def _dealt(pairs: DataFrame) -> DataFrame:
    """pairs (a, z) with slice: the a's of a z that has many go over slices of about ANSWERS."""
    slices = F.broadcast(hot_keys(pairs, "z", ANSWERS))
    return pairs.join(slices, "z", "left").withColumn("slice", F.when(F.col("_slices").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("a"), F.col("_slices"))).cast("long")).drop("_slices")


def star_links(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b, minus, plus): the linked ones of pairs (a, p), and the shingles by which a differs from b = p.

    Texts of the a's of one p come in slices, each with p's text once at its head.
    """
    dealt = _dealt(pairs.select("a", F.col("p").alias("z")))
    none = F.lit(None).cast("long")
    need = dealt.select(F.col("a").alias("doc_id"), "z", "slice", none.alias("pivot"), F.lit(1).alias("role")).union(dealt.select(F.col("z").alias("doc_id"), "z", "slice", none, F.lit(0)).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict = {}
        of = None
        for batch in batches:
            zs, slice_, role, ids = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
            out = []
            for lo, hi, buf, offs in K.chunks(batch.column(7)):
                sh, first = K.shingles(buf, offs, n)
                for d in range(hi - lo):
                    r, x = lo + d, sh[first[d] : first[d + 1]]
                    if of != (zs[r], slice_[r]):
                        of, heads = (zs[r], slice_[r]), {}
                    if role[r] == 0:
                        heads[x.tobytes()] = x  # one text as a rule
                        continue
                    for y in heads.values():
                        if _linked(len(x), len(y), _overlap(x, y), percent):
                            out.append((ids[r], zs[r], np.setdiff1d(y, x, True).tobytes(), np.setdiff1d(x, y, True).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["a", "b", "minus", "plus"])

    return stage(_with_texts(need, docs, None, n).mapInArrow(run, "a long, b long, minus binary, plus binary"), "links")


def answers(pairs: DataFrame, stars: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): the linked ones of pairs (a, p). An a of a star gets its answer from its pivot's; see the module's step 5.

    stars: (a, pivot, minus, plus), one row an a.
    """
    empty = F.lit(b"").cast("binary")
    asked = salted_join(pairs.select("a", F.col("p").alias("z")), stars, "a", ["z"], "left")
    asked = asked.select("a", "z", F.coalesce("pivot", "a").alias("pivot"), F.coalesce("minus", empty).alias("minus"), F.coalesce("plus", empty).alias("plus"))
    dealt = stage(_dealt(asked), "asked", narrow=True)
    need = dealt.select(F.col("z").alias("doc_id"), "z", "slice", F.lit(None).cast("long").alias("pivot"), F.lit(0).alias("role")).union(dealt.select("pivot", "z", "slice", "pivot", F.lit(1))).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pivot = None
        heads: dict = {}
        known: dict = {}  # of the pivot's text: size and overlap with each text of z
        for batch in batches:
            zs, slice_, pivots, role, ids, minus, plus = (batch.column(k).to_pylist() for k in range(7))
            out = []
            for lo, hi, buf, offs in K.chunks(batch.column(7)):
                sh, first = K.shingles(buf, offs, n)
                for d in range(hi - lo):
                    r = lo + d
                    if of != (zs[r], slice_[r]):
                        of, pivot, heads, known = (zs[r], slice_[r]), None, {}, {}
                    x = sh[first[d] : first[d + 1]]
                    if role[r] == 0:
                        heads[x.tobytes()] = x
                        continue
                    if pivot != pivots[r]:
                        pivot, known = pivots[r], {}
                    if role[r] == 1:
                        known[x.tobytes()] = [(y, len(x), _overlap(x, y)) for y in heads.values()]
                        continue
                    less, more = (np.frombuffer(v[r], np.uint64) for v in (minus, plus))
                    for y, size, both in (v for found in known.values() for v in found):
                        if _linked(size - len(less) + len(more), len(y), both - _overlap(less, y) + _overlap(more, y), percent):
                            out.append((ids[r], zs[r]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return stage(_with_texts(need, docs, dealt, n).mapInArrow(run, "a long, b long").distinct(), "links")


def postings(docs: DataFrame, classes_of: DataFrame, rows: int, order: np.ndarray, n: int, percent: int) -> DataFrame:
    """(token, class, n_lo, n_hi, head, tail) of the prefixes, combined over the sets of a class as far as a task sees them.

    head and tail are the most shingles of a set of the class before and after the token.
    """
    shared = docs.sparkSession.sparkContext.broadcast(order)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    side = F.broadcast(classes_of) if rows <= BROADCAST_ROWS else classes_of.hint("merge")
    given = given.join(side, "doc_id", "left").select(F.coalesce("class", "doc_id").alias("class"), "text")
    schema = "token long, class long, n_lo long, n_hi long, head long, tail long"

    def combined(parts: list[np.ndarray]) -> pa.RecordBatch:
        token, cls, size, pos = (np.concatenate([p[k] for p in parts]) for k in range(4))
        o = np.lexsort((cls, token))
        token, cls, size, pos = token[o], cls[o], size[o], pos[o]
        at = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1]))))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (token[at], cls[at], np.minimum.reduceat(size, at), np.maximum.reduceat(size, at), np.maximum.reduceat(pos, at), np.maximum.reduceat(size - 1 - pos, at))], ["token", "class", "n_lo", "n_hi", "head", "tail"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, parts, held = shared.value, [], 0
        for batch in batches:
            cls = batch.column(0).to_numpy()
            for lo, hi, buf, offs in K.chunks(batch.column(1)):
                sh, first = K.shingles(buf, offs, n)
                key = (rank[(sh & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(57)) | (sh >> np.uint64(7))
                cut = []
                for d in range(hi - lo):
                    x = np.sort(key[first[d] : first[d + 1]])
                    cut.append(x[: len(x) - (percent * len(x) + 99) // 100 + 1] if len(x) else x)
                p = np.array([len(x) for x in cut])
                if p.sum():
                    parts.append((np.concatenate(cut).astype(np.int64), np.repeat(cls[lo:hi], p), np.repeat(np.diff(first), p), np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)))
                    held += int(p.sum())
                if held >= COMBINE:
                    yield combined(parts)
                    parts, held = [], 0
        if held:
            yield combined(parts)

    return given.mapInArrow(run, schema)


def lists(index: DataFrame) -> DataFrame:
    """The rows of postings, one for each token and class, of lists that have several classes; memory is that of a batch.

    Lists of frequent tokens are dealt over slices by class and kept without a look at their classes.
    """
    hot = F.shiftright("token", 57) >= HOT_CLASS
    dealt = index.withColumn("_s", F.when(hot, F.pmod(F.xxhash64("class"), F.lit(HOT_SLICES))).otherwise(F.lit(0)).cast("int"))
    dealt = dealt.repartition(spread(index.sparkSession), "token", "_s").sortWithinPartitions("token", "class").drop("_s")
    names = ["token", "class", "n_lo", "n_hi", "head", "tail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 6
        opened = None  # the token of rest, if other classes of its list are out already

        def out(cols: list[np.ndarray], keep: np.ndarray) -> Iterator[pa.RecordBatch]:
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            token, cls, lo, hi, head, tail = (np.concatenate((r, c.to_numpy())) for r, c in zip(rest, batch.columns, strict=True))
            at = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1]))))
            cols = [token[at], cls[at], np.minimum.reduceat(lo, at), *(np.maximum.reduceat(x, at) for x in (hi, head, tail))]
            token = cols[0]
            start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            size = np.diff(np.concatenate((start, [len(token)])))
            keep = np.repeat((size > 1) | (token[start] >> 57 >= HOT_CLASS) | (token[start] == opened), size)
            last = np.zeros(len(token), bool)
            last[-1] = True
            opened = token[-1] if keep[-1] else None
            yield from out(cols, keep & ~last)
            rest = [c[-1:] for c in cols]
        if len(rest[0]):
            yield from out(rest, np.array([opened is not None or rest[0][0] >> 57 >= HOT_CLASS]))

    return dealt.mapInArrow(run, "token long, class long, n_lo long, n_hi long, head long, tail long")


def boxes(nodes: DataFrame) -> DataFrame:
    """(class, lo, hi): the least and the most of each histogram cell over a class's members."""

    def combined(cls: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        o = np.argsort(cls, kind="stable")
        cls, lo, hi = cls[o], lo[o], hi[o]
        at = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1])))
        return cls[at], np.minimum.reduceat(lo, at, axis=0), np.maximum.reduceat(hi, at, axis=0)

    def out(cls: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cls), *(pa.array([x.tobytes() for x in side], pa.binary()) for side in (lo, hi))], ["class", "lo", "hi"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                hist = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, CELLS)
                yield out(*combined(b.column(0).to_numpy(), hist, hist))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            if b.num_rows:
                new = (b.column(0).to_numpy(), *(np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, CELLS) for k in (1, 2)))
                cls, lo, hi = combined(*(np.concatenate(x) for x in zip(rest, new, strict=True))) if rest else combined(*new)
                if len(cls) > 1:
                    yield out(cls[:-1], lo[:-1], hi[:-1])
                rest = (cls[-1:], lo[-1:], hi[-1:])
        if rest:
            yield out(*rest)

    schema = "class long, lo binary, hi binary"
    return nodes.select("class", "hist").mapInArrow(partial, schema).repartition(spread(nodes.sparkSession), "class").sortWithinPartitions("class").mapInArrow(final, schema)


def candidate_classes(entries: DataFrame, box: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (c1 < c2) of classes that meet in a list and that neither the bounds of their blocks nor their boxes rule out."""
    long = stage(entries.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).cast("int").alias("_k")).where("_k > 1"), "long-lists", narrow=True)
    met = salted_join(entries, box, "class", ["token"])
    sliced = salted_join(met, long, "token", ["class"], "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("class"), F.col("_k")), F.lit(0)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_k"), F.lit(1)) - 1)).alias("other")
    names = ["token", "x", "y", "own", "class", "n_lo", "n_hi", "head", "tail", "lo", "hi"]
    every = sliced.select("*", other).withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
    dealt = every.select(*names).repartition(spread(entries.sparkSession), "token", "x", "y").sortWithinPartitions("token", "x", "y")

    def pairs_of(sides: np.ndarray, apart: bool, cls: np.ndarray, lo: np.ndarray, hi: np.ndarray, head: np.ndarray, tail: np.ndarray, least: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of one list, or of two of its slices if apart."""
        o = np.argsort(lo, kind="stable")
        sides, cls, lo, hi, head, tail, least, most = (x[o] for x in (sides, cls, lo, hi, head, tail, least, most))
        cuts = np.arange(0, len(cls), BLOCK)
        b_lo, b_hi, b_head, b_tail = (f.reduceat(x, cuts) for f, x in ((np.minimum, lo), (np.maximum, hi), (np.maximum, head), (np.maximum, tail)))
        for i in range(len(cuts)):
            meets = np.arange(i, len(cuts))
            j = meets[(100 * b_hi[i] >= percent * b_lo[meets]) & (100 * b_hi[meets] >= percent * b_lo[i]) & ((1 + np.minimum(b_head[i], b_head[meets]) + np.minimum(b_tail[i], b_tail[meets])) * (100 + percent) >= percent * (b_lo[i] + b_lo[meets]))]
            mine = np.arange(cuts[i], min(cuts[i] + BLOCK, len(cls)))
            for k in j:
                theirs = np.arange(cuts[k], min(cuts[k] + BLOCK, len(cls)))
                x, y = np.repeat(mine, len(theirs)), np.tile(theirs, len(mine))
                ok = (x < y) & (cls[x] != cls[y]) & (100 * hi[x] >= percent * lo[y]) & (100 * hi[y] >= percent * lo[x])
                ok &= (1 + np.minimum(head[x], head[y]) + np.minimum(tail[x], tail[y])) * (100 + percent) >= percent * (lo[x] + lo[y])
                if apart:
                    ok &= sides[x] != sides[y]
                x, y = x[ok], y[ok]
                gap = np.maximum(np.maximum(least[x] - most[y], least[y] - most[x]), 0).sum(1, dtype=np.int64)
                ok = gap * (100 + percent) <= (hi[x] + hi[y]) * (100 - percent)
                x, y = x[ok], y[ok]
                if len(x):
                    yield np.minimum(cls[x], cls[y]), np.maximum(cls[x], cls[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def groups(cols: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rest
            token, x, y = cols[:3]
            starts = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
            ends = np.concatenate((starts[1:], [len(token)]))
            if not last:
                rest = [c[starts[-1] :] for c in cols]
                starts, ends = starts[:-1], ends[:-1]
            found = [p for s, e in zip(starts, ends, strict=True) if e - s > 1 for p in pairs_of(cols[3][s:e], bool(x[s] != y[s]), *(c[s:e] for c in cols[4:]))]
            if found:
                u = np.unique(np.stack([np.concatenate([p[k] for p in found]) for k in (0, 1)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1])], ["c1", "c2"])

        for batch in batches:
            if batch.num_rows:
                cols = [c.to_numpy() for c in batch.columns[:9]] + [np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16) for c in batch.columns[9:]]
                cols = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols, strict=True)]
                yield from groups(cols, False)
        if rest is not None:
            yield from groups(rest, True)

    return dealt.mapInArrow(run, "c1 long, c2 long").distinct()


def member_pairs(cands: DataFrame, nodes: DataFrame, percent: int, chunk: int = 512) -> DataFrame:
    """(a, p, nearest): pairs of members of candidate classes that sizes and histograms admit; nearest: the first of a pair of chunks.

    Members travel in chunks, so a pair of classes is a few rows, and pairs of members exist only inside a task's arrays.
    """
    slots = nodes.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("long").alias("slots"))
    dealt = salted_join(nodes.select("class", "node", "n", "hist"), slots, "class", ["node"])
    packed = stage(dealt.groupBy("class", F.pmod(F.xxhash64("node"), F.col("slots")).alias("slot")).agg(F.collect_list(F.struct("node", "n", "hist")).alias("members")), "members")
    cands = cands.select(F.col("c1").alias("left_class"), F.col("c2").alias("right_class"))
    left = salted_join(cands, packed.select(F.col("class").alias("left_class"), F.col("members").alias("m1")), "left_class", ["right_class"])
    both = salted_join(stage(left, "candidates"), packed.select(F.col("class").alias("right_class"), F.col("members").alias("m2")), "right_class", ["left_class"])

    def side(column: pa.Array) -> list[tuple]:
        return [(np.array([x["node"] for x in m]), np.array([x["n"] for x in m]), np.frombuffer(b"".join(x["hist"] for x in m), np.uint8).reshape(-1, CELLS)) for m in column.to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, p, near = [], [], []
            for (x, nx, hx), (y, ny, hy) in zip(side(batch.column(0)), side(batch.column(1)), strict=True):
                start, gains = len(a), []
                for i in range(len(x)):
                    size_ok = 100 * np.minimum(nx[i], ny) >= percent * np.maximum(nx[i], ny)
                    ok, far = histograms_admit(hx[i], nx[i], hy, ny, percent)
                    at = np.flatnonzero(ok & size_ok)
                    a += [x[i]] * len(at)
                    p += y[at].tolist()
                    gains += (far[at] / (nx[i] + ny[at])).tolist()
                near += [False] * len(gains)
                if gains:
                    near[start + int(np.argmin(gains))] = True
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(p, pa.int64()), pa.array(near)], ["a", "p", "nearest"])

    return both.select("m1", "m2").mapInArrow(run, "a long, p long, nearest boolean")


def classes(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    percent = _percent(threshold)
    made = stage(sets(docs, n), "sets")
    rows = made.where("frequent IS NULL")
    nodes = stage(rows.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("fp").agg(F.min(F.struct("doc_id", F.col("n_shingles").alias("n"), "mins", "hist")).alias("x")).select("fp", F.col("x.doc_id").alias("node"), "x.n", "x.mins", "x.hist"), "nodes", narrow=True)
    stars = star_links(stage(_stars(nodes, percent), "pairs"), docs, n, percent)
    links = stars.select("a", "b")
    labels = stage(components(links), "labels", narrow=True)

    def labelled(labels: DataFrame) -> DataFrame:
        return nodes.join(labels, "node", "left").select("fp", "node", "n", "hist", F.coalesce("label", "node").alias("class"))

    known = stage(labelled(labels), "classes", narrow=True)
    fp_class = known.select("fp", "class")
    of_docs = salted_join(rows.where("doc_id IS NOT NULL AND n_shingles > 0").select("doc_id", "fp"), fp_class, "fp", ["doc_id"]).where("doc_id <> class").select("doc_id", "class").distinct()
    of_docs = stage(of_docs, "classes-of-documents", narrow=True)
    index = postings(docs, of_docs, of_docs.count(), frequency_classes(made), n, percent)
    cands = stage(candidate_classes(stage(lists(index), "lists"), stage(boxes(known), "boxes"), percent), "candidate-classes")
    rest = stage(member_pairs(cands, known, percent), "member-pairs")
    # a doc_id of several texts has no one difference from a pivot
    several = stage(rows.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("doc_id"), "shared-ids", narrow=True)
    one = stars if several.isEmpty() else stars.join(several.withColumnRenamed("doc_id", "a"), "a", "left_anti").join(several.withColumnRenamed("doc_id", "b"), "b", "left_anti")
    derived = stage(one.groupBy("a").agg(F.min(F.struct(F.col("b").alias("pivot"), "minus", "plus")).alias("x")).select("a", "x.*"), "stars")
    for step in (rest.where("nearest"), None):
        if step is None:
            # what the nearest pairs have joined needs no further answer
            of = known.select(F.col("node").alias("a"), F.col("class").alias("_1"))
            step = salted_join(rest.where("NOT nearest"), of, "a", ["p"])
            step = salted_join(step, of.select(F.col("a").alias("p"), F.col("_1").alias("_2")), "p", ["a"]).where("_1 <> _2")
        step = stage(step.select("a", "p").distinct(), "pairs", narrow=True)
        if step.isEmpty():
            continue
        more = answers(step, derived, docs, n, percent)
        if not more.isEmpty():
            links = links.union(more)
            known = stage(labelled(stage(components(links), "labels", narrow=True)), "classes", narrow=True)
    final = known.select("fp", "class")
    out = salted_join(rows.withColumn("fp", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("fp"))), final, "fp", ["doc_id"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("class", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
