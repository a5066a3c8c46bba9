"""SimHash near-duplicates by vantage-point trees over fingerprints.

1. `fingerprints`: a text's fingerprint has a bit where over half of its shingles' 64-bit hashes have it.
2. Equal fingerprints are one node. The bits fall into PARTS parts; two nodes within `radius` are within radius // PARTS
   in one of them at least. (Over all 64 bits nearly all distances lie near 32, and most nodes near any boundary.)
3. For each part a tree of vantage points is grown from a bounded sample of the nodes: each inner vertex has a vantage
   point and the median distance from it in that part. Its leaves are the shards. Each node is a member of the shard that
   its distances lead to. By the triangle inequality the distances of two near nodes from any point differ by no more
   than they do from each other, so a node asks beyond a boundary only if it lies that near to it. It asks shards to the
   right of its own only, which finds every pair of a part once.
4. A task holds the members of a shard, or of a part of a large one, and streams what asks there past them. Within the
   task the members are a vantage-point tree too, down to groups of GROUP, where distances are computed. Of the linked
   pairs a task reports a spanning forest: at most a row a node, however many pairs a group of copies has.

Cases: null and empty texts and texts without words have fingerprint zero and link like any other; rows with a null
doc_id get a fingerprint and a null component and link with nothing; repeated rows get equal results; rows that share a
doc_id are judged each by its own text and share no link by the identifier alone; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import salted_join, spread, stage, table
from .components import components

#: Parts of the bits, each with a tree of its own.
PARTS = 3
#: Nodes from which the vantage points of shards are chosen, and the most vertices of that tree (16 bytes each).
SAMPLE, VERTICES = 1 << 18, 1 << 14
#: Members that a shard is planned for, members that a task holds at a time, and members that are compared without a tree.
SHARD, PART, GROUP = 4096, 16_384, 512
#: Distances that are computed at a time, and hashes whose bits are counted at a time.
PAIRS = 1 << 18
COUNTED = 1 << 16


def hashes(text: bytes, n: int) -> Iterator[np.ndarray]:
    """XXH64 with seed 42 of the n-word shingles of a lower-cased text, repeats included, COUNTED at a time."""
    words = text.split()  # on space and the ASCII controls 9 to 13
    if not words:
        return
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    if len(words) >= n:
        starts, ends = starts[: len(words) - n + 1], ends[n - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    for lo in range(0, len(starts), COUNTED):
        spans = map(slice, starts[lo : lo + COUNTED].tolist(), ends[lo : lo + COUNTED].tolist())
        yield np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), repeat(42)), np.uint64)


def fingerprint(text: bytes, n: int) -> int:
    """Bit b is 1 if it is set in over half of the shingles' hashes."""
    total, ones = 0, np.zeros(64, np.int64)
    for h in hashes(text, n):
        total += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > total).tolist())


def fingerprints(docs: DataFrame, n: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed integer of the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in K.chunks(batch.column(1)):
                raw = K.lower(buf).tobytes()
                fp = np.array([fingerprint(raw[offs[d] : offs[d + 1]], n) for d in range(hi - lo)], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def masks(parts: int) -> list[np.uint64]:
    """64 bits in parts of about equal size."""
    cuts = [64 * k // parts for k in range(parts + 1)]
    return [np.uint64((1 << hi) - (1 << lo)) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def distance(x: np.ndarray, y: np.ndarray, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((x ^ y) & mask).astype(np.int16)


class Tree:
    """Vertices in preorder: vantage point, median distance in the mask's bits, right child (0: a leaf), and a leaf's number."""

    def __init__(self, sample: np.ndarray, leaves: int, mask: np.uint64) -> None:
        self.mask, self.point, self.median, self.right, self.leaf, self.leaves = mask, [], [], [], [], 0
        self._grow(np.sort(sample), 1.5 * max(16, -(-len(sample) // max(1, leaves))))

    def _split(self, x: np.ndarray) -> tuple[np.uint64, int]:
        """Of a few points the one from which distances vary most, and the distance that halves the nodes best."""
        trial = x[:: max(1, len(x) // 8)][:8]
        v = max(trial, key=lambda t: float(distance(x, t, self.mask).std()))
        d = distance(x, v, self.mask)
        mid = int(np.median(d))
        return v, min((mid - 1, mid), key=lambda m: abs(float((d <= m).mean()) - 0.5))

    def _grow(self, x: np.ndarray, most: float) -> None:
        me = len(self.point)
        v, mid = self._split(x) if len(x) > most else (np.uint64(0), 0)
        left = distance(x, v, self.mask) <= mid
        for column, value in ((self.point, v), (self.median, mid), (self.right, 0), (self.leaf, -1)):
            column.append(value)
        if len(x) <= most or not left.any() or left.all():
            self.leaf[me] = self.leaves
            self.leaves += 1
            return
        self._grow(x[left], most)
        self.right[me] = len(self.point)
        self._grow(x[~left], most)

    def homes(self, x: np.ndarray, radius: int, member: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, rows of x, whether they are members) of all leaves. Members end in one leaf and ask to the right of it;
        rows that aren't members ask wherever a member within radius can be."""
        stack = [(0, np.arange(len(x)), np.ones(len(x), bool) if member is None else member)]
        while stack:
            k, rows, member = stack.pop()
            if not len(rows):
                continue
            if not self.right[k]:
                yield self.leaf[k], rows, member
                continue
            d, mid = distance(x[rows], self.point[k], self.mask), self.median[k]
            left = d <= mid
            go_left, go_right = np.where(member, left, d - radius <= mid), np.where(member & ~left, True, d + radius > mid)
            stack.append((k + 1, rows[go_left], member[go_left]))
            stack.append((self.right[k], rows[go_right], (member & ~left)[go_right]))


def roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = up


def join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Hooks the trees of a[i] and b[i] together, the larger root below the smaller."""
    while len(a):
        a, b = roots(parent, a), roots(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(parent, high, low)


def near(members: np.ndarray, asking: np.ndarray, parent: np.ndarray, radius: int, mask: np.uint64) -> None:
    """Joins in parent all members (its first entries) and askers (its next) that are near to a member."""
    every = np.concatenate((members, asking))
    tree = Tree(members, -(-len(members) // GROUP), mask)
    for _, rows, member in tree.homes(every, radius // PARTS, np.arange(len(every)) < len(members)):
        own = rows[member]
        step = max(1, PAIRS // max(1, len(own)))
        for lo in range(0, len(rows) if len(own) else 0, step):
            some = rows[lo : lo + step]
            i, j = np.nonzero(np.bitwise_count(every[some][:, None] ^ every[own][None]) <= radius)
            a, b = some[i], own[j]
            fresh = a != b
            join(parent, a[fresh], b[fresh])


def links(nodes: DataFrame, count: int, radius: int) -> DataFrame:
    """(a, b): links of nodes (node, fp), enough to connect all that pairs within radius connect."""
    spark = nodes.sparkSession
    leaves = min(VERTICES, -(-count // SHARD))
    sample = nodes.select("fp").orderBy(F.xxhash64("fp", F.lit(5)), "fp").limit(min(SAMPLE, 64 * leaves + 1024)).toArrow()["fp"].to_numpy()
    trees = [Tree(sample.astype(np.int64).view(np.uint64), leaves, mask) for mask in masks(PARTS)]
    shared = spark.sparkContext.broadcast(trees)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                node, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for k, tree in enumerate(shared.value):
                    for leaf, rows, member in tree.homes(fp.view(np.uint64), radius // PARTS):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), leaf * PARTS + k)), pa.array(~member), pa.array(node[rows]), pa.array(fp[rows])], ["shard", "asks", "node", "fp"])

    dealt = stage(nodes.select("node", "fp").mapInArrow(deal, "shard long, asks boolean, node long, fp long"), "shards", narrow=True)
    # a shard of more members than planned is cut into parts; each part meets what asks there, and the members of later parts
    parts = dealt.where("NOT asks").groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PART).cast("long").alias("parts")).where("parts > 1")
    cut = dealt.join(F.broadcast(parts), "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))  # a row a leaf at most
    own = F.pmod(F.xxhash64("node"), F.col("parts"))
    meets = F.when(F.col("asks"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), own))
    each = cut.withColumn("part", F.explode(meets)).withColumn("asks", F.col("asks") | (F.col("part") < own)).select("shard", "part", "asks", "node", "fp")
    each = each.repartition(spread(spark), "shard", "part").sortWithinPartitions("shard", "part", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        of = None
        members: list[tuple] = []

        def compared(asking: list[tuple]) -> Iterator[pa.RecordBatch]:
            m_node, m_fp = (np.concatenate([x[k] for x in members]) if members else np.zeros(0, np.int64) for k in (0, 1))
            a_node, a_fp = (np.concatenate([x[k] for x in asking]) if asking else np.zeros(0, np.int64) for k in (0, 1))
            if not len(m_node):
                return
            parent = np.arange(len(m_node) + len(a_node))
            near(m_fp.view(np.uint64), a_fp.view(np.uint64), parent, radius, masks(PARTS)[of[0] % PARTS])
            root, node = roots(parent, np.arange(len(parent))), np.concatenate((m_node, a_node))
            at = np.flatnonzero(root != np.arange(len(root)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[root[at]])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            shard, part, asks, node, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            cuts = np.flatnonzero(np.concatenate(([True], (shard[1:] != shard[:-1]) | (part[1:] != part[:-1]))))
            for lo, hi in zip(cuts, [*cuts[1:], len(shard)], strict=True):
                if of != (shard[lo], part[lo]):
                    yield from compared(held)
                    of, members, held = (shard[lo], part[lo]), [], []
                mid = lo + int(np.searchsorted(asks[lo:hi], True))
                members += [(node[lo:mid], fp[lo:mid])] if mid > lo else []
                held += [(node[mid:hi], fp[mid:hi])] if hi > mid else []
                if sum(len(x[0]) for x in held) >= 4 * PART:
                    yield from compared(held)
                    held = []
        yield from compared(held)

    return each.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, n: int = 4, radius: int = 4) -> DataFrame:
    """Per document: doc_id, fingerprint, component_id."""
    made = stage(fingerprints(docs, n), "fingerprints")
    nodes = stage(made.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes", narrow=True)
    count = nodes.count()
    # nodes are numbered by their fingerprints: a doc_id may stand for several
    keyed = nodes.select(F.col("fp").alias("node"), "fp")
    labels = components(stage(links(keyed, count, radius), "links", narrow=True)) if count > 1 else None
    known = nodes.select("fp", F.col("node").alias("least"))
    if labels is not None:
        known = salted_join(known.withColumnRenamed("fp", "key"), labels.select(F.col("node").alias("key"), "label"), "key", ["key"], "left")
        known = stage(known.select(F.col("key").alias("fp"), F.coalesce("label", "key").alias("class"), "least"), "classes", narrow=True)
        least = known.groupBy("class").agg(F.min("least").alias("component_id"))
        known = stage(salted_join(known, least, "class", ["fp"]).select("fp", "component_id"), "components", narrow=True)
    else:
        known = known.withColumnRenamed("least", "component_id")
    out = salted_join(made.withColumn("_fp", F.when(F.col("doc_id").isNotNull(), F.col("fp"))), known.withColumnRenamed("fp", "_fp"), "_fp", ["doc_id"], "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
