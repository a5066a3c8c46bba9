"""Exact removal of repeated substrings with a sparse, distributed suffix array.

A byte goes if a string of `size` bytes that covers it also starts in a document with a smaller doc_id. Sorting every
suffix of the corpus would move many times its bytes, so suffixes are sampled by content first, without loss:

1. Anchors: every window of `size` bytes has a minimal 20-byte substring (by hash), so equal windows have equal anchors
   at the same offset. An anchor's context is all bytes of windows that can have it (up to 80).
2. Anchors are grouped by hash. An occurrence whose whole context also occurs in a smaller document is settled at once,
   by the task that finds it if that has seen both, so a very common passage is shuffled as one row a task. What is left
   of a group with two or more different contexts goes on, one document for each context.
   Contexts are the same here if both their anchors' and their own 64-bit hashes are.
3. The windows of these contexts are ordered by deep-shallow sorting: multikey quicksort by 8-byte digits down to a
   shallow depth, then blind tries over the groups that still share a long prefix, which look at branching digits only.
   Neighbours equal to full depth form a class, and all but the smallest document's windows in it are removed.

Whole copies of a smaller document's text are settled before step 1. Ordering within a task goes in slabs of whole anchor
groups; a large group is ordered one offset at a time. The anchors with more than HOT contexts are dealt
over tasks SIDES times, each time for the windows whose anchor stands in one part of the offsets, by the bytes on both
sides that all these windows hold, so windows that are equal still meet.

Cases: a null text is empty; a null doc_id is smaller and larger than none, so its text stays and removes nothing;
repeated rows (same doc_id and text) get equal results and don't remove one another; rows that share a doc_id with other
texts are documents of one identifier; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import hot_keys, salted_join, spread, stage, table

ANCHOR = 20
SHALLOW = 16
SLAB = 10_000
#: Anchors that a task gathers before it settles what it can by itself; contexts of one anchor beyond which it is dealt out.
GATHER, HOT = 500_000, 4096
#: Bytes of text whose anchors are found at a time.
ANCHOR_CHUNK = 1 << 18
#: Parts of the offsets of an anchor in its windows.
SIDES = 4
#: A side of at most so many rows is broadcast after it has been counted.
BROADCAST_ROWS = 100_000
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over x[i : i + width] for each i, by doubling."""
    span, y = 1, x
    while span * 2 <= width:
        y = f(y[: len(y) - span], y[span:])
        span *= 2
    rest = width - span
    return f(y[: len(y) - rest], y[rest:]) if rest else y


def rolled(buf: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each place on: of 8, 8 and 4 bytes, each through mix()."""
    eight = K.eights(buf)[: len(buf)].view("<u8").ravel()
    n = len(buf) - ANCHOR + 1
    return K.mix(K.mix(K.mix(eight[:n] ^ np.uint64(0x9FB21C651E98DF25)) ^ eight[8 : n + 8]) ^ (eight[16 : n + 16] & np.uint64(2**32 - 1)))


def anchors(buf: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position within it, anchor hash, context hash) of all anchors of a chunk's texts."""
    n, width = len(buf), size - ANCHOR + 1
    if n < size:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    h = rolled(buf) | np.uint64(1)
    least = _slide(h, width, np.minimum)
    length = np.diff(offs)
    ends = np.repeat(offs[1:], length)
    least[ends[: len(least)] - np.arange(len(least)) < size] = 0  # no window of one text starts here
    pad = np.zeros(width - 1, np.uint64)
    most = _slide(np.concatenate((pad, least, pad)), width, np.maximum)
    at = np.flatnonzero(most[: len(h)] == h)
    text = np.searchsorted(offs, at, "right") - 1
    a, b = np.maximum(at - (width - 1), offs[text]), np.minimum(at + size, offs[text + 1])
    shape = (at - a).astype(np.uint64) * np.uint64(1009) + (b - at).astype(np.uint64)
    ctx = K.mix(K.span_hashes(buf, a, b) + shape * np.uint64(0x9FB21C651E98DF25))
    return text, at - offs[text], h[at], ctx


class Digits:
    """The 8 bytes of suffixes from a depth on as integers that order as the bytes do; bytes beyond the full depth are cut off."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, depth: int) -> None:
        self.eight, self.starts, self.depth = np.lib.stride_tricks.sliding_window_view(buf, 8), starts, depth

    def __call__(self, which: np.ndarray, d: np.ndarray) -> np.ndarray:
        key = np.ascontiguousarray(self.eight[self.starts[which] + d]).view(">u8").ravel().astype(np.uint64)
        return key >> (8 * np.maximum(0, d + 8 - self.depth)).astype(np.uint64)


def _several(live: np.ndarray, fresh: np.ndarray, known: np.ndarray, depth: int) -> np.ndarray:
    """Of the places those whose segment has other members and isn't known up to depth."""
    begins = fresh[live]
    alone = begins & np.concatenate((begins[1:], [True]))
    return live[~alone & (known[live] < depth)]


def multikey_quicksort(digit: Digits, order: np.ndarray, fresh: np.ndarray, known: np.ndarray, depth: int) -> None:
    """Orders the suffixes of each segment up to depth. A round parts every open segment in three around a pivot digit of
    its own: those below and above it go on at the same depth, those equal to it 8 bytes deeper.

    order: suffixes; fresh: whether a segment begins at a place; known: how deep the suffix there is known. All change.
    """
    live = _several(np.arange(len(order)), fresh, known, depth)
    while len(live):
        first = np.flatnonzero(fresh[live])
        size = np.diff(np.concatenate((first, [len(live)])))
        of = np.repeat(np.arange(len(first)), size)
        key = digit(order[live], known[live])
        pivot = np.sort(np.stack((key[first], key[first + size // 2], key[first + size - 1])), axis=0)[1][of]
        side = 1 + (key > pivot) - (key < pivot).astype(np.int64)
        cell = of * 3 + side
        count = np.bincount(cell, minlength=3 * len(first))
        base = np.cumsum(count) - count
        to = np.empty(len(live), np.int64)
        for k in range(3):
            mine = np.flatnonzero(side == k)
            own = of[mine]
            began = np.searchsorted(own, np.arange(len(first)))
            to[mine] = base[cell[mine]] + np.arange(len(mine)) - began[own]
        place = live[to]
        order[place], known[place] = order[live], known[live] + 8 * (side == 1)
        fresh[live[base[count > 0]]] = True
        live = _several(live, fresh, known, depth)


def blind_tries(digit: Digits, order: np.ndarray, fresh: np.ndarray, known: np.ndarray, depth: int) -> None:
    """Orders the suffixes of each segment to full depth by tries that keep no text: only where, and by which digit, suffixes branch.

    A round takes the first suffix of every open segment as a spine and finds how far each other one follows it. A suffix
    that leaves it at some depth hangs there by its branching digit: in order, those below the spine from its top down,
    the spine with all that equal it, those above it from its end up. Suffixes that hang by the same digit are a subtrie
    and go on as a segment with a spine of their own.
    """
    live = _several(np.arange(len(order)), fresh, known, depth)
    while len(live):
        first = np.flatnonzero(fresh[live])
        size = np.diff(np.concatenate((first, [len(live)])))
        of = np.repeat(np.arange(len(first)), size)
        mine, spine = order[live], order[live[first]][of]
        leaves, branch, side = known[live].copy(), np.zeros(len(live), np.uint64), np.ones(len(live), np.int64)
        follows = np.flatnonzero(mine != spine)
        while len(follows):
            key, along = digit(mine[follows], leaves[follows]), digit(spine[follows], leaves[follows])
            off = key != along
            gone = follows[off]
            branch[gone], side[gone] = key[off], np.where(key[off] < along[off], 0, 2)
            follows = follows[~off]
            leaves[follows] += 8
            follows = follows[leaves[follows] < depth]
        leaves[side == 1] = depth
        o = np.lexsort((branch, np.where(side == 2, -leaves, leaves), side, of))
        order[live], known[live] = mine[o], np.where(side == 1, depth, leaves + 8)[o]
        cells = np.stack((of[o], side[o], leaves[o]))
        apart = (cells[:, 1:] != cells[:, :-1]).any(0) | (branch[o][1:] != branch[o][:-1])
        fresh[live[1:][apart]] = True
        live = _several(live, fresh, known, depth)


def deep_shallow(buf: np.ndarray, starts: np.ndarray, depth: int, group: np.ndarray | None = None, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at starts by their first depth bytes (within ascending groups), and a class number for each
    in that order; equal numbers mean equal to full depth. buf has 8 bytes of padding at least behind the last suffix.

    Multikey quicksort up to the shallow depth, then blind tries for what shares a longer prefix.
    """
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.arange(n) if group is None else np.argsort(group, kind="stable")
    fresh, known, digit = np.zeros(n, bool), np.zeros(n, np.int64), Digits(buf, starts, depth)
    fresh[0] = True
    if group is not None:
        fresh[1:] = group[order][1:] != group[order][:-1]
    multikey_quicksort(digit, order, fresh, known, min(shallow, depth))
    blind_tries(digit, order, fresh, known, depth)
    return order, np.cumsum(fresh) - 1


def candidate_anchors(docs: DataFrame, size: int) -> DataFrame:
    """(h, ctx, doc_id, pos, done) of all anchors; docs: doc_id, text, tag. pos has the tag in its upper half.

    done: the task has seen the same context in a smaller document. h then only deals the row to some task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            h, ctx, doc, pos = (np.concatenate([x[k] for x in held]) for k in range(4))
            order = np.argsort(ctx, kind="stable")
            c, a = ctx[order], h[order]
            first = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (a[1:] != a[:-1]))))
            least = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.concatenate((first, [len(order)]))))
            done = np.zeros(len(h), bool)
            done[order] = doc[order] > least
            h = np.where(done, K.mix(pos.view(np.uint64) + doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), h)
            for a in range(0, len(h), 100_000):
                part = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(h[part].view(np.int64)), pa.array(ctx[part].view(np.int64)), pa.array(doc[part]), pa.array(pos[part]), pa.array(done[part])], ["h", "ctx", "doc_id", "pos", "done"])

        rows = 0
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for lo, _, buf, offs in K.chunks(batch.column(1), ANCHOR_CHUNK):
                text, pos, h, ctx = anchors(buf, offs, size)
                held.append((h, ctx, ids[text + lo], tags[text + lo] << 32 | pos))
                rows += len(h)
                if rows >= GATHER:
                    yield from out()
                    held, rows = [], 0
        if rows:
            yield from out()

    return docs.select("doc_id", "text", "tag").mapInArrow(run, "h long, ctx long, doc_id long, pos long, done boolean")


def settle(found: DataFrame) -> DataFrame:
    """(doc_id, pos, h, settled): occurrences whose context a smaller document has, and those that must be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 4

        def out(rows: list[np.ndarray], mask: np.ndarray, settled: bool) -> Iterator[pa.RecordBatch]:
            if mask.any():
                k = int(mask.sum())
                yield pa.RecordBatch.from_arrays([pa.array(rows[2][mask]), pa.array(rows[3][mask]), pa.array(rows[0][mask]), pa.array(np.full(k, settled))], ["doc_id", "pos", "h", "settled"])

        def several(reps: list[np.ndarray]) -> np.ndarray:
            h, ctx = reps[0], reps[1]
            if not len(h):
                return np.zeros(0, bool)
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            many = np.minimum.reduceat(ctx, first) != np.maximum.reduceat(ctx, first)
            return np.repeat(many, np.diff(np.concatenate((first, [len(h)]))))

        for batch in batches:
            done = batch.column(4).to_numpy(zero_copy_only=False)
            given = [c.to_numpy() for c in batch.columns[:4]]
            yield from out(given, done, True)
            given = [c[~done] for c in given]
            if not len(given[0]):
                continue
            rows = [np.concatenate(x) for x in zip(rest, given, strict=True)]
            h, ctx, doc, _ = rows
            first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1]))))
            least = np.repeat(doc[first], np.diff(np.concatenate((first, [len(h)]))))
            yield from out(rows, doc > least, True)
            reps = [x[doc == least] for x in rows]
            done = reps[0] != reps[0][-1]
            yield from out(reps, several(reps) & done, False)
            rest = [x[~done] for x in reps]
        yield from out(rest, several(rest), False)

    dealt = found.repartition(spread(found.sparkSession), "h").sortWithinPartitions("h", "ctx", "doc_id")
    return dealt.mapInArrow(run, "doc_id long, pos long, h long, settled boolean")


def contexts(docs: DataFrame, marks: DataFrame, size: int) -> DataFrame:
    """(h, doc_id, pos, before, context) of marks to compare; before: bytes of context that precede the anchor."""
    grouped = marks.where("NOT settled").select("doc_id", F.shiftright("pos", 32).alias("tag"), F.col("pos").bitwiseAND(F.lit(2**32 - 1)).alias("pos"), "h").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("pos", "h")).alias("marks"))
    given = docs.select("doc_id", "tag", "text").join(grouped.hint("merge"), ["doc_id", "tag"]).select("doc_id", "tag", "text", "marks")
    width = size - ANCHOR + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            for lo, hi, buf, offs in K.chunks(batch.column(2)):
                raw = buf.tobytes()
                for r in range(lo, hi):
                    values = marks[r].values
                    pos, h = (values.field(k).to_numpy() for k in (0, 1))
                    a, b = int(offs[r - lo]), int(offs[r - lo + 1])
                    at = pos + a
                    left, right = np.maximum(at - (width - 1), a), np.minimum(at + size, b)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), ids[r])), pa.array(tags[r] << 32 | pos), pa.array((at - left).astype(np.int32)), pa.array([raw[x:y] for x, y in zip(left.tolist(), right.tolist(), strict=True)], pa.binary())], ["h", "doc_id", "pos", "before", "context"])

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in run(batches):
            held.append(b)
            rows += b.num_rows
            if rows >= 20_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return given.mapInArrow(batched, "h long, doc_id long, pos long, before int, context binary")


def compare(ctx: DataFrame, hot: DataFrame, size: int) -> DataFrame:
    """(doc_id, tag, lo, hi): byte ranges that are removed because of windows in these contexts.

    hot: (h, _slices) of the anchors that are dealt out. Windows with `first` to `last` bytes left of their anchor hold the
    `first` bytes before it and the size - ANCHOR - last behind it.
    """
    schema = "doc_id long, tag long, lo long, hi long"
    each_side = -(-(size - ANCHOR + 1) // SIDES)
    parts_of = [(lo, min(lo + each_side - 1, size - ANCHOR)) for lo in range(0, size - ANCHOR + 1, each_side)]

    def ordered(run_of: np.ndarray, side: np.ndarray, doc, pos, before, data: list[bytes]) -> Iterator[pa.RecordBatch]:
        length = np.array([len(x) for x in data], np.int64)
        base = np.cumsum(length) - length
        buf = np.frombuffer(b"".join(data) + b"\0" * (size + 16), np.uint8)
        count = np.maximum(length - size + 1, 0)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        row = np.repeat(np.arange(len(doc)), count)
        offset = before[row] - step
        mine = (side[row] == 0) | (side[row] == offset // each_side + 1)
        row, step, offset = row[mine], step[mine], offset[mine]
        starts, runs = base[row] + step, run_of
        gone = np.zeros(len(starts), bool)
        parts = [np.arange(len(starts))] if len(starts) < 31 * SLAB * 2 else [np.flatnonzero(offset == o) for o in np.unique(offset)]
        for part in parts:
            if not len(part):
                continue
            order, cls = deep_shallow(buf, starts[part], size, runs[row[part]] * 64 + offset[part])
            d = doc[row[part]][order]
            first = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1])))
            least = np.repeat(np.minimum.reduceat(d, first), np.diff(np.concatenate((first, [len(d)]))))
            gone[part[order]] = d > least
        at = np.flatnonzero(gone)
        if not len(at):
            return
        new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])))
        a, b = at[new], at[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(at) - 1]))]
        place = (pos & (2**32 - 1))[row[a]] - before[row[a]]
        yield pa.RecordBatch.from_arrays([pa.array(doc[row[a]]), pa.array((pos >> 32)[row[a]]), pa.array(place + step[a]), pa.array(place + step[b] + size)], ["doc_id", "tag", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def new_runs(t: pa.Table | pa.RecordBatch) -> np.ndarray:
            """Whether a row's anchor, side or slice differs from the row's before."""
            keys = [t.column(k).to_numpy() for k in (0, 1, 2)]
            return np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0)))

        def go() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            yield from ordered(np.cumsum(new_runs(t)), t.column(1).to_numpy(), t.column(3).to_numpy(), t.column(4).to_numpy(), t.column(5).to_numpy().astype(np.int64), t.column(6).to_pylist())

        for batch in batches:
            if not batch.num_rows:
                continue
            if sum(b.num_rows for b in held) + batch.num_rows >= SLAB:
                cuts = np.flatnonzero(new_runs(batch))
                at = int(cuts[-1])
                if not at and held and all(held[-1].column(k)[-1] == batch.column(k)[0] for k in (0, 1, 2)):
                    held.append(batch)  # all of it goes on with the last run
                    continue
                if at:
                    held.append(batch.slice(0, at))
                if held:
                    yield from go()
                held = [batch.slice(at)]
            else:
                held.append(batch)
        if held:
            yield from go()

    end = F.octet_length("context") - F.col("before") - ANCHOR
    of_side = []
    for k, (first, last) in enumerate(parts_of):
        bytes_ = F.xxhash64(F.substr("context", F.col("before") - first + 1, F.lit(first)), F.substr("context", F.col("before") + ANCHOR + 1, F.lit(size - ANCHOR - last)))
        of_side.append(F.when((F.col("before") >= first) & (end >= size - ANCHOR - last), F.struct(F.lit(k + 1).alias("side"), bytes_.alias("slice"))))
    alone = F.array(F.struct(F.lit(0).alias("side"), F.lit(0).cast("long").alias("slice")))
    sides = F.when(F.col("_slices").isNull(), alone).otherwise(F.array_compact(F.array(*of_side)))
    each = ctx.join(F.broadcast(hot), "h", "left").withColumn("_x", F.explode(sides)).select("*", "_x.*")
    dealt = each.select("h", F.col("side").cast("long").alias("side"), "slice", "doc_id", "pos", "before", "context")
    dealt = dealt.repartition(spread(ctx.sparkSession), "h", "side", "slice").sortWithinPartitions("h", "side", "slice")
    return dealt.mapInArrow(run, schema)


def remove(docs: DataFrame, size: int = 50) -> DataFrame:
    """RESULT of each document, with `kept`, the bytes that remain."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    prints = stage(given.where("doc_id IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("sha")), "text-hashes")
    first = prints.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    copies = stage(salted_join(prints, first, "sha", ["doc_id"]).where("doc_id > least").select("doc_id", "sha").distinct(), "text-copies", narrow=True)
    shared = stage(prints.groupBy("doc_id").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).where("a <> b").select("doc_id", F.lit(True).alias("_shared")), "shared-ids", narrow=True)
    small = lambda side: F.broadcast(side) if side.count() <= BROADCAST_ROWS else side.hint("merge")

    def tagged(x: DataFrame) -> DataFrame:
        x = x.join(small(shared), "doc_id", "left")
        return x.select("doc_id", "text", F.when(F.col("_shared"), F.crc32("text") % (2**31)).otherwise(F.lit(0)).cast("long").alias("tag"))

    fresh = given.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= size)).withColumn("sha", F.sha2("text", 256)).join(small(copies), ["doc_id", "sha"], "left_anti").drop("sha")
    marks = stage(settle(candidate_anchors(tagged(fresh), size)), "anchors")
    hot = stage(hot_keys(marks.where("NOT settled"), "h", HOT), "hot-anchors", narrow=True)
    ranges = stage(compare(contexts(tagged(fresh), marks, size), hot, size), "ranges")
    width = size - ANCHOR + 1
    settled = marks.where("settled").select("doc_id", F.shiftright("pos", 32).alias("tag"), F.col("pos").bitwiseAND(F.lit(2**32 - 1)).alias("pos"))
    spans = settled.select("doc_id", "tag", F.greatest(F.lit(0), F.col("pos") - (width - 1)).alias("lo"), (F.col("pos") + size).alias("hi")).unionByName(ranges)
    per_doc = spans.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    whole = copies.withColumn("whole", F.lit(True))
    ready = tagged(given).withColumn("sha", F.sha2("text", 256)).join(small(whole), ["doc_id", "sha"], "left").join(per_doc.hint("merge"), ["doc_id", "tag"], "left").select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, spans = batch.column(2).to_pylist(), batch.column(3)
            for lo, hi, buf, offs in K.chunks(batch.column(1)):
                out: list[tuple] = []
                for r in range(lo, hi):
                    text = buf[offs[r - lo] : offs[r - lo + 1]]
                    n = len(text)
                    gone = np.zeros(n, bool)
                    if whole[r] and n >= size:
                        gone[:] = True
                    elif spans[r].is_valid and n >= size:
                        values = spans[r].values
                        edge = np.zeros(n + 1, np.int64)
                        np.add.at(edge, values.field(0).to_numpy(), 1)
                        np.add.at(edge, np.minimum(values.field(1).to_numpy(), n), -1)
                        gone = np.cumsum(edge)[:n] > 0
                    kept = text[~gone].tobytes()
                    out.append((n, int(gone.sum()), int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return ready.mapInArrow(run, RESULT + ", kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents")).drop("kept")
