"""Hierarchical best-fit packing of token pieces into sequences.

1. Pieces are dealt by a hash of their place over groups of about AT_ONCE. Each group is packed by best-fit, largest
   first, in its task; as pieces of one length are alike, the plan is made over counts of lengths.
2. Sequences with no more than `slack` tokens left are done. The underfull ones go on as items of their fill: they are
   dealt over fewer groups and packed by best-fit again, up a tree, until one group is left at its root (or a round over
   several groups joins hardly any, as when all are over half full).
3. A piece's place is that in its first sequence, moved by those of the items that this one became part of.

Memory is that of a group in each task; the driver only counts. Groups are alike however long and short texts lie in the
files, so sequences are about as many as by best-fit over all pieces; with one group they are the same.

Cases: a null or empty text is the end id alone; a null doc_id is packed like any other; repeated rows are packed each
by itself; a text longer than `room` tokens is cut into pieces, however long; an empty table gives no rows; other columns
are ignored, whatever their names. Pieces of equal length take places in no fixed order.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import stage, table

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Items that a group is planned for.
AT_ONCE = 16_384
#: A table of so many rows at most is broadcast after it has been counted; beyond that the join is a merge.
BROADCAST_ROWS = 50_000


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Bins of indices into sizes: largest first, each into the fullest bin with room. O(n log n + n * room/word)."""
    bins: list[list[int]] = []
    left: list[list[int]] = [[] for _ in range(room + 1)]
    free: list[int] = []  # remaining rooms that some bin has, ascending
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        need = sizes[i]
        k = bisect_left(free, need)
        if k < len(free):
            r = free[k]
            b = left[r].pop()
            if not left[r]:
                free.pop(k)
        else:
            r, b = room, len(bins)
            bins.append([])
        bins[b].append(i)
        r -= need
        if r:
            if not left[r]:
                insort(free, r)
            left[r].append(b)
    return bins


def best_fit_counts(counts: dict[int, int], room: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """best_fit over counts of sizes: (bins, [(size, how many in each)]), largest first. Each size adds at most three kinds."""
    left: list[list[tuple]] = [[] for _ in range(room + 1)]
    free: list[int] = []

    def put(n: int, parts: tuple, r: int) -> None:
        if r and not left[r]:
            insort(free, r)
        left[r].append((n, parts))

    for size in sorted(counts, reverse=True):
        more = counts[size]
        while more:
            i = bisect_left(free, size)
            if i < len(free):
                r = free[i]
                n, parts = left[r].pop()
                if not left[r]:
                    free.pop(i)
            else:
                r, n, parts = room, -(-more // (room // size)), ()
            each = r // size
            whole = min(n, more // each)
            more -= whole * each
            if whole:
                put(whole, (*parts, (size, each)), r - each * size)
            if whole < n and more:
                put(1, (*parts, (size, more)), r - more * size)
                more, whole = 0, whole + 1
            if whole < n:
                put(n - whole, parts, r)
    return [(n, list(parts)) for kinds in left for n, parts in kinds]


def slots(counts: dict[int, int], room: int) -> np.ndarray:
    """Rows (size, first rank, how many in each sequence, first sequence, offset), by size and rank: where the pieces of a size go."""
    rows, rank, sequence = [], dict.fromkeys(counts, 0), 0
    for n, parts in best_fit_counts(counts, room):
        at = 0
        for size, each in parts:
            rows.append((size, rank[size], each, sequence, at))
            rank[size] += n * each
            at += size * each
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    kept: list[tuple] = []
    for x in rows:
        kept.append(x)
        if len(kept) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)
            kept = []
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)


def packed(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset, fill of the sequence) of items by best-fit, largest first."""
    values, count = np.unique(sizes, return_counts=True)
    size, first, each, sequence, at = np.ascontiguousarray(slots(dict(zip(values.tolist(), count.tolist(), strict=True)), room).T)
    order = np.argsort(sizes, kind="stable")
    rank = np.empty(len(sizes), np.int64)
    rank[order] = np.arange(len(sizes)) - np.repeat(np.cumsum(count) - count, count)
    k = np.searchsorted(size << 48 | first, sizes << 48 | rank, "right") - 1
    q, r = np.divmod(rank - first[k], each[k])
    into, offset = sequence[k] + q, at[k] + r * sizes
    return into, offset, np.bincount(into, weights=sizes).astype(np.int64)[into]


def by_groups(items: DataFrame, size: str, groups: int, room: int) -> DataFrame:
    """items with bin, offset and fill, packed within groups by a hash of `item`, the items' identifier."""
    kept = items.columns
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in items.schema)}, bin long, offset long, fill long"

    def run(rows: pa.Table) -> pa.Table:
        into, offset, fill = packed(rows.column(size).to_numpy().astype(np.int64), room)
        number = rows.column("_group")[0].as_py() << 32
        out = rows.select(kept)
        for name, column in (("bin", into + number), ("offset", offset), ("fill", fill)):
            out = out.append_column(name, pa.array(column))
        return out

    dealt = items.withColumn("_group", F.pmod(F.xxhash64("item"), F.lit(groups)).cast("long"))
    return dealt.groupBy("_group").applyInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str | None = None, room: int = 4096, slack: int | None = None) -> DataFrame:
    """Per piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    slack: tokens that may be left in a sequence that is done, a 128th of room if not given.
    """
    path, slack = vocabulary or tokens.default_vocabulary(), room // 128 if slack is None else slack
    cut_schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("item", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            item = TaskContext.get().partitionId() << 40
            for batch in batches:
                doc_ids = batch.column(0).to_pylist()
                for k, ids in tokens.encoded(batch.column(1), path):
                    for n, lo in enumerate(range(0, len(ids), room)):
                        own = ids[lo : lo + room]
                        yield doc_ids[k], n, lo, len(own), tokens.crc(own), item
                        item += 1

        return _batches(rows(), cut_schema)

    groups_of = lambda n: max(1, -(-n // AT_ONCE))
    pieces = stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, f"{PIECE}, item long"), "pieces")
    groups = groups_of(pieces.count())
    placed = stage(by_groups(pieces, "length", groups, room), "packed", narrow=True)
    rounds: list[DataFrame] = []  # (item, bin, offset): where underfull sequences went
    left = placed.where((F.col("offset") == 0) & (F.col("fill") < room - slack)).select(F.col("bin").alias("item"), "fill")
    while groups > 1:
        n = left.count()
        groups = min(groups - 1, groups_of(n))
        # numbers of a round's sequences don't meet those of rounds before
        merged = by_groups(left.withColumnRenamed("fill", "size"), "size", groups, room).withColumn("bin", F.col("bin") + F.lit((len(rounds) + 1) << 56))
        merged = stage(merged, "merged", narrow=True)
        rounds.append(merged.select("item", "bin", "offset"))
        fresh = merged.where("offset = 0")
        if groups > 1 and fresh.count() > 0.99 * n:
            break
        left = fresh.where(F.col("fill") < room - slack).select(F.col("bin").alias("item"), "fill")
    out = placed.select(*cut_schema.names[:5], F.col("bin").alias("sequence_id"), "offset")
    for moved in rounds:
        step = moved.select(F.col("item").alias("sequence_id"), F.col("bin").alias("_bin"), F.col("offset").alias("_offset"))
        step = F.broadcast(step) if step.count() <= BROADCAST_ROWS else step.hint("merge")
        out = out.join(step, "sequence_id", "left").select(*cut_schema.names[:5], F.coalesce("_bin", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("_offset", F.lit(0))).alias("offset"))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
