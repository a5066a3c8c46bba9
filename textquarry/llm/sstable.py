"""Sorted-string-table shards of token ids, keyed by document identifier.

A shard is a run of blocks, then the block index, the Bloom filter and a footer. In a block each entry stores the length
of the prefix its key shares with the entry before, the rest of the key, and the value; blocks are zstd-compressed. The
sparse index has for each block its first key, place, sizes, and the ids and entries before it, so that a lookup asks
the filter, bisects the index and reads one block (more only where a key is repeated across blocks).

Cases: a null text holds the end id alone; a null doc_id has a key of its own that sorts first; repeated identifiers
are kept as repeated entries, ordered by a hash of their texts, and may go on in the next blocks and shards; an empty
table gives no shard with entries; columns beyond doc_id and text aren't read.
"""

from __future__ import annotations

import struct
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import gathered, new_folder, spread, table
from .storage import random_access, written

MAGIC = b"TQSST001"
_FOOTER = struct.Struct("<QQQQQQII8s")
BLOCK = 64 << 10
BITS, PROBES = 10, 7
SHARD_BYTES, MOST_SHARDS = 256 << 20, 1_000_000
MANIFEST = "shard int, path string"
FOOTERS = "shard int, n_docs long, n_ids long"
ENTRIES = "shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def key_of(doc_id: int | None) -> bytes:
    """Nine bytes that sort as the identifiers do, null first."""
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + 2**63)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - 2**63 if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _hashes(key: bytes) -> tuple[int, int]:
    return xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places in the filter of keys, whose two hashes are the rows of hashes."""
    return (hashes[:, :1] + np.arange(PROBES, dtype=np.uint64) * hashes[:, 1:]) % np.uint64(bits)


class Writer:
    """Takes entries in ascending key order."""

    def __init__(self, out) -> None:
        self.out, self.at, self.codec = out, 0, pa.Codec("zstd", compression_level=1)
        self.block, self.last, self.first, self.count = bytearray(), b"", b"", 0
        self.index, self.hashes, self.docs, self.ids, self.before = [], array("Q"), 0, 0, (0, 0)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if not self.count:
            self.first, self.last, self.before = key, b"", (self.docs, self.ids)
        shared = 0
        while shared < len(self.last) and shared < len(key) and self.last[shared] == key[shared]:
            shared += 1
        wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
        value = ids.astype("<u4" if wide else "<u2").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + key[shared:] + _varint(len(ids) << 1 | wide) + value
        if key != self.last or not self.docs:
            self.hashes.extend(_hashes(key))
        self.last = key
        self.count += 1
        self.docs += 1
        self.ids += len(ids)
        if len(self.block) >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.count:
            packed = self.codec.compress(bytes(self.block), asbytes=True)
            self.out.write(packed)
            self.index.append((self.first, self.at, len(packed), len(self.block), *self.before))
            self.at += len(packed)
            self.block, self.count = bytearray(), 0

    def close(self) -> None:
        self.flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QIIQQ", *rest) for k, *rest in self.index)
        hashes = np.frombuffer(self.hashes, np.uint64).reshape(-1, 2)
        bits = max(64, BITS * len(hashes))
        bloom = np.zeros(bits, bool)
        for lo in range(0, len(hashes), 100_000):
            bloom[_probes(hashes[lo : lo + 100_000], bits).ravel()] = True
        filter_ = np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(index)
        self.out.write(filter_)
        self.out.write(_FOOTER.pack(self.at, len(index), self.at + len(index), bits, self.docs, self.ids, len(self.index), PROBES, MAGIC))


class Reader:
    """Looks up and scans one shard."""

    def __init__(self, path: str) -> None:
        self.file = random_access(path)
        end = self.file.size()
        foot = self._read(end - _FOOTER.size, _FOOTER.size)
        at, size, bloom_at, self.bits, self.docs, self.ids, blocks, _, magic = _FOOTER.unpack(foot)
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        raw, p = self._read(at, size), 0
        self.first, self.blocks = [], []
        for _ in range(blocks):
            n, p = _read_varint(raw, p)
            self.first.append(raw[p : p + n])
            self.blocks.append(struct.unpack_from("<QIIQQ", raw, p + n))
            p += n + 32
        self.bloom_at, self.bloom, self.codec = bloom_at, None, pa.Codec("zstd")

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def entries(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        at, packed, size, _, _ = self.blocks[k]
        data, p, key = self.codec.decompress(self._read(at, packed), decompressed_size=size, asbytes=True), 0, b""
        while p < size:
            shared, p = _read_varint(data, p)
            n, p = _read_varint(data, p)
            key = key[:shared] + data[p : p + n]
            n, p = _read_varint(data, p + n)
            kind, count = ("<u4", 4) if n & 1 else ("<u2", 2), n >> 1
            yield key, np.frombuffer(data, kind[0], count, p).astype(np.uint32)
            p += count * kind[1]

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.blocks)):
            yield from self.entries(k)

    def may_have(self, key: bytes) -> bool:
        if self.bloom is None:
            self.bloom = np.frombuffer(self._read(self.bloom_at, -(-self.bits // 8)), np.uint8)
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(np.array([_hashes(key)], np.uint64), self.bits)[0].tolist())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Values of all entries of an identifier."""
        key = key_of(doc_id)
        if not self.blocks or not self.may_have(key):
            return []
        k, out = max(0, bisect_left(self.first, key) - 1), []
        while k < len(self.blocks) and self.first[k] <= key:
            out += [v for found, v in self.entries(k) if found == key]
            k += 1
        return out


def shard_count(docs: DataFrame) -> int:
    """One shard for SHARD_BYTES of the input as Spark's statistics put it, and no fewer than shuffle partitions."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return spread(docs.sparkSession, min(MOST_SHARDS, -(-size // SHARD_BYTES)))


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, shards: int | None = None) -> DataFrame:
    """Writes shards of ascending identifier ranges; returns a row of MANIFEST for each."""
    path = vocabulary or tokens.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        name = f"{folder}/shard-{shard:06d}.sst"
        with written(name) as out:
            own = Writer(out)
            for batch in batches:
                keys = [key_of(x) for x in batch.column(0).to_pylist()]
                for k, ids in tokens.encoded(batch.column(1), path):
                    own.add(keys[k], ids)
            own.close()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [name]})

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = given.withColumn("_h", F.xxhash64("text"))  # rows of one identifier can be split
    dealt = keyed.repartitionByRange(shards or shard_count(given), "doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    return dealt.select("doc_id", "text").mapInArrow(run, MANIFEST)


def footers(manifest: DataFrame) -> DataFrame:
    """A row of FOOTERS for each shard, read from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Reader(path) for path in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.docs for x in found], pa.int64()), pa.array([x.ids for x in found], pa.int64())], ["shard", "n_docs", "n_ids"])

    return manifest.select("shard", "path").mapInArrow(run, FOOTERS)


def read(manifest: DataFrame) -> DataFrame:
    """A row of ENTRIES for each entry of the shards in the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = Reader(path)
                at = 0
                for k in range(len(own.blocks)):
                    rows = [(id_of(key), len(ids), tokens.crc(ids)) for key, ids in own.entries(k)]
                    size = np.array([r[1] for r in rows], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array(at + np.cumsum(size) - size), pa.array(size), pa.array([r[2] for r in rows], pa.int64())], ["shard", "doc_id", "local_start", "n_tokens", "ids_crc32"])
                    at += int(size.sum())

    few = manifest.select("shard", "path").repartition(spread(manifest.sparkSession), "shard")
    return few.mapInArrow(run, ENTRIES)


def documents(manifest: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start (ids of all shards and entries before it, by the files' footers), n_tokens, ids_crc32."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = footers(manifest).select("shard", before.alias("_base"))  # a row a shard
    return read(manifest).join(F.broadcast(base), "shard").select("doc_id", (F.col("_base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return documents(gathered(write(docs, new_folder(spark, "sstable"))))
