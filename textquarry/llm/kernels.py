"""Vectorised text kernels over the byte buffers of Arrow string columns.

Texts are handled in chunks of about CHUNK bytes (a chunk has one text at least), so memory doesn't depend on the
number of rows in an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Spans of more bytes are hashed one by one; the others 8 bytes at a time, all spans at once.
LONG = 128
_LOW_BYTES = np.array([2 ** (8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into these bytes) of runs of rows; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the number of words before it (one entry more than texts)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~_SPACE[buf]
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    cut = offs[:-1]
    before[cut[cut < len(buf)]] = False
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    last = offs[1:] - 1
    after[last[last >= 0]] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs, "left")


def eights(buf: np.ndarray) -> np.ndarray:
    """For each place of buf the 8 bytes from there on; behind the end stand zeros."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.lib.stride_tricks.as_strided(padded, (len(buf) + 1, 8), (1, 1))


def digits(eight: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place as one integer, without those beyond the `left` that a span still has."""
    return eight[at].view("<u8").ravel() & _LOW_BYTES[np.minimum(left, 8)]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: its length, then 8 bytes after 8 through mix(); a long one by XXH3.

    mix() is no linear map, so there are no words (as with sums of powers modulo 2**64) that collide by their structure.
    Spans of one length up to 8 bytes never collide.
    """
    size, eight = ends - starts, eights(buf)
    h = mix((size.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    live = np.flatnonzero((size > 0) & (size <= LONG))
    for k in range(0, LONG, 8):
        live = live[size[live] > k]
        if not len(live):
            break
        h[live] = mix(h[live] ^ digits(eight, starts[live] + k, size[live] - k))
    for d in np.flatnonzero(size > LONG).tolist():
        h[d] = xxhash.xxh3_64_intdigest(buf[starts[d] : ends[d]].tobytes())
    return h


def equal_spans(buf1: np.ndarray, start1: np.ndarray, buf2: np.ndarray, start2: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes of spans of equal size are the same."""
    one, two = eights(buf1), eights(buf2)
    same = np.ones(len(size), bool)
    live = np.flatnonzero((size > 0) & (size <= LONG))
    for k in range(0, LONG, 8):
        live = live[size[live] > k]
        if not len(live):
            break
        left = size[live] - k
        same[live] &= digits(one, start1[live] + k, left) == digits(two, start2[live] + k, left)
    for d in np.flatnonzero(size > LONG).tolist():
        same[d] = np.array_equal(buf1[start1[d] : start1[d] + size[d]], buf2[start2[d] : start2[d] + size[d]])
    return same


def span_classes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each span, the same for spans of the same bytes and for no others."""
    size = ends - starts
    _, first, number = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    model = first[number]
    same = size == size[model]
    fit = np.flatnonzero(same & (model != np.arange(len(size))))
    same[fit] = equal_spans(buf, starts[fit], buf, starts[model[fit]], size[fit])
    if same.all():
        return number
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(buf[a:b].tobytes(), len(seen)) for a, b in zip(starts, ends, strict=True)], np.int64)


def doubled_classes(number: np.ndarray, times: int) -> np.ndarray:
    """Of classes of single items the classes of each 2**times consecutive ones, without hashing."""
    for k in range(times):
        step = 1 << k
        number = np.unique(number[:-step] * (int(number.max(initial=0)) + 1) + number[step:], return_inverse=True)[1]
    return number


def lower(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive hashes."""
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out += mix(h[k : len(h) - n + 1 + k] + np.uint64(0xA0761D6478BD642F * (k + 1) & (2**64 - 1)))
    return mix(out)


def shingles(buf: np.ndarray, offs: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingle hashes of each text, ascending within a text, and the offsets of the texts.

    A text of 1 to n-1 words has one shingle, the whole sequence; one without words has none.
    """
    low = lower(buf)
    starts, ends, first = word_spans(low, offs)
    words = np.diff(first)
    h = span_hashes(low, starts, ends)
    m = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    doc = np.repeat(np.arange(len(words)), m)
    out = np.zeros(int(m.sum()), np.uint64)
    base = np.concatenate(([0], np.cumsum(m)))
    if len(h) >= n:
        every = windows(h, n)
        long = np.repeat(words >= n, m)
        at = first[:-1][doc] + np.arange(len(doc)) - base[:-1][doc]
        out[long] = every[at[long]]
    for d in np.flatnonzero((words > 0) & (words < n)):
        x = h[first[d] : first[d + 1]]
        out[base[d]] = windows(x, len(x))[0] ^ np.uint64(len(x))
    parts = [np.unique(out[base[d] : base[d + 1]]) for d in range(len(words))]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values from first[i] up to first[i+1]."""
    total = np.concatenate((np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]
