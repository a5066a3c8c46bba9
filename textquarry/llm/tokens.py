"""Token ids of whole texts by a public tokenizer file, unit by unit with a cache.

The tokenizer drops white space and never joins pieces across it, and within a word of plain letters, digits and marks it
takes each run of letters, each digit and each run of marks by itself. So the ids of a text are those of its units one
after another: each distinct unit is encoded once by the tokenizers library and then looked up. A word with any other
character (quotes, other scripts, controls) is one unit, which goes through the library's whole encode().
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from . import kernels as K

#: Units that a Python worker keeps, in a table of SLOTS places; beyond it the cache starts anew.
CACHE_UNITS, SLOTS = 500_000, 1 << 20
END = 1
_state: dict[str, tuple] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_SPACE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, 9, 10, 11, 12, 13]] = _SPACE
_KIND[97:123] = _LETTER
_KIND[48:58] = _DIGIT
#: Quotes begin the tokenizer's endings ('s, 'll) and "<" its special tokens, so words with them aren't taken apart.
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<"]] = _MARK
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level BPE writes each byte as one printable character: printable ones as themselves, the rest from 256 on.
_AS_CHARACTER = dict.fromkeys(range(256)) | {b: b for b in _KEPT} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(_KEPT))}


def units(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, whether a unit is a word for encode(), units before each text).

    Letters are those of ASCII and the Latin ones that UTF-8 begins with C3; both are lower-cased as the tokenizer does.
    """
    low = K.lower(buf)
    kind = _KIND[low]
    lead = np.flatnonzero(low[:-1] == 0xC3) if len(low) else np.zeros(0, np.int64)
    if len(lead):
        tail = low[lead + 1]
        good = (tail != 0x97) & (tail != 0xB7)
        lead, tail = lead[good], tail[good]
        low[lead + 1] = np.where(tail < 0x9F, tail + 0x20, tail)
        kind[lead] = kind[lead + 1] = _LETTER
    starts, ends, first = K.word_spans(low, offs)
    if not len(starts):
        return low, starts, ends, np.zeros(0, bool), first
    begin = np.empty(len(low), bool)
    begin[0] = True
    begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    begin &= kind != _SPACE
    begin[starts] = True
    odd = np.concatenate(([0], np.cumsum(kind == _OTHER)))
    whole = odd[ends] > odd[starts]
    if whole.any():
        edge = np.zeros(len(low) + 1, np.int8)
        edge[starts[whole]] += 1
        edge[ends[whole]] -= 1
        begin &= np.cumsum(edge[:-1], dtype=np.int8) == 0
        begin[starts[whole]] = True
    at = np.flatnonzero(begin)
    before = np.searchsorted(at, starts)
    stop = np.empty_like(at)
    stop[:-1] = at[1:]
    stop[np.append(before[1:], len(at)) - 1] = ends
    odd_unit = np.zeros(len(at), bool)
    odd_unit[before[whole]] = True
    return low, at, stop, odd_unit, np.append(before, len(at))[first]


class UnitIds:
    """Ids of units, kept in one growing array and found by an open table of 64-bit hashes.

    A unit that is found has the same bytes: they are kept beside its ids and compared, so equal hashes never decide.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path)
        self.model = self.encode.model
        self.reset()
        probe = ["and", "The,", "\u00c9t\u00e9.", "gr\u00f6\u00dfe!!", "a***1b22", "ni\u00f1o", "x=10.5;", "[A]", "\u00ff\u00d8?"]
        self.direct = [self._taken_apart(w) for w in probe] == [self.encode.encode(w, add_special_tokens=False).ids for w in probe]

    def _taken_apart(self, word: str) -> list[int]:
        raw = np.frombuffer(word.encode(), np.uint8)
        low, starts, ends, _, _ = units(raw, np.array([0, len(raw)]))
        return [x for a, b in zip(starts, ends, strict=True) for x in self.piece(low[a:b].tobytes())]

    def reset(self) -> None:
        self.keys, self.place = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.count, self.used, self.held = 1, 1, 0
        self.bytes, self.at, self.length = np.zeros(1 << 18, np.uint8), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.start, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.ids[0], self.size[0] = END, 1  # place 0 is the end of a text

    def piece(self, raw: bytes) -> list[int]:
        text = raw.decode("ascii") if raw.isascii() else raw.decode("latin-1").translate(_AS_CHARACTER)
        return [t.id for t in self.model.tokenize(text)]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of units by their hashes, -1 where they aren't known."""
        out = np.full(len(keys), -1, np.int64)
        slot = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
        todo = None
        while True:
            k = keys if todo is None else keys[todo]
            there = self.keys[slot]
            hit = there == k
            if todo is None:
                out[hit] = self.place[slot[hit]]
            else:
                out[todo[hit]] = self.place[slot[hit]]
            go = ~hit & (there != 0)
            if not go.any():
                return out
            todo = np.flatnonzero(go) if todo is None else todo[go]
            slot = (slot[go] + 1) & (SLOTS - 1)

    def insert(self, keys: np.ndarray, places: np.ndarray) -> None:
        """New units of different hashes; those that meet in a slot go on to the next one."""
        slot, todo = (keys & np.uint64(SLOTS - 1)).astype(np.int64), np.arange(len(keys))
        while len(todo):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            win = free[one]
            at = slot[win]
            self.keys[at], self.place[at] = keys[todo[win]], places[todo[win]]
            rest = np.ones(len(todo), bool)
            rest[win] = False
            todo, slot = todo[rest], (slot[rest] + 1) & (SLOTS - 1)

    def same(self, places: np.ndarray, text: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the bytes kept at the places are those of the spans of text."""
        out = self.length[places] == size
        fit = np.flatnonzero(out)
        out[fit] = K.equal_spans(self.bytes[: self.held], self.at[places[fit]], text, starts[fit], size[fit])
        return out

    def add(self, raw: list[bytes], whole: np.ndarray) -> None:
        """Ids of new units go to the next places."""
        got: list = [None] * len(raw)
        words = np.flatnonzero(whole).tolist()
        for lo in range(0, len(words), 8192):
            part = words[lo : lo + 8192]
            for k, e in zip(part, self.encode.encode_batch_fast([raw[k].decode("utf-8", "replace") for k in part], add_special_tokens=False), strict=True):
                got[k] = e.ids
        piece = self.piece
        for k in np.flatnonzero(~whole).tolist():
            got[k] = piece(raw[k])
        size = np.fromiter(map(len, got), np.int32, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.count + len(raw) > len(self.start):
            self.start, self.size = np.concatenate((self.start, np.zeros_like(self.start))), np.concatenate((self.size, np.zeros_like(self.size)))
        self.ids[self.used : self.used + len(flat)] = flat
        new = slice(self.count, self.count + len(raw))
        self.size[new] = size
        self.start[new] = self.used + np.cumsum(size) - size
        self.used += len(flat)
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        while self.held + int(length.sum()) > len(self.bytes):
            self.bytes = np.concatenate((self.bytes, np.zeros_like(self.bytes)))
        while self.count + len(raw) > len(self.at):
            self.at, self.length = np.concatenate((self.at, np.zeros_like(self.at))), np.concatenate((self.length, np.zeros_like(self.length)))
        self.bytes[self.held : self.held + int(length.sum())] = np.frombuffer(b"".join(raw), np.uint8)
        self.at[new], self.length[new] = self.held + np.cumsum(length) - length, length
        self.held += int(length.sum())
        self.count += len(raw)

    def texts(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with END at its end, and the offsets of the texts."""
        if self.direct:
            low, starts, ends, whole, first = units(buf, offs)
        else:
            low = buf
            starts, ends, first = K.word_spans(buf, offs)
            whole = np.ones(len(starts), bool)
        keys, size = K.span_hashes(low, starts, ends), ends - starts
        text = low
        if whole.any():  # words for encode() as they stand, behind the lower-cased text
            keys[whole] = K.span_hashes(buf, starts[whole], ends[whole]) ^ np.uint64(0x5851F42D4C957F2D)
            text, starts = np.concatenate((low, buf)), starts + len(low) * whole
        keys |= np.uint64(1)
        place = self.find(keys)
        known = np.flatnonzero(place >= 0)
        odd = known[~self.same(place[known], text, starts[known], size[known])]
        if (place < 0).any() or len(odd):
            new = np.flatnonzero(place < 0)
            _, at, inverse = np.unique(keys[new], return_index=True, return_inverse=True)
            one = new[at]
            differ = size[new] != size[one[inverse]]
            fit = np.flatnonzero(~differ)
            differ[fit] = ~K.equal_spans(text, starts[new[fit]], text, starts[one[inverse[fit]]], size[new[fit]])
            alone = np.concatenate((odd, new[differ]))  # another unit has their hash
            if self.count + len(one) + len(alone) > CACHE_UNITS and self.count > 1:
                self.reset()
                return self.texts(buf, offs)
            base, raw = self.count, text.tobytes()
            every = np.concatenate((one, alone))
            self.add([raw[a : a + n] for a, n in zip(starts[every].tolist(), size[every].tolist(), strict=True)], whole[every])
            if self.count <= SLOTS // 2:
                self.insert(keys[one], np.arange(base, base + len(one)))
            place[new] = base + inverse
            place[alone] = base + len(one) + np.arange(len(alone))
        n = len(offs) - 1
        every = np.insert(place, first[1:], 0) if len(place) else np.zeros(n, np.int64)
        size = self.size[every].astype(np.int64)
        after = np.concatenate(([0], np.cumsum(size)))
        base = after[first + np.arange(n + 1)]
        return self.ids[np.repeat(self.start[every] - after[:-1], size) + np.arange(int(after[-1]))], base


def unit_ids(path: str) -> UnitIds:
    if path not in _state:
        _state[path] = (UnitIds(path),)
    return _state[path][0]


def encoded(column: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids with END) of each text of an Arrow column; a null has END alone."""
    own = unit_ids(path)
    for lo, hi, buf, offs in K.chunks(column, 2 << 20):
        ids, base = own.texts(buf, offs)
        for d in range(hi - lo):
            yield lo + d, ids[base[d] : base[d + 1]]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
