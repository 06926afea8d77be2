"""Vectorised text kernels over Arrow string columns.

All of them work on the raw UTF-8 bytes of many documents at once, in chunks of bounded size,
so that no per-word Python object is made. Words are runs of bytes that are not ASCII white
space (0x20, 0x09-0x0D); lower-casing touches A-Z alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_LANE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = int(_rng.integers(1, 2**62)) * 4 + 1
_BASE_INV = pow(_BASE, -1, 2**64)
_WBASE = int(_rng.integers(1, 2**62)) * 4 + 1
_WBASE_INV = pow(_WBASE, -1, 2**64)

IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = IDENTITY.copy()
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Letters, digits and every non-ASCII byte; what is left separates words where punctuation is ignored.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

CHUNK_BYTES = 1 << 20
#: Bytes or words that are hashed at a time: longer documents take no larger tables.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of an odd base and of its inverse, as far as they have been asked for."""

    def __init__(self, base: int, inverse: int):
        self.base, self.inverse, self.up, self.down = base, inverse, _powers(base, 1), _powers(inverse, 1)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, int(n - 1).bit_length())
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)
        return self.up, self.down


_byte_powers, _word_powers = _Powers(_BASE, _BASE_INV), _Powers(_WBASE, _WBASE_INV)


@dataclass
class Chunk:
    """Consecutive documents: the bytes of all, and where each begins and ends."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def n(self) -> int:
        return len(self.bounds) - 1


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    return (np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)), bounds


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The documents of a column in order, about `size` bytes at a time; one document is never cut."""
    data, bounds = strings(column)
    first, n = 0, len(bounds) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1)
        last = min(last, n)
        yield Chunk(first, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
        first = last


def pieces(c: Chunk, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """A chunk, cut every `size` bytes where it is one longer document."""
    if c.n > 1 or len(c.data) <= size:
        yield c
    else:
        for s in range(0, len(c.data), size):
            part = c.data[s : s + size]
            yield Chunk(c.first, part, np.array([0, len(part)]))


@dataclass
class Words:
    """Words of a chunk. of: index of each document's first word, and the number of words."""

    start: np.ndarray
    end: np.ndarray
    of: np.ndarray

    def doc(self) -> np.ndarray:
        """Index of the document that holds each word."""
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))


def words(chunk: Chunk, separates: np.ndarray = SPACE) -> Words:
    inside = ~separates[chunk.data]
    n = len(inside)
    if not n:
        none = np.empty(0, np.int64)
        return Words(none, none, np.zeros(len(chunk.bounds), np.int64))
    edge = chunk.bounds[(chunk.bounds > 0) & (chunk.bounds < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[edge] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edge - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, chunk.bounds))


def _long_word(data: np.ndarray, fold: np.ndarray) -> np.uint64:
    """What word_hashes() gives a word of any length, a block at a time."""
    up, _ = _byte_powers.upto(BLOCK)
    total = 0
    for s in range(0, len(data), BLOCK):
        part = _BYTE[fold[data[s : s + BLOCK]]]
        total += int(np.sum(part * up[: len(part)], dtype=U64)) * pow(_BASE, s, 2**64)
    return mix(np.array([total % 2**64 ^ len(data)], U64))[0]


def word_hashes(chunk: Chunk, w: Words, fold: np.ndarray = IDENTITY) -> np.ndarray:
    """64-bit hash of each word's bytes after `fold`, wherever the word stands. A block of the text is worked on at a time."""
    out = np.empty(len(w.start), U64)
    i = 0
    while i < len(out):
        lo = int(w.start[i])
        j = int(np.searchsorted(w.end, lo + BLOCK, "right"))
        if j <= i:
            out[i] = _long_word(chunk.data[lo : w.end[i]], fold)
            i += 1
            continue
        n = int(w.end[j - 1]) - lo
        up, down = _byte_powers.upto(n + 1)
        total = np.empty(n + 1, U64)
        total[0] = 0
        np.cumsum(_BYTE[fold[chunk.data[lo : lo + n]]] * up[:n], out=total[1:])
        start, end = w.start[i:j] - lo, w.end[i:j] - lo
        out[i:j] = mix((total[end] - total[start]) * down[start] ^ (end - start).astype(U64))
        i = j
    return out


def windows(h: np.ndarray, of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `size` consecutive words within one document, and the index of its first word."""
    if len(h) < size:
        return np.empty(0, U64), np.empty(0, np.int64)
    at = np.flatnonzero(np.arange(size, len(h) + size) <= np.repeat(of[1:], np.diff(of)))
    out = np.empty(len(at), U64)
    for i in range(0, len(at), BLOCK):
        a = at[i : i + BLOCK]
        lo, hi = int(a[0]), int(a[-1]) + size
        up, down = _word_powers.upto(hi - lo + 1)
        total = np.empty(hi - lo + 1, U64)
        total[0] = 0
        np.cumsum(h[lo:hi] * up[: hi - lo], out=total[1:])
        a = a - lo
        out[i : i + BLOCK] = mix((total[a + size] - total[a]) * down[a] ^ U64(size))
    return out, at


def sequence_hash(h: np.ndarray, of: np.ndarray, lane: int) -> np.ndarray:
    """Hash of each document's whole word sequence; `lane` picks one of several independent ones."""
    out = np.zeros(len(of) - 1, U64)
    for lo in range(0, len(h), BLOCK):
        x = mix(h[lo : lo + BLOCK] ^ _LANE[lane])
        up, down = _word_powers.upto(len(x) + 1)
        total = np.zeros(len(x) + 1, U64)
        np.cumsum(x * up[: len(x)], out=total[1:])
        start, end = (np.clip(v, lo, lo + len(x)) - lo for v in (of[:-1], of[1:]))
        part = (total[end] - total[start]) * down[start]
        going_on = int(np.searchsorted(of, lo, "right")) - 1  # the document that holds word lo
        if of[going_on] < lo:
            part[going_on : going_on + 1] *= U64(pow(_WBASE, lo - int(of[going_on]), 2**64))
        out += part
    return mix(out ^ np.diff(of).astype(U64))


def rejoined(c: Chunk, w: Words, keep: np.ndarray) -> pa.Array:
    """Each document's words that are kept, joined by one space."""
    data, k = np.append(c.data, np.uint8(32)), np.flatnonzero(keep)
    parts = [np.empty(0, np.uint8)]
    for i in range(0, len(k), BLOCK >> 2):
        at = k[i : i + (BLOCK >> 2)]
        size = w.end[at] - w.start[at] + 1
        first = np.cumsum(size) - size
        x = data[np.arange(int(size.sum())) + np.repeat(w.start[at] - first, size)]
        x[first + size - 1] = 32
        parts.append(x)
    upto = np.concatenate(([0], np.cumsum(np.where(keep, w.end - w.start + 1, 0))))[w.of]
    full = np.diff(upto) > 0  # a document ends without a space
    flat = np.delete(np.concatenate(parts), upto[1:][full] - 1)
    bounds = upto - np.concatenate(([0], np.cumsum(full)))
    return pa.LargeStringArray.from_buffers(c.n, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(flat)).cast(pa.string())


def shingle_sets(h: np.ndarray, of: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document; a document of fewer words than `size` has one, one without words none."""
    s, at = windows(h, of, size)
    cut = np.searchsorted(at, of)
    out = []
    short = None
    for i in range(len(of) - 1):
        n = of[i + 1] - of[i]
        if n >= size:
            x = np.sort(s[cut[i] : cut[i + 1]])
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif n:
            if short is None:
                short = sequence_hash(h, of, 7)
            out.append(short[i : i + 1])
        else:
            out.append(np.empty(0, U64))
    return out


def text_shingles(column: pa.Array, size: int, fold: np.ndarray = LOWER) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(index of the first document, sets) for each chunk of a column."""
    for c in chunks(column):
        w = words(c)
        yield c.first, shingle_sets(word_hashes(c, w, fold), w.of, size)
