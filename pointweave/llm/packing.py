"""Hierarchical packing of tokenised documents into sequences of several context sizes.

Each document is cut into full windows of the largest tier and a rest; the rest is routed to the
smallest tier that holds it. Each tier packs its rests best fit first, then fills what is left of
a window from shorter tiers and closes the last gap with a cut piece. Sequences that leave a tier
are exactly as long as the tier. Finished sequences are dealt into step groups of equal tokens.

One task packs what it reads, as a stream: its pools hold a bounded number of tokens, nothing is
shuffled, and a task that is run again packs the same rows alike. At its end each task cuts what
its pools still hold into windows and powers of two, so that no sequence needs padding.

Defined results: rows without a doc_id are left out; null or empty text has the end id alone;
repeated rows are packed each on their own; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .workspace import small_batches

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


# The normaliser and the cut into words of word_bpe_49k.json, as the file has them.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_CUT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Kinds of bytes: white space, letters, digits, punctuation; words with any other byte, ' or < are left whole.
_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _MARK
_KIND[[39, 60]] = _ODD
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[kernel.SPACE] = _SPACE
_SLICE = 1 << 18


class WordTokenizer:
    """Token ids of whole texts by way of their distinct parts, each encoded once.

    With the normaliser and the cut above no token reaches over white space, and an ASCII word falls
    into runs of letters, runs of marks and single digits that are merged apart: these parts go
    straight to the merges, other words through the whole tokenizer. Any other tokenizer file
    encodes each text as a whole. known_parts bounds the memory of a worker: beyond it, parts that
    were met in one chunk only are forgotten.
    """

    def __init__(self, path: str, known_parts: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known_parts = Tokenizer.from_file(path), known_parts
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = all(x["special"] and not x["normalized"] and re.fullmatch(r"<\|\w+\|>", x["content"]) for x in spec["added_tokens"])
        self.by_parts = special and spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == _CUT and spec["model"]["type"] == "BPE" and not spec["model"]["dropout"]
        self._forget(np.empty(0, np.int64))

    def _forget(self, keep: np.ndarray) -> None:
        """Hold no parts but those at some places of the table."""
        if not len(keep):
            self.known, self.begin, self.size, self.again = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
            self.flat, self.used = np.empty(1 << 20, np.uint32), 0
            return
        size = self.size[keep]
        begin = np.cumsum(size) - size
        ids = self.flat[np.arange(int(size.sum())) + np.repeat(self.begin[keep] - begin, size)]
        self.known, self.begin, self.size, self.again = self.known[keep], begin, size, np.zeros(len(keep), bool)
        self.flat[: len(ids)], self.used = ids, len(ids)

    def _learn(self, hashes: np.ndarray, got: list[list[int]]) -> None:
        size = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum()))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        begin = self.used + np.cumsum(size) - size
        self.used += len(flat)
        at = np.searchsorted(self.known, hashes)
        self.known, self.begin, self.size = np.insert(self.known, at, hashes), np.insert(self.begin, at, begin), np.insert(self.size, at, size)
        self.again = np.insert(self.again, at, False)

    @staticmethod
    def parts(c: kernel.Chunk) -> tuple[kernel.Words, np.ndarray]:
        """The parts of a chunk, and which of them go straight to the merges."""
        w = kernel.words(c)
        kind = _KIND[c.data]
        odd = np.concatenate(([0], np.cumsum(kind == _ODD)))
        plain = odd[w.end] == odd[w.start]
        step = np.zeros(len(kind) + 1, np.int8)
        step[w.start[plain]] += 1
        step[w.end[plain]] -= 1
        cut = np.cumsum(step, dtype=np.int8)[:-1] > 0
        cut[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        cut[w.start] = True
        start = np.flatnonzero(cut)
        word = np.searchsorted(w.start, start, "right") - 1
        return kernel.Words(start, np.minimum(np.append(start[1:], len(kind)), w.end[word]), np.searchsorted(start, c.bounds)), plain[word]

    def _new(self, raw: bytes, lower: np.ndarray, start: np.ndarray, end: np.ndarray, plain: np.ndarray) -> list[list[int]]:
        """Ids of parts, those that are plain before the others."""
        size = end[plain] - start[plain] + 1
        first = np.cumsum(size) - size
        joined = lower[np.arange(int(size.sum())) + np.repeat(np.append(start[plain], 0)[:-1] - first, size)]
        joined[first + size - 1] = 10
        merge = self.tokenizer.model.tokenize
        ids = [[t.id for t in merge(x)] for x in joined.tobytes().decode("ascii").split("\n")[:-1]]
        rest = [raw[s:e].decode("utf-8", "replace") for s, e in zip(start[~plain].tolist(), end[~plain].tolist(), strict=True)]
        return ids + [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first document, ids of a chunk, bounds of its documents in them)."""
        for c in kernel.chunks(column):
            raw = c.data.tobytes()
            if not self.by_parts:
                texts = [raw[s:e].decode("utf-8", "replace") for s, e in zip(c.bounds[:-1].tolist(), c.bounds[1:].tolist(), strict=True)]
                got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                yield c.first, np.fromiter(chain.from_iterable(got), np.uint32), np.concatenate(([0], np.cumsum([len(x) for x in got])))
                continue
            w, plain = self.parts(c)
            h = kernel.word_hashes(c, w, kernel.IDENTITY if b"<|" in raw else kernel.LOWER)
            lower = np.append(kernel.LOWER[c.data], np.uint8(10))
            ids, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
            for i in range(0, len(h), _SLICE):  # of a very long document
                at = slice(i, i + _SLICE)
                x, size = self._look_up(h[at], lambda k, at=at: self._new(raw, lower, w.start[at][k], w.end[at][k], plain[at][k]), plain[at])
                ids.append(x)
                sizes.append(size)
            yield c.first, np.concatenate(ids), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))[w.of]

    def _look_up(self, h: np.ndarray, new_ids, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, one after another, and how many each has."""
        if len(self.known) > self.known_parts:
            keep = np.flatnonzero(self.again)
            self._forget(keep if len(keep) < self.known_parts // 2 else keep[:0])
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, u)
        new = np.ones(len(u), bool) if not len(self.known) else self.known[np.minimum(at, len(self.known) - 1)] != u
        self.again[at[~new]] = True
        if new.any():
            order = np.flatnonzero(new)
            order = np.concatenate((order[plain[first[order]]], order[~plain[first[order]]]))
            got = new_ids(first[order])
            back = np.argsort(order, kind="stable")
            self._learn(u[new], [got[i] for i in back.tolist()])
            at = np.searchsorted(self.known, u)
        size, begin = self.size[at][inverse], self.begin[at][inverse]
        end = np.cumsum(size)
        return self.flat[np.arange(int(end[-1])) + np.repeat(begin - end + size, size)], size


@dataclass
class Piece:
    doc_id: int
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:n], self.doc_tokens), Piece(self.doc_id, self.start + n, self.ids[n:], self.doc_tokens)


@dataclass
class Packer:
    """Pools of one task. tiers: context sizes, powers of two; pool: windows' worth of tokens a tier gathers before it packs."""

    tiers: tuple[int, ...]
    step_tokens: int
    pool: int = 16
    pools: dict[int, list[Piece]] = field(default_factory=dict)
    held: dict[int, list[list[Piece]]] = field(default_factory=dict)
    load: dict[int, int] = field(default_factory=dict)

    def __post_init__(self):
        self.pools, self.held, self.load = {t: [] for t in self.tiers}, {t: [] for t in self.tiers}, dict.fromkeys(self.tiers, 0)

    def add(self, p: Piece) -> Iterator[list[list[Piece]]]:
        """Take a document; yields groups of sequences that are complete."""
        top = self.tiers[-1]
        while len(p.ids) >= top:
            window, p = p.cut(top)
            yield from self._finish([window])
        if len(p.ids):
            t = self._route(p)
            if self.load[t] >= self.pool * t:
                yield from self._pack(t)

    def _route(self, p: Piece) -> int:
        t = self.tiers[bisect_left(self.tiers, len(p.ids))]
        self.pools[t].append(p)
        self.load[t] += len(p.ids)
        return t

    def _take(self, t: int, i: int = -1) -> Piece:
        p = self.pools[t].pop(i)
        self.load[t] -= len(p.ids)
        return p

    def _pack(self, t: int) -> Iterator[list[list[Piece]]]:
        """Windows of tier t from its pool: best fit, longest first; gaps go to shorter tiers."""
        windows: list[list[Piece]] = []
        room: list[tuple[int, int]] = []  # what each window has left, least first
        for p in sorted(self.pools[t], key=lambda x: -len(x.ids)):
            n = len(p.ids)
            k = bisect_left(room, (n, -1))
            left, i = room.pop(k) if k < len(room) else (t, len(windows))
            if i == len(windows):
                windows.append([])
            windows[i].append(p)
            insort(room, (left - n, i))
        self.pools[t], self.load[t] = [], 0
        for gap, i in room:
            window = windows[i]
            gap = self._fill(window, gap, t)
            if gap:  # nothing shorter is at hand: the pieces wait for the next documents
                self.pools[t] += window
                self.load[t] += sum(len(p.ids) for p in window)
            else:
                yield from self._finish(window)

    def _fill(self, window: list[Piece], gap: int, t: int) -> int:
        shorter = [x for x in reversed(self.tiers) if x <= t]
        for s in shorter[1:] or shorter:
            pool = self.pools[s]
            for i in range(len(pool) - 1, -1, -1):
                if gap and len(pool[i].ids) <= gap:
                    p = self._take(s, i)
                    window.append(p)
                    gap -= len(p.ids)
        if gap:
            for s in shorter:
                if self.pools[s]:
                    piece, rest = self._take(s).cut(gap)
                    window.append(piece)
                    if len(rest.ids):
                        self._route(rest)
                    return gap - len(piece.ids)
        return gap

    def _finish(self, window: list[Piece]) -> Iterator[list[list[Piece]]]:
        t = sum(len(p.ids) for p in window)
        self.held[t].append(window)
        if len(self.held[t]) * t >= self.step_tokens:
            yield self.held[t]
            self.held[t] = []

    def end(self) -> Iterator[list[list[Piece]]]:
        """What is left: windows, then powers of two; then groups of the tiers' odd sequences, balanced by tokens."""
        rest = [p for t in reversed(self.tiers) for p in self.pools[t]]
        left, odd = sum(len(p.ids) for p in rest), []
        while left:
            want = min(self.tiers[-1], 1 << (left.bit_length() - 1))
            left -= want
            window: list[Piece] = []
            while want:
                p = rest.pop()
                if len(p.ids) > want:
                    p, more = p.cut(want)
                    rest.append(more)
                window.append(p)
                want -= len(p.ids)
            odd.append(window)
        odd += [w for t in self.tiers for w in self.held[t]]
        size = lambda w: sum(len(p.ids) for p in w)
        total = sum(map(size, odd))
        if total:
            groups: list[list[list[Piece]]] = [[] for _ in range(-(-total // self.step_tokens))]
            load = [0] * len(groups)
            for w in sorted(odd, key=size, reverse=True):
                i = load.index(min(load))
                groups[i].append(w)
                load[i] += size(w)
            yield from groups


_tokenizers: dict[str, WordTokenizer] = {}


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = (256, 512, 1024, 2048), end_id: int = 1, step_tokens: int = 65536) -> DataFrame:
    """One row per piece: SCHEMA. ids holds little-endian unsigned 32-bit ids; tier is the length of the sequence."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _tokenizers:
            _tokenizers[tokenizer_path] = WordTokenizer(tokenizer_path)
        tokenizer, packer = _tokenizers[tokenizer_path], Packer(tuple(tiers), step_tokens)
        base, done, groups, rows, size = TaskContext.get().partitionId() << 33, 0, 0, [], 0

        def out() -> pa.RecordBatch:
            nonlocal rows, size
            cols = list(zip(*rows, strict=True))
            rows, size = [], 0
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

        def emit(group: list[list[Piece]]) -> Iterator[pa.RecordBatch]:
            nonlocal done, groups, size
            for window in group:
                at, tier = 0, sum(len(p.ids) for p in window)
                for p in window:
                    rows.append((p.doc_id, p.start, len(p.ids), p.ids.astype("<u4").tobytes(), p.doc_tokens, base + done, at, tier, base + groups))
                    at += len(p.ids)
                size += tier
                done += 1
                if size > 1 << 20:
                    yield out()
            groups += 1

        end = np.array([end_id], np.uint32)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, ids, bounds in tokenizer.encode(batch.column(1)):
                for i in range(len(bounds) - 1):
                    own = np.concatenate((ids[bounds[i] : bounds[i + 1]], end))
                    for group in packer.add(Piece(doc_ids[first + i], 0, own, len(own))):
                        yield from emit(group)
        for group in packer.end():
            yield from emit(group)
        if rows:
            yield out()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null").mapInArrow(run, SCHEMA)
