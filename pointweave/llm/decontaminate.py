"""Benchmark passages in documents: pigeonhole search with an edit budget, verified by bit-parallel distance.

An item of n words may differ from a passage by k = floor(n * tolerance) word edits. Split into
k + 1 pieces, at least one piece stands unchanged in any such passage: exact hits of pieces
propose places, and Myers' bit-parallel algorithm finds the least edit distance of the whole item
to any part of the text around them. Words are runs of letters and digits, lower-cased, so case,
punctuation and white space don't count.

The documents are read as a stream and never shuffled. The items are the stated query set: they
go to the executors in blocks of bounded size, one scan of the documents for each.

Defined results: rows without an id are left out; null or empty text has no hit; items without a
word match nothing; repeated items each report; repeated rows report once; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .workspace import small_batches

SCHEMA = "doc_id long, item_id long, distance long, item_words long, start_word long, end_word long"
_TABLE_BITS = 20


def myers(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of pattern to any part of text, and where the first such part ends."""
    m = len(pattern)
    where: dict[int, int] = defaultdict(int)
    for i, x in enumerate(pattern):
        where[x] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, x in enumerate(text, 1):
        eq = where.get(x, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up, down = (minus | ~(horizontal | plus)) & full, plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = (down | ~(vertical | up)) & full, up & vertical
        if score < best:
            best, end = score, j
    return best, end


def find(pattern: list[int], text: list[int]) -> tuple[int, int, int]:
    """(distance, start, end) of the part of text that is closest to pattern."""
    distance, end = myers(pattern, text)
    back, length = myers(pattern[::-1], text[:end][::-1])
    return distance, end - length if back == distance else 0, end


@dataclass
class Items:
    """One block of items, ready to search. pieces: by length, sorted hashes, then item and offset of each."""

    ids: list[int]
    words: list[list[int]]
    budget: list[int]
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    seen: dict[int, np.ndarray]

    @classmethod
    def of(cls, ids: list[int], texts: list[str], tolerance: float) -> Items:
        hashes = []
        for c in kernel.chunks(pa.array(texts, pa.string())):
            w = kernel.words(c, ~kernel.ALNUM)
            h = kernel.word_hashes(c, w)
            hashes += [h[w.of[i] : w.of[i + 1]] for i in range(c.n)]
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        budget = []
        for i, h in enumerate(hashes):
            k = int(len(h) * tolerance)
            budget.append(k)
            cut = [len(h) * j // (k + 1) for j in range(k + 2)]
            for s, e in zip(cut, cut[1:], strict=False):
                if e > s:
                    x, _ = kernel.windows(h[s:e], np.array([0, e - s]), e - s)
                    found[e - s].append((int(x[0]), i, s))
        pieces, seen = {}, {}
        for size, rows in found.items():
            rows.sort()
            pieces[size] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
            seen[size] = np.zeros(1 << _TABLE_BITS, bool)
            seen[size][(pieces[size][0] >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        return cls(ids, [h.tolist() for h in hashes], budget, pieces, seen)


@dataclass(frozen=True)
class Decontaminator:
    """tolerance: word edits a word of the item; items, chars: of one block, about (an item of more characters is a block of its own)."""

    tolerance: float = 0.2
    items: int = 20_000
    chars: int = 16_000_000

    def matches(self, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
        """SCHEMA: each document and item that occurs in it, with the closest place (in words of the document)."""
        spark = docs.sparkSession
        small_batches(spark)
        items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.lower(F.col(item_text).cast("string")).alias("text")).filter("item_id is not null and text is not null")
        short = F.length("text") <= self.chars
        count, chars = items.filter(short).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
        blocks = max(1, -(-count // self.items), -(-chars // self.chars))
        long = [r.item_id for r in items.filter(~short).select("item_id").distinct().orderBy("item_id").collect()]
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col).cast("string")).alias("text")).filter("doc_id is not null")

        def scan(these) -> DataFrame:
            rows = items.filter(these).orderBy("item_id", "text").collect()
            shared = spark.sparkContext.broadcast(Items.of([r.item_id for r in rows], [r.text for r in rows], self.tolerance))
            return texts.mapInArrow(lambda b: _search(b, shared), SCHEMA)

        parts = [short & (F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) for b in range(blocks)] + [~short & (F.col("item_id") == i) for i in long]
        return reduce(DataFrame.unionByName, map(scan, parts)).distinct()

    def clean(self, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **columns: str) -> DataFrame:
        """The rows of docs, all columns as they are, in which no item occurs."""
        from .minmax_dedup import without
        from .workspace import Workspace

        gone = Workspace(docs.sparkSession, "decontaminate").keep(self.matches(docs, benchmark, id_col, **columns).select("doc_id").distinct(), "gone")
        return without(docs, gone, id_col).select(*docs.columns)


def _search(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    items: Items = shared.value
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    for batch in batches:
        out: list[tuple[int, ...]] = []
        doc_ids = batch.column(0)
        for c in kernel.chunks(batch.column(1)):
            w = kernel.words(c, ~kernel.ALNUM)
            h = kernel.word_hashes(c, w)
            places: dict[tuple[int, int], list[int]] = defaultdict(list)
            for size, (hashes, item, offset) in items.pieces.items():
                x, at = kernel.windows(h, w.of, size)
                near = np.flatnonzero(items.seen[size][(x >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
                first, last = np.searchsorted(hashes, x[near], "left"), np.searchsorted(hashes, x[near], "right")
                for j in np.flatnonzero(last > first).tolist():
                    pos = int(at[near[j]])
                    doc = int(np.searchsorted(w.of, pos, "right")) - 1
                    for i in range(first[j], last[j]):
                        places[doc, int(item[i])].append(pos - int(offset[i]))
            for (doc, i), starts in places.items():
                k, pattern, begin, end = items.budget[i], items.words[i], int(w.of[doc]), int(w.of[doc + 1])
                best = None
                starts.sort()
                spans: list[list[int]] = []
                for s in starts:  # places whose surroundings overlap are searched at once
                    lo, hi = max(begin, s - k), min(end, s + len(pattern) + k)
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(hi, spans[-1][1])
                    else:
                        spans.append([lo, hi])
                for lo, hi in spans:
                    distance, s, e = find(pattern, h[lo:hi].tolist())
                    if distance <= k and (best is None or distance < best[0]):
                        best = distance, lo - begin + s, lo - begin + e
                if best:
                    out.append((doc_ids[c.first + doc].as_py(), items.ids[i], best[0], len(pattern), best[1], best[2]))
        cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=names)
