"""Exact repeats of long word runs across documents, found by fixed-block anchors.

Each document's words are cut into non-overlapping reference blocks of half a window. A window
that stands in two documents holds a whole block of either; the index of all blocks is probed with
every rolling run of that length, and a block's run that two documents or more have is an anchor.
Anchors extend to windows: the windows that hold one are told by every document that has them, and
the least document of each decides. Windows next to each other make up the maximal repeats, of
which all documents but the first lose their words.

Rows are pre-aggregated before a shuffle or joined in a way that splits skewed keys, so a passage
that many documents share is no hot spot; no group is collected but the windows of one document.
Windows are held against each other by 64-bit hashes of their words: among n different windows two
are taken for one with a probability of about n * n / 2**65.
The filters between the passes are of bounded size and only spare work: what they let by wrongly
is told apart by the exact shuffles behind them. With more blocks than a filter holds, more rows
are shuffled, at most in proportion to the input, and the result is the same.

Defined results: rows without an id are left out; null or empty text has no words and nothing is
removed; a doc_id in several rows is one document, of which each row is reported; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitfilter, kernel
from .workspace import Workspace, release

SCHEMA = "doc_id long, n_words long, spans array<struct<start: long, end: long>>, kept_text string"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_text", pa.string())]
)


@dataclass(frozen=True)
class SubstringDedup:
    """window: words that a repeat has at least; filter_bits: the largest filter has 2**filter_bits bits."""

    window: int = 50
    filter_bits: int = bitfilter.MAX_BITS

    @property
    def block(self) -> int:
        return self.window // 2

    def cut(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """SCHEMA: of every row the removed spans (in words) and the words that are kept, joined by one space."""
        spark, work, block, window = docs.sparkSession, Workspace(docs.sparkSession, "repeats"), self.block, self.window
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
        size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        index = bitfilter.build(spark, texts, "h", size // (4 * block), self.filter_bits, made=lambda b: _blocks(b, block))
        met = texts.mapInArrow(lambda b: _probe(b, index, block), "h long, doc_id long").groupBy("h").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"))
        anchors = work.keep(met.filter("x < y").select("h"), "anchors")
        release(spark)
        anchored = bitfilter.build(spark, anchors, "h", anchors.count(), self.filter_bits)

        told = texts.mapInArrow(lambda b: _extend(b, anchored, block, window), "h long, doc_id long, at int")
        # a table of its own: a join that shares a stage with this sum could not be split where a window is frequent
        first = work.keep(told.groupBy("h").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).filter("x < y").select("h", "x"), "first")
        release(spark)
        again = work.keep(told.join(first, "h").filter("doc_id > x").select("doc_id", "at", "h"), "again")
        release(spark)
        ids = again.select("doc_id").distinct().select(F.xxhash64("doc_id").alias("k"))
        touched = bitfilter.build(spark, ids, "k", ids.count(), self.filter_bits)
        keyed = texts.select("doc_id", F.xxhash64("doc_id").alias("k"), "text")
        whole = keyed.mapInArrow(lambda b: _whole(b, touched), SCHEMA)
        held = keyed.mapInArrow(lambda b: _held(b, touched), "doc_id long, text string")
        windows = again.groupBy("doc_id").agg(F.collect_list("at").alias("at"), F.collect_list("h").alias("h"))
        return whole.unionByName(held.join(windows, "doc_id", "left").select("doc_id", "text", "at", "h").mapInArrow(lambda b: _remove(b, window), SCHEMA))


def _hashes(batch: pa.RecordBatch, column: int) -> Iterator[tuple[kernel.Chunk, kernel.Words, np.ndarray]]:
    for c in kernel.chunks(batch.column(column)):
        w = kernel.words(c)
        yield c, w, kernel.word_hashes(c, w)


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Hash of each reference block."""
    for batch in batches:
        for _, w, h in _hashes(batch, 1):
            x, at = kernel.windows(h, w.of, block)
            own = (at - np.repeat(w.of[:-1], np.diff(w.of))[at]) % block == 0
            yield pa.RecordBatch.from_arrays([pa.array(x[own].view(np.int64))], names=["h"])


def _probe(batches: Iterator[pa.RecordBatch], index, block: int) -> Iterator[pa.RecordBatch]:
    """Every rolling run that the index may hold, with its document."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for c, w, h in _hashes(batch, 1):
            x, at = kernel.windows(h, w.of, block)
            hit = index.value.has(x)
            yield pa.RecordBatch.from_arrays([pa.array(x[hit].view(np.int64)), pa.array(ids[c.first + w.doc()[at[hit]]])], names=["h", "doc_id"])


def _extend(batches: Iterator[pa.RecordBatch], anchored, block: int, window: int) -> Iterator[pa.RecordBatch]:
    """Every window that holds an anchor, with its document and its place there."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for c, w, h in _hashes(batch, 1):
            x, at = kernel.windows(h, w.of, block)
            anchors = np.zeros(len(h) + 1, np.int64)
            anchors[at[anchored.value.has(x)] + 1] = 1
            before = np.cumsum(anchors)
            x, at = kernel.windows(h, w.of, window)
            near = before[at + window - block + 1] > before[at] if len(at) else np.zeros(0, bool)
            x, at = x[near], at[near]
            doc = w.doc()[at]
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(ids[c.first + doc]), pa.array((at - w.of[doc]).astype(np.int32))], names=["h", "doc_id", "at"])


def _out(ids: pa.Array, words: np.ndarray, edges: list[np.ndarray], kept: pa.Array) -> pa.RecordBatch:
    """edges: starts and ends of each row's spans, in turn."""
    flat = np.concatenate([np.empty(0, np.int64), *edges])
    pairs = pa.StructArray.from_arrays([pa.array(flat[::2]), pa.array(flat[1::2])], ["start", "end"])
    bounds = np.concatenate(([0], np.cumsum([len(x) // 2 for x in edges]))).astype(np.int32)
    return pa.RecordBatch.from_arrays([ids, pa.array(words.astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), pairs), kept], schema=_ARROW)


def _whole(batches: Iterator[pa.RecordBatch], touched) -> Iterator[pa.RecordBatch]:
    """Rows of documents that surely lose nothing."""
    for batch in batches:
        rows = batch.filter(pa.array(~touched.value.has(batch.column(1).to_numpy().view(np.uint64))))
        for c in kernel.chunks(rows.column(2)):
            w = kernel.words(c)
            yield _out(rows.column(0)[c.first : c.first + c.n], np.diff(w.of), [np.empty(0, np.int64)] * c.n, kernel.rejoined(c, w, np.ones(len(w.start), bool)))


def _held(batches: Iterator[pa.RecordBatch], touched) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.filter(pa.array(touched.value.has(batch.column(1).to_numpy().view(np.uint64))))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2)], names=["doc_id", "text"])


def _remove(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows with the windows that are said to stand in an earlier document; a window counts where it does stand in this row."""
    for batch in batches:
        places, hashes = batch.column(2), batch.column(3)
        for c, w, h in _hashes(batch, 1):
            x, at = kernel.windows(h, w.of, window)
            out, edges = np.zeros(len(h), bool), []
            for i in range(c.n):
                row, start, end = c.first + i, int(w.of[i]), int(w.of[i + 1])
                if places[row].is_valid and len(places[row].values):
                    gone = np.zeros(end - start + 1, np.int64)
                    p, want = places[row].values.to_numpy(), hashes[row].values.to_numpy().view(np.uint64)
                    j = np.searchsorted(at, start + p)
                    ok = (j < len(at)) & (start + p + window <= end)
                    j, p, want = j[ok], p[ok], want[ok]
                    p = p[(at[j] == start + p) & (x[j] == want)]
                    np.add.at(gone, p, 1)
                    np.add.at(gone, p + window, -1)
                    out[start:end] = np.cumsum(gone)[:-1] > 0
                edges.append(np.flatnonzero(np.diff(np.concatenate(([False], out[start:end], [False])).astype(np.int8))))
            yield _out(batch.column(0)[c.first : c.first + c.n], np.diff(w.of), edges, kernel.rejoined(c, w, ~out))
