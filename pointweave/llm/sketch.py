"""Bottom-k sketches of word-shingle hashes.

A sketch keeps the k least hashes of a document's distinct shingles. Sketches of parts merge into
the sketch of the whole; two sketches estimate resemblance (the share of the union's k least
hashes that both hold), containment and distinct shingle counts, exactly where a set has fewer
than k shingles. A fingerprint is the base64 text of the hashes, ascending, as little-endian
64-bit numbers.

Defined results: null or empty text, or text without a word, has the empty sketch, which is like
another empty one (1) and unlike all others (0); fewer words than a shingle make one shingle.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .workspace import small_batches

K, SHINGLE = 128, 5


def sketches(column: pa.Array, k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The k least shingle hashes of each text, ascending."""
    return [s[:k] for _, sets in kernel.text_shingles(column, shingle) for s in sets]


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def decode(fingerprint: str | None) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint or ""), "<u8")


def merge(parts: list[np.ndarray], k: int = K) -> np.ndarray:
    return np.unique(np.concatenate(parts))[:k] if parts else np.empty(0, np.uint64)


def distinct(s: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(s)) if len(s) < k else (k - 1) / ((float(s[-1]) + 1) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.sort(np.concatenate((a, b)))
    twice = union[1:] == union[:-1]
    first = np.flatnonzero(np.concatenate(([True], ~twice)))[:k]
    both = np.append(twice, False)[first].sum()
    return float(both / len(first))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    if not len(a):
        return float(not len(b))
    j, x, y = resemblance(a, b, k), distinct(a, k), distinct(b, k)
    return min(1.0, j * (x + y) / (1 + j) / x)


def fingerprint(text: Column | str, k: int = K, shingle: int = SHINGLE) -> Column:
    """Fingerprint of a text column."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([encode(s) for s in sketches(column, k, shingle)], pa.string())

    return run(F.col(text) if isinstance(text, str) else text)


def _of_two(f) -> Column:
    def column(a: Column | str, b: Column | str, k: int = K) -> Column:
        @F.pandas_udf("double")
        def run(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([f(decode(p), decode(q), k) for p, q in zip(x, y, strict=True)])

        return run(a, b)

    return column


resemblance_of, containment_of = _of_two(resemblance), _of_two(containment)


def distinct_of(a: Column | str, k: int = K) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([distinct(decode(p), k) for p in x])

    return run(a)


def merged(df: DataFrame, keys: list[str], fingerprint_col: str = "fingerprint", k: int = K) -> DataFrame:
    """One fingerprint for each key: that of all its parts' shingles.

    Each task merges its parts of a key before the shuffle, so a key of many parts gathers one
    sketch of k hashes a task.
    """
    rows = df.select(*keys, F.col(fingerprint_col).alias("fingerprint"))
    names = rows.columns

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = pdf.groupby(keys, dropna=False, sort=False)["fingerprint"]
        return pd.DataFrame([(*key, encode(merge([decode(p) for p in x], k))) for key, x in parts], columns=names, dtype=object)

    def early(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in frames:
            held = one(pdf if held is None else pd.concat([held, pdf]))
            if len(held) > 50_000:
                yield held
                held = None
        if held is not None:
            yield held

    out = rows.mapInPandas(early, rows.schema).groupBy(*keys).applyInPandas(one, rows.schema)
    return out.withColumnRenamed("fingerprint", fingerprint_col)


def each_with_next(docs: DataFrame, run, schema: str, id_col: str = "doc_id", text_col: str = "text", block: int = 512, blocks: int = 10_000) -> DataFrame:
    """mapInArrow with every text's successor by id at hand: run(ids, texts, next texts) -> RecordBatch.

    Rows are dealt once, into blocks of neighbouring ids (about `block` of them, at most `blocks`
    blocks), and streamed in order of id. A block also gets the first row of the next one; the
    last block gets the first row of all. Rows without an id are left out; null text is empty; rows
    of one id stand in order of their texts, and a block that begins with several of them hands all
    of them on, of which the last row before takes the first; a single row is its own successor.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).filter("doc_id is not null")
    ids = rows.select("doc_id")
    n = ids.count()
    parts = max(1, min(blocks, -(-n // block)))
    bounds = sorted(set(ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or [])) if parts > 1 else []
    shared = spark.sparkContext.broadcast(np.array(bounds, np.int64))

    @F.pandas_udf("int")
    def block_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, x.to_numpy(), "left")).astype("int32")

    first = {r.b: r.m for r in ids.groupBy(block_of("doc_id").alias("b")).agg(F.min("doc_id").alias("m")).collect()}
    order = sorted(first)
    guests = spark.sparkContext.broadcast({first[b]: order[i - 1] for i, b in enumerate(order)})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy()
            own = np.searchsorted(shared.value, x, "left").astype(np.int32)
            guest = np.array([i for i, v in enumerate(x.tolist()) if v in guests.value], np.int64)
            to = np.array([guests.value[v] for v in x[guest].tolist()], np.int32)
            at = pa.array(np.concatenate((np.arange(len(x)), guest)))
            late = np.concatenate((np.zeros(len(x), bool), np.ones(len(guest), bool)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((own, to))), pa.array(late), batch.column(0).take(at), batch.column(1).take(at)], names=["block", "late", "doc_id", "text"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, None  # a row whose successor hasn't come yet
        for batch in batches:
            out_ids, texts, following = [], [], []
            for b, late, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and b == block:
                    out_ids.append(held[0])
                    texts.append(held[1])
                    following.append(text)
                block, held = b, None if late else (i, text)
            if out_ids:
                yield from run(out_ids, texts, following)

    dealt = rows.mapInArrow(deal, "block int, late boolean, doc_id long, text string")
    return dealt.repartition("block").sortWithinPartitions("block", "late", "doc_id", "text").mapInArrow(pairs, schema)
