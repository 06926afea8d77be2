"""A bit filter of bounded size: tells which 64-bit keys are surely absent.

It only ever saves work. Keys that pass are checked exactly by a shuffle, so a filter that is
too small for its keys makes the shuffle larger and never the result wrong. One filter word
holds three bits of each of its keys, hence a probe reads one word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import blobs

#: Largest filter: 2**27 bits are 16 MB in each Python worker and on the driver.
MAX_BITS = 27
BITS_A_KEY = 16
#: Words of the filter that one task puts together at a time: 64 KB.
PART = 1 << 13


class BitFilter:
    def __init__(self, words: np.ndarray):
        self.words, self.shift = words, np.uint64(64 - (len(words).bit_length() - 1))

    def has(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64, copy=False)
        one, six = np.uint64(1), np.uint64(63)
        mask = (one << (keys & six)) | (one << ((keys >> np.uint64(6)) & six)) | (one << ((keys >> np.uint64(12)) & six))
        return (self.words[(keys >> self.shift).astype(np.int64)] & mask) == mask


def build(spark: SparkSession, keys: DataFrame, column: str, count: int, max_bits: int = MAX_BITS, made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None):
    """Broadcast of a BitFilter over a column of well mixed 64-bit keys; `count` rows are expected.

    made: makes batches of the keys alone from those of `keys`, in the Python worker that takes their bits. A step
    of its own in front would hold a second worker for each core, and Spark keeps all workers for later steps.

    Executors send the bits of keys, part of the filter by part of it, and then whole parts: what
    reaches the driver is the filter, of 2**max_bits bits at most, whatever the number of keys.
    """
    bits = min(max_bits, max(16, int(max(1, count) * BITS_A_KEY - 1).bit_length()))
    size = 1 << (bits - 6)
    part = min(size, PART)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in made(batches) if made else batches:
            held.append(_bits_of(batch.column(0).to_numpy().view(np.uint64), bits))
            n += len(held[-1])
            if n > 1 << 21:
                yield from out(held)
                held, n = [], 0
        if held:
            yield from out(held)

    def out(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        x = np.unique(np.concatenate(held))
        yield from blobs.deal(0, ("d8",), (x >> np.uint64(18)).astype(np.int64) // part, x)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, words = None, None
        for bucket, _, (x,), _ in blobs.read(batches, {0: ("d8",)}):
            if bucket != at:
                if words is not None:
                    yield blobs.row(0, [at], [words.tobytes()])
                at, words = bucket, np.zeros(part, np.uint64)
            _set(words, x, at * part)
        if words is not None:
            yield blobs.row(0, [at], [words.tobytes()])

    table = blobs.gathered((keys if made else keys.select(column)).mapInArrow(send, blobs.SCHEMA)).mapInArrow(gather, blobs.SCHEMA).toArrow()
    words = np.zeros(size, np.uint64)
    for bucket, blob in zip(table["bucket"].to_pylist(), table["blob"], strict=True):
        words[bucket * part : (bucket + 1) * part] = np.frombuffer(blob.as_buffer(), np.uint64)
    return spark.sparkContext.broadcast(BitFilter(words))


def _bits_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The word of the filter that a key falls into, above the places of its three bits."""
    return (keys >> np.uint64(64 - (bits - 6))) << np.uint64(18) | keys & np.uint64((1 << 18) - 1)


def _set(words: np.ndarray, x: np.ndarray, first: int) -> None:
    one, six = np.uint64(1), np.uint64(63)
    mask = (one << (x & six)) | (one << ((x >> np.uint64(6)) & six)) | (one << ((x >> np.uint64(12)) & six))
    at = (x >> np.uint64(18)).astype(np.int64) - first
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.empty(0, np.int64)
    if len(new):  # x is sorted, so the bits of one word stand together
        words[at[new]] |= np.bitwise_or.reduceat(mask, new)
