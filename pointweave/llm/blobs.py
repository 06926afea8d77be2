"""Shuffles of many small records as few rows: records of one bucket travel as one binary value.

A row is (bucket, kind, blob). A kind is a list of numpy types, and a blob holds that many arrays
of equal length, one after another. The type d8 stands for unsigned 64-bit numbers in about
ascending order, of which the differences are written, byte by byte of all of them, so that what they
have in common compresses. Buckets are drawn from hashes, so they are alike in size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "bucket long, kind int, blob binary"
#: Records of one blob at most.
LONGEST = 1 << 14


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of well mixed 64-bit keys, for up to 2**32 buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _bytes(x: np.ndarray, kind: str) -> bytes:
    if kind != "d8":
        return x.tobytes()
    step = np.diff(x, prepend=np.uint64(0))
    return np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes()


def _array(blob: bytes, kind: str, n: int, at: int) -> np.ndarray:
    if kind != "d8":
        return np.frombuffer(blob, kind, n, at)
    planes = np.frombuffer(blob, np.uint8, 8 * n, at).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _plain(kind: str) -> np.dtype:
    return np.dtype("u8" if kind == "d8" else kind)


def deal(kind: int, types: tuple[str, ...], bucket: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of records, by bucket; the order of records within a bucket is kept."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order].astype(_plain(t), copy=False) for c, t in zip(columns, types, strict=True)]
    cut = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
    ids, blobs, held = [], [], 0
    for s, e in zip(cut, cut[1:], strict=False):
        for i in range(s, e, LONGEST):
            j = min(e, i + LONGEST)
            ids.append(int(bucket[s]))
            blobs.append(b"".join(_bytes(c[i:j], t) for c, t in zip(columns, types, strict=True)))
            held += len(blobs[-1])
            if held > 1 << 22:
                yield row(kind, ids, blobs)
                ids, blobs, held = [], [], 0
    if ids:
        yield row(kind, ids, blobs)


def row(kind: int, ids: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.full(len(ids), kind, np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "kind", "blob"])


def gathered(rows: DataFrame) -> DataFrame:
    """Rows with those of one bucket next to each other, by kind."""
    return rows.repartition("bucket").sortWithinPartitions("bucket", "kind")


def read(batches: Iterator[pa.RecordBatch], types: dict[int, tuple[str, ...]]) -> Iterator[tuple[int, int, tuple[np.ndarray, ...], bytes]]:
    """(bucket, kind, arrays, blob) of each row."""
    sizes = {k: [_plain(t).itemsize for t in v] for k, v in types.items()}
    for batch in batches:
        for bucket, kind, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            blob = value.as_py()
            n, at, out = len(blob) // sum(sizes[kind]), 0, []
            for t, size in zip(types[kind], sizes[kind], strict=True):
                out.append(_array(blob, t, n, at))
                at += n * size
            yield bucket, kind, tuple(out), blob


def add_up(keys: int, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct values of the first `keys` columns, ascending, and the sums of the others."""
    if not len(columns[0]):
        return columns
    order = np.lexsort(columns[:keys][::-1]) if keys > 1 else np.argsort(columns[0], kind="stable")
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[0] = True
    for c in columns[:keys]:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return (*[c[first] for c in columns[:keys]], *[np.add.reduceat(c, first) for c in columns[keys:]])


def joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
