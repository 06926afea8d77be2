"""Candidates for near-equal sets among many that share most of their members.

Two sets whose intersection holds num/den of their union, with all members in one order, have the
first common member among the first few of either: an n-set has it before place
n - ceil(num * n / den) + 1. Members are ordered by how often they occur, rare ones first, so what
all sets of a crowd have in common stands at the end and proposes nothing. The condition is a
necessary one: no pair is lost, whatever the order.

How often a member occurs is told by a table of slots, in which members share slots: that bounds
what is broadcast and only makes the order less apt. Records travel as blobs (module blobs).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs, kernel

U64 = np.uint64
#: Most slots: 2**22 counts are 16 MB in each Python worker and on the driver.
MAX_BITS = 22
#: Slots that one task puts together at a time.
PART = 1 << 13
#: Members that are sorted at a time, and records that a bucket is meant to hold.
ROOM = 1 << 20
#: (member, block i, block j) by hash, id, label, size of the set, place in it, side: 0 of block i, 1 of block j, 2 where both are the same.
TYPES = {0: ("d8", "i8", "i8", "u4", "u4", "u1")}


def pairs(crowd: DataFrame, num: int, den: int, block: int = 4096) -> DataFrame:
    """(a, b), a < b, distinct: a superset of the pairs of different labels with den * intersection >= num * union.

    crowd: id, label (long), set (distinct 64-bit hashes, binary). block: sets with one rare member that a group of a task holds.
    """
    spark = crowd.sparkSession
    members = crowd.agg(F.coalesce(F.sum(F.octet_length("set")), F.lit(0))).first()[0] // 8
    bits = min(MAX_BITS, max(13, int(members).bit_length()))
    often = spark.sparkContext.broadcast(_slots(crowd.select("set").mapInArrow(lambda b: _count(b, bits, None, 0, 1), blobs.SCHEMA), bits))
    counts = _slots(crowd.select("set").mapInArrow(lambda b: _count(b, bits, often, num, den), blobs.SCHEMA), bits)
    rare = spark.sparkContext.broadcast(counts)
    buckets = max(256, -(-int(counts[counts > 1].sum(dtype=np.int64)) // ROOM))
    told = crowd.select("set", "id", "label").mapInArrow(lambda b: _records(b, bits, often, rare, num, den, buckets, block), blobs.SCHEMA)
    return blobs.gathered(told).mapInArrow(lambda b: _meet(b, num, den), "a long, b long").distinct()


def slot_of(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> U64(64 - bits)).astype(np.int64)


def _parts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, members, size of each row's set) of some rows at a time."""
    sets = [np.frombuffer(x.as_buffer(), U64) for x in column]
    first, held = 0, 0
    for i, x in enumerate(sets):
        held += len(x)
        if held >= ROOM or i + 1 == len(sets):
            yield first, np.concatenate(sets[first : i + 1]), np.array([len(s) for s in sets[first : i + 1]], np.int64)
            first, held = i + 1, 0


def _first(x: np.ndarray, size: np.ndarray, often: np.ndarray, bits: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, row, place) of the rarest members of each row, so many that a partner has one of them."""
    row = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((x, often[slot_of(x, bits)], row))
    place = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
    ok = place <= (size + (-num * size) // den)[row]
    return x[order[ok]], row[ok], place[ok]


def _count(batches: Iterator[pa.RecordBatch], bits: int, often, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """How often members of a slot occur: all of them, or the rarest of each set."""
    held = np.zeros(1 << bits, np.int64)
    for batch in batches:
        for _, x, size in _parts(batch.column(0)):
            if often is not None:
                x = _first(x, size, often.value, bits, num, den)[0]
            slot, n = np.unique(slot_of(x, bits), return_counts=True)
            held[slot] += n
    some = np.flatnonzero(held)
    yield from blobs.deal(0, ("u4", "u4"), some // PART, some, np.minimum(held[some], 2**32 - 1))


def _slots(counted: DataFrame, bits: int) -> np.ndarray:
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, None
        for bucket, _, (slot, n), _ in blobs.read(batches, {0: ("u4", "u4")}):
            if bucket != at:
                if sums is not None:
                    yield blobs.row(0, [at], [np.minimum(sums, 2**32 - 1).astype(np.uint32).tobytes()])
                at, sums = bucket, np.zeros(PART, np.int64)
            sums[slot.astype(np.int64) - at * PART] += n
        if sums is not None:
            yield blobs.row(0, [at], [np.minimum(sums, 2**32 - 1).astype(np.uint32).tobytes()])

    table, out = blobs.gathered(counted).mapInArrow(gather, blobs.SCHEMA).toArrow(), np.zeros(1 << bits, np.uint32)
    for bucket, blob in zip(table["bucket"].to_pylist(), table["blob"], strict=True):
        out[bucket * PART : (bucket + 1) * PART] = np.frombuffer(blob.as_buffer(), np.uint32)
    return out


def _records(batches: Iterator[pa.RecordBatch], bits: int, often, rare, num: int, den: int, buckets: int, block: int) -> Iterator[pa.RecordBatch]:
    """Records of the rarest members, except those that no other set can have among its own. Many sets of one member are dealt in blocks, two at a time."""
    for batch in batches:
        ids, labels = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for first, x, size in _parts(batch.column(0)):
            x, row, place = _first(x, size, often.value, bits, num, den)
            n = rare.value[slot_of(x, bits)].astype(np.int64)
            ok = np.flatnonzero(n > 1)
            x, row, place, blocks = x[ok], row[ok], place[ok], -(-n[ok] // block)
            own = (kernel.mix(ids[first + row].view(U64)) % blocks.astype(U64)).astype(np.int64)
            again = np.repeat(np.arange(len(x)), blocks)
            x, row, place, own = x[again], row[again], place[again], own[again]
            other = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            side = np.where(own == other, 2, own > other).astype(np.uint8)
            key = kernel.mix(x ^ kernel.mix((np.minimum(own, other) << 32 | np.maximum(own, other)).astype(U64)))
            order = np.argsort(key)
            row = row[order]
            yield from blobs.deal(0, TYPES[0], blobs.bucket_of(key[order], buckets), key[order], ids[first + row], labels[first + row], size[row], place[order], side[order])


def _meet(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs of one member (one pair of blocks) whose sizes and places allow enough common members, if this is the first one."""

    def out(parts: list) -> Iterator[pa.RecordBatch]:
        key, *columns = blobs.joined(parts)
        order = np.lexsort((columns[2], key))
        key, (ids, label, n, place, side) = key[order], [c[order].astype(np.int64) for c in columns]
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
        end, top, found, size = np.repeat(ends, np.diff(ends, prepend=0)), n - place, [], 0
        i, step = np.flatnonzero(end > np.arange(len(key)) + 1), 1
        while len(i):  # all rows with the one that stands `step` after them, as long as that has the same key and isn't too large
            i = i[den * n[i] >= num * n[i + step]]
            k = i + step
            ok = (label[k] != label[i]) & ((num + den) * np.minimum(top[i], top[k]) >= num * (n[i] + n[k])) & ((side[k] == 2) | (side[k] != side[i]))
            x, y = ids[i[ok]], ids[k[ok]]
            if len(x):
                found.append((np.minimum(x, y), np.maximum(x, y)))
                size += len(x)
            if size > ROOM:
                yield from told(found)
                found, size = [], 0
            step += 1
            i = i[end[i] > i + step]
        if found:
            yield from told(found)

    def told(found: list) -> Iterator[pa.RecordBatch]:
        a, b = blobs.add_up(2, *blobs.joined(found))
        for i in range(0, len(a), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 50_000]), pa.array(b[i : i + 50_000])], names=["a", "b"])

    held, parts = None, []
    for bucket, _, columns, _ in blobs.read(batches, TYPES):
        if parts and bucket != held:
            yield from out(parts)
            parts = []
        held = bucket
        parts.append(columns)
    if parts:
        yield from out(parts)
