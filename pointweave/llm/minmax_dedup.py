"""Near-duplicate documents by min-max hashing.

Each permutation gives two values of a document's shingle set, its minimum and its maximum, so
a signature takes half as many hash evaluations as values. Bands of the signature propose
candidates; each link is then confirmed on the full shingle sets.

Copies with equal sets are one class and take part once. In each bucket of a band the members
are held against one pivot (a star, not all pairs), in some rounds with another pivot each, in
which only members outside the pivot's component still count. Buckets whose members are not yet
in one component afterwards go through a last pass that holds members of different components
against each other: first by signatures alone, then the texts of those that may have a partner. It
tells the links alone. Members of buckets too large for that are held against those alone with
which they share one of their rarest shingles, as any link does (module rarest).

Tables that a hot bucket or pivot meets are written before they are joined, so Spark can split it.

Defined results: rows without a doc_id are left out (keep_one() keeps them); null or empty text, or
text without a word, has no shingles, is linked with nothing and is kept; a doc_id that occurs in
several rows is one document (each row is returned); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitfilter, kernel, rarest
from .graph import components
from .workspace import Workspace

U64 = np.uint64


@dataclass(frozen=True)
class MinMaxDedup:
    """shingle_words, and the least similarity as a fraction num/den of the union.

    bands * band_values = 2 * permutations. With 24 bands of 4 values, a pair at similarity 0.85
    escapes all bands with probability 2e-8, one at 0.8 with 3e-6. slack: a pair may be left out
    of the last pass if its signatures agree in less than num/den - slack of their values; this adds
    less than 1e-9 to either. Sets are those of 64-bit hashes of shingles, equal sets are told by
    128 bits. rounds: of stars; star, block: rows that one group of a task holds; in the last pass,
    the members of buckets of more than `block` are compared by their rarest shingles.
    """

    shingle_words: int = 5
    num: int = 80
    den: int = 100
    permutations: int = 48
    band_values: int = 4
    slack: float = 0.3
    rounds: int = 3
    star: int = 64
    block: int = 256
    seed: int = 11

    @property
    def bands(self) -> int:
        return 2 * self.permutations // self.band_values

    def signatures(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, n_shingles, set_lo, set_hi (a 128-bit hash of the set), bands, sig (16 bits of each value)."""
        return (
            docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .filter("doc_id is not null")
            .mapInArrow(self._sign, "doc_id long, n_shingles long, set_lo long, set_hi long, bands array<long>, sig binary")
        )

    def _sign(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.Generator(np.random.PCG64(self.seed))
        draw = lambda n: rng.integers(0, 2**63, n, dtype=np.int64).astype(U64) * U64(2) + U64(1)
        xor, mul, lanes, coef = draw(self.permutations), draw(self.permutations), draw(2), draw(2 * self.permutations)
        width, bands = 2 * self.permutations, self.bands
        for batch in batches:
            n = batch.num_rows
            sizes, lo, hi = np.zeros(n, np.int64), np.zeros(n, U64), np.zeros(n, U64)
            values = np.zeros((n, width), U64)
            for first, sets in kernel.text_shingles(batch.column(1), self.shingle_words):
                size = np.array([len(s) for s in sets], np.int64)
                sizes[first : first + len(sets)] = size
                full = np.flatnonzero(size)
                if not len(full):
                    continue
                x, at, rows = np.concatenate([sets[i] for i in full]), np.concatenate(([0], np.cumsum(size[full])[:-1])), first + full
                lo[rows], hi[rows] = (np.add.reduceat(kernel.mix(x ^ k), at) for k in lanes)
                for k in range(self.permutations):
                    v = (x ^ xor[k]) * mul[k]
                    v ^= v >> U64(32)
                    values[rows, 2 * k], values[rows, 2 * k + 1] = np.minimum.reduceat(v, at), np.maximum.reduceat(v, at)
            keys = kernel.mix((values * coef).reshape(n, bands, self.band_values).sum(2, dtype=U64) + np.arange(bands, dtype=U64))
            sig = np.ascontiguousarray(kernel.mix(values).astype(np.uint16))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes), pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.view(np.int64).ravel())),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * (2 * width)), pa.py_buffer(sig)]),
                ],
                names=["doc_id", "n_shingles", "set_lo", "set_hi", "bands", "sig"],
            )

    def components(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, n_shingles, component_id, kept, class_id (the least doc_id with the same shingle set)."""
        spark = docs.sparkSession
        work = Workspace(spark, "dedup")
        signed = work.keep(self.signatures(docs, id_col, text_col), "signatures")
        full = signed.filter("n_shingles > 0")
        classes = work.keep(full.groupBy("set_lo", "set_hi", "n_shingles").agg(F.min("doc_id").alias("class_id")), "classes")
        picked = classes.select(F.col("class_id").alias("doc_id"), "set_lo", "set_hi").withColumnRenamed("set_hi", "hi").withColumnRenamed("set_lo", "lo")
        reps = work.keep(
            full.join(picked, "doc_id").filter("set_lo = lo and set_hi = hi").select(F.col("doc_id").alias("class_id"), F.col("n_shingles").alias("n"), "bands", "sig").dropDuplicates(["class_id"]),
            "representatives",
        )
        fits = f"{self.den} * least(n, pivot_n) >= {self.num} * greatest(n, pivot_n)"

        heads = work.keep(
            reps.select("class_id", "n", F.explode("bands").alias("bucket"))
            .groupBy("bucket")
            .agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("class_id", "n")).alias("least"))
            .filter("members > 1")
            .select("bucket", F.col("least.class_id").alias("pivot"), F.col("least.n").alias("pivot_n")),
            "heads",
        )
        shared = bitfilter.build(spark, heads, "bucket", heads.count())
        members = work.keep(reps.select("class_id", "n", "bands").mapInArrow(_in_buckets(shared), "bucket long, band int, class_id long, n long").join(heads, "bucket"), "members")
        stars = members.filter(f"class_id <> pivot and {fits}").select(F.col("pivot").alias("a"), F.col("class_id").alias("b")).distinct()
        links = work.keep(self._confirm(stars, docs, id_col, text_col, work), "links")
        members, labels = members.select("bucket", "band", "class_id", "n"), components(links, work)
        for turn in range(1, self.rounds + 1):
            named, mixed = self._mixed(members, labels, work)
            if mixed.isEmpty():
                break
            rows = work.keep(named.join(mixed, "bucket"), "rows")
            if turn < self.rounds:
                drawn = F.struct(F.xxhash64("bucket", "class_id", F.lit(turn)).alias("u"), F.col("class_id").alias("pivot"), F.col("n").alias("pivot_n"), F.col("label").alias("pivot_label"))
                pivots = work.keep(rows.groupBy("bucket").agg(F.min(drawn).alias("p")).select("bucket", "p.pivot", "p.pivot_n", "p.pivot_label"), "pivots")
                pairs = rows.join(pivots, "bucket").filter(f"label <> pivot_label and {fits}").select(F.least("pivot", "class_id").alias("a"), F.greatest("pivot", "class_id").alias("b")).distinct()
            else:
                pairs = None
            found = self._across(rows, reps, docs, id_col, text_col, work) if pairs is None else self._confirm(pairs, docs, id_col, text_col, work)
            more = work.keep(found, "links")
            if not more.isEmpty():
                labels = components(more, work, labels)

        named = classes.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").select("set_lo", "set_hi", "class_id", F.coalesce("label", "class_id").alias("component_id"))
        out = signed.select("doc_id", "n_shingles", "set_lo", "set_hi").join(named, ["set_lo", "set_hi"], "left")
        component = F.coalesce("component_id", "doc_id")
        return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"), F.coalesce("class_id", "doc_id").alias("class_id"))

    def _mixed(self, members: DataFrame, labels: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
        """members with their component's label, and the buckets that hold more than one, with whether they are crowded."""
        named = members.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("label", F.coalesce("label", "class_id"))
        named = work.keep(named, "named")
        mixed = named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("m")).filter("x <> y")
        return named, work.keep(mixed.select("bucket", (F.col("m") > self.block).alias("crowded")), "mixed")

    def _across(self, rows: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, work: Workspace) -> DataFrame:
        """Links (a, b) between different components of one bucket.

        A task gets a bucket: signatures first, which leave few members with a partner they may be
        linked to, then the texts of these, to hold full sets against each other. A pair is looked
        at in the first of the bands that it shares, and no longer once its components are linked
        there. The members of crowded buckets are one crowd, whatever their buckets.
        """
        dealt = rows.filter("not crowded").drop("n", "crowded").join(reps.select("class_id", "n", "bands", "sig"), "class_id").select("bucket", "band", "class_id", "label", "n", "bands", "sig")
        by_bucket = lambda df: df.repartition("bucket").sortWithinPartitions("bucket")
        near = work.keep(by_bucket(dealt).mapInArrow(self._with_partners, dealt.schema), "near")
        texts = self._some_texts(near.select("class_id"), docs, id_col, text_col)
        links = by_bucket(near.join(texts, "class_id").select(*dealt.columns, "text")).mapInArrow(self._compare, "a long, b long").distinct()
        named = work.keep(rows.filter("crowded").select("class_id", "label").distinct(), "crowded")
        if named.isEmpty():
            return links
        crowd = named.join(self._some_texts(named.select("class_id"), docs, id_col, text_col), "class_id").select("class_id", "label", "text")
        crowd = work.keep(crowd.mapInArrow(self._sets, "id long, label long, set binary"), "crowd")
        return links.union(self._confirm(rarest.pairs(crowd, self.num, self.den), docs, id_col, text_col, work)).distinct()

    def _some_texts(self, ids: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """class_id and text of at least these documents, each once."""
        ids = ids.select(F.xxhash64("class_id").alias("k")).distinct()
        return self._texts(docs, bitfilter.build(docs.sparkSession, ids, "k", ids.count()), id_col, text_col).withColumnRenamed("id", "class_id").dropDuplicates(["class_id"])

    def _sets(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in kernel.text_shingles(batch.column(2), self.shingle_words):
                part = batch.slice(first, len(sets))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "label", "set"])

    def _partners(self, t: pa.Table, label: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each row of a bucket, the rows with greater ids that its signature leaves it."""
        ids, n = (t.column(c).to_numpy() for c in ("class_id", "n"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(ids), -1)
        bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        band, least = t.column("band")[0].as_py(), (self.num / self.den - self.slack) * sig.shape[1]
        for i in range(len(ids)):
            k = np.flatnonzero((ids > ids[i]) & (label[i] != label) & (self.den * np.minimum(n[i], n) >= self.num * np.maximum(n[i], n)))
            k = k[(sig[i] == sig[k]).sum(1) >= least]
            yield i, k[(bands[i] == bands[k]).argmax(1) == band]

    def _with_partners(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            some = np.zeros(t.num_rows, bool)
            for i, k in self._partners(t, t.column("label").to_numpy()):
                some[k] = True
                some[i] |= len(k) > 0
            yield from t.filter(pa.array(some)).to_batches()

    def _compare(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            sets = [x for _, part in kernel.text_shingles(t.column("text"), self.shingle_words) for x in part]
            ids, label, links = t.column("class_id").to_numpy(), t.column("label").to_numpy().copy(), []
            for i, right in self._partners(t, label):
                for k in right.tolist():
                    if label[i] != label[k] and _similar(sets[i], sets[k], self.num, self.den):
                        links.append((min(ids[i], ids[k]), max(ids[i], ids[k])))
                        label[label == label[k]] = label[i]
            a, b = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def _texts(self, docs: DataFrame, wanted, id_col: str, text_col: str) -> DataFrame:
        """id and text of the documents that a bit filter lets by."""
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long")).alias("k"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
        return rows.mapInArrow(_wanted(wanted), "id long, text string")

    def _confirm(self, pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, work: Workspace) -> DataFrame:
        """The pairs (a, b) whose full shingle sets are similar enough. Texts of no other documents are shuffled."""
        pairs = work.keep(pairs, "pairs")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().select(F.xxhash64("id").alias("k"))
        wanted = bitfilter.build(pairs.sparkSession, ids, "k", 2 * pairs.count())
        texts = self._texts(docs, wanted, id_col, text_col)
        sizes = work.keep(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / self.star).alias("parts")), "sizes")
        dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
        member = dealt.join(texts.withColumnRenamed("id", "b"), "b").select("a", "part", "b", "text")
        pivot = sizes.join(texts.withColumnRenamed("id", "a"), "a").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")
        rows = pivot.unionByName(member).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
        return rows.mapInArrow(self._hold, "a long, b long").distinct()

    def _hold(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot_id, pivot = None, np.empty(0, U64)
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            found_a, found_b = [], []
            for first, sets in kernel.text_shingles(batch.column(3), self.shingle_words):
                for i, s in enumerate(sets, first):
                    if b[i] is None:
                        pivot_id, pivot = a[i], s
                    elif a[i] == pivot_id and len(s) and len(pivot) and self.den * min(len(s), len(pivot)) >= self.num * max(len(s), len(pivot)):
                        if _similar(s, pivot, self.num, self.den):
                            found_a.append(a[i])
                            found_b.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    def keep_one(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The rows of docs, all columns as they are, without the documents that are near copies of an earlier one. Rows without an id stay."""
        spark, columns = docs.sparkSession, docs.columns
        gone = Workspace(spark, "dedup-out").keep(self.components(docs, id_col, text_col).filter("not kept").select("doc_id").distinct(), "gone")
        return without(docs, gone, id_col).select(*columns)


def _similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets that aren't empty have den * intersection >= num * union."""
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return den * both >= num * (len(x) + len(y) - both)


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """Rows of docs whose id is not in gone(doc_id, distinct). A bit filter lets most rows by without a shuffle."""
    absent = bitfilter.build(docs.sparkSession, gone.select(F.xxhash64("doc_id").alias("k")), "k", gone.count())
    maybe = F.pandas_udf(lambda k: _flags(absent, k), "boolean")
    marked = docs.withColumn("__pw_maybe", F.coalesce(maybe(F.xxhash64(F.col(id_col).cast("long"))), F.lit(False)))
    held = marked.filter("__pw_maybe").join(gone.withColumnRenamed("doc_id", "__pw_gone"), F.col(id_col).cast("long") == F.col("__pw_gone"), "left_anti")
    return marked.filter("not __pw_maybe").unionByName(held)


def _flags(shared, k):
    import pandas as pd

    return pd.Series(shared.value.has(k.to_numpy().view(np.uint64)))


def _in_buckets(shared):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            keys = lists.flatten().to_numpy()
            each = len(keys) // batch.num_rows
            hit = np.flatnonzero(shared.value.has(keys.view(U64)))
            row = hit // each
            yield pa.RecordBatch.from_arrays([pa.array(keys[hit]), pa.array((hit % each).astype(np.int32)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], names=["bucket", "band", "class_id", "n"])

    return run


def _wanted(shared):
    def run(batches):
        for batch in batches:
            kept = batch.filter(pa.array(shared.value.has(batch.column(1).to_numpy().view(U64))))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(2)], names=["id", "text"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Consecutive rows that agree in the first (non-null long) column, over the bounds of batches."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(0).to_numpy()
        cut = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), batch.num_rows]
        for s, e in zip(cut, cut[1:], strict=False):
            key = int(k[s])
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(s, e - s))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
