"""Language identification by averaged hashed subword embeddings and a linear softmax.

Subwords are runs of 2 to 4 bytes of the lower-cased text, in which all that is no letter counts
as one space; they are hashed into buckets. A text is the average of its subwords' embeddings. The
embeddings and the linear layer are trained together in numpy by stochastic gradient descent on a
bounded sample of labelled rows. A part of the sample is kept back to calibrate: a temperature
that makes the probabilities honest, and two bounds of rejection. A text is rejected if its best
probability is too low, or if its subwords are too strange, by the mean negative log of their
frequency in the sample (text in none of the learned languages can be far from all and yet nearer
to one). Each bound is set so that a share `reject` of the rightly named kept-back texts falls beyond it.

To predict, embeddings and linear layer fold into one weight for each bucket and language. Texts
of more than a megabyte are taken in parts of a megabyte, and no subword reaches over two of them.

Defined results: rows without an id are left out (keep_known() goes by the text alone); null text
and text without a letter is `und` with score 0 and rejected; without a labelled row everything
is; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .workspace import small_batches

U64 = np.uint64
UNDETERMINED = "und"
_SIZES = (2, 3, 4)
_MULTIPLY = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9))
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_LETTER = regex.compile(r"\p{L}")


def subwords(c: kernel.Chunk, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of each subword of a chunk."""
    s = _FOLD[c.data]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 32) | (s[:-1] != 32)  # spaces run together, but not over the bounds of documents
    keep[c.bounds[:-1][c.bounds[:-1] < len(s)]] = True
    place = np.concatenate(([0], np.cumsum(keep)))
    s, bounds = s[keep].astype(U64), place[c.bounds]
    doc = np.repeat(np.arange(c.n), np.diff(bounds))
    buckets, docs = [], []
    code = s.copy()
    for size, multiply in zip(_SIZES, _MULTIPLY, strict=True):
        if len(s) < size:
            break
        code = code[: len(s) - size + 1] << U64(8) | s[size - 1 :]
        at = doc[: len(code)]
        whole = at == doc[size - 1 :]
        buckets.append(((code[whole] + U64(size)) * multiply >> U64(64 - bits)).astype(np.int64))
        docs.append(at[whole])
    if not buckets:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(buckets), np.concatenate(docs)


@dataclass
class Model:
    """weight[bucket, language] is the bucket's part of the logits; bias; temperature; rarity: negative log frequency of each
    bucket; least probability and largest mean rarity that aren't rejected."""

    languages: list[str]
    bits: int
    weight: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    rarity: np.ndarray | None = None
    threshold: float = 0.0
    strange: float = float("inf")

    def logits(self, c: kernel.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Logits and mean rarity of each document."""
        sums, n = np.zeros((len(self.languages) + 1, c.n)), np.zeros(c.n)
        for part in kernel.pieces(c):
            bucket, doc = subwords(part, self.bits)
            n += np.bincount(doc, minlength=c.n)
            for total, w in zip(sums, (*self.weight.T, self.rarity), strict=True):
                total += np.bincount(doc, w[bucket], c.n)
        sums /= np.maximum(1, n)
        return sums[:-1].T + self.bias, sums[-1]

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


@dataclass(frozen=True)
class LanguageId:
    """sample: labelled rows that are expected to be fitted on, as evenly over the languages as they allow; whole texts of them. steps: of descent, about."""

    sample: int = 3000
    bits: int = 15
    width: int = 16
    steps: int = 9600
    rate: float = 0.5
    held: float = 0.2
    reject: float = 0.001
    seed: int = 5

    def fit(self, docs: DataFrame, training: str, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
        """training: SQL condition on doc_id. Rows are picked by a hash of their id, so the same rows give the same model."""
        small_batches(docs.sparkSession)
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col).cast("string")).alias("text"), F.col(label_col).cast("string").alias("label"))
        rows = rows.filter("doc_id is not null and text is not null and label is not null").filter(training)
        counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        languages = sorted(counts)
        if not languages:
            return Model([], self.bits, np.zeros((1 << self.bits, 0)), np.zeros(0), rarity=np.zeros(1 << self.bits))
        share = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, self.sample / len(languages) / counts[k]))]), F.col("label"))
        u = F.pmod(F.xxhash64("doc_id", F.lit(self.seed)), F.lit(1 << 30)) / float(1 << 30)
        bits = self.bits
        small = np.int16 if bits < 16 else np.int32

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists, weights = [], []
                for c in kernel.chunks(batch.column(1)):
                    found = [np.unique(doc << bits | bucket, return_counts=True) for bucket, doc in (subwords(p, bits) for p in kernel.pieces(c))]
                    u, back = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
                    n = np.bincount(back, np.concatenate([x for _, x in found]), len(u)).astype(np.int32)
                    cut = np.searchsorted(u >> bits, np.arange(c.n + 1))
                    u &= (1 << bits) - 1
                    lists += [u[s:e].astype(small) for s, e in zip(cut, cut[1:], strict=False)]
                    weights += [n[s:e] for s, e in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lists, pa.list_(pa.from_numpy_dtype(small))), pa.array(weights, pa.list_(pa.int32()))], names=["doc_id", "label", "buckets", "counts"])

        kind = "smallint" if small is np.int16 else "int"
        picked = rows.filter(u < share).mapInArrow(count, f"doc_id long, label string, buckets array<{kind}>, counts array<int>").toArrow()
        number = {k: i for i, k in enumerate(languages)}
        data = []
        # rows are read in order where they are: the driver holds the sample once, as it came
        for i in pc.sort_indices(picked, sort_keys=[("doc_id", "ascending"), ("label", "ascending")]).to_pylist():
            bucket, n = (picked[c][i].values.to_numpy() for c in ("buckets", "counts"))
            if len(bucket):
                data.append((bucket, n, number[picked["label"][i].as_py()]))
        model = self._train(data, languages)
        del picked, data
        pa.default_memory_pool().release_unused()
        return model

    def _train(self, data: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str]) -> Model:
        """data: buckets of each text, how often each occurs, and the number of its language."""
        rng = np.random.Generator(np.random.PCG64(self.seed))
        e = rng.uniform(-1, 1, (1 << self.bits, self.width)).astype(np.float32) / self.width
        w, bias = np.zeros((self.width, len(languages)), np.float32), np.zeros(len(languages), np.float32)
        order = rng.permutation(len(data))
        kept, fitted = np.split(order, [int(len(data) * self.held)])
        epochs, done = -(-self.steps // max(1, len(fitted))), 0
        steps = max(1, epochs * len(fitted))
        for _ in range(epochs if len(fitted) else 0):
            for i in rng.permutation(fitted).tolist():
                (bucket, _, y), share = data[i], _share(data[i])
                rate = np.float32(self.rate * (1 - done / steps))
                h = share.astype(np.float32) @ e[bucket]
                g = h @ w + bias
                g = np.exp(g - g.max())
                g /= g.sum()
                g[y] -= 1
                back = w @ g
                w -= rate * np.outer(h, g)
                bias -= rate * np.float32(0.1) * g
                e[bucket] -= rate * np.minimum(1, 20 * share).astype(np.float32)[:, None] * back
                done += 1
        often = np.ones((len(languages), 1 << self.bits))  # of the rows that were fitted, so that those kept back are as strange as new ones
        for i in fitted.tolist():
            bucket, n, y = data[i]
            often[y, bucket] += n
        rarity = -np.log((often / often.sum(1, keepdims=True)).mean(0))  # each language counts alike
        model = Model(languages, self.bits, (e @ w).astype(np.float64), bias.astype(np.float64), rarity=rarity)
        if len(kept):
            z = np.array([_share(data[i]) @ model.weight[data[i][0]] + model.bias for i in kept])
            y = np.array([data[i][2] for i in kept])

            def loss(t: float) -> float:
                model.temperature = t
                return -np.log(np.maximum(1e-12, model.probabilities(z)[np.arange(len(y)), y])).mean()

            model.temperature = min((2.0**k for k in np.arange(0, 5, 0.25)), key=loss)
            p = model.probabilities(z)
            right = p.argmax(1) == y
            if right.any():
                top = np.clip(p.max(1)[right], 1e-12, 1 - 1e-12)
                model.threshold = float(1 / (1 + np.exp(-self._bound(np.log(top / (1 - top)), -1))))
                model.strange = float(self._bound(np.array([_share(data[i]) @ rarity[data[i][0]] for i in kept[right]]), 1))
        return model

    def _bound(self, values: np.ndarray, side: int) -> float:
        """What a share `reject` of values is beyond on one side: their quantile, or what a normal law of their mean and spread gives where the kept-back rows are too few to show so small a share."""
        tail = values.mean() + side * NormalDist().inv_cdf(1 - self.reject) * values.std()
        return side * max(side * np.quantile(values, self.reject if side < 0 else 1 - self.reject), side * tail)

    def predict(self, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, lang_pred, score, rejected."""
        shared = docs.sparkSession.sparkContext.broadcast(model)
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col).cast("string")).alias("text")).filter("doc_id is not null")
        return rows.mapInArrow(lambda b: _predict(b, shared), "doc_id long, lang_pred string, score double, rejected boolean")

    def keep_known(self, docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
        """The rows of docs, all columns as they are, whose text isn't rejected. Nothing is shuffled."""
        shared = docs.sparkSession.sparkContext.broadcast(model)

        @F.arrow_udf("boolean")
        def rejected(text: pa.Array) -> pa.Array:
            return pa.array(_name(text, shared.value)[2], pa.bool_())

        return docs.filter(~rejected(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))


def _share(row: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    return row[1] / row[1].sum()


def _name(column: pa.Array, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    n = len(column)
    names, score, rejected = [UNDETERMINED] * n, np.zeros(n), np.ones(n, bool)
    ascii_letter, beyond = np.zeros(256, bool), np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    beyond[128:] = True
    for c in kernel.chunks(column):
        if not model.languages or not len(c.data):
            continue
        total = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags[c.data])))[c.bounds])
        letters = total(ascii_letter) > 0
        for i in np.flatnonzero(~letters & (total(beyond) > 0)).tolist():
            letters[i] = bool(_LETTER.search(column[c.first + i].as_py()))
        logits, rarity = model.logits(c)
        p = model.probabilities(logits)
        best = p.argmax(1)
        top = p[np.arange(c.n), best]
        for i in np.flatnonzero(letters).tolist():
            names[c.first + i] = model.languages[best[i]]
            score[c.first + i], rejected[c.first + i] = top[i], top[i] < model.threshold or rarity[i] > model.strange
    return names, score, rejected


def _predict(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, score, rejected = _name(batch.column(1), shared.value)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])
