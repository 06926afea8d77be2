"""Language-model scores by a probabilistic suffix tree over words, next to an add-one word model.

Both models spread their probability over the same symbols: the V distinct training tokens (a
document's words, lower-cased, and one end) and one more for every unknown word. The empty context
discounts each count by the share of words seen once, which goes to the unknown word.

Each run of up to `depth` preceding tokens that occurs at least `context` times in the training
text is a candidate context, whichever other runs are. It becomes a state by a divergence test: the
bits its own next-symbol distribution saves against that of its longest suffix that is a state
(count times Kullback-Leibler divergence) have to exceed what its parameters cost (half the log of
the token count for each). A state keeps the successors seen at least `pair` times after it, each
discounted; what that leaves is spread over all other symbols in proportion to that suffix's
distribution. Each token is scored by its longest suffix that is a state. The least counts are the
same at every size of the corpus, so states and successors grow with it.

A run is named by a hash of the two runs it consists of without its last and without its first
token. Counts, states and successors are tables keyed by these names; counts cover all training
text, are summed before and after a shuffle, and take one pass over the text for each depth.

With L_d the log probability by contexts of up to d tokens, b the log of a state's factor for other
symbols, and a that of a kept successor's probability, L_d = L_(d-1) + b if the context of d tokens
is a state, and a kept successor adds a - b - L_(d-1) to that. So a score is a sum of values by key,
one for each word, state and kept successor that a text holds, and is found by joining on the keys.
Broadcast are only a cache of the most frequent values and filters of keys, both of bounded size:
they save records of the join and don't change results.

Counts of runs, keys that texts look up, and sums travel as blobs of records (module blobs), dealt
by hash: a key of many occurrences is summed up, or in the cache, before any shuffle. A text is
known by its place in a group of texts that one task read in a row, and the group by a hash of what
is in it, so a task that runs again fits to what others have read: documents whose plan shuffles or
samples, so that rows could come in another order then, are written to a table first.

Defined results: rows without a doc_id are left out; null or empty text has the end alone;
repeated rows are learned from and scored each on their own; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import bitfilter, blobs, kernel
from .workspace import Workspace, in_order, release

U64 = np.uint64
#: Records: values of keys (key, v, known, base); keys that texts hold (key, group of texts, text there, times); rows (group, text
#: there, doc_id, tokens, known, base logs, score); what a text's keys add up to (group, text there, known, base logs, score); counted
#: runs (context, suffix, times).
VALUE, ASKED, TEXT, SUM, RUN = range(5)
TYPES = {VALUE: ("d8", "f8", "u1", "f8"), ASKED: ("d8", "u8", "u2", "u4"), TEXT: ("u8", "u2", "i8", "i8", "i8", "f8", "f8"), SUM: ("u8", "u2", "u4", "f8", "f8"), RUN: ("d8", "u8", "u4")}
#: Records that a task gathers before it sums them up, or that a bucket is meant to hold.
ROOM = 1 << 20
#: Symbols of a document's bounds, and what tells a state's key from that of the same run as a successor.
START, END, STATE = U64(0x6A09E667F3BCC909), U64(0xBB67AE8584CAA73B), U64(0x3C6EF372FE94F82B)


def signed(x: np.uint64) -> int:
    return int(x.astype(np.int64))


def join_runs(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Name of the run that has these two, each one token shorter."""
    return kernel.mix(prefix * U64(0x9E3779B97F4A7C15) ^ suffix)


@F.arrow_udf(LongType())
def run_name(prefix: pa.Array, suffix: pa.Array) -> pa.Array:
    return pa.array(join_runs(prefix.to_numpy().view(U64), suffix.to_numpy().view(U64)).view(np.int64))


class Tally:
    """Counts of numbers; adds up what it holds now and then, so that its size follows the distinct ones."""

    def __init__(self, room: int = 3_000_000):
        self.room, self.parts, self.size = room, [], 0

    def add(self, keys: np.ndarray) -> None:
        if len(keys):
            self.parts.append(np.unique(keys, return_counts=True))
            self.size += len(self.parts[-1][0])

    def full(self) -> bool:
        if self.size > self.room and len(self.parts) > 1:
            self.parts = [self.sum()]
            self.size = len(self.parts[0][0])
        return self.size > self.room

    def sum(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, U64), np.empty(0, np.int64)
        keys, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first], np.add.reduceat(counts, first)


@dataclass
class Level:
    """Contexts of one length. key: suffix state * width + older symbol, sorted; a state's id is its place.

    pair: state * width + successor, sorted, with its count n and the log10 of its probability a;
    b: log10 of the factor of the suffix's probability for all other successors.
    """

    key: np.ndarray
    pair: np.ndarray
    n: np.ndarray
    a: np.ndarray
    b: np.ndarray


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table, -1 where it is missing or negative."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where((keys >= 0) & (table[at] == keys), at, -1)


@dataclass
class Tree:
    """The model in memory, for few words and states, and the constants of the empty context.

    word: sorted hashes of words; symbol i is word[i], the next one the end, the one after it any other word.
    """

    word: np.ndarray
    count: np.ndarray
    n_docs: int
    tokens: int
    types: int
    once: int
    levels: list[Level]

    def __post_init__(self):
        self.end, self.other, self.width = len(self.word), len(self.word) + 1, len(self.word) + 2
        self.discount = min(0.9, self.once / self.types) if self.types else 0.0
        self.mass = self.tokens + (self.once == 0)
        self.unknown = (self.discount * self.types or 1.0) / self.mass
        with np.errstate(divide="ignore"):
            self.log0 = np.log10(np.append(np.append(self.count, self.n_docs) - self.discount, 1.0)) - np.append(np.full(self.end + 1, np.log10(self.mass)), 0.0)
        if not self.n_docs:
            self.log0[self.end] = np.log10(self.unknown)

    def symbols(self, c: kernel.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, kernel.Words]:
        """(symbol of each token, place of each in its document, word hashes, words): words in order, an end after each document."""
        w = kernel.words(c)
        h = kernel.word_hashes(c, w, kernel.LOWER)
        at = _find(self.word, h)
        of = w.of + np.arange(c.n + 1)
        s = np.full(int(of[-1]), self.end, np.int64)
        s[np.arange(len(h)) + w.doc()] = np.where(at < 0, self.other, at)
        return s, np.arange(len(s)) - np.repeat(of[:-1], np.diff(of)), h, w

    def before(self, s: np.ndarray, place: np.ndarray, j: int) -> np.ndarray:
        """The symbol j tokens earlier; the end before a document's first token, nothing (-1) before that."""
        out = np.full(len(s), -1)
        out[j:] = s[:-j]
        return np.where(place >= j, out, np.where(place == j - 1, self.end, -1))

    def states(self, s: np.ndarray, place: np.ndarray) -> Iterator[np.ndarray]:
        """For each depth the state of each token's context, -1 where it is none."""
        at = np.zeros(len(s), np.int64)
        for j, level in enumerate(self.levels, 1):
            x = self.before(s, place, j)
            at = _find(level.key, np.where((at >= 0) & (x >= 0) & (x != self.other), at * self.width + x, -1))
            yield at

    def logs(self, s: np.ndarray, place: np.ndarray) -> np.ndarray:
        """log10 probability of each token; where it is another word, what its word's own probability is to be multiplied by."""
        out = self.log0[s]
        for level, at in zip(self.levels, self.states(s, place), strict=True):
            live = np.flatnonzero(at >= 0)
            if not len(live):
                break
            kept = _find(level.pair, np.where(s[live] == self.other, -1, at[live] * self.width + s[live]))
            out[live] = np.where(kept >= 0, level.a[kept] if len(level.a) else 0, level.b[at[live]] + out[live])
        return out


@dataclass
class Runs:
    """Consecutive symbols of a chunk's documents: a start, the words, an end. names[d]: of the run of d + 1 symbols that ends at each one.

    The first `lead` symbols have been in the part before. texts: hash of each document's words.
    """

    symbol: np.ndarray
    place: np.ndarray
    is_word: np.ndarray
    doc: np.ndarray
    lead: int
    texts: np.ndarray
    names: list[np.ndarray]

    def pairs(self, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in symbol, context of d symbols, the run of d symbols that ends with the successor)."""
        i = np.flatnonzero(self.place[self.lead :] >= d) + self.lead
        return i, self.names[d - 1][i - 1], self.names[d - 1][i]


def runs(c: kernel.Chunk, longest: int, part: int = 1 << 18) -> Iterator[Runs]:
    """The runs of a chunk; of a long document a part at a time."""
    w = kernel.words(c)
    first = w.of + 2 * np.arange(c.n + 1)
    s = np.full(int(first[-1]), END, U64)
    s[first[:-1]] = START
    h = kernel.word_hashes(c, w, kernel.LOWER)
    at = np.arange(len(w.start)) + 2 * w.doc() + 1
    s[at] = h
    is_word = np.zeros(len(s), bool)
    is_word[at] = True
    texts = kernel.sequence_hash(h, w.of, 3)
    for lo in range(0, len(s), part):
        lead = min(lo, longest)
        x = s[lo - lead : lo + part]
        place = np.arange(lo - lead, lo - lead + len(x))
        doc = np.searchsorted(first, place, "right") - 1
        names = [x]
        for _ in range(longest - 1):
            names.append(join_runs(np.concatenate((x[:1], names[-1][:-1])), names[-1]))
        word = is_word[lo - lead : lo + part].copy()
        word[:lead] = False
        yield Runs(x, place - first[doc], word, doc, lead, texts, names)


class Cache:
    """Values of some keys, each in the one slot its high bits name; of keys that share a slot the most frequent one is held. 24 bytes a slot."""

    SLOTS = 20

    def __init__(self, t: pa.Table):
        self.key, self.v, self.base = np.zeros(1 << self.SLOTS, U64), np.zeros(1 << self.SLOTS), np.zeros(1 << self.SLOTS)
        key = t["key"].to_numpy().view(U64)
        order = np.argsort(t["n"].to_numpy(), kind="stable")  # the most frequent is written last
        at = self.slot(key[order])
        for held, x in ((self.key, key), (self.v, t["v"].to_numpy()), (self.base, t["base"].to_numpy())):
            held[at] = x[order]

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key >> U64(64 - self.SLOTS)).astype(np.int64)


@dataclass(frozen=True)
class SuffixTreeScorer:
    """context, pair: least numbers of occurrences; discount: taken off each kept successor's count; cached: values broadcast at most;
    rounds: parts of the texts that are scored one after another, so that the shuffles of one part are on disk at a time."""

    depth: int = 3
    context: int = 8
    pair: int = 3
    discount: float = 0.75
    cached: int = 2**20
    rounds: int = 2

    def score(self, docs: DataFrame, training: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, in_training, n_tokens, n_known, train_tokens, train_types, base_score, score. training: SQL condition on doc_id."""
        spark = docs.sparkSession
        work = Workspace(spark, "scores")
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
        if not in_order(texts):
            texts = work.keep(texts, "texts")
        learned = texts.filter(training).select("text")
        counts = work.keep(learned.mapInArrow(_words, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
        words = counts.filter("kind = 1").select("key", "n")
        n_docs = counts.filter("kind = 2").agg(F.sum("n")).first()[0] or 0
        tokens, types, once = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("n") == 1)).first()
        tokens, types = tokens + n_docs, types + (n_docs > 0)
        tree = Tree(np.empty(0, U64), np.empty(0, np.int64), n_docs, tokens, types, once + (n_docs == 1), [])

        log = F.log10(F.col("n") - F.lit(tree.discount)) - F.lit(float(np.log10(max(1, tree.mass))))
        values = words.select("key", "n", log.alias("v"), F.lit(1.0).alias("known"), F.log10(F.col("n") + 1).alias("base"))
        ends = spark.createDataFrame([(signed(END), n_docs)] if n_docs else [], "key long, n long")
        starts = spark.createDataFrame([(signed(START), n_docs)], "key long, n long")
        shorter = words.union(ends).select("key", "n", log.alias("logp"))
        contexts = words.union(starts)
        release(spark)
        for d in range(1, self.depth + 1):
            states, shorter = self._deepen(d, contexts, shorter, tokens, learned, work)
            none = [F.lit(0.0).alias("known"), F.lit(0.0).alias("base")]
            values = values.union(states.select(F.col("ctx").bitwiseXOR(F.lit(signed(STATE))).alias("key"), F.col("total").alias("n"), F.col("b").alias("v"), *none))
            values = values.union(shorter.filter("more is not null").select("key", "n", F.col("more").alias("v"), *none))
            contexts = shorter.select("key", "n")
            release(spark)

        # a quarter of a power of two of counts at a time, the most frequent values that the cache has room for
        step = F.floor(F.log2("n") * 4).cast("int")
        sizes, room, least = sorted(((r.s, r["count"]) for r in values.groupBy(step.alias("s")).count().collect()), reverse=True), self.cached, 1 << 30
        for s, n in sizes:
            if n > room:
                break
            room, least = room - n, s
        cache = spark.sparkContext.broadcast(Cache(values.filter(step >= least).select("key", "n", "v", "base").toArrow()))
        keys = bitfilter.build(spark, values, "key", sum(n for _, n in sizes))

        depth, buckets = self.depth, self._buckets(tokens)
        release(spark)
        parts = []
        for r in range(self.rounds):
            some = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(self.rounds)) == r)
            asked = some.mapInArrow(lambda b: _ask(b, depth, tree, cache, keys, buckets), blobs.SCHEMA)
            told = values.select("key", "v", F.col("known").cast("byte"), "base").mapInArrow(lambda b: _tell(b, buckets), blobs.SCHEMA)
            sums = work.keep(blobs.gathered(asked.unionByName(told)).mapInArrow(lambda b: _answer(b, buckets), blobs.SCHEMA), "sums")
            release(spark)
            parts.append(work.keep(blobs.gathered(sums).mapInArrow(_total, "doc_id long, n_tokens long, known long, logs double, score double"), "totals"))
            work.drop(sums)
            release(spark)
        rows = reduce(DataFrame.unionByName, parts)
        base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(tokens + types + 1)))
        score = F.col("score") + (F.col("n_tokens") - F.col("known")) * F.lit(float(np.log10(tree.unknown)))
        return rows.select(
            "doc_id", F.expr(training).alias("in_training"), "n_tokens", F.col("known").alias("n_known"),
            F.lit(tokens).cast("long").alias("train_tokens"), F.lit(types).cast("long").alias("train_types"), base.alias("base_score"), score.alias("score"),
        )

    @staticmethod
    def _buckets(tokens: int) -> int:
        """So many that none gathers more than about ROOM records, however many tokens there are."""
        return max(256, -(-tokens // ROOM))

    def _deepen(self, d: int, contexts: DataFrame, shorter: DataFrame, tokens: int, learned: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
        """(ctx, total, b) of the states of d tokens; (key, n, logp, more) of all counted runs of d + 1 tokens.

        contexts: runs of d tokens with their counts; shorter: those that a shorter context's successor ends.
        logp: of the last token by the longest state of up to d tokens; more: what a kept successor adds to L_(d-1) + b.
        """
        spark = learned.sparkSession
        often, known = contexts.filter(F.col("n") >= self.context), shorter.filter(F.col("n") >= self.pair)
        before, last = (bitfilter.build(spark, x, "key", x.count()) for x in (often, known))
        buckets, least = self._buckets(tokens), self.pair
        # a context of more than half a bucket's tokens is spread over as many buckets as it would fill, twice over; there are 2 * buckets of them at most
        wide = often.filter(F.col("n") > F.lit(max(1, tokens // (2 * buckets)))).orderBy(F.desc("n"), "key").limit(1 << 16).toArrow().sort_by("key")
        keys = np.sort(wide["key"].to_numpy().view(U64))
        bits = np.ceil(np.log2(wide["n"].to_numpy()[np.argsort(wide["key"].to_numpy().view(U64))] * buckets / max(1, tokens))).clip(0, 20).astype(np.int64) + 1
        spread = spark.sparkContext.broadcast((keys, bits))
        counted = learned.mapInArrow(lambda b: _successors(b, d, before, last, spread, buckets), blobs.SCHEMA)
        pairs = work.keep(blobs.gathered(counted).mapInArrow(lambda b: _often(b, least), "ctx long, sfx long, n long"), f"pairs{d}")
        for shared in (before, last, spread):
            shared.destroy()
        release(spark)
        named = pairs.join(often.select(F.col("key").alias("ctx"), F.col("n").alias("total")), "ctx").join(known.select(F.col("key").alias("sfx"), F.col("logp").alias("near")), "sfx")
        log_a = F.log10((F.col("n") - F.lit(self.discount)) / F.col("total"))
        table = work.keep(named.select(run_name("ctx", "sfx").alias("key"), "ctx", "n", "total", "near", log_a.alias("a")), f"depth{d}")
        work.drop(pairs)
        sums = table.groupBy("ctx", "total").agg(
            F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("seen"), F.sum(F.pow(F.lit(10.0), F.col("a"))).alias("kept"),
            F.sum(F.pow(F.lit(10.0), F.col("near"))).alias("near"), F.sum(F.col("n") * (F.col("a") - F.col("near"))).alias("saved"),
        )
        left, room = F.greatest(F.lit(1e-12), 1 - F.col("kept")), F.greatest(F.lit(1e-12), 1 - F.col("near"))
        saved = (F.col("saved") + (F.col("total") - F.col("seen")) * F.col("b")) * float(np.log(10))
        states = sums.withColumn("b", F.log10(left / room)).filter(saved > 0.5 * float(np.log(max(2, tokens))) * F.col("kinds")).select("ctx", "total", "b")
        states = work.keep(states, f"states{d}")
        runs = table.join(states.select("ctx", "b"), "ctx", "left")
        runs = work.keep(runs.select("key", "n", F.when(F.col("b").isNull(), F.col("near")).otherwise(F.col("a")).alias("logp"), (F.col("a") - F.col("b") - F.col("near")).alias("more")), f"runs{d}")
        work.drop(table)
        return states, runs


def _rows(tally: Tally, kind: int | None = None) -> Iterator[pa.RecordBatch]:
    keys, n = tally.sum()
    tally.parts, tally.size = [], 0
    for i in range(0, len(keys), 50_000):
        k, m = pa.array(keys[i : i + 50_000].view(np.int64)), pa.array(n[i : i + 50_000])
        yield pa.RecordBatch.from_arrays([k, m], names=["key", "n"]) if kind is None else pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), k, m], names=["kind", "key", "n"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (kind 1) and of documents (kind 2)."""
    tally, docs = Tally(), 0
    for batch in batches:
        docs += batch.num_rows
        for c in kernel.chunks(batch.column(0)):
            tally.add(kernel.word_hashes(c, kernel.words(c), kernel.LOWER))
            if tally.full():
                yield from _rows(tally, 1)
    yield from _rows(tally, 1)
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([docs], pa.int64())], names=["kind", "key", "n"])


def _add_runs(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct (context, suffix) and their numbers, about by context. Sorted by half of the bits of each, so a pair may be told twice, with a part of its number each time."""
    ctx, sfx, n = blobs.joined(parts)
    order = np.argsort((ctx >> U64(32) << U64(32)) | (sfx >> U64(32)))
    ctx, sfx, n = ctx[order], sfx[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], (ctx[1:] != ctx[:-1]) | (sfx[1:] != sfx[:-1]))))
    return ctx[first], sfx[first], np.add.reduceat(n, first)


def _successors(batches: Iterator[pa.RecordBatch], d: int, before, last, spread, buckets: int) -> Iterator[pa.RecordBatch]:
    """RUN records of (context of d tokens, run of d tokens that ends with its successor), as far as both may be counted ones."""
    parts, size = [], 0

    def out() -> Iterator[pa.RecordBatch]:
        ctx, sfx, n = parts[0]  # the successors of a frequent context are spread over many buckets, those of others stay together and share its name
        keys, bits = spread.value
        at = _find(keys, ctx)
        salt = sfx >> (64 - np.append(bits, 0)[at]).clip(0, 63).astype(U64)
        yield from blobs.deal(RUN, TYPES[RUN], blobs.bucket_of(kernel.mix(np.where(at >= 0, ctx + salt, ctx)), buckets), ctx, sfx, n)

    for batch in batches:
        for c in kernel.chunks(batch.column(0)):
            for r in runs(c, d):
                _, ctx, sfx = r.pairs(d)
                live = np.flatnonzero(before.value.has(ctx))
                live = live[last.value.has(sfx[live])]
                if len(live):
                    parts.append(_add_runs([(ctx[live], sfx[live], np.ones(len(live), np.int64))]))
                    size += len(parts[-1][0])
                if size > ROOM:
                    parts = [_add_runs(parts)]
                    size = len(parts[0][0])
                    if size > ROOM // 2:
                        yield from out()
                        parts, size = [], 0
    if parts:
        parts = [_add_runs(parts)]
        yield from out()


def _often(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(ctx, sfx, n) of RUN records that add up to `least` or more."""

    def out(parts: list) -> Iterator[pa.RecordBatch]:
        ctx, sfx, n = blobs.add_up(2, *blobs.joined(parts))
        ok = np.flatnonzero(n >= least)
        for i in range(0, len(ok), 50_000):
            k = ok[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(ctx[k].view(np.int64)), pa.array(sfx[k].view(np.int64)), pa.array(n[k])], names=["ctx", "sfx", "n"])

    held, parts = None, []
    for bucket, _, columns, _ in blobs.read(batches, TYPES):
        if parts and bucket != held:
            yield from out(parts)
            parts = []
        held = bucket
        parts.append((columns[0], columns[1], columns[2].astype(np.int64)))
    if parts:
        yield from out(parts)


class Group:
    """Texts that a task has read in a row, what the cache holds of them, and the keys that it doesn't hold."""

    def __init__(self):
        self.texts, self.rows, self.asked, self.size, self.count = [], [], [], 0, 0

    def records(self, buckets: int) -> Iterator[pa.RecordBatch]:
        if not self.texts:
            return
        words, (text, *row) = np.concatenate(self.texts), blobs.joined(self.rows)
        name = kernel.mix(np.array([kernel.mix(words + kernel.mix(np.arange(len(words), dtype=U64))).sum(dtype=U64) ^ kernel.mix(row[0].view(U64) + kernel.mix(np.arange(len(text), dtype=U64))).sum(dtype=U64)]))[0]
        yield from blobs.deal(TEXT, TYPES[TEXT], home(name, text, buckets), np.full(len(text), name), text, *row)
        if self.asked:
            key, text, times = blobs.joined(self.asked)
            order = np.argsort(key)
            key = key[order]
            yield from blobs.deal(ASKED, TYPES[ASKED], blobs.bucket_of(key, buckets), key, np.full(len(key), name), text[order], times[order])


def home(group: np.uint64, text: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket where a text's rows and sums meet."""
    return blobs.bucket_of(kernel.mix(group ^ (text >> 7).astype(U64)), buckets)


def _ask(batches: Iterator[pa.RecordBatch], depth: int, tree: Tree, cache, keys, buckets: int) -> Iterator[pa.RecordBatch]:
    """ASKED records of the keys that the cache doesn't hold; TEXT records with the sums over those that it holds."""
    cache, keys, group = cache.value, keys.value, Group()
    end = (float(tree.log0[tree.end]) if tree.n_docs else 0.0, int(tree.n_docs > 0), float(np.log10(tree.n_docs + 1.0)))
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for c in kernel.chunks(batch.column(1)):
            tokens, sums, late, place = np.zeros(c.n, np.int64), np.tile(np.array(end)[:, None], c.n), [], None
            for r in runs(c, depth + 1):
                if place is None:
                    name, one, place = np.unique(r.texts, return_index=True, return_inverse=True)
                    if group.count + len(name) > 1 << 16 or group.size > ROOM:
                        yield from group.records(buckets)
                        group = Group()
                    place = place + group.count
                    alone = np.zeros(c.n, bool)  # equal texts are looked up once
                    alone[one] = True
                    group.texts.append(name)
                    group.count += len(name)
                tokens += np.bincount(r.doc[r.lead :], minlength=c.n)

                def look(i: np.ndarray, x: np.ndarray, worded: bool = False) -> None:
                    doc = r.doc[i]  # noqa: B023
                    slot = cache.slot(x)
                    hit = cache.key[slot] == x
                    found, slot = doc[hit], slot[hit]
                    sums[0] += np.bincount(found, cache.v[slot], sums.shape[1])  # noqa: B023
                    if worded:
                        sums[1] += np.bincount(found, minlength=sums.shape[1])  # noqa: B023
                        sums[2] += np.bincount(found, cache.base[slot], sums.shape[1])  # noqa: B023
                    rest = np.flatnonzero(~hit & alone[doc])  # noqa: B023
                    rest = rest[keys.has(x[rest])]
                    late.append((x[rest], doc[rest]))  # noqa: B023

                i = np.flatnonzero(r.is_word)
                look(i, r.symbol[i], True)
                for d in range(1, depth + 1):
                    i, ctx, _ = r.pairs(d)
                    look(i, ctx ^ STATE)
                    look(i, r.names[d][i])
            x, doc = blobs.joined(late)
            x, doc, times = blobs.add_up(2, x, doc, np.ones(len(x), np.int64))
            group.asked.append((x, place[doc], times))
            group.size += int(r.symbol.size)
            score, known, total = sums
            group.rows.append((place, ids[c.first : c.first + c.n], tokens - 1, np.rint(known).astype(np.int64), total, score))
    yield from group.records(buckets)


def _tell(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """VALUE records."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size > ROOM:
            yield from _values(held, buckets)
            held, size = [], 0
    if held:
        yield from _values(held, buckets)


def _values(held: list[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(held)
    key = t["key"].to_numpy().view(U64)
    order = np.argsort(key)
    yield from blobs.deal(VALUE, TYPES[VALUE], blobs.bucket_of(key[order], buckets), key[order], *[t[n].to_numpy()[order] for n in ("v", "known", "base")])


def _answer(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """SUM records of what the keys that texts ask for are worth; TEXT records as they are."""
    at, told, table, sums, size = None, [], None, [], 0

    def out() -> Iterator[pa.RecordBatch]:
        group, text, *rest = blobs.add_up(2, *blobs.joined(sums))
        yield from blobs.deal(SUM, TYPES[SUM], home(group, text, buckets), group, text, *rest)

    for bucket, kind, columns, blob in blobs.read(batches, TYPES):
        if bucket != at:
            at, told, table = bucket, [], None
        if kind == VALUE:
            told.append(columns)
        elif kind == TEXT:
            yield blobs.row(TEXT, [bucket], [blob])
        elif told:
            if table is None:
                key, *rest = blobs.joined(told)
                order = np.argsort(key)
                table = [key[order], *[x[order] for x in rest]]
            x, group, text, times = columns
            place = _find(table[0], x)
            ok = place >= 0
            group, text, times, place = group[ok], text[ok], times[ok].astype(np.int64), place[ok]
            sums.append(blobs.add_up(2, group, text, times * table[2][place], times * table[3][place], times * table[1][place]))
            size += len(sums[-1][0])
            if size > ROOM:
                sums = [blobs.add_up(2, *blobs.joined(sums))]
                size = len(sums[0][0])
                if size > ROOM // 2:
                    yield from out()
                    sums, size = [], 0
    if sums:
        yield from out()


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n_tokens, known, logs, score)."""

    def out(rows: list, sums: list) -> Iterator[pa.RecordBatch]:
        group, text, ids, tokens, known, logs, score = blobs.joined(rows)
        if sums:
            keys, more_text, *more = blobs.add_up(2, *blobs.joined([(a, b, c.astype(np.int64), d, e) for a, b, c, d, e in sums]))
            whole, name = np.unique(np.concatenate((keys, group))), np.uint64(16)
            at = _find(np.searchsorted(whole, keys).astype(U64) << name | more_text, np.searchsorted(whole, group).astype(U64) << name | text)
            known, logs, score = (own + np.where(at >= 0, x[at], 0) for own, x in zip((known, logs, score), more, strict=True))
        for i in range(0, len(ids), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000]) for x in (ids, tokens, known, logs, score)], names=["doc_id", "n_tokens", "known", "logs", "score"])

    at, rows, sums = None, [], []
    for bucket, kind, columns, _ in blobs.read(batches, TYPES):
        if bucket != at:
            if rows:
                yield from out(rows, sums)
            at, rows, sums = bucket, [], []
        (rows if kind == TEXT else sums).append(columns)
    if rows:
        yield from out(rows, sums)
