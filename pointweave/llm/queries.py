"""Queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, packing, secret_ledger, sharding, sketch
from .decontaminate import Decontaminator
from .langid import LanguageId
from .minmax_dedup import MinMaxDedup
from .substring_dedup import SubstringDedup
from .suffix_tree import SuffixTreeScorer
from .workspace import Workspace, release

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCORER_TRAINING = "crc32(cast(doc_id as string)) % 7 <> 2"
LANGUAGE_TRAINING = "crc32(cast(doc_id as string)) % 5 <> 0"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MinMaxDedup(shingle_words=3, num=85, den=100).components(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = SuffixTreeScorer().score(_table(spark, sf_dir, "documents"), SCORER_TRAINING)
    return scores.select("doc_id", (~F.col("in_training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Decontaminator().matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ledger = _table(spark, sf_dir, "documents"), secret_ledger.Ledger(spark, Workspace(spark, "secrets").path)
    ledger.update(docs, secret_ledger.BASE)
    release(spark)
    ledger.update(docs)  # every blob is known: the rules that were added are due, no others
    found = ledger.findings(docs)
    base = F.filter("spans", lambda s: s["rank"] < len(secret_ledger.BASE))
    number = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(secret_ledger.listed(base), 256).alias("base_sha256"), secret_ledger.listed(F.col("spans")).alias("spans"), "blob",
    )


def op6_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(ids: list[int], texts: list[str], following: list[str]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(ids), 500):
            x, y = texts[at : at + 500], following[at : at + 500]
            cut = [len(t) // 4 for t in x]
            edited = [t[: len(t) - n] + u[:n] for t, u, n in zip(x, y, cut, strict=True)]
            own, changed = (sketch.sketches(pa.array(v, pa.string())) for v in (x, edited))
            # a block's last row isn't followed by its successor, which is in another block
            apart = [i for i, u in enumerate(y) if i + 1 == len(x) or x[i + 1] != u]
            after = [*own[1:], None]
            for i, s in zip(apart, sketch.sketches(pa.array([y[i] for i in apart], pa.string())), strict=True):
                after[i] = s
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[at : at + 500], pa.int64()), pa.array([len(t) for t in x], pa.int64()), pa.array(edited, pa.string()),
                    pa.array(list(map(sketch.encode, own))), pa.array(list(map(sketch.encode, changed))),
                    pa.array(list(map(sketch.resemblance, own, changed))), pa.array(list(map(sketch.resemblance, own, after))),
                ],
                names=["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = sketch.each_with_next(_table(spark, sf_dir, "documents"), run, schema)
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, language = _table(spark, sf_dir, "documents"), LanguageId()
    named = language.predict(docs, language.fit(docs, LANGUAGE_TRAINING))
    return named.select("doc_id", (~F.expr(LANGUAGE_TRAINING)).alias("held_out"), "lang_pred", "score", "rejected")


def op8_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"), licenses.digests(spark))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = SubstringDedup(window=50).cut(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.even_tree(16)
    shards = sharding.assign(_table(spark, sf_dir, "documents"), tree, sharding.grown(tree))
    return shards.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", F.col("other_shard").alias("grown_shard"), "region", "rack")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minmax_dedup, op2_packing, op3_suffix_tree, op4_decontaminate, op5_secret_ledger, op6_sketch, op7_language_id, op8_license_digest,
        op9_substring_dedup, op10_hash_tree,
    )
}
ORACLE: dict[str, str] = {"op8_license_digest": licenses.oracle_sql()}
