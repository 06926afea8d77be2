"""From documents to packed training sequences.

Each stage is a function (spark, docs, sf_dir) that works on what its predecessor kept; all but
the last return the columns of documents. run() writes each stage's rows as Parquet in the shared
folder and reads them again, so a lost executor never costs more than a stage's own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointweave.llm import packing, secret_ledger
from pointweave.llm.decontaminate import Decontaminator
from pointweave.llm.langid import LanguageId
from pointweave.llm.minmax_dedup import MinMaxDedup
from pointweave.llm.queries import LANGUAGE_TRAINING, TOKENIZER
from pointweave.llm.workspace import Workspace


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence; the model is fitted on docs itself."""
    language = LanguageId()
    return language.keep_known(docs, language.fit(docs, LANGUAGE_TRAINING))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the least doc_id."""
    return MinMaxDedup(shingle_words=5, num=80, den=100).keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return Decontaminator().clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a marker in place of each secret."""
    return secret_ledger.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their token ids."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("packing", pack)]
#: Model fitting, signatures and tokenization are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.keep(stage(spark, docs, sf_dir), name)
    return docs
