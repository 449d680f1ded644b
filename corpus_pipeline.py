"""A training corpus from ``documents``, in five stages.

Each stage is written as Parquet in the shared checkpoint folder and read again
as the next one's documents, so a lost executor costs at most one stage's work.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimwright.llm import bpe, language, mixing, near, pii
from claimwright.llm.common import ensure_checkpoint_dir, read
from claimwright.llm.queries import MIN_POSTERIOR, MIX_WEIGHTS, vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Documents whose 5-word shingle sets reach this similarity are one group.
NEAR_PERCENT = 80
#: Bytes of pieces that a worker remembers: workers live on from stage to stage, beside the memory of the others.
REMEMBERED = 64 << 20


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised."""
    return language.keep_identified(docs, language.identify(language.document_view(docs), min_posterior=MIN_POSTERIOR))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, repeated rows and rows without ids among them."""
    return near.keep_first(docs, percent=NEAR_PERCENT)


def sanitise_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that give it away, replaced in the text."""
    names = docs.columns
    clean = pii.sanitised(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*names)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights, in shuffled order."""
    return mixing.mix_sources(docs, MIX_WEIGHTS, copy_col=None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.bpe_digests(docs, vocabulary(), REMEMBERED)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("pii", sanitise_pii),
    ("mixing", mix),
    ("bpe", encode),
]

#: BPE cannot be written as SQL; tests hold the stages against plain Python.
ORACLE_SQL: str | None = None


def _drop(spark: SparkSession, path: str) -> None:
    """Remove a stage that its successor no longer needs, wherever the shared folder is."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
        if k:
            _drop(spark, f"{folder}/{k - 1}_{STAGES[k - 1][0]}")
    return docs
