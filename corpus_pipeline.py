"""Corpus pipeline: quality, near-duplicates, decontamination, personal data, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import bpe
from folio.llm.decontaminate import with_matches
from folio.llm.neardup import near_duplicates
from folio.llm.pii import with_surrogates
from folio.llm.quality import with_score
from folio.llm.queries import DEMO_KEY
from folio.llm.shared import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score 0.5 or more)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return with_score(docs.select(*COLUMNS), labels, COLUMNS, name="quality_score").where("quality_score >= 0.5").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, that with the smallest doc_id. Rows of one doc_id are one document; rows without one stay."""
    gone = written(near_duplicates(docs).where("not kept").select("doc_id").distinct())
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that matches a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return with_matches(docs.select(*COLUMNS), benchmark).where(F.size("item_ids") == 0).select(*COLUMNS)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars follows the new text."""
    out = with_surrogates(docs.select(*COLUMNS), DEMO_KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of the bytes that they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.round_trip(docs, path, public_tokenizers.PATTERN))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("PII", surrogates),
    ("byte-level BPE encoding and decoding", tokens),
]

#: SQL can express neither the classifier nor the surrogates; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of sf_dir through all stages, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
