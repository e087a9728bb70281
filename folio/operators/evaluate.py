"""Retrieval evaluation: labels, metrics of questions, aggregates of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labels_from_answers(messages: DataFrame, citations: DataFrame) -> DataFrame:
    """(conv_id, question, relevant_chunk_ids): cited chunks of each answer, in order, as labels of its question."""
    asked = messages.where("role = 'user'").select("conv_id", F.col("content").alias("question"))
    told = messages.where("role = 'assistant'").select("conv_id", "message_id")
    cited = told.join(citations, "message_id").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("cited"))
    return asked.join(cited, "conv_id").select("conv_id", "question", F.array_distinct(F.transform("cited", lambda c: c["chunk_id"])).alias("relevant_chunk_ids"))


def check_labels(questions: DataFrame, datasets: DataFrame, documents: DataFrame, chunks: DataFrame, removed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Questions with distinct labels, in order, and unknown labels (question_id, chunk_id): not a chunk of the data set's kb, maybe any more.

    With removed(chunk_id, doc_id), the chunks that re-indexing has removed, they have a reason too: ``stale`` for a chunk that the kb
    once had, ``unknown`` for one that it never had.
    """
    clean = questions.withColumn("relevant_chunk_ids", F.array_distinct("relevant_chunk_ids"))
    each = clean.join(datasets.select("dataset_id", "kb_id"), "dataset_id").select("question_id", "kb_id", F.explode("relevant_chunk_ids").alias("chunk_id"))
    known = chunks.select("chunk_id", "doc_id").join(documents.select("doc_id", "kb_id"), "doc_id").select("kb_id", "chunk_id")
    missing = each.join(known, ["kb_id", "chunk_id"], "left_anti")
    if removed is None:
        return clean, missing.select("question_id", "chunk_id")
    once = removed.select("chunk_id", "doc_id").join(documents.select("doc_id", "kb_id"), "doc_id").select("kb_id", "chunk_id", F.lit("stale").alias("_once")).distinct()
    reasons = missing.join(once, ["kb_id", "chunk_id"], "left").select("question_id", "chunk_id", F.coalesce("_once", F.lit("unknown")).alias("reason"))
    return clean, reasons


def question_metrics(questions: DataFrame, hits: DataFrame, top_k: int) -> DataFrame:
    """(question_id, dataset_id, recall, precision, reciprocal_rank, retrieved_chunk_ids) of questions(question_id, dataset_id, relevant_chunk_ids) and hits(question_id, rank, chunk_id)."""
    labels = questions.select("question_id", F.explode(F.array_distinct("relevant_chunk_ids")).alias("chunk_id"), F.lit(1).alias("relevant"))
    kept = hits.where(F.col("rank") <= top_k).select("question_id", "rank", "chunk_id").join(labels, ["question_id", "chunk_id"], "left")
    found = kept.groupBy("question_id").agg(
        F.count("relevant").alias("matches"), F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda h: h["chunk_id"]).alias("retrieved"),
    )
    rows = questions.join(found, "question_id", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    size = F.size(F.array_distinct("relevant_chunk_ids"))
    return rows.select(
        "question_id", "dataset_id", F.when(size > 0, F.col("matches") / size).otherwise(0.0).alias("recall"), (F.col("matches") / F.lit(top_k)).alias("precision"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), F.coalesce("retrieved", F.expr("cast(array() as array<long>)")).alias("retrieved_chunk_ids"),
    )


def run_metrics(results: DataFrame, by: str = "dataset_id") -> DataFrame:
    """(by, questions, recall_at_k, precision_at_k, mrr, hit_rate) and, if results have latency_ms, its mean."""
    means = [
        F.count(F.lit(1)).alias("questions"), F.avg("recall").alias("recall_at_k"), F.avg("precision").alias("precision_at_k"),
        F.avg("reciprocal_rank").alias("mrr"), F.avg((F.col("precision") > 0).cast("double")).alias("hit_rate"),
    ]
    if "latency_ms" in results.columns:
        means.append(F.avg("latency_ms").alias("average_latency_ms"))
    return results.groupBy(by).agg(*means)


def empty_datasets(datasets: DataFrame, questions: DataFrame) -> DataFrame:
    """Data sets without a question: a run over them is an error."""
    return datasets.join(questions.select("dataset_id").distinct(), "dataset_id", "left_anti")


def run_history(runs: DataFrame) -> DataFrame:
    """Runs, newest first."""
    return runs.orderBy(F.desc("created_at"), F.desc("run_id"))


def dataset_list(datasets: DataFrame, questions: DataFrame) -> DataFrame:
    """Data sets with their numbers of questions, 0 included, newest first."""
    n = questions.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("question_count"))
    out = datasets.join(n, "dataset_id", "left").withColumn("question_count", F.coalesce("question_count", F.lit(0)))
    return out.orderBy(F.desc("created_at"), F.desc("dataset_id"))
