"""Continuous ingest, and request metrics by window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_pages
from ..operators.ingest import admit, document_status, reject_duplicates
from ..operators.listing import request_metrics
from ..sources.files import decoded
from ..sources.store import exists, written


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


#: Folders of the stored fingerprints; a batch reads those that its own fall into.
FINGERPRINT_BUCKETS = 256


def _bucket():
    return F.pmod(F.xxhash64("kb_id", "sha256"), F.lit(FINGERPRINT_BUCKETS)).cast("int").alias("bucket")


def stored_fingerprints(files: DataFrame, store: str, batch: int) -> DataFrame:
    """(kb_id, sha256) stored by other batches, from the buckets of these files' fingerprints alone."""
    spark = files.sparkSession
    own = [r[0] for r in files.select(_bucket()).distinct().collect()]
    known = _read(spark, f"{store}/fingerprints", "kb_id string, sha256 string, bucket int, batch long")
    return known.where(F.col("bucket").isin(own) & (F.col("batch") != batch)).select("kb_id", "sha256")


def ingest_batch(spark: SparkSession, files: DataFrame, store: str, batch: int, embed: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Admit, deduplicate against what is stored, chunk and store one batch of files(doc_id, kb_id, file_name, content).

    The batch's number is a partition of each table and is overwritten when the batch runs again, so a repeated
    batch changes nothing.
    """
    # once written, neither fingerprints nor the choice of new files are made again for each table
    checked = written(admit(files))
    new = written(reject_duplicates(checked, stored_fingerprints(checked.where("reject_reason is null"), store, batch)))
    pages = new.select("doc_id", F.lit(1).alias("page_number"), decoded("content").alias("text"))
    chunks = chunk_pages(pages).join(new.select("doc_id", "kb_id"), "doc_id")
    if embed is not None:
        chunks = embed(chunks)
    documents = new.select("doc_id", "kb_id", "name", "file_type", "sha256", F.lit(0).alias("page_count"), F.lit(0).alias("chunk_count"), F.lit("processing").alias("status"), F.lit(None).cast("string").alias("error_message"))
    rejected = checked.where("reject_reason is not null").select("doc_id", "kb_id", "name", "reject_reason")

    def put(df: DataFrame, table: str) -> None:
        df.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{store}/{table}")

    put(chunks, "chunks")
    put(rejected, "rejected")
    done = _read(spark, f"{store}/chunks", "doc_id long, batch long").where(F.col("batch") == batch)
    put(document_status(documents, pages, done), "documents")
    # last: what a batch has stored is not new to later ones; the batch itself, run again, doesn't look at its own
    prints = new.select("kb_id", "sha256", _bucket(), F.lit(batch).cast("long").alias("batch"))
    prints.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{store}/fingerprints")


def ingest_stream(files: DataFrame, store: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """A streaming query that ingests all files there are, then stops; run again, it takes what is new."""

    def one(df: DataFrame, batch: int) -> None:
        ingest_batch(df.sparkSession, df, store, batch, embed)

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_metrics(requests: DataFrame, size: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Request metrics by window of ``ts``; as a stream, state is bounded by the watermark and later rows are dropped."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    marked = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("window", window)
    out = request_metrics(marked, ["window"])
    return out.select(F.col("window.start").alias("window_start"), "requests", "errors", "error_rate", "mean_latency_ms")
