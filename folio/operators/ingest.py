"""Admission, fingerprints, document status, re-indexing and deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import file_type, safe_filename
from ..sources.store import written

TYPES = ("pdf", "txt", "md", "docx")
MOST_BYTES = 25 * 1024 * 1024


def admit(files: DataFrame) -> DataFrame:
    """files(file_name, content) with name, file_type, sha256 and reject_reason: unsupported, empty or too large, in that order; null if admitted."""
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    named = files.withColumn("name", safe_filename("file_name")).withColumn("file_type", file_type("name"))
    reason = (
        F.when(F.col("file_type").isNull() | ~F.col("file_type").isin(*TYPES), "unsupported")
        .when(size == 0, "empty").when(size > MOST_BYTES, "too large")
    )
    return named.withColumn("sha256", F.sha2("content", 256)).withColumn("reject_reason", reason)


def reject_duplicates(incoming: DataFrame, stored: DataFrame, arrival: str = "doc_id") -> DataFrame:
    """Admitted rows of incoming(kb_id, sha256, ...) that are new to their kb: neither stored nor, within the batch, a later copy.

    Only keys are shuffled to find the first of each; the rest of the row is not carried along.
    """
    keys = incoming.where("reject_reason is null").select("kb_id", "sha256", arrival)
    first = keys.groupBy("kb_id", "sha256").agg(F.min(arrival).alias(arrival))
    new = first.join(stored.select("kb_id", "sha256"), ["kb_id", "sha256"], "left_anti").select(arrival)
    return incoming.where("reject_reason is null").join(new, arrival, "left_semi")


def document_status(documents: DataFrame, pages: DataFrame, chunks: DataFrame, message: str = "no text found") -> DataFrame:
    """documents(doc_id, page_count, chunk_count) with counts and status: ready, or failed without a chunk (stored counts stay)."""
    n_pages = pages.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("new_pages"))
    n_chunks = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("new_chunks"))
    joined = documents.drop("status", "error_message").join(n_pages, "doc_id", "left").join(n_chunks, "doc_id", "left")
    failed = F.coalesce("new_chunks", F.lit(0)) == 0
    return joined.select(
        *(c for c in documents.columns if c not in ("status", "error_message", "page_count", "chunk_count")),
        F.when(failed, F.col("page_count")).otherwise(F.coalesce("new_pages", F.lit(0))).alias("page_count"),
        F.when(failed, F.col("chunk_count")).otherwise(F.col("new_chunks")).alias("chunk_count"),
        F.when(failed, "failed").otherwise("ready").alias("status"),
        F.when(failed, F.lit(message[:1000])).alias("error_message"),
    )


def reindex(chunks: DataFrame, fresh: DataFrame, ids: DataFrame) -> DataFrame:
    """chunks with those of the documents ``ids`` replaced by ``fresh``; documents without fresh chunks keep the old ones (their status says failed)."""
    done = ids.select("doc_id").join(fresh.select("doc_id").distinct(), "doc_id", "left_semi").distinct()
    return chunks.join(done, "doc_id", "left_anti").unionByName(fresh.join(done, "doc_id", "left_semi"))


def delete(parents: DataFrame, gone: DataFrame, key: str, *children: tuple[DataFrame, str]) -> list[DataFrame]:
    """What is left of parents and, level by level, of their children: each (table, key of its parent) hangs on the one before it."""
    gone = gone.select(key).distinct()
    left = [parents.join(gone, key, "left_anti").select(*parents.columns)]
    for table, parent_key in children:
        keys = gone.withColumnRenamed(gone.columns[0], parent_key)
        left.append(table.join(keys, parent_key, "left_anti").select(*table.columns))
        own = table.columns[0]
        gone = table.join(keys, parent_key, "left_semi").select(own)
    return left


#: Foreign keys: table, its own key, its parent and the column that names the parent's row. Citations keep their quote when a chunk goes, so chunks aren't their parents.
KEYS = (
    ("members", "member_id", "knowledge_bases", "kb_id"),
    ("documents", "doc_id", "knowledge_bases", "kb_id"),
    ("chunks", "chunk_id", "documents", "doc_id"),
    ("conversations", "conv_id", "knowledge_bases", "kb_id"),
    ("messages", "message_id", "conversations", "conv_id"),
    ("citations", "citation_id", "messages", "message_id"),
    ("datasets", "dataset_id", "knowledge_bases", "kb_id"),
    ("questions", "question_id", "datasets", "dataset_id"),
    ("runs", "run_id", "datasets", "dataset_id"),
    ("results", "result_id", "runs", "run_id"),
)


def delete_rows(tables: dict[str, DataFrame], root: str, gone: DataFrame, keys=KEYS) -> dict[str, DataFrame]:
    """What is left of all tables when the rows of ``root`` with the keys in ``gone`` (one column) are deleted, with all that hangs on them.

    The graph of keys is walked from the root, each table after its parents; only keys move. Rows without a parent's key
    stay, and so do tables that don't hang on the root. A table with several parents loses the rows of each.
    """
    left, lost = dict(tables), {root: gone.toDF("_gone").distinct()}
    own = {child: key for child, key, _, _ in keys}
    root_key = own.get(root) or next((column for _, _, parent, column in keys if parent == root), gone.columns[0])
    left[root] = tables[root].join(lost[root].withColumnRenamed("_gone", root_key), root_key, "left_anti").select(*tables[root].columns)
    waiting = [k for k in keys if k[0] in tables]
    while True:
        # a table's turn comes when no parent of it has still to lose rows
        ready = [k for k in waiting if k[2] in lost and not any(o[0] == k[2] and o in waiting for o in waiting if o is not k and o[2] in lost)]
        if not ready:
            return left
        child = ready[0][0]
        mine = [k for k in ready if k[0] == child]
        waiting = [k for k in waiting if k not in mine]
        found = None
        for _, key, parent, column in mine:
            rows = tables[child].join(lost[parent].withColumnRenamed("_gone", column), column, "left_semi").select(F.col(key).alias("_gone"))
            found = rows if found is None else found.union(rows)
            left[child] = left[child].join(lost[parent].withColumnRenamed("_gone", column), column, "left_anti").select(*tables[child].columns)
        lost[child] = written(found.distinct() if child not in lost else found.union(lost[child]).distinct())


#: Folders of a table that is stored by document.
DOC_BUCKETS = 64


def doc_bucket(n: int = DOC_BUCKETS):
    return F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")


def put_chunks(chunks: DataFrame, path: str, buckets: int = DOC_BUCKETS) -> None:
    """Store chunks by buckets of their documents, so that few documents can be replaced; what df holds of a bucket replaces what is there."""
    rows = chunks.withColumn("bucket", doc_bucket(buckets))
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def replace_chunks(path: str, fresh: DataFrame, ids: DataFrame, buckets: int = DOC_BUCKETS) -> tuple[DataFrame, DataFrame]:
    """Re-index documents in a table of ``put_chunks``: their stored chunks give way to those in ``fresh``.

    Only the buckets of these documents are read and written, each replaced as a whole when all are ready: a job that fails before changes nothing.
    Documents of ``ids`` without fresh chunks keep what they have. Returns (doc_id, status), ready or failed, of each
    document in ids, and (chunk_id, doc_id) of the stored chunks that are no more.
    """
    spark = fresh.sparkSession
    ids = written(ids.select("doc_id").distinct())
    fresh = written(fresh.join(ids, "doc_id", "left_semi"))
    done = written(fresh.select("doc_id").distinct())
    touched = [r[0] for r in done.select(doc_bucket(buckets).alias("b")).distinct().collect()]
    status = ids.join(done.withColumn("_done", F.lit(1)), "doc_id", "left").select("doc_id", F.when(F.col("_done") == 1, "ready").otherwise("failed").alias("status"))
    stored = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    old = written(stored)
    removed = written(old.join(done, "doc_id", "left_semi").select("chunk_id", "doc_id").join(fresh.select("chunk_id"), "chunk_id", "left_anti"))
    rows = written(old.join(done, "doc_id", "left_anti").unionByName(fresh.withColumn("bucket", doc_bucket(buckets))).select(*stored.columns))
    if touched:
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return status, removed


def write_table(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write a table partitioned by kb_id; overwriting replaces only the partitions that df holds."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("kb_id").parquet(path)
