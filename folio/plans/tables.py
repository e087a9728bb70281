"""The given tables in the shapes that the operators take."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import expand_query
from ..operators import embed, index, search
from ..operators.chunking import chunk_pages, word_counts
from ..sources.store import parts_to_deal, shared_dir, written

#: Questions take one of these words by item_id, so that every intent occurs.
QUESTION_WORDS = ("数据集 ", "局限 ", "贡献 ", "模型架构 ", "", "结果 ")
LANGS = ("en", "fr", "de", "es")


#: Tables that several queries of a session derive from the same input, each written once.
_stored: dict[tuple, DataFrame] = {}


def _state(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = ("documents", "benchmark")) -> tuple[str, str]:
    """A folder and the names, sizes and times of the files that derived tables come from: tables written anew are another input."""
    jvm = spark._jvm
    out = []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for f in fs.listStatus(path):
            out.append((f.getPath().getName(), f.getLen(), f.getModificationTime()))
    return sf_dir, str(sorted(out))


def stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The derived table of this name, as this application has written it for sf_dir."""
    key = (spark.sparkContext.applicationId, *_state(spark, sf_dir), name)
    if key not in _stored:
        found = written(make())
        n = parts_to_deal(found)
        _stored[key] = written(found.repartition(n)) if n else found
    return _stored[key]


#: Partitions that given tables are dealt to, as found once for an application and input.
_parts: dict[tuple, int] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; one whose rows lie in a few splits is dealt out, as the work on its rows is much more than their reading."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in ("documents", "conversations"):
        return df
    key = (spark.sparkContext.applicationId, *_state(spark, sf_dir, (name,)), name)
    if key not in _parts:
        _parts[key] = parts_to_deal(df)
    return df.repartition(_parts[key]) if _parts[key] else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with kb_id (their language), a name, a status and a time."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("kb_id"))
    return d.select(
        "doc_id", "kb_id", F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("document_name"),
        F.when(F.col("doc_id") % 17 == 0, "failed").otherwise("ready").alias("status"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("created_at"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page for each document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_number"), "text")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of several pages."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_number"), "text")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all words of the documents."""
    return stored(spark, sf_dir, "words", lambda: word_counts(table(spark, sf_dir, "documents")))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents, with ids that SQL can make too."""

    def make():
        found = chunk_pages(pages(spark, sf_dir)).withColumn("chunk_id", F.col("doc_id") * 100000 + F.col("chunk_index"))
        return found.join(documents(spark, sf_dir).select("doc_id", "kb_id", "document_name"), "doc_id")

    return stored(spark, sf_dir, "chunks", make)


#: Index folders that an application has written.
_indexes: dict[tuple, str] = {}


def bm25_index(spark: SparkSession, sf_dir: str) -> str:
    """Where the BM25 index of the chunks lies."""
    key = (spark.sparkContext.applicationId, *_state(spark, sf_dir))
    if key not in _indexes:
        at = f"{shared_dir(spark)}/folio-index-{uuid.uuid4().hex}"
        index.write_index(chunks(spark, sf_dir), at)
        _indexes[key] = at
    return _indexes[key]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions, with intent words and a kb."""
    b = table(spark, sf_dir, "benchmark")
    word = F.element_at(F.array(*(F.lit(w) for w in QUESTION_WORDS)), (F.col("item_id") % len(QUESTION_WORDS) + 1).cast("int"))
    kb = F.element_at(F.array(*(F.lit(x) for x in LANGS)), (F.col("item_id") % len(LANGS) + 1).cast("int"))
    return b.select(F.col("item_id").alias("query_id"), kb.alias("kb_id"), F.concat(word, "text").alias("question"), F.expr("cast(null as array<long>)").alias("doc_ids"))


def vector_store(spark: SparkSession) -> str:
    """Where vectors of all texts that this application has encoded lie."""
    return f"{shared_dir(spark)}/folio-vectors-{spark.sparkContext.applicationId}"


def ready_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, doc_id, kb_id, content) of the chunks of ready documents, dealt evenly to four tasks a core: splits of stored files differ in size, and vectors are made of all texts."""
    ready = documents(spark, sf_dir).where("status = 'ready'").select("doc_id")
    dealt = chunks(spark, sf_dir).select("chunk_id", "doc_id", "kb_id", "content").repartition(4 * spark.sparkContext.defaultParallelism, "doc_id")
    return dealt.join(ready, "doc_id", "left_semi").select("chunk_id", "doc_id", "kb_id", "content")


def embedded(asked: DataFrame) -> DataFrame:
    """Questions with the vectors of what they are expanded to."""
    return embed.hash_embed(asked.withColumn("expanded", expand_query("question")), "expanded", digest="md5").drop("expanded")


def near(spark: SparkSession, sf_dir: str, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, semantic): the k nearest chunks that each question may use; their vectors are made in the tasks."""
    encode = lambda texts: embed.hash_vectors(texts, digest="md5")
    found = search.vector_topk(embedded(asked), ready_chunks(spark, sf_dir), k, item_id="chunk_id", scope="kb_id", doc_ids="doc_ids", least=0.0, text="content", encode=encode)
    return found.select("query_id", F.col("item_id").alias("chunk_id"), F.col("score").alias("semantic"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 nearest chunks of each question."""
    return stored(spark, sf_dir, "candidates", lambda: near(spark, sf_dir, questions(spark, sf_dir), search.CANDIDATES))
