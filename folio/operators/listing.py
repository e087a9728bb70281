"""Knowledge bases, documents, access and request metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visible_kbs(kbs: DataFrame, members: DataFrame, documents: DataFrame) -> DataFrame:
    """(user_id, kb_id, name, role, created_at, document_count) of the kbs that each user is a member of, oldest first."""
    n = documents.groupBy("kb_id").agg(F.count("doc_id").alias("document_count"))
    out = members.select("user_id", "kb_id", "role").join(kbs, "kb_id").join(n, "kb_id", "left")
    return out.withColumn("document_count", F.coalesce("document_count", F.lit(0))).orderBy("created_at", "kb_id")


def kb_documents(documents: DataFrame, kb_id) -> DataFrame:
    """Documents of one kb, newest first."""
    return documents.where(F.col("kb_id") == kb_id).orderBy(F.desc("created_at"), F.desc("doc_id"))


def ready_counts(documents: DataFrame) -> DataFrame:
    """(kb_id, ready, total) by kb."""
    return documents.groupBy("kb_id").agg(F.count_if(F.col("status") == "ready").alias("ready"), F.count(F.lit(1)).alias("total"))


def allowed(requests: DataFrame, members: DataFrame, write: bool = False) -> DataFrame:
    """Requests (user_id, kb_id) by members; to write, by owners and editors."""
    fit = members.where(F.col("role").isin("owner", "editor")) if write else members
    return requests.join(fit.select("user_id", "kb_id"), ["user_id", "kb_id"], "left_semi")


def check_requested(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """(request_id, accepted) of requests(request_id, kb_id, doc_ids): all ids exist, are ready, and in the kb."""
    each = requests.select("request_id", "kb_id", F.explode_outer(F.array_distinct("doc_ids")).alias("doc_id"))
    good = documents.where("status = 'ready'").select("doc_id", "kb_id", F.lit(True).alias("good"))
    joined = each.join(good, ["doc_id", "kb_id"], "left")
    return joined.groupBy("request_id").agg(F.bool_and(F.coalesce("good", F.col("doc_id").isNull())).alias("accepted"))


def request_metrics(requests: DataFrame, by: list | None = None) -> DataFrame:
    """(requests, errors, error_rate, mean_latency_ms) of requests(path, status, latency_ms) but for health checks."""
    kept = requests.where(F.col("path") != "/health")
    n = F.count(F.lit(1))
    errors = F.count_if(F.col("status") >= 400)
    return kept.groupBy(*(by or [])).agg(
        n.alias("requests"), errors.alias("errors"), F.round(errors / F.greatest(F.lit(1), n), 4).alias("error_rate"),
        F.round(F.coalesce(F.sum("latency_ms"), F.lit(0.0)) / F.greatest(F.lit(1), n) + 1e-9, 2).alias("mean_latency_ms"),
    )
