"""What the operators share: tables that cut lineage, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_dir, written

__all__ = ["connected", "shared_dir", "small_batches", "written"]

#: Arrow batches of whole texts that a worker gets at a time; it cuts them into slices anyway.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Have the session hand texts to Python in batches of at most BATCH_BYTES (or one row); a smaller limit of its own stays."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(limit).lower().rstrip("b")
    if not now.lstrip("-").isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(limit, str(BATCH_BYTES))


def connected(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(v, label) for each end of an edge (a, b): label is the smallest vertex that it reaches.

    Labels spread along edges and jump to the label's label, so the rounds grow
    with the logarithm of a component's width. Each round is written, nothing but a count
    comes to the driver.
    """
    # rows are two numbers: fewer and larger parts than a shuffle of texts needs
    parts = max(8, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    edges = written(edges.select("a", "b").where("a <> b"))
    both = written(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().coalesce(parts))
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")).coalesce(parts))
    for _ in range(limit):
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("far"))
        following = written(
            labels.join(near, "v").join(jump, "label")
            .select("v", F.least("label", "near", "far").alias("label"), (F.least("near", "far") < F.col("label")).alias("moved"))
            .coalesce(parts)
        )
        moved = following.where("moved").limit(1).count()
        labels = following.select("v", "label")
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {limit} rounds")
