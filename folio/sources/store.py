"""Written tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset and Spark runs on this machine alone, a new temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="folio-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path, on any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def parts_to_deal(df: DataFrame) -> int:
    """Partitions that a table should be dealt to before costly work on its rows, at least one a core; 0 if its splits share the rows well enough.

    Splits follow the size of a file, but all rows of a row group come from one of them: a large file with one row group has many splits, of which
    one has all rows. So the rows of each split are counted, which reads the files' footers only.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    if len(rows) >= cores and max(rows) * cores <= 2 * sum(rows):
        return 0
    return max(cores, df.rdd.getNumPartitions())


def spread(df: DataFrame) -> DataFrame:
    """The same rows dealt to as many partitions as ``parts_to_deal`` says; as they are if it says 0."""
    n = parts_to_deal(df)
    return df.repartition(n) if n else df


def written(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read from there: what follows neither repeats the work nor loses it with an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folio-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
