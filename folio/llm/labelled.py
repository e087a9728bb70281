"""A bounded, repeatable sample of labelled texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, folds: int):
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, each: int, longest: int | None = None) -> DataFrame:
    """(doc_id, text, y): of each label, at most ``each`` documents outside the held-out fold, by smallest hash of their id.

    docs has doc_id and text. Labels other than 0 and 1, and null ids, are left out; of an id labelled more than
    once, the largest label counts. The ids are chosen before the texts are read, so few texts move. With ``longest``, texts of more bytes make room for others.
    """
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", folds) != held_out))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    if longest is not None:
        usable = usable.join(docs.where(F.octet_length("text") <= longest).select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = None
    for y in (0, 1):
        part = usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
        chosen = part if chosen is None else chosen.union(part)
    # at most 2 * each ids: small enough to send
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
