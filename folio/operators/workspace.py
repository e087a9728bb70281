"""Reading cards, comparisons, the reader's view, and the translation queue.

Table: chunks(doc_id, chunk_id, chunk_index, page_number, section_path, content), documents(doc_id, document_name, status).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import clean_display_text, is_display_noise, reader_sentences, signal_count, workspace_sentences
from ..sources.store import written


def excerpt(content, signals) -> Column:
    """The sentence with most signals, the first among equals, up to 360 signs; without sentences, the cleaned text's beginning."""
    found = F.transform(workspace_sentences(content), lambda s, i: F.struct(signal_count(F.lower(s), signals).alias("n"), (-i).alias("before"), s.alias("text")))
    return F.substring(F.coalesce(F.array_max(found)["text"], clean_display_text(content)), 1, 360)


def best_chunks(chunks: DataFrame, aspects=rules.ASPECTS) -> DataFrame:
    """(doc_id, a0, a1, ...): for each aspect the index of the chunk with most signals, ties to the first; null without any.

    One pass with partial aggregation; no text moves.
    """
    low = F.lower("content")
    counted = chunks.select("doc_id", "chunk_index", *(signal_count(low, s).alias(f"n{i}") for i, (_, s) in enumerate(aspects)))
    best = lambda i: F.max(F.when(F.col(f"n{i}") > 0, F.struct(F.col(f"n{i}"), -F.col("chunk_index"))))
    rows = counted.groupBy("doc_id").agg(*(best(i).alias(f"b{i}") for i in range(len(aspects))))
    return rows.select("doc_id", *((-F.col(f"b{i}")["col2"]).alias(f"a{i}") for i in range(len(aspects))))


def aspect_rows(documents: DataFrame, chunks: DataFrame, aspects=rules.ASPECTS) -> DataFrame:
    """(doc_id, aspect, value, page_number, section, quote): each document's excerpt and evidence for each aspect."""
    n = len(aspects)
    best = best_chunks(chunks, aspects)
    wanted = best.select("doc_id", F.posexplode(F.array(*(f"a{i}" for i in range(n)))).alias("aspect", "chunk_index")).where("chunk_index is not null")
    found = wanted.join(chunks, ["doc_id", "chunk_index"])
    value = F.lit(None).cast("string")
    for i, (_, signals) in enumerate(aspects):
        value = F.when(F.col("aspect") == i, excerpt("content", signals)).otherwise(value)
    found = found.select("doc_id", "aspect", value.alias("value"), "page_number", F.col("section_path").alias("section"), F.substring(clean_display_text("content"), 1, 420).alias("quote"))
    all_rows = documents.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("aspect"))
    return all_rows.join(found, ["doc_id", "aspect"], "left").withColumn("value", F.coalesce("value", F.lit(rules.NOT_FOUND)))


def _evidence(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """Distinct (page, quote) in aspect order, the section of the last: an array of at most ``most``."""
    each = rows.where("quote is not null").groupBy(*by, "page_number", "quote").agg(F.min("aspect").alias("first"), F.max_by("section", "aspect").alias("section"))
    listed = each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("first", "page_number", "section", "quote"))).alias("all"))
    return listed.select(*by, F.transform(F.slice("all", 1, most), lambda e: F.struct(e["page_number"].alias("page_number"), e["section"].alias("section"), e["quote"].alias("quote"))).alias("evidence"))


def reading_cards(documents: DataFrame, chunks: DataFrame, aspects=rules.ASPECTS, overview: str = rules.OVERVIEW_ASPECT) -> DataFrame:
    """(doc_id, document_name, overview, aspect_0, ..., evidence): one card for each document."""
    rows = written(aspect_rows(documents, chunks, aspects))  # read for the cards and for their evidence
    cards = rows.groupBy("doc_id").agg(*(F.max(F.when(F.col("aspect") == i, F.col("value"))).alias(f"aspect_{i}") for i in range(len(aspects))))
    at = [name for name, _ in aspects].index(overview)
    first = chunks.groupBy("doc_id").agg(F.min("chunk_index").alias("chunk_index")).join(chunks, ["doc_id", "chunk_index"]).select("doc_id", excerpt("content", ()).alias("opening"))
    out = documents.select("doc_id", "document_name").join(cards, "doc_id").join(first, "doc_id", "left").join(_evidence(rows, ["doc_id"], 5), "doc_id", "left")
    value = F.col(f"aspect_{at}")
    return out.select(
        "doc_id", "document_name", F.when(value == rules.NOT_FOUND, F.coalesce("opening", F.lit(rules.NOT_FOUND))).otherwise(value).alias("overview"),
        *(f"aspect_{i}" for i in range(len(aspects))), F.coalesce("evidence", F.expr("cast(array() as array<struct<page_number:int,section:string,quote:string>>)")).alias("evidence"),
    )


def comparison(sets: DataFrame, documents: DataFrame, chunks: DataFrame, aspects=rules.ASPECTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (set_id, aspect, label, values), evidence (set_id, doc_id, evidence) and rejected sets (set_id, reason) of sets(set_id, doc_ids).

    A set is 2 to 5 different ready documents; values keep its order.
    """
    asked = sets.select("set_id", F.size("doc_ids").alias("n"), F.posexplode("doc_ids").alias("at", "doc_id"))
    known = documents.where("status = 'ready'").select("doc_id", F.lit(1).alias("known"))
    checked = asked.join(known, "doc_id", "left")
    fine = checked.groupBy("set_id", "n").agg(F.count("known").alias("found"), F.countDistinct("doc_id").alias("different"))
    reason = F.when(~F.col("n").between(2, 5) | (F.col("different") != F.col("n")), "size").when(F.col("found") < F.col("n"), "not ready")
    fine = fine.withColumn("reason", reason)
    good = asked.join(fine.where("reason is null").select("set_id"), "set_id", "left_semi")
    used = documents.join(good.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = good.join(written(aspect_rows(used, chunks.join(used.select("doc_id"), "doc_id", "left_semi"), aspects)), "doc_id")
    listed = rows.groupBy("set_id", "aspect").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda v: v["value"]).alias("values"))
    label = F.element_at(F.array(*(F.lit(name) for name, _ in aspects)), F.col("aspect") + 1)
    table = listed.select("set_id", "aspect", label.alias("label"), "values")
    return table, _evidence(rows, ["set_id", "doc_id"], 4), fine.where("reason is not null").select("set_id", "reason")


def reader_view(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, page_number, section_path, text) of ready documents, cleaned; order by the first two to read."""
    ready = documents.where("status = 'ready'").select("doc_id")
    return chunks.join(ready, "doc_id", "left_semi").select("doc_id", "chunk_index", "page_number", "section_path", clean_display_text("content").alias("text"))


def translation_queue(view: DataFrame) -> DataFrame:
    """(sentence, uses): the distinct sentences of a reader's view that are worth translating."""
    each = view.select(F.explode(reader_sentences("text")).alias("sentence"))
    return each.where((F.trim("sentence") != "") & ~is_display_noise("sentence")).groupBy("sentence").agg(F.count(F.lit(1)).alias("uses"))
