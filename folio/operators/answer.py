"""Extractive answers with citations from ranked hits, for many questions at once.

Tables: questions(query_id, question), hits(query_id, rank, chunk_id, document_name, page_number, content, score).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import any_of, clean_display_text, excerpt_sentences, expand_query, signal_count, squeezed, strip, summary_sentences, terms, word_boundary


def best_excerpt(question, content, expansions=rules.EXPANSIONS, research=rules.RESEARCH_WORDS, triggers=rules.METHOD_TRIGGERS, signals=rules.EXCERPT_METHOD_SIGNALS) -> Column:
    """The sentence that answers best, the first among equals, up to 420 signs; without sentences, the content's beginning."""
    asked = terms(expand_query(question, expansions))
    method = any_of(question, triggers)

    def score(s):
        low = F.lower(s)
        overlap = F.size(F.array_intersect(asked, terms(s))) / F.greatest(F.lit(1), F.size(asked))
        bonus = F.when(any_of(low, research), 0.08).otherwise(0.0) + F.when(method, F.least(F.lit(0.42), signal_count(low, signals) * 0.07)).otherwise(0.0)
        years = F.regexp_count(s, F.lit(word_boundary(r"\p{Nd}{4}")))
        listed = F.startswith(low, F.lit("references")) | (years >= 4) | F.contains(low, F.lit("arxiv preprint"))
        return overlap + bonus - F.when(listed, 0.35).otherwise(0.0)

    scored = F.transform(excerpt_sentences(content), lambda s, i: F.struct(F.round(score(s), 12).alias("score"), (-i).alias("before"), s.alias("text")))
    best = F.array_max(scored)["text"]
    return strip(F.substring(F.coalesce(best, F.col(content) if isinstance(content, str) else content), 1, 420))


def _by_question(hits: DataFrame, columns: list[Column], most: int) -> DataFrame:
    """The first hits of each question in order, as an array of at most ``most`` structs."""
    kept = hits.where(F.col("rank") <= most)
    return kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *columns))).alias("hits"))


def _no_line() -> Column:
    return F.lit(None).cast("string")


def _lines(content: Column) -> Column:
    breaks = "\r\n|[" + "".join(f"\\x{{{c:x}}}" for c in (0xA, 0xB, 0xC, 0xD, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029)) + "]"
    return F.filter(F.transform(F.split(content, breaks), squeezed), lambda x: x != "")


def dataset_answer(hits: DataFrame, datasets=(), metrics=rules.METRICS, plain=rules.PLAIN_METRIC, signals=()) -> DataFrame:
    """(query_id, answer): known data sets and metrics in the first 5 hits, and the first reported result of the first 3.

    The caller names the data sets of its field, (label, signals), and the signals of a line that reports a result.
    """
    line = lambda lines: F.array_max(  # noqa: E731  the first line with a signal, as (-position)
        F.filter(F.transform(lines, lambda x, i: F.when((F.length(x) > 24) & any_of(F.lower(x), signals), -i)), lambda i: i.isNotNull())
    )
    rows = _by_question(hits, [F.col("content"), _lines(F.col("content")).alias("lines")], 5)
    low = F.lower(F.array_join(F.transform("hits", lambda h: h["content"]), "\n"))
    rows = rows.select("query_id", low.alias("low"), F.transform(F.filter("hits", lambda h: h["rank"] <= 3), lambda h: F.struct(h["lines"].alias("lines"), line(h["lines"]).alias("at"))).alias("found"))
    first = F.get(F.filter("found", lambda f: f["at"].isNotNull()), 0)
    begin = F.greatest(F.lit(0), -first["at"] - 1)
    result = F.substring(F.array_join(F.slice(first["lines"], begin + 1, -first["at"] + 4 - begin), " "), 1, 420)
    labels = F.array_compact(F.array(_no_line(), *(F.when(any_of("low", s), F.lit("- " + label)) for label, s in datasets)))
    named = F.array_compact(F.array(_no_line(), *(F.when(F.contains("low", F.lit(s)), F.lit("- " + label)) for label, s in metrics)))
    fallback = F.when(F.contains("low", F.lit(plain[0])), F.lit("- " + plain[1])).otherwise(F.lit(rules.TEXT_NO_METRICS))
    listed = lambda a, none: F.when(F.size(a) > 0, F.array_join(a, "\n")).otherwise(none)
    sections = F.array_compact(F.array(
        F.concat(F.lit(rules.TEXT_DATASETS + "\n"), listed(labels, F.lit(rules.TEXT_NO_DATASETS))),
        F.concat(F.lit(rules.TEXT_METRICS + "\n"), listed(named, fallback)),
        F.when(result.isNotNull(), F.concat(F.lit(rules.TEXT_RESULTS + "\n- "), result, F.lit(" [1]"))),
        F.lit(rules.TEXT_DATASET_END),
    ))
    return rows.select("query_id", F.array_join(sections, "\n\n").alias("answer"))


def component_lines(hits: DataFrame, components=()) -> DataFrame:
    """(query_id, lines): a line for each of the caller's components (line, sets of signals), citing the first of 5 hits that holds all signals of one of its sets."""
    low = F.lower("content")
    firsts = []
    for _, sets in components:
        at = [F.min(F.when(F.forall(F.array(*(F.contains(low, F.lit(s)) for s in one)), lambda x: x), F.col("rank"))) for one in sets]
        firsts.append(F.coalesce(*at))
    cited = hits.where("rank <= 5").groupBy("query_id").agg(F.count(F.lit(1)), *(c.alias(f"c{i}") for i, c in enumerate(firsts)))
    lines = [F.when(F.col(f"c{i}").isNotNull(), F.concat(F.lit(text + "["), F.col(f"c{i}"), F.lit("]"))) for i, (text, _) in enumerate(components)]
    return cited.select("query_id", F.array_compact(F.array(_no_line(), *lines)).alias("lines"))


def method_answer(hits: DataFrame, components=()) -> DataFrame:
    """(query_id, answer) of the questions with two components or more."""
    text = F.concat(F.lit(rules.TEXT_METHOD_HEAD + "\n"), F.array_join("lines", "\n"), F.lit("\n\n" + rules.TEXT_METHOD_END))
    return component_lines(hits, components).where(F.size("lines") >= 2).select("query_id", text.alias("answer"))


def summary_answer(hits: DataFrame, slots=rules.SUMMARY_SLOTS, components=()) -> DataFrame:
    """(query_id, answer) of the questions with a problem and a proposal sentence in the first 4 hits."""
    each = hits.where("rank <= 4").select("query_id", "rank", F.posexplode(summary_sentences("content")).alias("at", "sentence"))
    low = F.lower("sentence")
    for name, _, signals in slots:
        each = each.withColumn(name, signal_count(low, signals))
    best = lambda name: F.max(F.when(F.col(name) > 0, F.struct(F.col(name), -F.col("rank"), -F.col("at"), F.col("sentence"), F.col("rank").alias("cited"))))
    chosen = each.groupBy("query_id").agg(*(best(name).alias(name) for name, *_ in slots))
    line = lambda name, head: F.concat(F.lit(head + "\n- "), F.substring(F.col(name)["sentence"], 1, 460), F.lit(" ["), F.col(name)["cited"], F.lit("]"))
    (problem, h1, _), (proposal, h2, _), (result, h3, _) = slots
    method = component_lines(hits, components).where(F.size("lines") >= 2).select("query_id", F.slice("lines", 1, 4).alias("lines"))
    rows = chosen.where(F.col(problem).isNotNull() & F.col(proposal).isNotNull()).join(method, "query_id", "left")
    parts = F.array_compact(F.array(
        line(problem, h1), line(proposal, h2),
        F.when(F.col("lines").isNotNull(), F.concat(F.lit(rules.TEXT_CONTRIBUTIONS + "\n"), F.array_join("lines", "\n"))),
        F.when(F.col(result).isNotNull(), line(result, h3)), F.lit(rules.TEXT_SUMMARY_END),
    ))
    return rows.select("query_id", F.array_join(parts, "\n\n").alias("answer"))


def excerpt_answer(questions: DataFrame, hits: DataFrame, **kw) -> DataFrame:
    """(query_id, answer): distinct excerpts of the first 3 hits, numbered."""
    each = hits.where("rank <= 3").join(questions.select("query_id", "question"), "query_id")
    each = each.select("query_id", "rank", best_excerpt("question", "content", **kw).alias("excerpt")).where("excerpt <> ''")
    first = each.groupBy("query_id", "excerpt").agg(F.min("rank").alias("rank"))
    lines = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "excerpt"))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("- "), x["excerpt"], F.lit(" ["), x["rank"], F.lit("]"))), "\n")
    whole = F.concat(F.lit(rules.TEXT_EXCERPTS_HEAD + "\n"), F.coalesce(body, F.lit("")), F.lit("\n\n" + rules.TEXT_EXCERPTS_END))
    return questions.select("query_id").join(lines, "query_id", "left").select("query_id", whole.alias("answer"))


def batch_answers(questions: DataFrame, hits: DataFrame, triggers: dict | None = None, slots=rules.SUMMARY_SLOTS, components=(), limitation=rules.LIMITATION_WORDS, least: float = 0.02, dataset_rules: dict | None = None, excerpt_rules: dict | None = None) -> DataFrame:
    """(query_id, kind, answer): the first way of answering that applies to each question.

    Too little evidence; a question for limitations without any in the hits; data sets; method and summary, if they
    find enough; else excerpts. ``triggers`` may replace the trigger words: dataset, method, summary, limitation.
    """
    t = {"dataset": rules.DATASET_TRIGGERS, "method": rules.METHOD_TRIGGERS, "summary": rules.SUMMARY_TRIGGERS, "limitation": rules.LIMITATION_TRIGGERS} | (triggers or {})
    top = hits.groupBy("query_id").agg(F.min_by("score", "rank").alias("top"), F.max(any_of(F.lower("content"), limitation)).alias("stated"))
    rows = questions.select("query_id", "question").join(top, "query_id", "left")
    for name, found in (
        ("dataset", dataset_answer(hits, **(dataset_rules or {}))), ("method", method_answer(hits, components)),
        ("summary", summary_answer(hits, slots, components)), ("excerpts", excerpt_answer(questions, hits, **(excerpt_rules or {}))),
    ):
        rows = rows.join(found.withColumnRenamed("answer", name), "query_id", "left")
    kind = (
        F.when(F.col("top").isNull() | (F.col("top") < least), "none")
        .when(any_of("question", t["limitation"]) & ~F.col("stated"), "refusal")
        .when(any_of("question", t["dataset"]), "dataset")
        .when(any_of("question", t["method"]) & F.col("method").isNotNull(), "method")
        .when(any_of("question", t["summary"]) & F.col("summary").isNotNull(), "summary").otherwise("excerpts")
    )
    text = F.when(F.col("kind") == "none", rules.TEXT_NO_EVIDENCE).when(F.col("kind") == "refusal", rules.TEXT_NO_LIMITATION)
    for name in ("dataset", "method", "summary", "excerpts"):
        text = text.when(F.col("kind") == name, F.col(name))
    return rows.withColumn("kind", kind).select("query_id", "kind", text.alias("answer"))


def prompts(questions: DataFrame, hits: DataFrame, head: str = "") -> DataFrame:
    """(query_id, prompt): the question and numbered evidence, for an external model."""
    block = F.format_string(rules.PROMPT_HIT, "rank", "document_name", "page_number", "content")
    evidence = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("blocks"))
    text = F.concat(F.lit(head + rules.PROMPT_QUESTION), "question", F.lit("\n\n" + rules.PROMPT_EVIDENCE + "\n"), F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n"))
    return questions.join(evidence, "query_id").select("query_id", text.alias("prompt"))


def cited_window(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """The hits up to the largest [n] of each answer; all without a citation, none for [0]."""
    numbers = F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\p{Nd}{1,2})\]"), 1), lambda n: n.cast("int"))
    return hits.join(answers.select("query_id", F.array_max(numbers).alias("cited")), "query_id").where("cited is null or rank <= cited").drop("cited")


def evidence_quality(questions: DataFrame, cited: DataFrame) -> DataFrame:
    """(query_id, confidence, coverage): how well the cited hits support each answer."""
    n = F.count(F.lit(1))
    stats = cited.groupBy("query_id").agg(
        n.alias("n"), F.countDistinct(F.struct("document_name", "page_number")).alias("pages"),
        F.count_if(F.col("score") >= 0.55).alias("strong"), F.min_by("score", "rank").alias("first"),
    )
    value = F.least(F.lit(1.0), F.col("pages") / F.greatest(F.lit(1), F.least(F.lit(3), F.col("n"))) * 0.45 + F.col("strong") / F.greatest(F.lit(1), F.col("n")) * 0.45 + F.least(F.lit(1.0), F.col("first")) * 0.10)
    rows = questions.select("query_id").join(stats, "query_id", "left").withColumn("value", F.when(F.col("n").isNull(), 0.0).otherwise(value))
    level = F.when(F.col("value") >= 0.72, "high").when(F.col("value") >= 0.42, "medium").otherwise("low")
    return rows.select("query_id", level.alias("confidence"), F.round("value", 4).alias("coverage"))


def qa_tables(questions: DataFrame, answers: DataFrame, cited: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations, messages and citations of a batch of answers; ids follow from query_id."""
    both = questions.join(answers, "query_id")
    conversations = questions.select(F.col("query_id").alias("conv_id"), "kb_id", F.substring("question", 1, 80).alias("title"))
    messages = both.select(F.col("query_id").alias("conv_id"), F.posexplode(F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))).alias("at", "m"))
    messages = messages.select((F.col("conv_id") * 2 + F.col("at")).alias("message_id"), "conv_id", "m.role", "m.content")
    citations = cited.select((F.col("query_id") * 2 + 1).alias("message_id"), "rank", "chunk_id", "document_name", "page_number", F.substring(clean_display_text("content"), 1, 420).alias("quote"), "score")
    return conversations, messages, citations
