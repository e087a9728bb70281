"""Search of all chunks that a question may use: bounds first, then the best of each task. No table of question-chunk pairs is made.

Three narrow passes over the chunks' numbers, for blocks of questions that are sent to all tasks. The first counts what each
question may use (chunks, their mean length, how many have each of its words, the range of the vectors' likeness),
the second finds the range of BM25, the third scores in the task and keeps each question's best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import any_of, expand_query, reduced, terms, tokens
from ..sources.store import written
from . import search
from .embed import scaled_to_unit

#: Chunks and questions that meet in one matrix.
ROWS, QUESTIONS = 1024, 512


def hashed_tokens(c) -> Column:
    """The tokens of a text as 64-bit hashes, repetitions kept."""
    return F.transform(tokens(c), lambda t: F.xxhash64(t))


def library(chunks: DataFrame, documents: DataFrame, vectors: DataFrame | None = None, intents=rules.INTENTS) -> DataFrame:
    """What scores take from the chunks of ready documents, without their texts: ids, place, name, tokens, penalty, bonuses and vector.

    chunks(chunk_id, doc_id, page_number, chunk_index, section_path, content), documents(doc_id, kb_id, document_name, status),
    vectors(chunk_id, embedding); without ``vectors``, chunks has ``embedding`` itself, and no vector moves. Chunks without a vector have likeness 0;
    vectors of whole numbers (``embed.hash_counts``) are scaled to length 1 where they are compared.
    """
    ready = documents.where("status = 'ready'").select("doc_id", "kb_id", "document_name")
    numbers = search.chunk_features(chunks.drop("kb_id", "document_name").withColumn("tokens", hashed_tokens(search.searched())), intents)
    stem = reduced(F.regexp_replace("document_name", r"(?s)\.[^.]*$", ""))
    if vectors is not None:
        numbers = numbers.join(vectors.select("chunk_id", "embedding"), "chunk_id", "left")
    return numbers.join(ready, "doc_id").withColumn("stem", stem)


def _postings(block, q: np.ndarray, lists: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(entries, rows of their askers in q, chunks, times) of each asked token that these chunks' lists of tokens hold."""
    sizes = np.array([len(t) for t in lists])
    flat = np.concatenate(lists).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
    begin = np.searchsorted(block.token, flat, "left")
    known = begin < np.searchsorted(block.token, flat, "right")
    chunk = np.repeat(np.arange(len(lists)), sizes)[known]
    both, times = np.unique(np.stack([begin[known], chunk]), axis=1, return_counts=True)
    row_of = np.full(len(block.ids), -1)
    row_of[q] = np.arange(len(q))
    cuts = np.flatnonzero(np.diff(both[0])) + 1
    for at, chunks, n in zip(np.split(both[0], cuts), np.split(both[1], cuts), np.split(times, cuts)):
        if not len(at):
            continue
        entries = np.arange(at[0], np.searchsorted(block.token, block.token[at[0]], "right"))
        rows = row_of[block.asker[entries]]
        yield entries[rows >= 0], rows[rows >= 0], chunks, n


class _Asked:
    """The terms of one block of questions, by kb."""

    def __init__(self, rows: list):
        self.ids = np.array([r.query_id for r in rows], np.int64)
        self.kbs: dict = {}
        for i, r in enumerate(rows):
            self.kbs.setdefault(r.kb_id, []).append(i)
        self.kbs = {kb: np.array(x) for kb, x in self.kbs.items()}
        # entries (token, question) by token
        pairs = sorted((t, i) for i, r in enumerate(rows) for t in set(r.asked or ()))
        self.token = np.array([t for t, _ in pairs], np.int64)
        self.asker = np.array([i for _, i in pairs], np.int64)
        self.sizes = np.bincount(self.asker, minlength=len(rows))


class _Block(_Asked):
    """The questions of one block with all that scores need, as arrays: sent to all tasks."""

    def __init__(self, rows: list):
        super().__init__(rows)
        width = max((len(r.embedding) for r in rows if r.embedding is not None), default=1)
        self.vectors = np.array([r.embedding if r.embedding is not None else np.zeros(width) for r in rows], np.float64)
        self.limited = {i: np.array(sorted(r.doc_ids), np.int64) for i, r in enumerate(rows) if r.doc_ids}
        self.shows = np.array([r.shows for r in rows], np.float64).reshape(len(rows), -1)
        self.reduced = [r.reduced for r in rows]
        n = len(rows)
        self.n, self.length, self.df = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(len(self.token), np.int64)
        self.low, self.high, self.bm_low, self.bm_high = (np.full(n, x) for x in (np.inf, -np.inf, np.inf, -np.inf))

    def idf(self) -> np.ndarray:
        n = self.n[self.asker]
        return np.log(1 + (n - self.df + 0.5) / (self.df + 0.5))


class _Meeting:
    """Some questions of one kb and some chunks of it."""

    def __init__(self, block: _Block, q: np.ndarray, part: pd.DataFrame):
        self.block, self.q, self.part = block, q, part
        held = part["embedding"].to_numpy()
        width = block.vectors.shape[1]
        x = np.array([v if v is not None else np.zeros(width) for v in held], np.float64)
        if any(v is not None and v.dtype.kind == "i" for v in held):
            x = scaled_to_unit(x)
        self.semantic = np.maximum(block.vectors[q] @ x.T, 0.0)
        self.allowed = np.ones(self.semantic.shape, bool)
        docs = part["doc_id"].to_numpy()
        for j, i in enumerate(q.tolist()):
            if i in block.limited:
                self.allowed[j] = np.isin(docs, block.limited[i])

    def postings(self):
        return _postings(self.block, self.q, self.part["tokens"].to_numpy())

    def bm25(self) -> np.ndarray:
        block, out = self.block, np.zeros(self.semantic.shape)
        mean = block.length[self.q] / np.maximum(1, block.n[self.q])
        norm = search.K1 * (1 - search.B + search.B * self.part["dl"].to_numpy()[None, :] / np.maximum(1.0, mean)[:, None])
        idf = block.idf()
        for entries, rows, chunks, n in self.postings():
            out[np.ix_(rows, chunks)] += idf[entries][:, None] * (n * (search.K1 + 1))[None, :] / (n[None, :] + norm[np.ix_(rows, chunks)])
        return out

    def named(self) -> np.ndarray:
        """The bonus of questions that hold a document's name."""
        out, block = np.zeros(self.semantic.shape), self.block
        every = "\n".join(block.reduced[i] for i in self.q.tolist())
        for stem, at in self.part.groupby("stem", sort=False).indices.items():
            if len(stem) >= 3 and stem in every:
                for j, i in enumerate(self.q.tolist()):
                    if stem in block.reduced[i]:
                        out[j, at] = 0.35
        return out

    def score(self, bm25: np.ndarray) -> np.ndarray:
        block, q = self.block, self.q

        def scaled(x, low, high):
            low, high = low[q][:, None], high[q][:, None]
            close = np.abs(high - low) <= 1e-9 * np.maximum(np.abs(high), np.abs(low))
            with np.errstate(invalid="ignore", divide="ignore"):
                return np.where(close, (high > 0).astype(float), (x - low) / (high - low))

        bonus = np.stack(self.part["bonuses"].to_numpy()).astype(np.float64)
        out = scaled(self.semantic, block.low, block.high) * search.SEMANTIC + scaled(bm25, block.bm_low, block.bm_high) * search.LEXICAL
        return out + (self.named() + block.shows[q] @ bonus.T) - self.part["penalty"].to_numpy()[None, :]


def _meetings(block: _Block, frames: Iterator[pd.DataFrame]) -> Iterator[_Meeting]:
    for pdf in frames:
        for kb, some in pdf.groupby("kb_id", sort=False):
            q = block.kbs.get(kb)
            if q is None:
                continue
            for a in range(0, len(some), ROWS):
                part = some.iloc[a : a + ROWS].reset_index(drop=True)
                for b in range(0, len(q), QUESTIONS):
                    yield _Meeting(block, q[b : b + QUESTIONS], part)


def _statistics(shared):
    def count(frames):
        block = shared.value
        n, length, low, high, df = (x.copy() for x in (block.n, block.length, block.low, block.high, block.df))
        for m in _meetings(block, frames):
            n[m.q] += m.allowed.sum(1)
            length[m.q] += m.allowed @ m.part["dl"].to_numpy().astype(np.int64)
            low[m.q] = np.minimum(low[m.q], np.where(m.allowed, m.semantic, np.inf).min(1))
            high[m.q] = np.maximum(high[m.q], np.where(m.allowed, m.semantic, -np.inf).max(1))
            for entries, rows, chunks, _ in m.postings():
                df[entries] += m.allowed[np.ix_(rows, chunks)].sum(1)
        i, e = np.flatnonzero(n), np.flatnonzero(df)
        yield pd.DataFrame({"entry": -1, "at": i, "n": n[i], "length": length[i], "low": low[i], "high": high[i]})
        yield pd.DataFrame({"entry": e, "at": -1, "n": df[e], "length": 0, "low": 0.0, "high": 0.0})

    return count


def _bm25_ranges(shared):
    def ranges(frames):
        block = shared.value
        low, high = block.bm_low.copy(), block.bm_high.copy()
        for m in _meetings(block, frames):
            bm = m.bm25()
            low[m.q] = np.minimum(low[m.q], np.where(m.allowed, bm, np.inf).min(1))
            high[m.q] = np.maximum(high[m.q], np.where(m.allowed, bm, -np.inf).max(1))
        i = np.flatnonzero(low < np.inf)
        yield pd.DataFrame({"at": i, "low": low[i], "high": high[i]})

    return ranges


_HIT = "query_id long, chunk_id long, document_name string, page_number int, chunk_index int, score double, semantic double, bm25 double"


def _rows(block: _Block, m: _Meeting, r, c, score, bm) -> pd.DataFrame:
    p = m.part.iloc[c]
    return pd.DataFrame({"query_id": block.ids[m.q[r]], "chunk_id": p["chunk_id"].to_numpy(), "document_name": p["document_name"].to_numpy(), "page_number": p["page_number"].to_numpy(), "chunk_index": p["chunk_index"].to_numpy(), "score": score[r, c], "semantic": m.semantic[r, c], "bm25": bm[r, c]})


def _best(shared, k: int):
    def best(frames):
        block, kept, bar = shared.value, [], np.full(len(shared.value.ids), -np.inf)
        size = 0

        def shrunk() -> list[pd.DataFrame]:
            every = pd.concat(kept).sort_values(["query_id", "score", "chunk_id"], ascending=[True, False, True], kind="stable")
            every = every[every.groupby("query_id").cumcount() < k]
            last = every.groupby("query_id")["score"].agg(["size", "min"])
            full = last[last["size"] >= k]
            where = {x: i for i, x in enumerate(block.ids.tolist())}
            for x, lowest in zip(full.index.tolist(), full["min"].tolist()):
                bar[where[x]] = lowest
            return [every]

        for m in _meetings(block, frames):
            bm = m.bm25()
            score = np.where(m.allowed, np.round(m.score(bm), 9), -np.inf)
            # of one meeting, too, no more than the k best (and those as good) can be among the best
            floor = bar[m.q]
            if score.shape[1] > k:
                floor = np.maximum(floor, np.partition(score, -k, axis=1)[:, -k])
            r, c = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
            if len(r):
                kept.append(_rows(block, m, r, c, score, bm))
                size += len(r)
            if size > 4 * k * len(block.ids) + 65536:
                kept = shrunk()
                size = len(kept[0])
        if kept:
            yield from shrunk()

    return best


def _from_bar(shared, bars: dict[int, float]):
    def pool(frames):
        block = shared.value
        floor = np.array([bars.get(x, np.inf) for x in block.ids.tolist()])
        for m in _meetings(block, frames):
            bm = m.bm25()
            score = np.where(m.allowed, np.round(m.score(bm), 9), -np.inf)
            r, c = np.nonzero(score >= floor[m.q][:, None])
            if len(r):
                yield _rows(block, m, r, c, score, bm)

    return pool


class Exhaustive:
    """The questions' statistics over a library, from which their best chunks are taken."""

    def __init__(self, questions: DataFrame, items: DataFrame, expansions=rules.EXPANSIONS, intents=rules.INTENTS):
        """questions(query_id, kb_id, question, doc_ids, embedding), the vector being that of the expanded question; items from ``library``, written."""
        self.items, spark = items, items.sparkSession
        expanded = expand_query("question", expansions)
        asked = questions.select(
            "query_id", "kb_id", "doc_ids", "embedding", F.array_distinct(hashed_tokens(expanded)).alias("asked"), reduced(F.col("question")).alias("reduced"),
            F.array(*(any_of("question", t).cast("double") for t, _, _ in intents)).alias("shows"),
        )
        self.blocks = []
        for part in search._blocks(asked, "query_id"):
            rows = part.collect()
            if not rows:
                continue
            block = _Block(rows)
            shared = spark.sparkContext.broadcast(block)
            found = items.mapInPandas(_statistics(shared), "entry long, at long, n long, length long, low double, high double")
            for r in found.groupBy("entry", "at").agg(F.sum("n").alias("n"), F.sum("length").alias("length"), F.min("low").alias("low"), F.max("high").alias("high")).toLocalIterator():
                if r.entry >= 0:
                    block.df[r.entry] = r.n
                else:
                    block.n[r["at"]], block.length[r["at"]], block.low[r["at"]], block.high[r["at"]] = r.n, r.length, r.low, r.high
            shared.unpersist()
            shared = spark.sparkContext.broadcast(block)
            ranges = items.mapInPandas(_bm25_ranges(shared), "at long, low double, high double")
            for r in ranges.groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high")).toLocalIterator():
                block.bm_low[r["at"]], block.bm_high[r["at"]] = r.low, r.high
            shared.unpersist()
            self.blocks.append(spark.sparkContext.broadcast(block))

    def _passes(self, make, kind: str = _HIT) -> DataFrame:
        out = None
        for shared in self.blocks:
            one = self.items.mapInPandas(make(shared), kind)
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.items.sparkSession.createDataFrame([], kind)

    def best(self, k: int) -> DataFrame:
        """(query_id, chunk_id, document_name, page_number, chunk_index, score, semantic, bm25): the k best of each question, ties to the smaller chunk_id; each task sends its own k best."""
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
        return self._passes(lambda shared: _best(shared, k)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")

    def pool(self, bars: DataFrame) -> DataFrame:
        """All chunks of the questions in bars(query_id, bar) that score no less than the bar."""
        of = {r.query_id: r.bar for r in bars.select("query_id", "bar").collect()}
        return self._passes(lambda shared: _from_bar(shared, of))


def exhaustive_search(questions: DataFrame, items: DataFrame, chunks: DataFrame, top_k: int = 5, expansions=rules.EXPANSIONS, intents=rules.INTENTS, within: int = search.WITHIN, further: int = search.FURTHER) -> DataFrame:
    """(query_id, rank, chunk_id, score, semantic, bm25): hybrid search of all chunks that each question may use.

    questions as in ``Exhaustive``, items from ``library``, written; chunks(chunk_id, content) gives the texts of those that may be chosen.
    """
    found = Exhaustive(questions, items, expansions, intents)
    hits = written(found.best(max(within, further, top_k) + 1))
    chosen = written(search.diverse(hits, top_k, chunks, found.pool, within, further))
    known = hits.select("query_id", "chunk_id", "semantic", "bm25")
    lacking = chosen.join(known, ["query_id", "chunk_id"], "left_anti")
    if lacking.limit(1).count():
        more = found.pool(lacking.groupBy("query_id").agg(F.min("score").alias("bar")))
        known = known.unionByName(more.select(*known.columns)).distinct()
    return chosen.join(known, ["query_id", "chunk_id"])


def lexical_topk(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k chunks of each question's kb with the largest set cosine of terms, ties (to 9 decimals) to the smaller chunk_id; those that share no term are not given.

    queries(query_id, kb_id, question) in blocks, which meet the chunks in their tasks: each sends its own k best of a question.
    """
    terms_of = lambda c: F.transform(terms(c), lambda t: F.xxhash64(t))
    items, found = chunks.select("chunk_id", "kb_id", terms_of("content").alias("tokens")), None
    for part in search._blocks(queries, "query_id"):
        shared = queries.sparkSession.sparkContext.broadcast(_Asked(part.select("query_id", "kb_id", terms_of("question").alias("asked")).collect()))

        def best(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            block = shared.value
            top = search._Running(len(block.ids), k)
            for pdf in frames:
                for kb, some in pdf.groupby("kb_id", sort=False):
                    every = block.kbs.get(kb, np.zeros(0, np.int64))
                    for a in range(0, len(some), ROWS):
                        part = some.iloc[a : a + ROWS]
                        sizes = part["tokens"].map(len).to_numpy()
                        for b in range(0, len(every), QUESTIONS):
                            q = every[b : b + QUESTIONS]
                            n = np.zeros((len(q), len(part)))
                            for _, rows, held, _ in _postings(block, q, part["tokens"].to_numpy()):
                                n[np.ix_(rows, held)] += 1
                            with np.errstate(invalid="ignore", divide="ignore"):
                                score = np.where(n > 0, n / np.sqrt(block.sizes[q][:, None] * sizes[None, :]), -np.inf)
                            top.add(q, score, part["chunk_id"].to_numpy())
            r, c = np.nonzero(top.scores > -np.inf)
            yield pd.DataFrame({"query_id": block.ids[r], "chunk_id": top.ids[r, c], "score": top.scores[r, c]})

        one = items.mapInPandas(best, "query_id long, chunk_id long, score double")
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
