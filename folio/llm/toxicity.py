"""Toxicity by multiple-instance learning.

A text is a bag of sentences. Each sentence gets a probability from its words and word
beginnings; the text is toxic with one minus the product of the sentences'
complements (noisy-or). Only labels of whole texts train it, and the learned
sentence probabilities show where a text offends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import remainder, sample
from .shared import written
from .text import Words, mix, slices

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: At most so many labelled texts of each label make up the sample, and none of more bytes: the bound of what is collected.
SAMPLE_EACH, LONGEST = 1500, 1 << 17
#: Bytes of the word beginnings that count as features.
PREFIXES = (4, 5, 6)
#: A feature is learned if so many sample texts have it, and a larger share of the toxic ones.
LEAST_TEXTS, LEAST_RATIO = 4, 2.0
ROUNDS, RATE, PENALTY = 300, 0.3, 1e-5
_FILTER_BITS = 22

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


def sentences(words: Words) -> np.ndarray:
    """The sentence of each word, counted over all rows; it ends at . ! ? or a new line, and with its text."""
    ends = np.zeros(len(words.low) + 1, np.int64)
    np.cumsum(_ENDS[words.low], out=ends[1:])
    row = words.row()
    fresh = np.ones(len(row), np.int64)
    fresh[1:] = (row[1:] != row[:-1]) | (ends[words.start[1:]] > ends[words.end[:-1]])
    return np.cumsum(fresh) - 1


def features(words: Words) -> np.ndarray:
    """Hashes by word: the word and its beginnings."""
    return np.stack([words.hash, *(mix(words.prefix_hash(n) ^ np.uint64(n)) for n in PREFIXES)], axis=1)


def _bagged(batches):
    """(doc_id, y, n_sentences, hashes, sentences): each different feature of each sentence once."""
    for batch in batches:
        for part in slices(batch):
            words = Words(part.column("text"), "alnum")
            found, at = features(words), sentences(words)
            counts, hashes, places = [], [], []
            for i, j in zip(words.bounds[:-1], words.bounds[1:]):
                first = at[i] if j > i else 0
                counts.append(int(at[j - 1] - first) + 1 if j > i else 0)
                pairs = np.unique(np.stack([np.repeat(at[i:j] - first, found.shape[1]), found[i:j].ravel().view(np.int64)], axis=1), axis=0)
                places.append(pairs[:, 0].astype(np.int32))
                hashes.append(pairs[:, 1])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("y"), pa.array(counts, pa.int32()), pa.array(hashes, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
                names=["doc_id", "y", "n_sentences", "hashes", "sentences"],
            )


class Model:
    """Learned features with their weights, and the log-odds of a sentence that has none."""

    def __init__(self, y: np.ndarray, n_sentences: np.ndarray, doc: np.ndarray, sentence: np.ndarray, hashes: np.ndarray):
        """y and n_sentences of each sample text; places of the features to learn: text, sentence in it, hash."""
        self.bias = -8.0
        self.hashes, self.weights = np.zeros(0, np.uint64), np.zeros(0)
        if not 0 < y.sum() < len(y) or not len(hashes):
            return
        y = y.astype(np.float64)
        base = np.concatenate([[0], np.cumsum(n_sentences)])
        keys, which = np.unique(hashes, return_inverse=True)
        pairs = np.unique((base[doc] + sentence) * len(keys) + which)
        where, which = pairs // len(keys), pairs % len(keys)
        n = int(base[-1])
        owner = np.repeat(np.arange(len(y)), n_sentences)
        w, m, v = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
        w[-1] = self.bias
        scale = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
        for t in range(1, ROUNDS + 1):
            z = w[-1] + np.bincount(where, weights=w[which], minlength=n)
            p = 1 / (1 + np.exp(-z))
            none = np.exp(np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y)))
            push = scale * np.where(y == 1, -none / np.maximum(1 - none, 1e-6), 1.0)
            g = p * push[owner]
            grad = np.append(np.bincount(which, weights=g[where], minlength=len(keys)) + PENALTY, g.sum())
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
            w[:-1] = np.maximum(w[:-1], 0)
        used = w[:-1] > 0
        self.hashes, self.weights, self.bias = keys[used], w[:-1][used], float(min(w[-1], -5.0))

    def sentence_scores(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(probability of each sentence, first word of each)."""
        at = sentences(words)
        n = int(at[-1]) + 1 if len(at) else 0
        z = np.full(n, self.bias)
        if len(self.hashes) and n:
            maybe = np.zeros(1 << _FILTER_BITS, bool)
            low = np.uint64((1 << _FILTER_BITS) - 1)
            maybe[self.hashes & low] = True
            found = features(words)
            r, c = np.nonzero(maybe[found & low])
            h = found[r, c]
            place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[place] == h
            once = np.unique(at[r[hit]] * len(self.hashes) + place[hit])
            z += np.bincount(once // len(self.hashes), weights=self.weights[once % len(self.hashes)], minlength=n)
        first = np.flatnonzero(np.diff(at, prepend=-1)) if n else np.zeros(0, np.int64)
        return 1 / (1 + np.exp(-z)), first


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from a sample of at most SAMPLE_EACH texts of each label outside the held-out fold, none over LONGEST bytes.

    Features are counted and chosen on the executors; only the places of those that are learned come to the driver.
    """
    chosen = sample(docs, labels, "toxic", FOLDS, HELD_OUT, SAMPLE_EACH, LONGEST)
    bags = written(chosen.select("doc_id", "y", "text").mapInArrow(_bagged, "doc_id long, y int, n_sentences int, hashes array<long>, sentences array<int>"))
    texts = sorted(bags.select("doc_id", "y", "n_sentences").collect())
    y = np.array([t.y for t in texts], np.int64)
    toxic, clean = int(y.sum()), int((1 - y).sum())
    counted = bags.select("y", F.explode(F.array_distinct("hashes")).alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("texts"), F.sum("y").alias("toxic"))
    share = (F.col("toxic") / F.lit(max(1, toxic))) / ((F.col("texts") - F.col("toxic") + 1) / F.lit(clean + 1))
    learned = counted.where((F.col("texts") >= LEAST_TEXTS) & (share >= LEAST_RATIO)).select("hash")
    places = bags.select("doc_id", F.explode(F.arrays_zip("sentences", "hashes")).alias("at")).select("doc_id", "at.sentences", F.col("at.hashes").alias("hash")).join(learned, "hash")
    found = places.select("doc_id", "sentences", "hash").toArrow()
    order = {t.doc_id: i for i, t in enumerate(texts)}
    doc = np.array([order[d] for d in found.column("doc_id").to_pylist()], np.int64)
    return Model(y, np.array([t.n_sentences for t in texts], np.int64), doc, found.column("sentences").to_numpy().astype(np.int64), found.column("hash").to_numpy().view(np.uint64))


def _scorer(shared):
    def score(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"), "alnum")
                p, first = model.sentence_scores(words)
                owner = np.searchsorted(words.bounds, first, "right") - 1
                n = part.num_rows
                score = 1 - np.exp(np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))
                spans: list[list] = [[] for _ in range(n)]
                stops = np.append(first[1:], len(words.start)) - 1
                for k in np.flatnonzero(p >= THRESHOLD).tolist():
                    a, z = int(words.start[first[k]]), int(words.end[stops[k]])
                    o = int(owner[k])
                    begin = len(bytes(words.raw[words.offsets[o] : a]).decode("utf-8", "replace"))
                    text = bytes(words.raw[a:z]).decode("utf-8", "replace")
                    spans[o].append({"begin": begin, "end": begin + len(text), "score": float(p[k]), "sentence": text})
                kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("sentence", pa.string())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.clip(score, 0, 1)), pa.array(spans, kind)], names=["doc_id", "score", "offending"])

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, offending), one row for each row of docs.

    ``offending`` lists the sentences of THRESHOLD or more: begin and end (code points), score, sentence. Only the text
    makes the score. Null and empty texts have no sentence and get 0. A null
    doc_id stays null and is not held out. Repeated rows get equal results; further columns are ignored; an
    empty table gives no rows; without usable labels of both kinds all scores are near 0.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    out = docs.mapInArrow(_scorer(shared), "doc_id long, score double, offending array<struct<begin:long,end:long,score:double,sentence:string>>")
    held = F.coalesce(remainder("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending")
