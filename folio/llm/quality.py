"""Quality by nearest-neighbour voting among latent-semantic vectors.

A text is a bag of word shapes, pairs of neighbouring shapes and repeated words,
hashed into ``BINS`` terms. Weighted term vectors of a bounded labelled sample give a
truncated SVD; the sample's latent vectors are sent to every task, which
computes the exact cosine of each text with each of them in blocks and lets the
nearest vote, weighted by similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import remainder, sample
from .shared import small_batches
from .text import Words, mix, shapes, slices, tidied

FOLDS, HELD_OUT = 3, 1
#: At most so many labelled texts of each label make up the sample: the bound of what is collected and sent.
SAMPLE_EACH = 1500
BINS = 2048
RANK = 48
NEIGHBOURS = 15


def term_counts(column: pa.Array) -> np.ndarray:
    """Rows by BINS: how often each hashed term occurs."""
    words = Words(column)
    n = len(words.bounds) - 1
    row, shape = words.row(), shapes(words)
    out = np.zeros(n * BINS)
    terms = [(row, shape)]
    same = row[1:] == row[:-1]
    terms.append((row[1:][same], mix(shape[1:][same] * np.uint64(3) + shape[:-1][same])))
    for back in (1, 2, 3):
        if len(row) > back:
            again = (row[back:] == row[:-back]) & (words.hash[back:] == words.hash[:-back])
            terms.append((row[back:][again], np.full(int(again.sum()), 7 + back, np.uint64)))
    for r, h in terms:
        out += np.bincount(r * BINS + (h % np.uint64(BINS)).astype(np.int64), minlength=n * BINS)
    return out.reshape(n, BINS)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _counted(batches):
    for batch in batches:
        for part in slices(batch):
            counts = term_counts(part.column("text")).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("y"), pa.array([c.tobytes() for c in counts], pa.binary())], names=["doc_id", "y", "counts"]
            )


class Model:
    """Term weights, projection, and the sample's unit latent vectors with their labels."""

    def __init__(self, counts: np.ndarray, y: np.ndarray):
        self.y = y.astype(np.float64)
        present = (counts > 0).sum(0)
        self.idf = np.log((1 + len(counts)) / (1 + present)) + 0.1
        x = _weighted(counts, self.idf)
        # truncated SVD by subspace iteration from a fixed start
        basis = np.random.default_rng(7).standard_normal((BINS, RANK + 16))
        for _ in range(8 if len(x) else 0):
            basis = np.linalg.qr(x.T @ (x @ basis))[0]
        self.project = np.zeros((BINS, RANK))
        if len(x):
            small = x @ basis
            vectors = np.linalg.eigh(small.T @ small)[1]
            self.project = (basis @ vectors[:, ::-1])[:, :RANK]
        self.latent = self.vectors(counts)

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        z = _weighted(counts, self.idf) @ self.project
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 in the votes of the nearest sample texts; 0.5 with no sample or nothing in common.

        Nearness counts to 9 decimals, equally near ones by their place in the sample, which is sorted by doc_id.
        """
        if not len(self.y):
            return np.full(len(counts), 0.5)
        near = np.round(self.vectors(counts) @ self.latent.T, 9)
        k = min(NEIGHBOURS, len(self.y))
        # less than half a unit of the ninth decimal even for the last place
        top = np.sort(np.argpartition(np.arange(len(self.y)) * (4e-10 / len(self.y)) - near, k - 1, axis=1)[:, :k], axis=1)
        weight = np.maximum(np.take_along_axis(near, top, 1), 0) ** 4
        total = weight.sum(1)
        votes = (weight * self.y[top]).sum(1)
        return np.clip(np.where(total > 1e-12, votes / np.maximum(total, 1e-12), 0.5), 0, 1)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from a sample of at most SAMPLE_EACH texts of each label outside the held-out fold."""
    chosen = sample(docs, labels, "quality", FOLDS, HELD_OUT, SAMPLE_EACH).select("doc_id", "y", "text")
    rows = sorted(chosen.mapInArrow(_counted, "doc_id long, y int, counts binary").collect())
    counts = np.frombuffer(b"".join(r.counts for r in rows), np.float32).reshape(-1, BINS).astype(np.float64)
    return Model(counts, np.array([r.y for r in rows], np.int64))


def _scorer(shared, carry: list[str], text_col: str, name: str):
    def score(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch, text_col):
                scores = [model.score(term_counts(part.column(text_col).slice(i, 512))) for i in range(0, part.num_rows, 512)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(np.concatenate(scores))], names=[*carry, name])

    return score


def with_score(docs: DataFrame, labels: DataFrame, carry: list[str], id_col: str = "doc_id", text_col: str = "text", name: str = "score") -> DataFrame:
    """The columns ``carry`` of docs, which must be its own, and the score as ``name``: one narrow pass."""
    small_batches(docs.sparkSession)
    model = fit(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*carry).schema.add(name, "double")
    return docs.select(*dict.fromkeys([*carry, text_col])).mapInArrow(tidied(_scorer(shared, carry, text_col, name)), schema)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of docs.

    Only the text makes the score. Null and empty texts share nothing with any
    sample text and get 0.5, as do all texts where no label can be used. A null doc_id
    stays null and is not held out. Repeated rows get equal results; further columns are
    ignored; an empty table gives no rows. Of equally near sample texts, those of the smallest doc_ids vote.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = with_score(docs, labels, ["doc_id"])
    held = F.coalesce(remainder("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
