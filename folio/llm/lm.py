"""A log-bilinear language model trained with noise-contrastive estimation.

Word counts of all training texts are gathered by Spark. Every word has a class: the most
frequent ones a class of their own, each other word the class of its last letters, hashed;
so words never seen have one too. Two preceding words predict the next class: their vectors, each weighted by
position, add up to a query. Its products with the vectors of the groups of classes, and with those of the classes of
one group, plus biases, are normalised by batched matrix products: first the group, then the class within it.
A word's smoothed share of its class does the rest, so every token's probability is exact.
The SENT most frequent words have context vectors of their own, the others share TAIL hashed ones. The number of classes
grows with the vocabulary. Every part of the training texts trains a replica in numpy
against shared noise; replicas start alike and are averaged in a tree of Spark stages, context
vectors weighted by how often each replica saw the word, all others by its tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import remainder
from .shared import written
from .text import Words, hash_of, mix, slices

FOLDS, HELD_OUT = 7, 2
#: Words whose counts and context vectors are sent to every task at most (the counts of all others are joined), and context vectors that all others share.
SENT, TAIL = 131_072, 32_768
#: Bytes of a word's end by which it is put into a class, and the vectors' length.
ENDING, RANK = 3, 20
#: Tokens of a training step, noise groups of a step, noise classes of each group in a step, learning rates of context vectors and of all else.
BATCH, NOISE_GROUPS, NOISE, RATE_CONTEXT, RATE = 4096, 8, 16, 0.8, 0.2
#: Training tokens of a replica at least, and from how many replicas on it takes eight times as many (so that replicas stay smaller than the texts); how many are averaged in one task, and context vectors of one row of a written replica.
REPLICA_TOKENS, REPLICAS, FAN_IN, PIECE = 1_000_000, 1024, 16, 16_384

_END = int(hash_of("\x00end").view(np.int64))


def classes_of(distinct: int) -> tuple[int, int]:
    """(groups, classes of a group), powers of two, for a vocabulary: about 200 times its fourth root classes, a quarter of them of one word."""
    power = min(16, max(8, round(float(np.log2(200 * max(1, distinct) ** 0.25)))))
    groups = 1 << (power // 2 - (power % 2 == 0))
    return groups, (1 << power) // groups


def endings(words: Words) -> np.ndarray:
    """A 31-bit hash of each word's last ENDING bytes."""
    return (words.suffix_hash(ENDING) >> np.uint64(33)).astype(np.int64)


def _counter(batches):
    """(word, ending, n): words and ends of texts, counted over stretches of a part."""
    held, ends, size, texts = [], [], 0, 0

    def flush():
        words, first, n = np.unique(np.concatenate(held), return_index=True, return_counts=True)
        columns = (words.view(np.int64), np.concatenate(ends)[first].astype(np.int32), n.astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["word", "ending", "n"])

    for batch in batches:
        texts += batch.num_rows
        for part in slices(batch):
            words = Words(part.column("text"))
            held.append(words.hash)
            ends.append(endings(words))
            size += len(held[-1])
            if size > 4_000_000:
                yield flush()
                held, ends, size = [], [], 0
    if size:
        yield flush()
    if texts:
        yield pa.RecordBatch.from_arrays([pa.array([_END]), pa.array([0], pa.int32()), pa.array([texts], pa.int64())], names=["word", "ending", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, ending, n) over all texts: 64-bit word hashes, hashes of their ends, and the end token once a text."""
    counted = texts.select("text").mapInArrow(_counter, "word long, ending int, n long")
    return counted.groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


class Vocabulary:
    """Counts of the most frequent words (sorted by hash), the classes, their masses, and the totals of all words.

    Class numbers are group * width + place. ``by_ending`` holds, for each hashed class, (tokens, words) of all words with such ends.
    Contexts: the words here, then TAIL hashed ones, then the start of a text.
    """

    def __init__(self, words: np.ndarray, ending: np.ndarray, n: np.ndarray, total: int, distinct: int, by_ending: np.ndarray):
        self.groups, self.width = classes_of(distinct)
        size = self.groups * self.width
        self.own = size // 4
        by_count = np.lexsort((words, -n))[: self.own]
        classes = np.full(len(words), -1, np.int64)
        classes[by_count] = self._spread(np.arange(len(by_count)))
        order = np.argsort(words)
        self.words, self.n, self.cls = words[order], n[order], classes[order]
        self.total, self.distinct = total, distinct
        # tokens and words of each class, and one unknown word in each hashed one
        mass = np.full(size, 1e-6)
        mass[self._spread(np.arange(len(by_count)))] = n[by_count] + 1.0
        hashed = by_ending.sum(1).astype(np.float64) + 1
        np.subtract.at(hashed, ending[by_count] % len(hashed), n[by_count] + 1.0)
        mass[self._spread(self.own + np.arange(len(hashed)))] = hashed
        self.mass = mass
        #: unigram chances of groups, and of classes within their group
        self.of_group = mass.reshape(self.groups, -1).sum(1) / mass.sum()
        self.within = mass / np.repeat(self.of_group * mass.sum(), self.width)
        self.contexts = len(words) + TAIL + 1

    def _spread(self, c: np.ndarray) -> np.ndarray:
        return (c % self.groups) * self.width + c // self.groups

    def find(self, words: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, count, context) of words; count -1 for words whose counts are not here."""
        size = self.groups * self.width
        hashed = self._spread(self.own + ending % (size - self.own))
        shared = len(self.words) + (mix(words.view(np.uint64)) % np.uint64(TAIL)).astype(np.int64)
        if not len(self.words):
            return hashed, np.full(len(words), -1), shared
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        hit = self.words[at] == words
        cls = np.where(hit, self.cls[at], -1)
        return np.where(cls < 0, hashed, cls), np.where(hit, self.n[at], -1), np.where(hit, at, shared)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of all texts with an end after each, hashes of their ends, bounds of the texts)."""
    words = Words(column)
    lengths = np.diff(words.bounds) + 1
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    out, ending = np.full(int(bounds[-1]), _END, np.int64), np.zeros(int(bounds[-1]), np.int64)
    inside = np.ones(len(out), bool)
    inside[bounds[1:] - 1] = False
    out[inside], ending[inside] = words.hash.view(np.int64), endings(words)
    return out, ending, bounds


def _histories(near: np.ndarray, bounds: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Contexts one and two tokens back; before a text's first token, the start."""
    start = v.contexts - 1
    one, two = np.full(len(near), start), np.full(len(near), start)
    one[1:], two[2:] = near[:-1], near[:-2]
    first = bounds[:-1]
    one[first] = two[first] = start
    second = first[np.diff(bounds) > 1] + 1
    two[second] = start
    return one, two


class Parameters:
    """Vectors of contexts, and ``parts``: weights by position, vectors and biases of groups and of classes."""

    def __init__(self, v: Vocabulary, flat: np.ndarray | None = None):
        g, k = v.groups, v.groups * v.width
        self.sizes = [(2, RANK), (g, RANK), (g,), (k, RANK), (k,)]
        rng = np.random.default_rng(11)
        if flat is None:
            weights = np.ones((2, RANK)) * [[1.0], [0.5]]
            flat = np.concatenate([x.ravel() for x in (weights, rng.normal(0, 0.2, (g, RANK)), np.log(v.of_group), rng.normal(0, 0.2, (k, RANK)), np.log(v.within))])
        self.flat = flat.astype(np.float32)
        at, self.parts = 0, []
        for shape in self.sizes:
            size = int(np.prod(shape))
            self.parts.append(self.flat[at : at + size].reshape(shape))
            at += size
        self.near = np.empty((v.contexts, RANK), np.float32)
        self.near[:] = np.random.default_rng(12).normal(0, 0.01, RANK)


def _added(ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(ids, weights=rows[:, k], minlength=n) for k in range(rows.shape[1])], axis=1).astype(np.float32)


def _odds(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Trainer:
    """One replica: steps of noise-contrastive estimation with Adagrad."""

    def __init__(self, v: Vocabulary, seed: int):
        self.v, self.p, self.rng = v, Parameters(v), np.random.default_rng(seed)
        self.seen = [np.full(s, 1e-6, np.float32) for s in self.p.sizes]
        # context vectors have one step size each
        self.seen_near, self.uses = np.full(v.contexts, 1e-10, np.float32), np.zeros(v.contexts)
        self.groups_at = np.cumsum(v.of_group)
        #: k + the chances within group k, added up
        self.classes_at = (np.cumsum(v.within.reshape(v.groups, -1), axis=1) + np.arange(v.groups)[:, None]).ravel()
        self.log_groups = np.log(NOISE_GROUPS * v.of_group).astype(np.float32)
        self.log_classes = np.log(NOISE * v.within).astype(np.float32)
        self.tokens = 0

    def step(self, one: np.ndarray, two: np.ndarray, cls: np.ndarray) -> None:
        v, (weight, group_out, group_bias, out, bias) = self.v, self.p.parts
        order = np.argsort(cls, kind="stable")  # by group, so that each is a stretch
        one, two, cls = one[order], two[order], cls[order]
        group, n = cls // v.width, len(cls)
        a, b = self.p.near[one], self.p.near[two]
        query = a * weight[0] + b * weight[1]
        # groups against noise that the whole step shares
        noise = np.minimum(np.searchsorted(self.groups_at, self.rng.random(NOISE_GROUPS) * self.groups_at[-1]), v.groups - 1)
        push = -_odds(-(np.einsum("ij,ij->i", query, group_out[group]) + group_bias[group] - self.log_groups[group]))  # towards the group that came
        pull = _odds(query @ group_out[noise].T + (group_bias[noise] - self.log_groups[noise]))  # away from the noise
        to_query = push[:, None] * group_out[group] + pull @ group_out[noise]
        g_group_out, g_group_bias = _added(group, push[:, None] * query, v.groups), np.bincount(group, weights=push, minlength=v.groups)
        np.add.at(g_group_out, noise, pull.T @ query)
        np.add.at(g_group_bias, noise, pull.sum(0))
        # classes against noise of their own group
        push = -_odds(-(np.einsum("ij,ij->i", query, out[cls]) + bias[cls] - self.log_classes[cls]))
        to_query += push[:, None] * out[cls]
        every = np.arange(v.groups)[:, None]
        noise = np.clip(np.searchsorted(self.classes_at, every + self.rng.random((v.groups, NOISE))), every * v.width, (every + 1) * v.width - 1)
        vectors, shift = out[noise], bias[noise] - self.log_classes[noise]
        cuts = np.searchsorted(group, np.arange(v.groups + 1)).tolist()
        rows = [slice(i, j) for i, j in zip(cuts[:-1], cuts[1:])]
        pull = np.concatenate([query[r] @ x.T for r, x in zip(rows, vectors)])
        pull = _odds(pull + shift[group])
        to_query += np.concatenate([pull[r] @ x for r, x in zip(rows, vectors)])
        from_noise = np.concatenate([pull[r].T @ query[r] for r in rows])
        used, place = np.unique(np.concatenate([cls, noise.ravel()]), return_inverse=True)
        g_out = _added(place, np.concatenate([push[:, None] * query, from_noise]), len(used))
        g_bias = np.bincount(place, weights=np.concatenate([push, *(pull[r].sum(0) for r in rows)]))
        g_weight = np.stack([(to_query * a).sum(0), (to_query * b).sum(0)])
        contexts, place = np.unique(np.concatenate([one, two]), return_inverse=True)
        g_near = _added(place, np.concatenate([to_query * weight[0], to_query * weight[1]]), len(contexts))
        full = slice(None)
        for part, seen, rows, g in zip(self.p.parts, self.seen, (full, full, full, used, used), (g_weight, g_group_out, g_group_bias, g_out, g_bias)):
            g = (g / n).astype(np.float32)
            seen[rows] += g * g
            part[rows] -= RATE * g / np.sqrt(seen[rows])
        size = self.seen_near[contexts] + np.square(g_near).mean(1)
        self.seen_near[contexts] = size
        self.p.near[contexts] -= g_near * (RATE_CONTEXT / np.sqrt(size))[:, None]
        self.uses[contexts] += np.bincount(place)
        self.tokens += n


_REPLICA = "replica long, piece int, tokens long, ids binary, uses binary, vectors binary"


def _pieces(replica: int, tokens: int, flat: np.ndarray, uses: np.ndarray, near: np.ndarray):
    """A replica's rows: piece -1 is ``flat``, each other one holds the context vectors of PIECE ids that have been used."""
    rows = [(-1, b"", b"", flat.astype(np.float32).tobytes())]
    for k in range(0, len(uses), PIECE):
        at = np.flatnonzero(uses[k : k + PIECE]) + k
        if len(at):
            rows.append((k // PIECE, at.astype(np.int32).tobytes(), uses[at].astype(np.float32).tobytes(), near[at].astype(np.float16).tobytes()))
    for piece, *values in rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array([replica], pa.int64()), pa.array([piece], pa.int32()), pa.array([tokens], pa.int64()), *(pa.array([x], pa.binary()) for x in values)],
            names=["replica", "piece", "tokens", "ids", "uses", "vectors"],
        )


def _trainer(shared):
    def train(batches):
        from pyspark import TaskContext

        v, trainer = shared.value, None
        kept: list[list[np.ndarray]] = [[], [], []]
        for batch in batches:
            for part in slices(batch):
                tokens, ending, bounds = _tokens(part.column("text"))
                cls, _, near = v.find(tokens, ending)
                one, two = _histories(near, bounds, v)
                # the seed comes from the texts; steps take tokens from all over the slice
                trainer = trainer or Trainer(v, int(np.bitwise_xor.reduce(tokens.view(np.uint64))))
                order = trainer.rng.permutation(len(cls))
                for held, x in zip(kept, (one, two, cls)):
                    held.append(x[order])
                one, two, cls = (np.concatenate(k) for k in kept)
                whole = len(cls) - len(cls) % BATCH
                for i in range(0, whole, BATCH):
                    trainer.step(one[i : i + BATCH], two[i : i + BATCH], cls[i : i + BATCH])
                kept = [[one[whole:]], [two[whole:]], [cls[whole:]]]
        if trainer is not None:
            one, two, cls = (np.concatenate(k) for k in kept)
            if len(cls):
                trainer.step(one, two, cls)
            yield from _pieces(TaskContext.get().partitionId(), trainer.tokens, trainer.p.flat, trainer.uses, trainer.p.near)

    return train


def _averaged(batches):
    """Streams rows of a replica's pieces sorted by replica and piece, and yields one row for each of those: the weighted average."""
    at, tokens, sums, uses = None, 0, None, None

    def flush():
        ids = np.flatnonzero(uses) if at[1] >= 0 else np.zeros(0, np.int64)
        total = sums[ids] / uses[ids, None] if at[1] >= 0 else sums / tokens
        values = (ids + at[1] * PIECE).astype(np.int32).tobytes(), uses[ids].astype(np.float32).tobytes(), total.astype(np.float16 if at[1] >= 0 else np.float32).tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int32()), pa.array([tokens], pa.int64()), *(pa.array([x], pa.binary()) for x in values)],
            names=["replica", "piece", "tokens", "ids", "uses", "vectors"],
        )

    for batch in batches:
        for i in range(batch.num_rows):
            replica, piece, n, ids, use, vectors = (batch.column(c)[i].as_py() for c in ("replica", "piece", "tokens", "ids", "uses", "vectors"))
            if (replica, piece) != at:
                if at is not None:
                    yield flush()
                at, tokens, sums, uses = (replica, piece), 0, None, np.zeros(PIECE)
            tokens += n
            if piece < 0:
                x = np.frombuffer(vectors, np.float32).astype(np.float64) * n
                sums = x if sums is None else sums + x
            else:
                sums = np.zeros((PIECE, RANK)) if sums is None else sums
                k, w = np.frombuffer(ids, np.int32) - piece * PIECE, np.frombuffer(use, np.float32)
                sums[k] += np.frombuffer(vectors, np.float16).reshape(-1, RANK) * w[:, None].astype(np.float64)
                uses[k] += w
    if at is not None:
        yield flush()


def train(texts: DataFrame, shared_vocabulary, v: Vocabulary) -> Parameters:
    """One pass over all texts in replicas, as many as there are partitions if each has tokens enough, averaged FAN_IN at a time, piece by piece."""
    enough = max(min(REPLICAS, v.total // REPLICA_TOKENS), v.total // (8 * REPLICA_TOKENS))
    parts = max(1, min(texts.rdd.getNumPartitions(), enough))
    found = written(texts.select("text").coalesce(parts).mapInArrow(_trainer(shared_vocabulary), _REPLICA))
    while parts > 1:
        parts = -(-parts // FAN_IN)
        grouped = found.withColumn("replica", F.floor(F.col("replica") / FAN_IN)).repartition("replica", "piece").sortWithinPartitions("replica", "piece")
        found = written(grouped.mapInArrow(_averaged, _REPLICA))
    rows = found.collect()  # as large as what is sent: SENT + TAIL context vectors, and the classes
    p = Parameters(v, next((np.frombuffer(r.vectors, np.float32) for r in rows if r.piece < 0), None))
    for r in rows:
        if r.piece >= 0:
            p.near[np.frombuffer(r.ids, np.int32)] = np.frombuffer(r.vectors, np.float16).reshape(-1, RANK)
    return p


class Model:
    """Normalised chances of classes after contexts."""

    def __init__(self, p: Parameters, v: Vocabulary):
        self.v, self.near, self.parts = v, p.near.astype(np.float16), p.parts

    def log10(self, one: np.ndarray, two: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 of the probability of each class after its contexts."""
        out = np.empty(len(cls))
        for i in range(0, len(cls), 32_768):
            out[i : i + 32_768] = self._some(one[i : i + 32_768], two[i : i + 32_768], cls[i : i + 32_768])
        return out

    def _some(self, one, two, cls):
        weight, group_out, group_bias, class_out, bias = self.parts
        order = np.argsort(cls, kind="stable")
        query = self.near[one[order]].astype(np.float32) * weight[0] + self.near[two[order]].astype(np.float32) * weight[1]
        cls = cls[order]
        group = cls // self.v.width
        value = _log_softmax(query @ group_out.T + group_bias, group)
        cuts = np.searchsorted(group, np.arange(self.v.groups + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            rows, those = slice(cuts[k], cuts[k + 1]), slice(k * self.v.width, (k + 1) * self.v.width)
            value[rows] += _log_softmax(query[rows] @ class_out[those].T + bias[those], cls[rows] - k * self.v.width)
        out = np.empty(len(cls))
        out[order] = value / np.log(10)
        return out


def _log_softmax(scores: np.ndarray, taken: np.ndarray) -> np.ndarray:
    scores -= scores.max(1, keepdims=True)
    own = scores[np.arange(len(taken)), taken].astype(np.float64)
    return own - np.log(np.exp(scores, out=scores).sum(1).astype(np.float64))


_PARTIAL = "doc_id long, uid long, n_tokens long, known long, base double, model double, tail array<long>"


def _scorer(shared):
    def score(batches):
        model = shared.value
        v = model.v
        scale, log_mass = np.log10(v.total + v.distinct + 1), np.log10(v.mass)
        for batch in batches:
            for part in slices(batch):
                tokens, ending, bounds = _tokens(part.column("text"))
                cls, n, near = v.find(tokens, ending)
                one, two = _histories(near, bounds, v)
                seen, row = n >= 0, np.repeat(np.arange(part.num_rows), np.diff(bounds))
                log_n = np.log10(np.where(seen, n, 0) + 1.0)
                by_row = lambda x: np.bincount(row, weights=x, minlength=part.num_rows)
                model_score = model.log10(one, two, cls) + log_n - log_mass[cls]
                tail = np.flatnonzero(~seen)
                cuts = np.searchsorted(tail, bounds).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("uid"), pa.array(np.diff(bounds)),
                        pa.array(by_row(seen).astype(np.int64)), pa.array(by_row(log_n - scale)), pa.array(by_row(model_score)),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(tokens[tail])),
                    ],
                    names=["doc_id", "uid", "n_tokens", "known", "base", "model", "tail"],
                )

    return score


def counted(training: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """(counts of the words that are not in the vocabulary, vocabulary) of training texts."""
    counts = written(word_counts(training))
    # words at least so frequent that not more than SENT of them are sent
    level = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).orderBy(F.desc("level")).collect()
    total, distinct = sum(r.n for r in levels), sum(r.words for r in levels)
    reach, least = 0, 1 << 20
    for r in levels:
        if reach + r.words > SENT:
            break
        reach, least = reach + r.words, r.level
    head = sorted((r.word, r.ending, r.n) for r in counts.where(level >= least).collect())
    groups, width = classes_of(distinct)
    by_ending = np.zeros((groups * width - groups * width // 4, 2), np.int64)
    ends = F.pmod(F.col("ending"), F.lit(len(by_ending)))
    for r in counts.groupBy(ends.alias("k")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():  # one row a hashed class
        by_ending[r.k] = r.n, r.words
    word, ending, n = (np.array(x, np.int64) for x in (zip(*head) if head else ([], [], [])))
    return counts.where(level < least), Vocabulary(word, ending, n, total, distinct, by_ending)


def fit(training: DataFrame) -> tuple[DataFrame, Model]:
    """(counts of the words that are not in the model's vocabulary, model) of training texts."""
    rest, v = counted(training)
    shared = training.sparkSession.sparkContext.broadcast(v)
    return rest, Model(train(training, shared, v), v)


def language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of docs.

    Texts are lower-cased (A-Z) and split at ASCII blanks; an end follows each. Texts outside the held-out fold
    teach counts and model. Null and empty texts are one end token. A null doc_id stays null, is not held
    out, and teaches too. Repeated rows count and come back repeatedly; further columns are ignored; an empty
    table gives no rows. Words are told apart by 64-bit hashes. ``score`` depends on how the input is split into
    partitions, as each trains a replica; all other columns don't.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = F.coalesce(remainder("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    rest, model = fit(docs.where(~held))
    shared = spark.sparkContext.broadcast(model)

    scored = written(docs.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(_scorer(shared), _PARTIAL))
    tail = scored.select("uid", F.explode("tail").alias("word")).groupBy("uid", "word").agg(F.count(F.lit(1)).alias("k"))
    tail = tail.join(rest, "word").groupBy("uid").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("log_n"))
    out = scored.drop("tail").join(tail, "uid", "left").withColumn("log_n", F.coalesce("log_n", F.lit(0.0)))
    return out.select(
        "doc_id", F.coalesce(remainder("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.v.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("log_n")).alias("base_score"), (F.col("model") + F.col("log_n")).alias("score"),
    )
