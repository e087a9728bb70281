"""Phrase collocations by partitioned mining: shards mined whole at proportional support, their union counted exactly.

A phrase that a language has ``support`` times has its share of them in one shard at least, so mining each shard at the
support that its share of the language's words asks for, rounded up, misses none. The number of shards is fixed, so that this
support doesn't fall as the corpus grows; a shard's texts lie in any number of tasks, which count it together, level by level:
a phrase is looked at only if both phrases of one word less within it are frequent in the shard. What any shard finds goes
into a bit table, unless its counts in the shards that found it, and the most that it can have in all others, fall short of the support; the last pass counts all phrases that the table lets through, and sums them. Phrases that
only seem to be in a table are counted exactly like all others and fail the support, so its size decides the cost, never the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches, written
from .text import STOPS, Words, mix, slices

SUPPORT, LONGEST, ABSORB, TOP = 100, 5, 100, 2000
#: Shards, by a hash of the text. More of them find more phrases that prove too rare.
SHARDS = 4
#: Text of a language that a task counts together in the last pass, and hashes that it counts together in the others.
PART_BYTES, PART_HASHES = 24 << 20, 4 << 20
#: Languages whose shards' supports are sent to the tasks; shards of others are mined at support 1.
LANGS = 4096
#: Bits of the table: at least this many for each phrase found, up to the most (32 MB).
BITS_EACH, MOST_BITS = 8, 1 << 28
#: Blocks of the table, each put together by one task.
_BLOCKS = 64
_PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _pieces(words: Words) -> np.ndarray:
    """The number of the piece that each word stands in; texts begin pieces."""
    breaks = STOPS[words.low]
    breaks[words.offsets[:-1][words.offsets[:-1] < len(breaks)]] = True
    return np.cumsum(breaks)[words.start]


def _hashed(word: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the phrases of ``size`` words that begin at these places among the words' hashes."""
    h = np.full(len(first), np.uint64(size))
    for k in range(size):
        h += word[first + k] * _PLACES[k]
    return mix(h)


class _Part:
    """Words of one language from many texts."""

    def __init__(self):
        self.low, self.start, self.end, self.hash, self.piece = [], [], [], [], []
        self.size = self.pieces = self.words = 0

    def add(self, words: Words) -> None:
        piece = _pieces(words)
        # narrow numbers, as there are millions of words
        self.low.append(words.low)
        self.start.append((words.start + self.size).astype(np.uint32))
        self.end.append((words.end + self.size).astype(np.uint32))
        self.hash.append(words.hash)
        self.piece.append((piece + self.pieces).astype(np.uint32))
        self.words += len(words.start)
        self.size += len(words.low)
        # the next text begins a piece of its own
        self.pieces += int(piece[-1]) + 1 if len(piece) else 1

    def phrases(self, longest: int, keep: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(size, first word of one occurrence, count, hash) of the phrases of each size that ``keep(count, hash, size)`` lets stay.

        A phrase is looked at only if both phrases of one word less within it stay. Phrases are told apart by exact numbers, words by 64-bit hashes.
        """
        piece, self.piece = np.concatenate(self.piece), []
        word = np.concatenate(self.hash)
        self.hash = []
        # the hash of each different word, and the number of each word among them
        word, own = np.unique(word, return_inverse=True)
        self.number = own.astype(np.uint32)
        most = np.int64(len(word))
        number, at = own.astype(np.int64), np.arange(len(own), dtype=np.uint32)  # number of the phrase that begins at each place in ``at``
        del own
        for size in range(1, longest + 1):
            if size > 1:
                # places where a kept phrase begins and another one begins a word later, in the same piece
                here = np.flatnonzero((at[1:] == at[:-1] + 1) & (piece[at[:-1]] == piece[np.minimum(at[:-1].astype(np.int64) + size - 1, len(piece) - 1)]) & (at[:-1].astype(np.int64) + size <= len(piece)))
                at, number = at[here], number[here] * most
                number += self.number[at + (size - 1)]
            if not len(at):
                return
            _, first, number, count = np.unique(number, return_index=True, return_inverse=True, return_counts=True)
            one = at[first]
            h = np.full(len(one), np.uint64(size))
            for k in range(size):
                h += word[self.number[one + k]] * _PLACES[k]
            h = mix(h)
            stay = keep(count, h, size)
            yield size, one[stay], count[stay], h[stay]
            there = stay[number]
            at, number = at[there], number[there]
            number = (np.cumsum(stay) - 1)[number]

    def spelled(self, size: int, first: np.ndarray) -> list[str]:
        """The phrases of ``size`` words that begin at these words."""
        low, start, end = self._joined()
        places = (first[:, None] + np.arange(size)).ravel()
        number, of = np.unique(self.number[places], return_inverse=True)
        place = np.zeros(len(number), np.int64)
        place[of] = places
        words = [low[a:b].decode() for a, b in zip(start[place].tolist(), end[place].tolist())]
        return [" ".join([words[i] for i in row]) for row in of.reshape(-1, size).tolist()]

    def _joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        if len(self.low) > 1 or not isinstance(self.low, tuple):
            self.low = (b"".join(self.low),)
            self.start, self.end = [np.concatenate(self.start)], [np.concatenate(self.end)]
        return self.low[0], self.start[0], self.end[0]


def _by_lang(part: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    lang = part.column("lang").dictionary_encode()
    for code, name in enumerate(lang.dictionary.to_pylist()):
        yield name, part.filter(pa.compute.equal(lang.indices, code))


def _parts(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, _Part]]:
    """A task's rows of (lang, text) in parts, each of one language."""
    open_: dict[str, _Part] = {}
    for batch in batches:
        for some in slices(batch):
            for name, own in _by_lang(some):
                part = open_.setdefault(name, _Part())
                part.add(Words(own.column("text"), "within_piece"))
                if part.size >= limit:
                    yield name, open_.pop(name)
    yield from open_.items()


def _salted(h: np.ndarray, lang: str) -> np.ndarray:
    salt = np.frombuffer(lang.encode()[:4096].ljust(8), np.uint8).astype(np.uint64)
    return mix(h + mix((salt * mix(np.arange(1, len(salt) + 1, dtype=np.uint64))).sum(keepdims=True)))


_SHARD_SALTS = mix(np.arange(7001, 7001 + 4096, dtype=np.uint64))


def _is_set(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & np.uint64(8 * len(table) - 1)).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, int], int] = {}
    for batch in batches:
        for some in slices(batch):
            for name, own in _by_lang(some):
                sums = np.bincount(np.asarray(own.column("shard")), np.diff(Words(own.column("text"), "within_piece").bounds))
                for shard in np.flatnonzero(sums).tolist():
                    found[name, shard] = found.get((name, shard), 0) + int(sums[shard])
    yield pa.RecordBatch.from_pydict({"lang": pa.array([k for k, _ in found], pa.string()), "shard": pa.array([k for _, k in found], pa.int32()), "n": pa.array(list(found.values()), pa.int64())})


def _level(size: int, tables: list, langs, shards: int):
    """(h, code, n): a task's phrases of ``size`` words whose parts are in the tables of the sizes before. h tells phrases and languages apart, code languages (0 for those that are not listed) and shards."""

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def counted(name: str) -> pa.RecordBatch:
            h, shard = (np.concatenate(x) for x in zip(*held.pop(name)))
            _, first, n = np.unique(h ^ _SHARD_SALTS[shard], return_index=True, return_counts=True)
            code = langs.value.get(name, 0) * shards + shard[first]
            return pa.RecordBatch.from_pydict({"h": pa.array(h[first].view(np.int64)), "code": pa.array(code.astype(np.int32)), "n": pa.array(n.astype(np.int64))})

        for batch in batches:
            for some in slices(batch):
                for name, own in _by_lang(some):
                    words = Words(own.column("text"), "within_piece")
                    piece, shard = _pieces(words), np.asarray(own.column("shard"))[words.row()]
                    at = np.arange(len(words.hash))
                    for k in range(1, size + 1):
                        if k > 1:
                            here = np.flatnonzero(at[1:] == at[:-1] + 1)
                            at = at[here]
                            at = at[piece[at] == piece[np.minimum(at + k - 1, len(piece) - 1)]]
                        h = _salted(_hashed(words.hash, at, k), name)
                        if k < size:
                            at = at[_is_set(tables[k - 1].value, h ^ _SHARD_SALTS[shard[at]])]
                    if len(at):
                        held.setdefault(name, []).append((h, shard[at]))
                        if sum(len(x) for x, _ in held[name]) >= PART_HASHES:
                            yield counted(name)
        for name in list(held):
            yield counted(name)

    return level


def _bits(found: DataFrame, rows: int) -> np.ndarray:
    """A table of bits, set at the hashes h of ``found``, put together in _BLOCKS blocks."""
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(18, (BITS_EACH * rows - 1).bit_length()))
    size = bits // _BLOCKS

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.asarray(batch.column("at"))
            for b in np.unique(at // size).tolist():
                blocks.setdefault(b, np.zeros(size, bool))[at[at // size == b] % size] = True
        for b, x in blocks.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "bits": pa.array([np.packbits(x, bitorder="little").tobytes()], pa.binary())})

    at = found.select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("at"))
    parts = at.repartition(_BLOCKS, F.floor(F.col("at") / size)).mapInArrow(set_bits, "block int, bits binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for b, x in parts:
        out[b * size // 8 : (b + 1) * size // 8] = np.frombuffer(x, np.uint8)
    return out


def _found_in_shards(texts: DataFrame, sums: DataFrame, support: int, longest: int, shards: int) -> DataFrame:
    """(h) of the phrases of 1 to ``longest`` words that are frequent in some shard for its share of the words, and may be in all."""
    spark = texts.sparkSession
    kept = sums.groupBy("lang").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "lang").limit(LANGS).collect()
    number = {r.lang: i + 1 for i, r in enumerate(kept)}
    langs = spark.sparkContext.broadcast(number)
    listed = spark.createDataFrame([(r.lang, number[r.lang], r.total) for r in kept], "lang string, number int, total long")
    # at most LANGS * shards rows
    least = sums.join(F.broadcast(listed), "lang").select((F.col("number") * shards + F.col("shard")).alias("code"), "number", F.greatest(F.lit(1), F.ceil(support * F.col("n") / F.col("total")).cast("long")).alias("least"))
    short = F.lit(support) - F.sum(F.col("least") - 1).over(Window.partitionBy("number"))
    least = F.broadcast(written(least.select("code", "least", short.alias("need"))))
    found, tables = None, []
    for size in range(1, longest + 1):
        rows = texts.mapInArrow(_level(size, tables, langs, shards), "h long, code int, n long").groupBy("h", "code").agg(F.sum("n").alias("n")).join(least, "code", "left")
        own = rows.select("h", "code", F.col("n") - F.coalesce("least", F.lit(1)) + 1, F.coalesce("need", F.lit(support))).toDF("h", "code", "over", "need").where("over >= 1")
        own = written(own)
        found = own if found is None else found.unionByName(own)
        n = own.count()
        if not n or size == longest:
            break
        salt = F.element_at(F.array(*(F.lit(int(x)) for x in _SHARD_SALTS[:shards].view(np.int64))), (F.col("code") % shards + 1).cast("int"))
        tables.append(spark.sparkContext.broadcast(_bits(own.select(F.col("h").bitwiseXOR(salt).alias("h")), n)))
    # a shard that did not find a phrase has it less often than its support
    return found.groupBy("h").agg(F.sum("over").alias("over"), F.max("need").alias("need")).where("over >= need").select("h")


def frequent_phrases(texts: DataFrame, support: int = SUPPORT, longest: int = LONGEST, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, f), (lang, n)) of texts(lang, text): the phrases of 1 to ``longest`` words that a language has ``support`` times or more, and its words.

    To the driver come bit tables of at most MOST_BITS bits, one for each size and one for all.
    """
    spark = texts.sparkSession
    joined = texts.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text", F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int").alias("shard"))
    sums = written(joined.mapInArrow(_word_counts, "lang string, shard int, n long").groupBy("lang", "shard").agg(F.sum("n").alias("n")))
    found = written(_found_in_shards(joined, sums, support, longest, shards))
    table = spark.sparkContext.broadcast(_bits(found, found.count()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, part in _parts(batches, PART_BYTES):

            def known(count, h, size, lang=lang):
                return _is_set(table.value, _salted(h, lang))

            if part.words:
                for size, first, n, _ in part.phrases(longest, known):
                    for i in range(0, len(first), 1 << 16):
                        some = first[i : i + (1 << 16)]
                        k = len(some)
                        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * k, pa.string()), "phrase": pa.array(part.spelled(size, some), pa.string()), "size": pa.array(np.full(k, size, np.int32)), "f": pa.array(n[i : i + (1 << 16)].astype(np.int64))})

    counted = joined.mapInArrow(count, "lang string, phrase string, size int, f long")
    known = written(counted.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= support))
    return known, written(sums.groupBy("lang").agg(F.sum("n").alias("n")))


def _part(a, n) -> Column:
    return F.array_join(F.slice("words", a, n), " ")


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, absorb: int = ABSORB, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words by score of their weakest cut.

    docs(lang, text): null texts are empty, null languages are ``und``; other columns are not read, and repeated rows count each time.
    Words never reach over a stop or line end. A phrase within a longer one that has at least ``absorb`` percent of its
    occurrences is dropped. Equal scores go by a, then by phrase in byte order. Languages without such phrases give no row.
    """
    small_batches(docs.sparkSession)
    known, words = frequent_phrases(docs.select("lang", "text"), support, longest)
    phrases = known.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    # parts of longer phrases, with the most frequent phrase that holds them
    within = phrases.where("size >= 3").withColumn("k", F.explode(F.sequence(F.lit(2), F.col("size") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)))
    holders = within.select("lang", _part(F.col("at"), F.col("k")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    kept = phrases.join(holders, ["lang", "phrase"], "left").where(F.col("held").isNull() | (100 * F.col("held") < absorb * F.col("a")))
    cuts = kept.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("first"), _part(F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    of = lambda part, name: known.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    both = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"]).join(words, "lang")
    big = lambda c: f"cast({c} as decimal(19, 0))"
    both = both.withColumn("score", F.expr(f"cast((cast(1000 as decimal(4, 0)) * {big('a')} * {big('n')}) div ({big('l')} * {big('r')}) as bigint)"))
    weakest = both.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each part of a language first, so that no task holds a whole one
    some = weakest.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
