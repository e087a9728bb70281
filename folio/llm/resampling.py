"""Importance resampling: documents drawn by how likely the target makes their hashed features, ranks by parallel sorting.

Weights are sums over arrays of bucket gains. The drawing adds Gumbel noise keyed by doc_id and takes the highest scores.
Their order comes from sorting by regular sampling: each run is sorted locally, regular samples of all runs give
splitters, rows are exchanged by segment and merged there, and the counts of the segments before give exact ranks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, written
from .text import Words, slices

BUCKETS = 10_000
SEED = "2024"
#: Documents with fewer words are not drawn; share of the others that is, in percent.
LEAST_WORDS, PERCENT = 20, 10
#: Samples of a run at most, and of all runs together; rows of a segment that many segments are made for.
SAMPLES, ALL_SAMPLES, SEGMENT_ROWS = 4096, 1 << 20, 4 << 20

#: Bytes of a word that are hashed in step with other words; longer ones are hashed alone.
_STEPS = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def _crc(low: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC-32 of low[start:end] for each word, going on from ``state`` (finished values; 0 at the beginning)."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    first, left = start[order], -length[order]
    crc = ~state[order]
    for k in range(min(_STEPS, int(length.max(initial=0)))):
        m = int(np.searchsorted(left, -k, "left"))  # words longer than k
        crc[:m] = _CRC[(crc[:m] ^ low[first[:m] + k]) & 0xFF] ^ (crc[:m] >> 8)
    out = np.empty_like(crc)
    out[order] = ~crc
    for i in np.flatnonzero(length > _STEPS).tolist():
        out[i] = zlib.crc32(low[start[i] : end[i]].tobytes(), int(state[i]))
    return out


def features(words: Words, runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all runs of 1 to ``runs`` consecutive words of a text, joined by one space."""
    of, n = words.row(), len(words.start)
    crc, rows, found = np.zeros(n, np.uint32), [], []
    for k in range(runs):
        m = n - k
        if m <= 0:
            break
        if k:
            crc = ~(_CRC[(~crc[:m] ^ np.uint32(0x20)) & 0xFF] ^ (~crc[:m] >> 8))
        crc = _crc(words.low, words.start[k:], words.end[k:], crc[:m])
        within = of[:m] == of[k:]
        rows.append(of[:m][within])
        found.append((crc % np.uint32(buckets)).astype(np.int64)[within])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(found)


def _counter(runs: int, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                for side in (0, 1):
                    own = part.filter(pa.compute.equal(part.column("side"), side))
                    if own.num_rows:
                        got = np.bincount(features(Words(own.column("text"), "alnum"), runs, buckets)[1], minlength=buckets)
                        sums[side] = sums.get(side, 0) + got
        for side, n in sums.items():
            held = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), side, np.int32)), pa.array(held.astype(np.int32)), pa.array(n[held].astype(np.int64))], names=["side", "bucket", "n"])

    return count


def gains(docs: DataFrame, target: DataFrame, runs: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, floor(1000 * ln of its smoothed share in the target over that in docs); ``buckets`` numbers come to the driver."""
    both = docs.select("text", F.lit(0).alias("side")).unionByName(target.select("text", F.lit(1).alias("side")))
    rows = both.mapInArrow(_counter(runs, buckets), "side int, bucket int, n long").groupBy("side", "bucket").agg(F.sum("n").alias("n")).collect()
    n = np.zeros((2, buckets), np.float64)
    for side, bucket, count in rows:
        n[side, bucket] = count
    s, t = n
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def scored(docs: DataFrame, gain: np.ndarray, runs: int = 1, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of docs(doc_id, text) in a narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words, n = Words(part.column("text"), "alnum"), part.num_rows
                row, bucket = features(words, runs, len(shared.value))
                sums = np.zeros(n + 1, np.int64)
                order = np.argsort(row, kind="stable")
                total = np.concatenate([[0], np.cumsum(shared.value[bucket[order]])])
                at = np.searchsorted(row[order], np.arange(n + 1))
                sums = total[at[1:]] - total[at[:-1]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(words.bounds).astype(np.int64)), pa.array(np.diff(at).astype(np.int64)), pa.array(sums)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return rows.withColumn("score", F.col("weight") + noise)


def _keys(score, doc_id, run, at) -> list[np.ndarray]:
    """For lexsort, the last first: score descending, doc_id ascending with nulls last, then the place in its run."""
    none = np.array([x is None for x in doc_id]) if isinstance(doc_id, list) else np.asarray(doc_id.is_null())
    ids = np.array([x or 0 for x in doc_id], np.int64) if isinstance(doc_id, list) else np.asarray(doc_id.fill_null(0))
    return [np.asarray(at, np.int64), np.asarray(run, np.int64), ids, none.astype(np.int64), -np.asarray(score, np.int64)]


def _segments(rows: DataFrame, splitters: list) -> DataFrame:
    """rows with ``segment``: how many splitters stand before or at the row."""
    of = [[x[i] for x in splitters] for i in range(4)]
    shared = rows.sparkSession.sparkContext.broadcast(_keys(*of) if splitters else None)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segment = np.zeros(batch.num_rows, np.int32)
            if shared.value is not None and batch.num_rows:
                own = _keys(np.asarray(batch.column("score")), batch.column("doc_id"), np.asarray(batch.column("run")), np.asarray(batch.column("at")))
                k = len(shared.value[0])
                first = np.r_[np.zeros(k, np.int8), np.ones(batch.num_rows, np.int8)]
                order = np.lexsort([first, *(np.r_[a, b] for a, b in zip(shared.value, own))])
                before = np.cumsum(order < k)
                mine = order >= k
                segment[order[mine] - k] = before[mine]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment)], names=[*batch.schema.names, "segment"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(deal, f"{kinds}, segment int")


def _placed(before: dict[int, int], drawn: int):
    """Ranks of rows that come sorted within their segment."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = -1, 0
        for batch in batches:
            segment = np.asarray(batch.column("segment")).astype(np.int64)
            n = len(segment)
            if not n:
                continue
            begins = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            index = np.arange(n) - np.repeat(begins, np.diff(np.r_[begins, n]))
            if segment[0] == last:
                index[: begins[1] if len(begins) > 1 else n] += seen
            last, seen = int(segment[-1]), int(index[-1]) + 1
            rank = np.array([before[s] for s in segment[begins].tolist()]).repeat(np.diff(np.r_[begins, n])) + index + 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_features", "weight", "score")), pa.array(rank, mask=rank > drawn)], names=["doc_id", "n_features", "weight", "score", "rank"])

    return place


def ranked(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """rows of ``scored`` with ``rank``: 1, 2, 3, ... for the floor(percent * N / 100) highest scores of the N rows with ``least_words`` words or more, ties to the smaller doc_id; null for all others.

    To the driver come the length of each run, at most ALL_SAMPLES samples (one for each run at least) and a count for each segment.
    """
    spark = rows.sparkSession
    rows = written(rows.withColumn("eligible", F.col("n_words") >= least_words))
    # each partition is a run; its eligible rows stand first
    runs = written(rows.sortWithinPartitions(F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id")).withColumn("run", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    eligible = runs.where("eligible")
    lengths = {r.run: r.n for r in eligible.groupBy("run").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(lengths.values())
    drawn = percent * n // 100
    each = max(1, min(SAMPLES, ALL_SAMPLES // max(1, len(lengths))))
    steps = spark.createDataFrame([(k, max(1, -(-x // each))) for k, x in lengths.items()] or [(-1, 1)], "run int, step long")
    picked = eligible.join(F.broadcast(steps), "run").where(F.col("at") % F.col("step") == F.floor(F.col("step") / 2)).select("score", "doc_id", "run", "at", "step").collect()
    q = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SEGMENT_ROWS))
    splitters = []
    if picked:
        of = _keys(*([r[i] for r in picked] for i in range(4)))
        order = np.lexsort(of)
        share = np.cumsum([picked[i].step for i in order])
        at = np.searchsorted(share, share[-1] * np.arange(1, q) / q)
        splitters = [tuple(picked[order[i]])[:4] for i in np.unique(at)]
    dealt = _segments(eligible.select("doc_id", "n_features", "weight", "score", "run", "at"), splitters)
    counts = {r.segment: r.n for r in dealt.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for s in sorted(counts):
        before[s] = total
        total += counts[s]
    # segments behind the last drawn row need no order
    last = max((s for s, x in before.items() if x < drawn), default=-1)
    merged = dealt.where(F.col("segment") <= last).repartitionById(max(1, last + 1), F.col("segment")).sortWithinPartitions("segment", F.desc("score"), F.asc_nulls_last("doc_id"), "run", "at")
    placed = merged.mapInArrow(_placed(before, drawn), "doc_id long, n_features long, weight long, score long, rank long")
    columns = ["doc_id", "n_features", "weight", "score"]
    undrawn = dealt.where(F.col("segment") > last).select(*columns).unionByName(runs.where("not eligible").select(*columns))
    return placed.unionByName(undrawn.withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, runs: int = 1, buckets: int = BUCKETS, seed: str = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of docs(doc_id, text), drawn to resemble target(text).

    Null texts have no words and weigh 0; a null doc_id counts as an empty one and loses ties. Repeated rows are rows of
    their own: alike in score and doc_id, they take following ranks. Only doc_id and text are read, whatever other columns there are.
    Empty tables give no row, and an empty target leaves all gains as smoothed.
    """
    small_batches(docs.sparkSession)
    gain = gains(docs, target, runs, buckets)
    return ranked(scored(docs, gain, runs, seed), percent, least_words)
