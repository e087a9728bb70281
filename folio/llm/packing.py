"""Packing token ids into rows of fixed length by best-fit decreasing.

Texts longer than a row are split without loss. Segments are dealt into
shards of about ``SHARD_TOKENS`` tokens; in each, segments in falling length go to the
row with the least room that still holds them, found by a segment tree over
room left. A packed row carries its ids, the cumulative segment lengths and positions
that begin anew with each segment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids of a row.
CAPACITY = 2048
#: Tokens of a shard: what a task holds at a time, and how far packing looks.
SHARD_TOKENS = 4_000_000
#: Partitions that shards are dealt to, at most.
PARTITIONS = 4096


class Room:
    """A segment tree over room left, 0 to capacity: how many open rows have it, and which."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        k = room + self.width
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, row) with the least room of at least size, removed; None if there is none."""
        k = size + self.width
        if not self.count[k]:
            # up to the first subtree on the right that has rows, then down its left side
            while k > 1 and not (k % 2 == 0 and self.count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.width:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        room = k - self.width
        while k:
            self.count[k] -= 1
            k >>= 1
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Rows as lists of indices into sizes, which fall; none is over capacity."""
    tree, rows = Room(capacity), []
    for i, size in enumerate(sizes):
        found = tree.take(size)
        if found is None:
            found = capacity, len(rows)
            rows.append([])
        room, row = found
        rows[row].append(i)
        if room > size:
            tree.put(room - size, row)
    return rows


def _segmenter(capacity: int, dtype: str):
    def segments(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                doc, at, size, ids = [], [], [], []
                for d, x in zip(part.column("doc_id").to_pylist(), part.column("ids")):
                    flat = x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int32)
                    for a in range(0, len(flat), capacity):
                        piece = flat[a : a + capacity]
                        if int(piece.min()) < 0 or int(piece.max()) > np.iinfo(dtype).max:
                            raise ValueError(f"document {d} has an id that does not fit {dtype}")
                        doc.append(d)
                        at.append(a)
                        size.append(len(piece))
                        ids.append(piece.astype(dtype).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(size, pa.int32()), pa.array(ids, pa.binary())], names=["doc_id", "start", "size", "ids"]
                )

    return segments


_DTYPES = {2: "<u2", 4: "<u4"}


def segmenting(capacity: int = CAPACITY, width: int = 2) -> tuple:
    """A function of record batches (doc_id, ids) that splits texts into segments, and its schema; for mapInArrow or an encoder's ``then``."""
    if not 0 < capacity < 1 << (8 * width):
        raise ValueError("capacity must be positive and fit the width")
    return _segmenter(capacity, _DTYPES[width]), "doc_id long, start long, size int, ids binary"


_SCHEMA = (
    "shard int, row int, n_tokens int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, ids binary, positions binary"
)


def _packer(capacity: int, dtype: str, pad: int):
    def emit(shard, held):
        sizes = [s for _, _, s, _ in held]
        rows = best_fit_decreasing(sizes, capacity)
        for i in range(0, len(rows), 256):
            out: list[list] = [[] for _ in range(8)]
            for r, members in enumerate(rows[i : i + 256], i):
                lengths = [sizes[m] for m in members]
                cumulated = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                matrix = np.full(capacity, pad, dtype)
                matrix[: cumulated[-1]] = np.frombuffer(b"".join(held[m][3] for m in members), dtype)
                places = np.zeros(capacity, dtype)
                places[: cumulated[-1]] = np.concatenate([np.arange(n) for n in lengths])
                values = (shard, r, int(cumulated[-1]), [held[m][0] for m in members], [held[m][1] for m in members], cumulated.tolist(), matrix.tobytes(), places.tobytes())
                for k, x in enumerate(values):
                    out[k].append(x)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in zip(out, kinds)], names=["shard", "row", "n_tokens", "doc_ids", "starts", "cu_seqlens", "ids", "positions"]
            )

    def pack(batches):
        at, held = None, []
        for batch in batches:
            for shard, *segment in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "start", "size", "ids"))):
                if shard != at:
                    if held:
                        yield from emit(at, held)
                    at, held = shard, []
                held.append(segment)
        if held:
            yield from emit(at, held)

    return pack


def pack(encoded: DataFrame, tokens: int, capacity: int = CAPACITY, width: int = 2, pad: int = 0) -> DataFrame:
    """(shard, row, n_tokens, doc_ids, starts, cu_seqlens, ids, positions) from (doc_id, ids array<int>).

    ``tokens`` is about how many ids there are: it sets the number of shards. ``ids`` and ``positions`` are rows of ``capacity``
    little-endian unsigned integers of ``width`` bytes, filled with ``pad`` and 0; cu_seqlens begins with 0;
    doc_ids and starts tell which document, from which of its tokens, each segment holds. Documents with null or no ids
    fill no row; null doc_ids are packed as null; repeated rows are packed repeatedly; further columns are ignored; an
    empty table gives no rows. Ids must fit the width, and capacity must too; else the job fails. Shards are dealt to at most PARTITIONS
    partitions, in which one after the other is packed.
    """
    pieces = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(*segmenting(capacity, width))
    return pack_segments(pieces, tokens, capacity, width, pad)


def pack_segments(pieces: DataFrame, tokens: int, capacity: int = CAPACITY, width: int = 2, pad: int = 0) -> DataFrame:
    """pack() of segments (doc_id, start, size, ids binary), as ``segmenting`` makes them."""
    dtype, shards = _DTYPES[width], max(1, -(-tokens // SHARD_TOKENS))
    # by content too, as one id may be repeated
    shard = F.pmod(F.xxhash64("doc_id", "start", "ids"), F.lit(shards)).cast("int")
    parts = min(shards, PARTITIONS)
    dealt = pieces.withColumn("shard", shard).repartitionById(parts, F.col("shard") % parts).sortWithinPartitions("shard", F.desc("size"), "doc_id", "start")
    return dealt.mapInArrow(_packer(capacity, dtype, pad), _SCHEMA)


def write(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet files: id matrices, cumulative segment lengths and position resets."""
    packed.write.mode("overwrite").parquet(path)


def digests(packed: DataFrame) -> DataFrame:
    """(shard, row, n_tokens, n_segments, doc_ids, starts, cu_seqlens, ids_sha256, positions_sha256) of packed rows."""
    return packed.select(
        "shard", "row", F.col("n_tokens").cast("long").alias("n_tokens"), F.size("doc_ids").cast("long").alias("n_segments"), "doc_ids", "starts", "cu_seqlens",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"),
    )
