"""Byte-level BPE encoding by overlapping chunks, and decoding.

A long text is cut into overlapping chunks that are pre-tokenised in parallel.
The pattern looks ahead but never back, so two scans that share one boundary
agree from there on: neighbouring chunks are stitched at the first boundary
that both found in their overlap. Each stitched range is then encoded piece by
piece. Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches, written
from .text import slices, tidied

#: Code points of a chunk, and how far it reaches into the next one.
CHUNK = 32_768
OVERLAP = 1_024
#: Encoded pieces that a worker remembers.
REMEMBERED = 250_000


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """Id to token bytes; ids that no token has are empty."""
    table = ranks(path)
    out = [b""] * (max(table.values(), default=-1) + 1)
    for token, rank in table.items():
        out[rank] = token
    return out


class _Pieces(dict):
    """Piece of text to its ids as int32 bytes."""

    def __init__(self, path: str):
        import tiktoken

        self.merge = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks(path), special_tokens={})._encode_single_piece

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = np.array(self.merge(piece.encode()), np.int32).tobytes()
        self[piece] = ids
        return ids


@lru_cache(maxsize=4)
def _pieces(path: str) -> _Pieces:
    return _Pieces(path)


@lru_cache(maxsize=8)
def _compiled(pattern: str):
    return regex.compile(pattern)


def encode_text(text: str, path: str, pattern: str) -> np.ndarray:
    """Ids of one text: each match of the pattern by itself."""
    return np.frombuffer(b"".join(map(_pieces(path).__getitem__, _compiled(pattern).findall(text))), np.int32)


def pretoken_ends(text: str, pattern: str) -> list[int]:
    """Positions at which a pre-token ends."""
    return [m.end() for m in _compiled(pattern).finditer(text)]


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))


def _encoder(path: str, pattern: str, keys: tuple[str, ...]):
    def encode(batches):
        for batch in batches:
            for part in slices(batch):
                ids = [encode_text(t or "", path, pattern) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), _lists(ids)], names=[*keys, "ids"])

    return encode


def _cutter(chunk: int, overlap: int):
    def cut(batches):
        for batch in batches:
            for uid, doc, text in zip(*(batch.column(c).to_pylist() for c in ("uid", "doc_id", "text"))):
                at = range(0, max(1, len(text) - overlap), chunk)
                for i in range(0, len(at), 64):
                    starts = at[i : i + 64]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([uid] * len(starts), pa.int64()),
                            pa.array([doc] * len(starts), pa.int64()),
                            pa.array(range(i, i + len(starts)), pa.int32()),
                            pa.array([s == at[-1] for s in starts], pa.bool_()),
                            pa.array([text[s:] if s == at[-1] else text[s : s + chunk + overlap] for s in starts], pa.string()),
                        ],
                        names=["uid", "doc_id", "chunk", "last", "text"],
                    )

    return cut


def _scanner(chunk: int, overlap: int, pattern: str):
    def scan(batches):
        for batch in batches:
            head, tail = [], []
            for last, text in zip(batch.column("last").to_pylist(), batch.column("text").to_pylist()):
                ends = np.array(pretoken_ends(text, pattern), np.int32)
                head.append(ends[ends <= overlap])
                # what ends with the chunk may go on in the text
                tail.append(ends[:0] if last else ends[(ends >= chunk) & (ends < len(text))] - chunk)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("uid", "chunk", "last")), _lists(head), _lists(tail)], names=["uid", "chunk", "last", "head", "tail"]
            )

    return scan


def _range_encoder(chunk: int, path: str, pattern: str):
    def encode(batches):
        for batch in batches:
            for part in slices(batch):
                begin, end, last = (part.column(c).to_pylist() for c in ("begin", "stop", "last"))
                ids = [
                    encode_text(t[b:] if z else t[b : chunk + e], path, pattern)
                    for t, b, e, z in zip(part.column("text").to_pylist(), begin, end, last)
                ]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("uid", "doc_id", "chunk")), _lists(ids)], names=["uid", "doc_id", "chunk", "ids"])

    return encode


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, then: tuple | None = None) -> DataFrame:
    """(doc_id, ids array<int>), one row for each row of docs.

    ``path`` is a rank file, ``pattern`` the pre-token pattern; it must not look
    behind. Null and empty texts have no ids. Null doc_ids stay null, repeated
    rows give repeated results, further columns are ignored, an empty table
    gives no rows. A long text whose neighbouring chunks share no boundary in their overlap (one endless pre-token,
    say) is encoded whole. ``then`` may be a function of record batches (doc_id, ids) and its schema: what it makes of
    the rows is returned instead, without the ids leaving the worker that made them.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    length = F.length(F.coalesce("text", F.lit("")))
    finish, schema = then or (None, "doc_id long, ids array<int>")
    plain = _encoder(path, pattern, ("doc_id",))
    whole = tidied((lambda batches: finish(plain(batches))) if finish else plain)
    short = docs.where(length <= chunk + overlap).mapInArrow(whole, schema)

    long = docs.where(length > chunk + overlap).withColumn("uid", F.monotonically_increasing_id())
    cut = written(long.mapInArrow(_cutter(chunk, overlap), "uid long, doc_id long, chunk int, last boolean, text string"))
    found = cut.repartition("uid", "chunk").mapInArrow(
        _scanner(chunk, overlap, pattern), "uid long, chunk int, last boolean, head array<int>, tail array<int>"
    )
    order = Window.partitionBy("uid").orderBy("chunk")
    stop = F.array_min(F.array_intersect("tail", F.lead("head").over(order)))
    cuts = found.withColumn("stop", stop).withColumn("begin", F.coalesce(F.lag("stop").over(order), F.lit(0)))
    cuts = written(cuts.select("uid", "chunk", "begin", "stop", (~F.col("last") & F.col("stop").isNull()).alias("torn")))
    torn = cuts.where("torn").select("uid").distinct()
    ranged = (
        cut.join(cuts.drop("torn"), ["uid", "chunk"]).join(torn, "uid", "left_anti")
        .mapInArrow(tidied(_range_encoder(chunk, path, pattern)), "uid long, doc_id long, chunk int, ids array<int>")
    )
    gathered = ranged.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    stitched = gathered.select("doc_id", F.flatten(F.col("parts.ids")).alias("ids"))
    stitched = stitched.mapInArrow(finish, schema) if finish else stitched
    again = (
        cut.join(torn, "uid", "left_semi").withColumn("text", F.when(F.col("last"), F.col("text")).otherwise(F.substring("text", 1, chunk)))
        .groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("parts"))
        .select("doc_id", F.array_join(F.col("parts.text"), "").alias("text")).mapInArrow(whole, schema)
    )
    return short.unionByName(stitched).unionByName(again)


def _decoder(path: str):
    def decode(batches):
        names = token_bytes(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out = [b"".join(map(names.__getitem__, x.values.to_pylist())) if x.is_valid else b"" for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return decode


_DECODED = "doc_id long, ids array<int>, decoded binary"


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded binary): the ids' bytes in order; of null ids, no bytes."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(path), _DECODED)


def round_trip(docs: DataFrame, path: str, pattern: str, **kw) -> DataFrame:
    """decode(encode(docs)), the ids decoded by the worker that made them."""
    return encode(docs, path, pattern, then=(_decoder(path), _DECODED), **kw)


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): sizes and SHA-256 of the ids, joined by commas, and of the decoded bytes."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
