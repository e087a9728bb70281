"""Texts to vectors: the hashing embedder and a hook for any batch encoder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ..sources.store import exists

DIMS = 384
BATCH = 64


def text_features(c):
    """Word runs and all runs of three signs of the lower-cased text."""
    low = F.lower(c)
    words = F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_]+)"), 1)
    last = F.length(low) - 2
    grams = F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(low, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, grams)


def sparse_embedding(texts: DataFrame, key: str, text: str, dims: int = DIMS) -> DataFrame:
    """(key, dim, value) of unit vectors, with MD5 as the hash: built-in functions only, one shuffle with partial sums."""
    hashed = F.md5(F.encode(F.col("feature"), "utf-8"))
    number = lambda a, n: F.conv(F.substring(hashed, a, n), 16, 10).cast("long")
    each = texts.select(key, F.explode(text_features(F.col(text))).alias("feature")).select(
        key, F.pmod(number(1, 8), F.lit(dims)).cast("int").alias("dim"), F.when(number(9, 2) % 2 == 0, 1).otherwise(-1).alias("sign")
    )
    sums = each.groupBy(key, "dim").agg(F.sum("sign").alias("n")).where("n <> 0")
    norms = sums.groupBy(F.col(key).alias("_key")).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return sums.join(norms, F.col(key) == F.col("_key")).select(key, "dim", (F.col("n") / F.col("norm")).alias("value"))


DIGESTS = {"blake2b": lambda b: hashlib.blake2b(b, digest_size=8).digest(), "md5": lambda b: hashlib.md5(b).digest()}


def _placed(features: list[str], dims: int, digest: str) -> np.ndarray:
    """Where each feature counts: its dimension, plus dims if it counts as -1."""
    make = DIGESTS[digest]
    raw = np.frombuffer(b"".join([make(f.encode())[:5] for f in features]), np.uint8).reshape(-1, 5)
    return (raw[:, :4].copy().view(">u4").ravel().astype(np.int64) % dims) + (raw[:, 4] % 2).astype(np.int64) * dims


#: Where runs of three signs below 256 and words count, plus 1, as this process has hashed them; by dims and digest.
_grams: dict[tuple, np.ndarray] = {}
_words: dict[tuple, dict[str, int]] = {}
#: Words that a process remembers at most.
WORDS = 1 << 18


def _gram_places(points: np.ndarray, at: np.ndarray, dims: int, digest: str) -> np.ndarray:
    """``_placed`` of the runs of three signs that begin at ``at``; runs of signs below 256 are hashed once in a process, then looked up."""
    table = _grams.setdefault((dims, digest), np.zeros(1 << 24, np.int32))
    low = points < 256
    small = np.where(low, points, 0).astype(np.int32)
    number = (small[:-2] << 16 | small[1:-1] << 8 | small[2:])[at]
    low = (low[:-2] & low[1:-1] & low[2:])[at]
    new = np.unique(number[(table[number] == 0) & low])
    if len(new):
        table[new] = _placed([chr(x >> 16) + chr(x >> 8 & 255) + chr(x & 255) for x in new.tolist()], dims, digest) + 1
    out = table[number] - 1
    if not low.all():
        # as numbers of 63 bits
        p, others = points.astype(np.uint64), at[~low]
        different, back = np.unique(p[others] << np.uint64(42) | p[others + 1] << np.uint64(21) | p[others + 2], return_inverse=True)
        out[~low] = _placed(["".join(map(chr, (x >> 42, x >> 21 & 0x1FFFFF, x & 0x1FFFFF))) for x in different.tolist()], dims, digest)[back.ravel()]
    return out


def _word_places(words: list[list[str]], dims: int, digest: str) -> np.ndarray:
    known = _words.setdefault((dims, digest), {})
    if len(known) > WORDS:
        known.clear()
    new = list({w for of in words for w in of} - known.keys())
    if new:
        known.update(zip(new, _placed(new, dims, digest).tolist()))
    return np.array([known[w] for of in words for w in of], np.int64)


def hash_vectors(texts: list[str], dims: int = DIMS, digest: str = "blake2b", unit: bool = True) -> np.ndarray:
    """Unit vectors, one a row, of hashed features: word runs and all runs of three signs; whole numbers before they are scaled if not ``unit``."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner, size = np.repeat(np.arange(len(low)), [len(t) for t in low]), 2 * dims * len(texts)
    counts = np.zeros(size, np.int64)
    if len(points) > 2:
        at = np.flatnonzero(owner[2:] == owner[:-2])
        counts += np.bincount(owner[at] * (2 * dims) + _gram_places(points, at, dims, digest), minlength=size)
    words = [re.findall(r"\w+", t) for t in low]
    rows = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    counts += np.bincount(rows * (2 * dims) + _word_places(words, dims, digest), minlength=size)
    counts = counts.reshape(len(texts), 2 * dims)
    out = counts[:, :dims] - counts[:, dims:]
    return scaled_to_unit(out) if unit else out.astype(np.int32)


def scaled_to_unit(counts: np.ndarray) -> np.ndarray:
    """Rows at length 1; rows of zeros stay."""
    out = counts.astype(np.float64)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def hash_vector(text: str, dims: int = DIMS, digest: str = "blake2b") -> np.ndarray:
    """The vector of one text."""
    return hash_vectors([text], dims, digest)[0]


Encoder = Callable[[list[str]], list | np.ndarray]


def encode_batches(texts: DataFrame, text: str, make: Callable[[], Encoder], dims: int, prefix: str = "", batch: int = BATCH, name: str = "embedding") -> DataFrame:
    """texts with the vectors of a batch encoder; ``make`` is called once in each task.

    Null texts have null vectors. Equal texts of a batch of rows are encoded once. A vector of another length fails the job.
    """
    schema = StructType([*texts.schema.fields, StructField(name, ArrayType(DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for pdf in frames:
            codes, different = pd.factorize(pdf[text])  # -1 for nulls
            vectors: list = []
            for i in range(0, len(different), batch):
                part = different[i : i + batch]
                for _, v in zip(part, encode([prefix + t for t in part]), strict=True):
                    if len(v) != dims:
                        raise ValueError(f"the encoder gave {len(v)} dimensions, not {dims}")
                    vectors.append(np.asarray(v, dtype=np.float64))
            yield pdf.assign(**{name: [vectors[c] if c >= 0 else None for c in codes]})

    return texts.mapInPandas(run, schema)


def hash_embed(texts: DataFrame, text: str, dims: int = DIMS, name: str = "embedding", digest: str = "blake2b", prefix: str = "") -> DataFrame:
    """texts with hashing vectors, in one narrow pass."""
    return encode_batches(texts, text, lambda: lambda batch: hash_vectors(batch, dims, digest), dims, prefix, batch=1024, name=name)


def hash_counts(texts: DataFrame, text: str, dims: int = DIMS, name: str = "embedding", digest: str = "blake2b") -> DataFrame:
    """texts with hashing vectors as whole numbers, which take a fraction of the room; ``scaled_to_unit`` makes the vectors of ``hash_embed``. Null texts have null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for a in range(0, len(pdf), 1024):
                part = pdf.iloc[a : a + 1024]
                counts = hash_vectors([t if t is not None else "" for t in part[text]], dims, digest, unit=False)
                yield part.assign(**{name: [c if t is not None else None for c, t in zip(counts, part[text])]})

    return texts.mapInPandas(run, StructType([*texts.schema.fields, StructField(name, ArrayType(IntegerType()))]))


def stored_vectors(texts: DataFrame, text: str, path: str, model: str, make: Callable[[], Encoder], dims: int, prefix: str = "", batch: int = BATCH, name: str = "embedding") -> DataFrame:
    """texts with vectors from a table at ``path``, to which those of new texts are added first: no text is encoded twice by a model with a prefix.

    The table's key is the SHA-256 of the text within a folder for model and prefix. Keys alone are compared; of
    equal texts one is encoded. Null texts have null vectors. A run that fails adds nothing, and repeating it is safe:
    readers take one vector of a key.
    """
    spark = texts.sparkSession
    at = f"{path.rstrip('/')}/model={hashlib.sha256(f'{model}\n{prefix}\n{dims}'.encode()).hexdigest()[:16]}"
    keyed = texts.withColumn("_sha", F.sha2(text, 256))
    schema = StructType([StructField("_sha", StringType()), StructField("_vector", ArrayType(DoubleType()))])

    def known() -> DataFrame:
        return spark.read.schema(schema).parquet(at) if exists(spark, at) else spark.createDataFrame([], schema)

    new = keyed.where(F.col(text).isNotNull()).select("_sha", F.col(text).alias("_text")).join(known().select("_sha"), "_sha", "left_anti")
    # texts are sent once for each key; what is encoded is spread over the tasks
    new = new.groupBy("_sha").agg(F.first("_text").alias("_text"))
    encode_batches(new, "_text", make, dims, prefix, batch, "_vector").select("_sha", "_vector").write.mode("append").parquet(at)
    vectors = known().groupBy("_sha").agg(F.first("_vector").alias(name))
    return keyed.join(vectors, "_sha", "left").select(*texts.columns, name)


def stored_hash_embed(texts: DataFrame, text: str, path: str, dims: int = DIMS, name: str = "embedding", digest: str = "blake2b", prefix: str = "") -> DataFrame:
    """``hash_embed`` by way of ``stored_vectors``."""
    return stored_vectors(texts, text, path, f"hash-{digest}", lambda: lambda batch: hash_vectors(batch, dims, digest), dims, prefix, 1024, name)
