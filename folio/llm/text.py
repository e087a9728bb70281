"""Vectorised words and hashes of whole Arrow text columns.

Texts are read as UTF-8 bytes. ASCII capitals are lower-cased by a byte table;
bytes of longer code points stay as they are. A word is a run of bytes of one
class. Each word gets a 64-bit hash from a prefix sum, so no Python object is
made for a word. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; one longer text is worked on alone.
SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_NOT_BLANK = np.ones(256, bool)
_NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False

_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x61:0x7B] = _ALNUM[0x80:] = True

#: Signs that end a piece of text: stops and line ends.
STOPS = np.zeros(256, bool)
STOPS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True

#: Word classes by name: runs without blanks; runs of digits, letters and all beyond ASCII; runs without spaces, tabs and stops.
CLASSES = {"not_blank": _NOT_BLANK, "alnum": _ALNUM, "within_piece": ~STOPS}
CLASSES["within_piece"][[0x09, 0x20]] = False

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's last step)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, SLICE_BYTES), base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them, from 0; nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, cut so that each part holds about ``limit`` bytes of text."""
    _, at = text_buffer(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(at, at[begin] + limit, "right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def with_columns(part: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with these columns put in the place of those of the same name."""
    return pa.RecordBatch.from_arrays([columns.get(c, part.column(c)) for c in part.schema.names], names=part.schema.names)


def _give_back() -> None:
    """Hand memory that Arrow and malloc keep for later use back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def tidied(scan: Callable) -> Callable:
    """The same function of record batches; when its batches are done, freed memory goes back to the system, as the worker lives on and takes tasks of other steps."""

    def run(batches):
        try:
            yield from scan(batches)
        finally:
            _give_back()

    return run


class Words:
    """Words of a text column.

    ``bounds[i]:bounds[i + 1]`` are the words of row i; ``start`` and ``end`` are
    byte positions in ``raw``, ``low`` its lower-cased form; ``hash`` is a 64-bit hash of each word's
    lower-cased bytes, the same in every process.
    """

    def __init__(self, column: pa.Array, kind: str = "not_blank"):
        self.raw, self.offsets = text_buffer(column)
        self.low = _LOWER[self.raw]
        inside = CLASSES[kind][self.low]
        n = len(self.low)
        first = np.zeros(n + 1, bool)
        first[self.offsets[:-1]] = True
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | first[:-1]))
        after = np.zeros(n, bool)
        if n:
            after[:-1] = inside[1:]
        first[n] = True
        self.end = np.flatnonzero(inside & (~after | first[1:])) + 1
        self.bounds = np.searchsorted(self.start, self.offsets)
        power, inverse = _power(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[self.low] * power[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * inverse[self.start])
        self._sums, self._inverse = sums, inverse

    def prefix_hash(self, length: int) -> np.ndarray:
        """Hashes of the words' first ``length`` bytes; of the whole word if it is shorter."""
        end = np.minimum(self.end, self.start + length)
        return mix((self._sums[end] - self._sums[self.start]) * self._inverse[self.start] + np.uint64(length))

    def suffix_hash(self, length: int) -> np.ndarray:
        """Hashes of the words' last ``length`` bytes; of the whole word if it is shorter."""
        start = np.maximum(self.start, self.end - length)
        return mix((self._sums[self.end] - self._sums[start]) * self._inverse[start] + np.uint64(length))

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def hash_of(word: str) -> np.uint64:
    """The hash that ``Words`` gives to this word."""
    return Words(pa.array([word])).hash[0]


_PLACES = mix(np.arange(101, 201, dtype=np.uint64)) | np.uint64(1)


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += hashes[k : k + n] * _PLACES[k % 100]
    return mix(out)


def shingles(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of a text's runs of ``size`` words, in order; of a shorter text the whole sequence as one; none without words."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    if len(hashes) < size:
        return mix(runs(hashes, len(hashes)) + np.uint64(len(hashes)))
    return runs(hashes, size)


_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x41:0x5B] = ord("A")
_SHAPE[0x61:0x7B] = ord("a")
_SHAPE[0x30:0x3A] = ord("0")
_SHAPE[0x80:] = ord("a")


def shapes(words: Words) -> np.ndarray:
    """A hash of each word's shape: small letters (and all beyond ASCII), capitals and digits as one sign each, runs of one sign as one."""
    sign = _SHAPE[words.raw]
    n = len(sign)
    fresh = np.ones(n, bool)
    fresh[1:] = sign[1:] != sign[:-1]
    fresh[words.start] = True
    place = np.zeros(n + 1, np.int64)
    np.cumsum(fresh, out=place[1:])
    power, inverse = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(np.where(fresh, _BYTE_VALUES[sign] * power[place[:-1]], np.uint64(0)), out=sums[1:])
    return mix((sums[words.end] - sums[words.start]) * inverse[place[words.start]])
