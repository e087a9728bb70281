"""Benchmark decontamination by SimHash windows.

A text's windows have the size classes of the benchmark items and start at
content-chosen words, so a copied passage and its item are cut alike. Each
window gets a 64-bit SimHash of its word pairs, weighted by how often they occur. Four
16-bit blocks index the items' fingerprints: a window within ``RADIUS`` bits of
an item has a block with at most RADIUS // 4 wrong bits, and a table lists the
items for each block value that near, so none within the radius is missed. Most block
values are near no item, so the table numbers the sets of items that there are.
Exact Jaccard similarity of five-word shingles, weighted by their counts, over a window of the item's own length then
decides.

An item's windows begin at all its content-chosen words and cover it to the end, and to where a match may
end that lacks as many words as the similarity allows, so that shortened passages have windows in common with it.
Fingerprints can still miss: edits that change more bits than the radius, or an item whose halves are swapped, as no
window of the text begins and ends like one of the item's. So each item's rarest shingles, as many as no match can lack, are looked up too,
and every window around a hit is compared exactly; without ``exact`` that is left out.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, written
from .text import Words, mix, runs, shingles, slices, tidied, with_columns

SHINGLE = 5
SIMILARITY = 0.75
#: Wrong bits up to which every fingerprint is found.
RADIUS = 11
BLOCKS, BLOCK_BITS = 4, 16
#: Of each run of so many word pairs, the one with the smallest hash may start a window.
SPAN = 7
#: Word pairs of the smallest window; of items that have no such window, one starts at every word.
SHORT = 6
#: Limits on what one pass over the texts holds in memory; a larger benchmark takes more passes.
ITEMS_PER_PASS = 1000
BYTES_PER_PASS = 64 << 20
#: Word pairs whose running sums are held at a time.
PAIRS_AT_ONCE = 1 << 16


def _classes(limit: int) -> list[int]:
    out, size = [], SHORT
    while size <= limit:
        out.append(size)
        size = max(size + 1, int(size * 1.25))
    return out


def _starts(pairs: np.ndarray) -> np.ndarray:
    """Positions that are the smallest of some run of SPAN word pairs."""
    n = len(pairs) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = np.lib.stride_tricks.sliding_window_view(pairs, SPAN)
    return np.unique(low.argmin(1) + np.arange(n))


#: Largest window whose counts fit one byte each.
_BYTE = 255


def _bits(pairs: np.ndarray) -> np.ndarray:
    return np.unpackbits(pairs.view(np.uint8).reshape(-1, 8), axis=1)


class _Counts:
    """How many of the hashes in a window have each bit set, from sums over all prefixes.

    Eight counts share a 64-bit sum. A window's counts fit one byte each, so the difference of two
    sums is exact although the sums themselves run over.
    """

    def __init__(self, pairs: np.ndarray):
        self.pairs = pairs
        lanes = _bits(pairs).view(np.uint64)
        self.sums = np.zeros((len(pairs) + 1, 8), np.uint64)
        np.cumsum(lanes, axis=0, out=self.sums[1:])
        self.wide = None

    def fingerprints(self, begin: np.ndarray, size: int) -> np.ndarray:
        """A bit is set where more than half of the window's hashes have it."""
        if size <= _BYTE:
            counts = (self.sums[begin + size] - self.sums[begin]).view(np.uint8)
        else:
            if self.wide is None:
                self.wide = np.zeros((len(self.pairs) + 1, 64), np.int32)
                np.cumsum(_bits(self.pairs), axis=0, dtype=np.int32, out=self.wide[1:])
            counts = self.wide[begin + size] - self.wide[begin]
        return np.packbits(counts > size // 2, axis=1).view(np.uint64).ravel()


_NEAR = np.array([x for x in range(1 << BLOCK_BITS) if bin(x).count("1") <= RADIUS // BLOCKS], np.uint16)


class _Rarest:
    """Items by their rarest shingles: each window at SIMILARITY holds at least one of them (prefix filter)."""

    BITS = 20

    def __init__(self, items: list[tuple[int, np.ndarray]], looked_up: bool = True):
        #: key, words, words of a shingle, distinct shingles and their counts
        self.items, self.words, self.tables = [], [], []
        for key, words in items:
            if len(words) >= 2:
                self.items.append((key, len(words), min(SHINGLE, len(words)), *np.unique(shingles(words, SHINGLE), return_counts=True)))
                self.words.append(words)
        if not looked_up:
            return
        held = Counter(g for *_, grams, _ in self.items for g in grams.tolist())
        found: dict[int, dict[int, list[int]]] = {}
        for i, (_, _, length, grams, counts) in enumerate(self.items):
            # a match shares 75 % of the item's shingles, so it lacks at most a quarter
            left = int(counts.sum()) - int(np.ceil(SIMILARITY * counts.sum()))
            for g, n in sorted(zip(grams.tolist(), counts.tolist()), key=lambda x: (held[x[0]], x[0])):
                found.setdefault(length, {}).setdefault(g, []).append(i)
                left -= n
                if left < 0:
                    break
        for length, by_gram in sorted(found.items()):
            grams = np.array(sorted(by_gram), np.uint64)
            maybe = np.zeros(1 << self.BITS, bool)
            maybe[grams >> np.uint64(64 - self.BITS)] = True
            self.tables.append((length, maybe, grams, [by_gram[g] for g in grams.tolist()]))

    def matches(self, words: Words):
        """(row, item, similarity, first word) of each item's first best window, at SIMILARITY or more."""
        bounds = words.bounds
        for length, maybe, grams, holders in self.tables:
            # as shingles() has them of a text of this length or more words
            own = runs(words.hash, length)
            own = own if length == SHINGLE else mix(own + np.uint64(length))
            at = np.flatnonzero(maybe[own >> np.uint64(64 - self.BITS)])
            place = np.minimum(np.searchsorted(grams, own[at]), len(grams) - 1)
            hit = grams[place] == own[at]
            at, place = at[hit], place[hit]
            row = np.searchsorted(bounds, at, "right") - 1
            whole = at + length <= bounds[row + 1]
            places: dict[tuple[int, int], list[int]] = {}
            for r, p, g in zip(row[whole].tolist(), at[whole].tolist(), place[whole].tolist()):
                for i in holders[g]:
                    places.setdefault((r, i), []).append(p - int(bounds[r]))
            for (r, i), hits in places.items():
                best = self.best(own[bounds[r] : bounds[r + 1] - length + 1], i, hits)
                if best[0] >= SIMILARITY:
                    yield r, self.items[i][0], *best

    def best(self, text: np.ndarray, i: int, hits: list[int]) -> tuple[float, int]:
        """The item's best window in a text's shingles among those that hold one of these places."""
        _, size, length, grams, counts = self.items[i]
        item, width = int(counts.sum()), min(len(text), size - length + 1)
        need = -(-3 * (width + item) // 7)  # shared shingles at similarity 3/4
        best, own = (0.0, 0), counts.tolist()
        for first, last in self._regions(hits, width, len(text)):
            # window s has shingles s to s + width
            part = text[first : last + width]
            at = np.minimum(np.searchsorted(grams, part), len(grams) - 1)
            ids = np.where(grams[at] == part, at, -1)
            sums = np.concatenate([[0], np.cumsum(ids >= 0)])
            enough = np.flatnonzero(sums[width:] - sums[:-width] >= need)
            if not len(enough):
                continue
            ids = ids.tolist()
            for stretch in np.split(enough, np.flatnonzero(np.diff(enough) > 1) + 1):
                begin, end = int(stretch[0]), int(stretch[-1])
                have, shared = [0] * len(own), 0
                for x in ids[begin : begin + width]:
                    if x >= 0:
                        shared += have[x] < own[x]
                        have[x] += 1
                for s in range(begin, end + 1):
                    value = shared / (width + item - shared)
                    if value > best[0]:
                        best = (value, first + s)
                    if s < end:
                        x, y = ids[s], ids[s + width]
                        if x >= 0:
                            have[x] -= 1
                            shared -= have[x] < own[x]
                        if y >= 0:
                            shared += have[y] < own[y]
                            have[y] += 1
        return best

    @staticmethod
    def _regions(hits: list[int], width: int, n: int):
        """First and last windows of each stretch of windows that hold a place, in order."""
        out: list[list[int]] = []
        for p in hits:
            first, last = max(0, p - width + 1), min(p, n - width)
            if out and first <= out[-1][1] + 1:
                out[-1][1] = max(out[-1][1], last)
            else:
                out.append([first, last])
        return out


def _windows(pairs: np.ndarray, lost: int) -> list[tuple[int, int, bool]]:
    """(first pair, pairs, whether texts are cut so at every word) of the windows of an item that are indexed.

    A match lacks up to ``lost`` words at the item's ends, so some windows keep that far from both. What begins a
    window is chosen by content from pairs that are then surely there, as texts choose theirs.
    """
    n, out = len(pairs), set()
    for a in _starts(pairs).tolist():
        out.update((a, size, False) for size in _classes(n - a)[-1:] if 2 * size > n - 2 * lost)
    inner, safe = pairs[lost : n - lost], False
    for a in (_starts(inner) + lost).tolist():
        for size in _classes(n - lost - a)[-1:]:
            if 2 * size > n - 2 * lost:
                out.add((a, size, False))
                safe = True
    if not safe:
        size = max(1, n - 2 * lost)
        size = _classes(size)[-1] if size >= SHORT else size
        out.update((a, size, True) for a in range(0, n - size + 1, max(1, (n - size) // 4)))
    return sorted(out)


class _Index:
    """Fingerprints of the items by window length, in groups of 64, with a table for each block."""

    def __init__(self, items: list[tuple[int, str]], exact: bool = True):
        entries: dict[tuple[int, bool], list[tuple[np.uint64, int, int]]] = {}
        hashed = [(key, Words(pa.array([text], pa.string()), "alnum").hash) for key, text in items]
        self.rarest = _Rarest(hashed, exact)
        for number, (_, size, length, _, shared) in enumerate(self.rarest.items):
            pairs = runs(self.rarest.words[number], 2)
            lost = min(int((1 - SIMILARITY) * shared.sum()), (size - length) // 2)
            counts = _Counts(pairs)
            for a, width, everywhere in _windows(pairs, lost):
                entries.setdefault((width, everywhere), []).append((counts.fingerprints(np.array([a]), width)[0], number, a))
        self.groups = []
        for (size, everywhere), found in sorted(entries.items()):
            for i in range(0, len(found), 64):
                part = found[i : i + 64]
                prints = np.array([p for p, _, _ in part], np.uint64)
                blocks = prints.view(np.uint16).reshape(-1, BLOCKS)
                tables = [self._table(blocks[:, k]) for k in range(BLOCKS)]
                self.groups.append((size, everywhere, prints, tables, [k for _, k, _ in part], np.array([a for _, _, a in part])))

    @staticmethod
    def _table(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each value of a block the place of its set of items, a bit each, among the distinct sets: at most 64 * len(_NEAR) and the empty one, so 16 bits do."""
        held = np.zeros(1 << BLOCK_BITS, np.uint64)
        for j, value in enumerate(values):
            held[value ^ _NEAR] |= np.uint64(1) << np.uint64(j)
        some = np.flatnonzero(held)
        sets, place = np.unique(held[some], return_inverse=True)
        at = np.zeros(1 << BLOCK_BITS, np.uint16)
        at[some] = place + 1
        return at, np.concatenate([np.zeros(1, np.uint64), sets])

    def near(self, words: Words):
        """(row, item, word at which the item would start), each within the radius."""
        bounds = words.bounds
        rows = np.arange(len(bounds) - 1)
        for lo, hi in self._stretches(bounds):
            first, last = bounds[lo], bounds[hi]
            pairs = runs(words.hash[first:last], 2)
            if not len(pairs):
                continue
            row = np.repeat(rows[lo:hi], np.diff(bounds[lo : hi + 1]))[:-1]
            stop = bounds[row + 1] - 1 - first  # pairs of a row end here
            at = np.arange(len(pairs))
            inside = at < stop
            starts = _starts(pairs) if hi == lo + 1 else np.unique(np.concatenate([_starts(pairs[max(0, b - first) : max(0, e - 1 - first)]) + (b - first) for b, e in zip(bounds[lo:hi], bounds[lo + 1 : hi + 1])]))
            starts = starts[inside[starts]]
            for c in range(0, len(pairs), PAIRS_AT_ONCE):
                upto = min(len(pairs), c + PAIRS_AT_ONCE + max((g[0] for g in self.groups), default=0))
                counts = _Counts(pairs[c:upto])
                prints_of = {}
                for size, everywhere, prints, tables, keys, offsets in self.groups:
                    if (size, everywhere) not in prints_of:
                        p = at[inside] if everywhere else starts
                        p = p[(p >= c) & (p < c + PAIRS_AT_ONCE)]
                        p = p[p + size <= stop[p]]
                        found = counts.fingerprints(p - c, size)
                        prints_of[size, everywhere] = p, found, found.view(np.uint16).reshape(-1, BLOCKS).T.astype(np.intp)
                    p, found, block = prints_of[size, everywhere]
                    if not len(p):
                        continue
                    mask = np.zeros(len(p), np.uint64)
                    for (at_set, sets), values in zip(tables, block):
                        mask |= sets.take(at_set.take(values))
                    some = np.flatnonzero(mask)
                    mask = mask[some]
                    while len(some):
                        # each window's lowest item, then the next
                        which = np.bitwise_count((mask & -mask) - np.uint64(1))
                        close = np.flatnonzero(np.bitwise_count(found[some] ^ prints[which]) <= RADIUS)
                        for i, j in zip(some[close].tolist(), which[close].tolist()):
                            r = int(row[p[i]])
                            yield r, keys[j], int(p[i] + first - bounds[r] - offsets[j])
                        mask &= mask - np.uint64(1)
                        left = np.flatnonzero(mask)
                        some, mask = some[left], mask[left]

    @staticmethod
    def _stretches(bounds):
        """Runs of rows with about PAIRS_AT_ONCE words."""
        lo = 0
        while lo < len(bounds) - 1:
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + PAIRS_AT_ONCE, "right")) - 1)
            yield lo, hi
            lo = hi

    def verified(self, words: Words) -> dict[int, dict[int, tuple[float, int]]]:
        """row -> item -> (similarity, first word) of its best window at SIMILARITY or more."""
        places: dict[tuple[int, int], set[int]] = {}
        for r, number, begin in self.near(words):
            places.setdefault((r, number), set()).add(begin)
        grams: dict[tuple[int, int], np.ndarray] = {}
        out: dict[int, dict[int, tuple[float, int]]] = {}

        def put(r: int, key: int, value: float, s: int) -> None:
            best = out.get(r, {}).get(key, (0.0, 0))
            if value >= SIMILARITY and (value, -s) > (best[0], -best[1]):
                out.setdefault(r, {})[key] = (value, s)

        for (r, number), begins in sorted(places.items()):
            key, size, length, _, _ = self.rarest.items[number]
            if (r, length) not in grams:
                grams[r, length] = shingles(words.hash[words.bounds[r] : words.bounds[r + 1]], length)
            own = grams[r, length]
            if len(words.hash[words.bounds[r] : words.bounds[r + 1]]) >= length:
                # all windows that hold the middle of where the item would stand
                middle = sorted({min(max(0, b + (size - length) // 2), len(own) - 1) for b in begins})
                put(r, key, *self.rarest.best(own, number, middle))
        for r, key, value, s in self.rarest.matches(words):
            put(r, key, value, s)
        return out


_FOUND = ("item_ids", "similarities", "first_words")
_KINDS = ("array<long>", "array<double>", "array<long>")
_ARROW = (pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int64()))


def _pass(items: list[tuple[int, str]], text_col: str, names: list[str], exact: bool):
    def scan(batches):
        index = _Index(items, exact)
        for batch in batches:
            for part in slices(batch, text_col):
                columns = [part.column(c).to_pylist() for c in names]
                for r, matches in index.verified(Words(part.column(text_col), "alnum")).items():
                    for key in sorted(matches):
                        for column, x in zip(columns, (key, *matches[key])):
                            column[r] = [*column[r], x]
                yield with_columns(part, {c: pa.array(x, kind) for c, x, kind in zip(names, columns, _ARROW)})

    return scan


def with_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", prefix: str = "", item_col: str = "item_id", item_text: str = "text", exact: bool = True) -> DataFrame:
    """docs, whose columns must differ from these, with item_ids, similarities and first_words, each after ``prefix``: narrow passes only, each written before the next."""
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null").distinct()
    count, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(-(-count // ITEMS_PER_PASS), -(-size // BYTES_PER_PASS), 1)
    names = [prefix + c for c in _FOUND]
    out = docs.select("*", *(F.expr(f"cast(array() as {kind})").alias(c) for c, kind in zip(names, _KINDS)))
    for k in range(passes if count else 0):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        # written, as workers of passes in one task would hold all their indexes at once
        out = (written(out) if k else out).mapInArrow(tidied(_pass(sorted((r.item_id, r.text) for r in part.collect()), text_col, names, exact)), out.schema)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", exact: bool = True) -> DataFrame:
    """(doc_id, n_items, item_ids, similarities, first_words, best_similarity, contaminated), a row for each row of docs.

    An item matches where a window of its length (the whole text, if shorter) has
    weighted five-word shingle similarity of SIMILARITY or more; its best window is reported,
    of equal ones the first. With ``exact`` none is missed; without it, those that fingerprints find. Words are runs of ASCII letters, digits and anything
    beyond ASCII, lower-cased (A-Z). Null and empty texts and an empty benchmark match nothing; items that are null or
    have fewer than two words never match; items of one item_id and text count once. Null
    doc_ids stay null, repeated rows give repeated results, further columns are ignored. The
    benchmark is sent to the executors in parts of bounded size, one pass of narrow work for each.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = with_matches(docs, benchmark, item_col=item_col, item_text=item_text, exact=exact)
    return out.select(
        "doc_id", F.size("item_ids").cast("long").alias("n_items"), "item_ids", "similarities", "first_words",
        F.coalesce(F.array_max("similarities"), F.lit(0.0)).alias("best_similarity"), (F.size("item_ids") > 0).alias("contaminated"),
    )
