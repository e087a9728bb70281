"""Licence notices: exact phrases, and short notices with a bounded number of errors.

A text is normalised to its words, one blank apart. A notice that may hold k
errors is split into k + 1 pieces, so any place within k errors holds one piece
unchanged (pigeonhole): exact search for the pieces gives candidate windows, and
the regex library's fuzzy matching verifies each, counts the edits and gives the span.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Words, hash_of, slices

#: Phrases whose words must stand consecutively.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: Short notices that may hold errors: label, notice, words that must stand unchanged in their places.
NOTICES = (
    ("mit", "under the mit license", ("mit",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ()),
    ("apache-2", "apache license version 2", ("2",)),
    ("bsd", "redistribution and use in source and binary forms", ()),
    ("gpl-2", "gnu general public license version 2", ("2",)),
    ("gpl-3", "gnu general public license version 3", ("3",)),
    ("lgpl", "gnu lesser general public license", ("lesser",)),
    ("agpl", "gnu affero general public license", ("affero",)),
    ("mpl-2", "mozilla public license version 2", ("2",)),
    ("epl", "eclipse public license", ()),
    ("cc-by-nc", "licensed under cc by nc", ("cc", "by", "nc")),
    ("cc-by-sa", "licensed under cc by sa", ("cc", "by", "sa")),
    ("cc-by-nd", "licensed under cc by nd", ("cc", "by", "nd")),
    ("cc-by", "creative commons attribution", ()),
    ("public-domain", "released into the public domain", ()),
    ("unlicense", "this is free and unencumbered software", ()),
)

#: One error is allowed for so many signs of a notice.
SIGNS_PER_ERROR = 9


def errors_allowed(notice: str) -> int:
    return len(notice) // SIGNS_PER_ERROR


@lru_cache(maxsize=8)
def _compiled(notices: tuple = NOTICES):
    """(label, notice, errors, pieces with their places, fuzzy pattern) of each notice."""
    out = []
    for label, notice, kept in notices:
        k = errors_allowed(notice)
        cuts = [round(i * len(notice) / (k + 1)) for i in range(k + 2)]
        pieces = [(a, notice[a:b].encode()) for a, b in zip(cuts[:-1], cuts[1:])]
        # kept words as they are, each stretch between them with errors; their sum is checked on the match
        parts = re.split(rf"((?<!\S)(?:{'|'.join(kept)})(?!\S))", notice) if kept else [notice]
        form = "".join(rf"(?<!\S){x}(?!\S)" if x in kept else rf"(?:{regex.escape(x, literal_spaces=True)}){{e<={k}}}" for x in parts if x)
        out.append((label, notice, k, pieces, regex.compile(rf"(?b)(?<!\S){form}(?!\S)")))
    return out


@lru_cache(maxsize=8)
def _seeds(notices: tuple = NOTICES):
    """All pieces, each once."""
    pieces = sorted({p for *_, ps, _ in _compiled(notices) for _, p in ps}, key=lambda p: (-len(p), p))
    return pieces


def normalised(words: Words) -> tuple[bytes, np.ndarray]:
    """All words, one blank apart and a new line after the last word of a text, and where each begins."""
    length = words.end - words.start
    stop = np.cumsum(length + 1)
    out = np.zeros(int(stop[-1]) if len(stop) else 0, np.uint8)
    is_sign = np.ones(len(out), bool)
    is_sign[stop - 1] = False
    reach = np.zeros(len(words.low) + 1, np.int64)
    np.add.at(reach, words.start, 1)
    np.add.at(reach, words.end, -1)
    out[is_sign] = words.low[np.cumsum(reach[:-1]) > 0]
    out[stop - 1] = 32
    last = words.bounds[1:][np.diff(words.bounds) > 0] - 1
    out[stop[last] - 1] = 10
    return out.tobytes(), stop - length - 1


def base_places(words: Words) -> list[tuple[int, str]]:
    """(word, label) of every place of a base phrase."""
    row, found = words.row(), []
    for label, phrase in BASE:
        parts = [hash_of(w) for w in phrase.split()]
        n = len(words.hash) - len(parts) + 1
        if n <= 0:
            continue
        here = row[:n] == row[len(parts) - 1 :]
        for k, h in enumerate(parts):
            here &= words.hash[k : k + n] == h
        found += [(int(i), label) for i in np.flatnonzero(here)]
    return found


def _all_matches(fuzzy, k: int, text: str):
    """Matches with at most k errors, none over another. A search gives the best match of a stretch, so what stands before it and after it is searched again."""
    left = [(0, len(text))]
    while left:
        begin, end = left.pop()
        m = fuzzy.search(text, begin, end)
        if m and sum(m.fuzzy_counts) <= k:
            yield m
            left += [(a, b) for a, b in ((begin, m.start() - 1), (m.end() + 1, end)) if a < b]


def fuzzy_places(text: bytes, notices: tuple = NOTICES) -> list[tuple[str, int, int, int, int]]:
    """(label, begin, end, edits, length of the notice) of notices in normalised text, positions in bytes."""
    seen: dict[bytes, list[int]] = {}
    for piece in _seeds(notices):
        at, i = [], text.find(piece)
        while i >= 0:
            at.append(i)
            i = text.find(piece, i + 1)
        if at:
            seen[piece] = at
    out = []
    for label, notice, k, pieces, fuzzy in _compiled(notices):
        windows = sorted({max(0, i - a - 4 * k) for a, p in pieces for i in seen.get(p, ())})
        reach = len(notice) + 9 * k  # an edit may be a sign of up to four bytes
        merged: list[list[int]] = []
        for b in windows:
            if merged and b <= merged[-1][1]:
                merged[-1][1] = b + reach
            else:
                merged.append([b, b + reach])
        for b, e in merged:
            # whole words, of one text at a time
            b = text.rfind(b" ", 0, b) + 1 if b else 0
            e = len(text) if (z := text.find(b" ", e)) < 0 else z
            for line in re.finditer(rb"[^\n]+", text[b:e]):
                piece = line.group().decode("utf-8", "replace")
                for m in _all_matches(fuzzy, k, piece):
                    begin = b + line.start() + len(piece[: m.start()].encode())
                    out.append((label, begin, begin + len(m.group().encode()), sum(m.fuzzy_counts), len(notice)))
    return sorted(set(out))


_MATCH = pa.list_(pa.struct([("label", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("text", pa.string())]))
_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "matches array<struct<label:string,begin:long,end:long,edits:int,text:string>>"
)


def _scanner(notices: tuple):
    return lambda batches: _scan(batches, notices)


def _scan(batches, notices: tuple):
    for batch in batches:
        for part in slices(batch):
            words = Words(part.column("text"), "alnum")
            n = part.num_rows
            bounds = words.bounds
            base: list[list] = [[] for _ in range(n)]
            matches: list[list] = [[] for _ in range(n)]
            score = [0.0] * n
            for word, label in base_places(words):
                r = int(np.searchsorted(bounds, word, "right")) - 1
                base[r].append((word - int(bounds[r]), label))
                score[r] = 1.0
            text, begins = normalised(words)
            for label, b, e, edits, length in fuzzy_places(text, notices):
                first = int(np.searchsorted(begins, b, "right")) - 1
                last = int(np.searchsorted(begins, e - 1, "right")) - 1
                r = int(np.searchsorted(bounds, first, "right")) - 1
                a, z, at = int(words.start[first]), int(words.end[last]), int(words.offsets[r])
                begin = len(bytes(words.raw[at:a]).decode("utf-8", "replace"))
                found = bytes(words.raw[a:z]).decode("utf-8", "replace")
                matches[r].append({"label": label, "begin": begin, "end": begin + len(found), "edits": edits, "text": found})
                score[r] = max(score[r], 1 - edits / length)
            join = lambda labels: ",".join(sorted(set(labels)))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.diff(bounds).astype(np.int64)),
                    pa.array([len(x) for x in base], pa.int64()),
                    pa.array([min(x)[0] if x else None for x in base], pa.int64()),
                    pa.array([max(x)[0] if x else None for x in base], pa.int64()),
                    pa.array([join(k for _, k in x) for x in base]),
                    pa.array([join([k for _, k in x] + [m["label"] for m in y]) for x, y in zip(base, matches)]),
                    pa.array(score),
                    pa.array(matches, _MATCH),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"],
            )


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple = NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches), one row for each row of docs.

    ``notices`` has (label, notice, words that must stand unchanged) of what is sought with errors: small letters and digits, words one blank apart. ``matches`` lists label, begin, end (code points of the text), edits and text of
    the notices found within their errors. score: 1 with a base phrase, else the best
    match's 1 - edits / length, else 0. Null and empty texts have no words and no
    labels. Null doc_ids stay null, repeated rows give repeated results, further columns are ignored, an empty
    table gives no rows.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scanner(notices), _SCHEMA)
