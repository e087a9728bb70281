"""Collocations against plain counts."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np

from folio.llm import collocations

FOLD = {i: i + 32 for i in range(65, 91)}


def plain(rows, support, longest, absorb, top):
    out = []
    for lang in {x or "und" for x, _ in rows}:
        f, n = Counter(), 0
        for x, text in rows:
            if (x or "und") == lang:
                for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
                    w = re.findall(r"[^\x20\x09]+", piece)
                    n += len(w)
                    f.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
        found = {p: a for p, a in f.items() if a >= support and len(p) > 1}
        held = {}
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    held[p[i : i + k]] = max(held.get(p[i : i + k], 0), a)
        scored = []
        for p, a in found.items():
            if 100 * held.get(p, -1) < absorb * a:
                score, k = min((int(Fraction(1000 * a * n, f[p[:k]] * f[p[k:]])), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]], n))
        out += [(lang, r + 1, p.decode(), -a, l, x, n, -s) for r, (s, a, p, l, x, n) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def test_collocations_equal_plain_counts(spark, monkeypatch):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(30)] + ["New", "york", "É", "世"]
    def text():
        out = []
        for _ in range(rnd.randint(0, 60)):
            out += [rnd.choice(["new york city hall", "New York"])] if rnd.random() < 0.1 else [rnd.choices(words, [1 / (i + 1) for i in range(len(words))])[0]]
            out += [rnd.choice(["", ",", ".", "\n", "\t", "!?"])] if rnd.random() < 0.2 else []
        return rnd.choice([" ", "  ", " \t"]).join(out)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), text()) for _ in range(400)] + [("a", None), ("b", ""), ("c", "lonely words"), ("d", "z " * 5000), ("e", "." * 100), ("a", "q" * 70_000)]
    rows += [("b", "copy of the same text, again")] * 150
    docs = spark.createDataFrame([(x, t, "p") for x, t in rows], "lang string, text string, phrase string").repartition(6)
    want = plain(rows, 20, 5, 100, 25)
    assert len(want) > 60
    got = lambda: sorted(map(tuple, collocations.collocations(docs, 20, 5, 100, 25).collect()))
    assert got() == want
    # small parts, few languages listed, and bit tables so full that they let nearly all through change nothing
    monkeypatch.setattr(collocations, "PART_BYTES", 500)
    monkeypatch.setattr(collocations, "PART_HASHES", 300)
    monkeypatch.setattr(collocations, "LANGS", 1)
    monkeypatch.setattr(collocations, "_bits", lambda found, n: np.full(1 << 10, 255, np.uint8))
    assert got() == want
    assert sorted(map(tuple, collocations.collocations(docs, 20, 3, 60, 25).collect())) == plain(rows, 20, 3, 60, 25)


def test_no_collocations(spark):
    docs = spark.createDataFrame([("a", "one two"), (None, None)], "lang string, text string")
    assert collocations.collocations(docs).count() == 0 and collocations.collocations(docs.limit(0)).count() == 0


def test_shards_miss_nothing_at_the_support(spark):
    # the rarest phrase that counts, spread as thinly as can be, and one a time too rare
    rows = [("a", f"pad{i} pad{i}x just enough pad{i}y") for i in range(100)] + [("a", f"fill{i} one short fill{i}z") for i in range(99)]
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(5)).collect()
    assert [(r.phrase, r.a, r.l, r.r) for r in got] == [("just enough", 100, 100, 100)]
