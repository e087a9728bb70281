"""Invertible sketches against plain sets of paragraph digests."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from folio.llm import fingerprint


def digests(text):
    number = lambda b: int(hashlib.md5(b).hexdigest()[:15], 16)
    held = Counter(number(p.encode()) for p in re.findall(r"[^\n]{1,80}", text or ""))
    return {d if n == 1 else number(f"{d}:{n}".encode()) for d, n in held.items()}


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edited_fingerprints_equal_plain_sets(spark):
    rnd = random.Random(3)
    line = lambda: " ".join(rnd.choice("a bc def ghij ß 世界 👍".split()) for _ in range(rnd.randint(1, 40)))
    texts = ["\n".join(line() for _ in range(rnd.choice([1, 3, 20, 60]))) for _ in range(60)]
    texts += ["", None, "x", "same\nsame\nsame\n", "\n\n", "y" * 300_000, "\n".join(f"line {i}" for i in range(20_000)), texts[0], texts[0]]
    rows = [(i * 3 - 9, t, "f", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, n_chars int").repartition(5)
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for k, (i, t, *_) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == likeness(digests(t), digests(edited)) and r.near_next == likeness(digests(t), digests(after))
    same = [r.fingerprint for r, (_, t, *_) in zip((got[i] for i, *_ in rows), rows) if t == texts[0]]
    assert len(same) == 3 and len(set(same)) == 1 and len({r.fingerprint for r in got.values()}) > 60
    assert len(got[rows[65][0]].fingerprint) < 1500  # however long the text


def test_null_and_repeated_ids(spark):
    rows = [(None, "n"), (1, "a\nb"), (1, "a\nb"), (1, "c"), (2, "d")]
    got = fingerprint.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 1), (1, 1), (1, 3), (1, 3), (2, 1)]
    assert len({r.edited_sha256 for r in got if r.n_chars == 3}) == 1
    one = fingerprint.edited_fingerprints(spark.createDataFrame([(5, "ab\ncd")], "doc_id long, text string")).first()
    assert (one.near_next, one.edited_sha256) == (1.0, hashlib.sha256(b"ab\nab").hexdigest())
    assert fingerprint.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_differing_paragraphs_are_recovered(spark):
    old = "\n".join(f"paragraph {i}" for i in range(500))
    pairs = [
        (1, old, old.replace("paragraph 7\n", "changed\n")), (2, old, old), (3, "a", None), (4, old, "\n".join(f"other {i}" for i in range(3000))),
        (None, "x\ny", "y\nz"), (None, "x\ny", "y\nz"), (6, "r\nr", "r"), (7, None, ""),
    ]
    df = spark.createDataFrame(pairs, "k long, a string, b string")
    found = {}
    for r in fingerprint.differing(df, "k", "a", "b").collect():
        assert (r.k, r.digest) not in found
        found[r.k, r.digest] = r.side
    want = {(k, d): 1 for k, a, b in pairs for d in digests(a) - digests(b)} | {(k, d): -1 for k, a, b in pairs for d in digests(b) - digests(a)}
    assert found == want


def test_peeling_is_native(spark):
    df = spark.createDataFrame([(i, f"text {i}\nmore") for i in range(30)], "doc_id long, text string")
    plan = fingerprint.edited_fingerprints(df.withColumn("text", F.concat("text", F.lit("!"))))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
