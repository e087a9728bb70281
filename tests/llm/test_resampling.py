"""Importance resampling against a plain computation."""

import hashlib
import math
import random
import re
import zlib

from folio.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def features(text, runs):
    w = WORD.findall((text or "").translate(FOLD))
    return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % 500 for k in range(1, runs + 1) for i in range(len(w) - k + 1)]


def plain(rows, target, runs):
    s, t = [0] * 500, [0] * 500
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for x in texts:
            for b in features(x, runs)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 500) / ((s[b] + 1) * (sum(t) + 500)))) for b in range(500)]
    out = []
    for i, x in rows:
        w, f = features(x, runs)
        h = int(hashlib.sha256(f"s:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    order = sorted((r for r in out if r[4] >= 3), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = [r[:4] for r in order[: 40 * len(order) // 100]]
    return sorted(r[:4] for r in out if r[0] is not None), drawn, sorted(map(str, (r[:4] for r in out)))


def test_resampling_equals_plain(spark):
    rnd = random.Random(1)
    words = ["Tor", "straße", "a1", "世界", "x" * 90, "y" * 64, "b", "C3", "d4"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n)) + rnd.choice(["", "!", "\n-"])
    rows = [(i, text(rnd.randint(0, 12))) for i in range(300)] + [(900, None), (901, ""), (None, text(9)), (902, " ".join(words) * 3000), (903, "q" * 100_000)]
    rows += [(5000, "tie tie tie")] * 40 + [(5001, "tie tie tie")] * 3
    target = [text(8) for _ in range(20)] + [None]
    docs = spark.createDataFrame([(i, x, 1) for i, x in rows], "doc_id long, text string, score int").repartition(7)
    bench = spark.createDataFrame([(x,) for x in target], "text string")
    for runs in (1, 3):
        got = resampling.resampled(docs, bench, runs, 500, "s", 40, 3).collect()
        _, drawn, every = plain(rows, target, runs)
        assert sorted(map(str, (tuple(r)[:4] for r in got))) == every
        assert [tuple(r)[:4] for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
        assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_many_equal_scores_are_split(spark, monkeypatch):
    # few samples and all keys alike: ranks must still be exact and no segment may hold all rows
    monkeypatch.setattr(resampling, "SAMPLES", 50)
    rows = spark.range(0, 4000, 1, 6).selectExpr("cast(7 as long) doc_id", "20L n_words", "20L n_features", "5L weight", "1L score")
    got = resampling.ranked(rows, percent=50)
    assert sorted(r["rank"] for r in got.where("rank is not null").collect()) == list(range(1, 2001))
    sizes = [r["count"] for r in got.where("rank is not null").groupBy(resampling.F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 2000


def test_empty_tables(spark):
    docs = spark.createDataFrame([(i, "a b c d") for i in range(10)], "doc_id long, text string")
    none = docs.limit(0)
    assert resampling.resampled(none, docs.select("text")).count() == 0
    got = resampling.resampled(docs, none.select("text"), least_words=1).collect()
    assert len(got) == 10 and sum(r["rank"] is not None for r in got) == 1
    assert all(r["rank"] is None for r in resampling.resampled(docs, none.select("text")).collect())
