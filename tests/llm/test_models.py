"""Quality, toxicity and the language model: held-out accuracy on small made texts, contracts, edge rows."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from folio.llm import lm
from folio.llm import quality as quality_module
from folio.llm import toxicity as toxicity_module
from folio.llm.quality import quality
from folio.llm.text import Words
from folio.llm.toxicity import toxicity

SCHEMA = "doc_id long, text string, score double, y string, uid long"
EDGE = [None, "", " \n\t", "!!!", "word", "w " * 30_000]


def frame(spark, texts):
    rows = [(i, t, 0.5, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, texts[0], 0.5, "clash", 1), rows[0]], SCHEMA)


def labels(spark, column, values):
    rows = [(i, v) for i, v in enumerate(values)] + [(None, 1), (5, None), (10**9, 0)]
    return spark.createDataFrame(rows, f"doc_id long, {column} int")


def remainder(i, folds):
    return zlib.crc32(str(i).encode()) % folds


def test_quality_held_out(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8)))
    good = lambda: " ".join(word() for _ in range(60)) + "."
    bad = lambda: " ".join(word().upper() + "!!" for _ in range(60))
    y = [i % 3 != 0 for i in range(240)]
    texts = [good() if v else bad() for v in y] + EDGE
    rows = quality(frame(spark, texts), labels(spark, "quality", [int(v) for v in y])).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (r.doc_id is not None and remainder(r.doc_id, 3) == 1)
    held = [r for r in rows if r.held_out and r.doc_id < 240]
    assert sum(r.predicted == y[r.doc_id] for r in held) >= 0.98 * len(held)
    assert quality(frame(spark, texts).limit(0), labels(spark, "quality", [1])).count() == 0
    assert {r.score for r in quality(frame(spark, texts), labels(spark, "quality", [])).collect()} == {0.5}


def test_toxicity_held_out_and_places(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6)))
    sentence = lambda: " ".join(word() for _ in range(8)) + "."
    y = [i % 4 == 0 for i in range(240)]
    texts = []
    for v in y:
        s = [sentence() for _ in range(8)]
        if v:
            s[rnd.randrange(8)] = f"{word()} {rnd.choice(['zurk', 'zurkling', 'quux'])} {word()}."
        texts.append(" ".join(s))
    texts += EDGE
    rows = toxicity(frame(spark, texts), labels(spark, "toxic", [int(v) for v in y])).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (r.doc_id is not None and remainder(r.doc_id, 4) == 2)
        for s in r.offending:
            assert texts[r.doc_id or 0][s.begin : s.end] == s.sentence
    held = [r for r in rows if r.held_out and r.doc_id < 240]
    assert sum(r.predicted == y[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(any(w in s.sentence for w in ("zurk", "quux")) for r in held if y[r.doc_id] for s in r.offending)
    assert toxicity(frame(spark, texts).limit(0), labels(spark, "toxic", [1])).count() == 0


def test_votes_by_brute_force():
    rnd = random.Random(7)
    # copies under several ids and labels: equally near
    kinds = ["".join(rnd.choice("aA0.") for _ in range(rnd.randint(1, 6))) for _ in range(12)]
    texts = [" ".join(rnd.choices(kinds, k=rnd.randint(1, 5))) for _ in range(40)] * 3
    y = np.array([rnd.random() < 0.5 for _ in texts], np.int64)
    model = quality_module.Model(quality_module.term_counts(pa.array(texts)), y)
    asked = quality_module.term_counts(pa.array([*texts[:25], "", "Aa0 zz", "0" * 500]))
    want = []
    for z in model.vectors(asked):
        near = sorted((-round(float(z @ x), 9), i) for i, x in enumerate(model.latent))[: quality_module.NEIGHBOURS]
        weights = [max(-s, 0) ** 4 for s, _ in near]
        want.append(sum(w * y[i] for w, (_, i) in zip(weights, near)) / sum(weights) if sum(weights) > 1e-12 else 0.5)
    assert np.allclose(model.score(asked), want, atol=1e-6)
    assert np.allclose(np.concatenate([model.score(asked[i : i + 1]) for i in range(len(asked))]), want, atol=1e-6)


def test_noisy_or_by_brute_force(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6)))
    texts = [" ".join(f"{word()} {rnd.choice(['zurkel', 'quuxen']) if i % 3 == 0 else word()} {word()}." for _ in range(rnd.randint(1, 6))) for i in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)], "doc_id long, toxic int")
    model = toxicity_module.fit(docs, marks)
    weights = dict(zip(model.hashes.tolist(), model.weights.tolist()))
    assert len(weights) > 3
    for r in toxicity(docs, marks).collect():
        none = 1.0
        for s in re.split(r"(?<=[.!?\n])", texts[r.doc_id]):
            own = set()
            for w in re.findall("[a-z0-9]+", s):
                own |= {int(h) for h in toxicity_module.features(Words(pa.array([w]), "alnum"))[0]}
            if own:
                none *= 1 - 1 / (1 + math.exp(-(model.bias + sum(weights.get(h, 0.0) for h in own))))
        assert math.isclose(r.score, 1 - none, abs_tol=1e-9)


def test_long_labelled_texts_are_not_collected(spark):
    texts = ["zurk x. " * 5 if i % 2 else "fine x. " * 5 for i in range(60)] + ["fine zurk. " * 30_000] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(62)], "doc_id long, toxic int")
    rows = {r.doc_id: r.score for r in toxicity(docs, marks).collect()}
    assert all((rows[i] >= 0.3) == bool(i % 2) for i in range(60)) and rows[60] == rows[61]


def test_language_model_counts_and_probabilities(spark, monkeypatch):
    monkeypatch.setattr(lm, "SENT", 30)
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 40))) for _ in range(150)] + EDGE
    frame_rows = frame(spark, texts)
    rows = lm.language_model(frame_rows).collect()
    split = lambda t: [*(t or "").encode().lower().split(), None]
    given = [(r.doc_id, r.text) for r in frame_rows.collect()]
    c = Counter(w for i, t in given if i is None or remainder(i, 7) != 2 for w in split(t))
    n, v = sum(c.values()), len(c)
    for r in rows:
        tokens = split(texts[r.doc_id or 0])
        want = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(c[w] > 0 for w in tokens), n)
        assert math.isclose(r.base_score, want, rel_tol=1e-9) and r.score < 0
        assert r.held_out == (r.doc_id is not None and remainder(r.doc_id, 7) == 2)
    assert lm.language_model(frame_rows.limit(0)).count() == 0


def _vocabulary(texts):
    tokens, ending, _ = lm._tokens(pa.array(texts))
    words, first, n = np.unique(tokens, return_index=True, return_counts=True)
    groups, width = lm.classes_of(len(words))
    by_ending = np.zeros((groups * width - groups * width // 4, 2), np.int64)
    for e, k in zip(ending[first] % len(by_ending), n):
        by_ending[e] += k, 1
    return lm.Vocabulary(words, ending[first], n, int(n.sum()), len(words), by_ending)


def test_language_model_learns_and_is_normalised():
    rnd = random.Random(5)
    words = [f"{x}{i}" for i, x in enumerate(rnd.choices(["ment", "ung", "tion", "a"], k=300))]
    texts = []
    for _ in range(600):
        at, text = rnd.randrange(300), []
        for _ in range(60):
            at = (at + 1) % 300 if rnd.random() < 0.8 else rnd.randrange(300)
            text.append(words[at])
        texts.append(" ".join(text))
    v = _vocabulary(texts)
    trainer = lm.Trainer(v, 1)
    tokens, ending, bounds = lm._tokens(pa.array(texts))
    cls, n, near = v.find(tokens, ending)
    one, two = lm._histories(near, bounds, v)
    for _ in range(3):
        for i in range(0, len(cls), 512):
            trainer.step(one[i : i + 512], two[i : i + 512], cls[i : i + 512])
    model = lm.Model(trainer.p, v)
    size = v.groups * v.width
    for k in (0, 100, 2000):
        every = 10 ** model.log10(np.full(size, one[k]), np.full(size, two[k]), np.arange(size))
        assert abs(every.sum() - 1) < 1e-5
    # words of a class, and one that nobody knows, share its mass
    assert abs(v.mass.sum() - (v.total + v.distinct + size - v.own)) < 1
    gain = model.log10(one, two, cls) + np.log10(n + 1.0) - np.log10(v.mass[cls]) - np.log10((n + 1.0) / (v.total + v.distinct + 1))
    assert gain.mean() > 0.8, gain.mean()


def test_score_by_plain_numpy(spark, monkeypatch):
    monkeypatch.setattr(lm, "SENT", 60)
    monkeypatch.setattr(lm, "REPLICA_TOKENS", 300)  # several replicas, averaged in several steps
    monkeypatch.setattr(lm, "FAN_IN", 2)
    fitted = []
    fit = lm.fit
    monkeypatch.setattr(lm, "fit", lambda training: fitted.append(fit(training)) or fitted[-1])
    rnd = random.Random(6)
    words = [f"w{i}ung" if i % 3 else f"W{i}" for i in range(150)]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 40))) for _ in range(120)] + EDGE
    rows = {r.doc_id: r for r in lm.language_model(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()}
    (_, model), v = fitted[0], fitted[0][1].v
    split = lambda t: [*(t or "").encode().lower().split(), b"\x00end"]
    c = Counter(w for i, t in enumerate(texts) if remainder(i, 7) != 2 for w in split(t))
    weight, group_out, group_bias, class_out, bias = (x.astype(float) for x in model.parts)
    near = model.near.astype(float)
    for i in (*range(0, 120, 7), *range(120, 125)):
        tokens, ending, bounds = lm._tokens(pa.array([texts[i]]))
        cls, _, contexts = v.find(tokens, ending)
        past, want = [v.contexts - 1, v.contexts - 1], 0.0
        for w, k, x in zip(split(texts[i]), cls.tolist(), contexts.tolist()):
            query = near[past[-1]] * weight[0] + near[past[-2]] * weight[1]
            groups = np.exp(group_out @ query + group_bias)
            g = k // v.width
            within = np.exp(class_out[g * v.width : (g + 1) * v.width] @ query + bias[g * v.width : (g + 1) * v.width])
            want += math.log10(groups[g] / groups.sum() * within[k % v.width] / within.sum() * (c[w] + 1) / v.mass[k])
            past.append(x)
        assert math.isclose(rows[i].score, want, rel_tol=1e-4, abs_tol=1e-3), (i, rows[i].score, want)


def test_gain_over_the_base_on_held_out_texts(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables here")
    rows = lm.language_model(spark.read.parquet(path)).where("held_out").select("n_tokens", "base_score", "score").collect()
    gain = sum(r.score - r.base_score for r in rows) / sum(r.n_tokens for r in rows)
    assert gain >= 0.25, gain
