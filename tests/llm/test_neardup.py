import random
from collections import Counter

from folio.llm import neardup

SCHEMA = "doc_id long, text string, cls long, n string"


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for x, (i, a) in enumerate(sets):
        for y, (j, b) in enumerate(sets[:x]):
            if a and b and i is not None and j is not None and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return Counter((i, len(a), None if i is None else least[find(x)]) for x, (i, a) in enumerate(sets))


def rows():
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([6, 30, 150]))]
        for _ in range(rnd.randint(1, 22)):
            copy = [rnd.choice(vocabulary) if rnd.random() < rnd.choice([0, 0.01, 0.025, 0.05]) else w for w in base]
            out.append(" ".join(copy[rnd.randint(0, 2) :]))
    out += ["", None, "  \n", "one", "One", "a b c", "A  b\tc", "a b c d", out[0], out[0].upper(), "x y z u v " * 400]
    ids = list(range(100, 100 + len(out)))
    rnd.shuffle(ids)
    made = list(zip(ids, out))
    return [*made, (None, out[0]), made[5], made[5]]


def test_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "SET_BLOCK", 300)
    monkeypatch.setattr(neardup, "TRIED", 2)
    monkeypatch.setattr(neardup, "CENTRES", 1)
    made = rows()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in made], SCHEMA)
    got = neardup.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(made)
    assert all(r.kept == (r.doc_id == r.component_id) if r.doc_id is not None else r.kept is None for r in got)


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_estimate_is_near_and_corrected():
    import numpy as np

    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 900, dtype=np.uint64)
        a, b = pool[:700], pool[200:]
        ra, rb = neardup.registers(a), neardup.registers(b)
        errors.append(neardup.estimate(ra[None], rb[None], np.array([700]), np.array([700]))[0] - 500 / 900)
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < 0.07


def test_hot_keys_change_nothing(spark, monkeypatch):
    rnd = random.Random(21)
    base = [f"w{rnd.randrange(500)}" for _ in range(60)]
    texts = [" ".join(base)] * 30 + [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(0, 60, 3)] + ["", None, "one two"] * 5
    texts += [" ".join(base[:30] + [f"y{rnd.randrange(900)}" for _ in range(30)]) for _ in range(30)]
    docs = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    shown = lambda: sorted((tuple(r) for r in neardup.near_duplicates(docs).collect()), key=str)
    want = shown()
    assert len({r[2] for r in want}) < len(want) - 20
    monkeypatch.setattr(neardup, "HOT", 2)
    assert shown() == want


def test_very_long_texts_of_unlike_words(spark):
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [(1, long), (2, long + " and a few more words at its end"), (3, " ".join(f"v{i}" for i in range(120_000))), (4, "x" * 500_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (119_996, 1), 2: (120_004, 1), 3: (119_996, 3), 4: (1, 4)}
