import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from folio.llm import ann

SCHEMA = "vec_id long, embedding array<float>, cell int, rank string"


def brute(rows, queries, k):
    usable = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v) and len(v) == 8]
    out = {}
    for q, x in usable:
        if q in queries:
            near = sorted({(-sum(a * b for a, b in zip(x, y)), i) for i, y in usable if i != q})[:k]
            out[q] = [(n + 1, i) for n, (_, i) in enumerate(near)]
    return out


def test_results_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 60)
    monkeypatch.setattr(ann, "BLOCK", 40)
    rnd = random.Random(9)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    hot = [0.5] * 8
    rows += [(i, hot) for i in range(400, 600)]
    rows += [(600, None), (601, [0.0] * 8), (602, [1.0, None] + [0.0] * 6), (603, [float("nan")] * 8), (604, [float("inf")] * 8), (None, hot), (605, [1.0, 2.0]), (606, [])]
    docs = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], SCHEMA)
    queries = {i for i, _ in rows if i is not None and i % 20 == 0}
    got = {}
    for r in ann.neighbours(docs, docs.where("vec_id % 20 = 0").select("vec_id"), k=7, confidence=0.9999).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    want = brute(rows, queries, 7)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.99 * sum(map(len, want.values()))
    assert sorted(got[420]) == sorted(want[420])


def test_few_and_none(spark):
    docs = spark.createDataFrame([(0, [1.0, 0.0], 1, ""), (20, [0.0, 1.0], 1, ""), (21, [1.0, 1.0], 1, "")], SCHEMA)
    got = ann.neighbours(docs, docs.select("vec_id"), k=20).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got)[:2] == [(0, 1, 21, 1.0), (0, 2, 20, 0.0)] and len(got) == 6
    empty = spark.createDataFrame([], SCHEMA)
    assert ann.neighbours(empty, empty.select("vec_id")).count() == 0


def test_chi_square():
    # 0.95 quantile with 8 degrees of freedom
    assert abs(ann.stopping_ratio(0.95, 8) - 15.5073) < 1e-3


def _unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def _measured(spark, path, x):
    """(recall of the 20 nearest, share of the vectors that a query was multiplied with), all settings by default."""
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x.astype(np.float32))}), path)
    vectors = spark.read.parquet(str(path))
    got, verified = {}, {}
    for r in ann.neighbours(vectors, vectors.where("vec_id % 400 = 0").select("vec_id")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
        verified[r.query_id] = r.n_verified
    exact = x.astype(np.float32).astype(np.float64)
    hits = 0
    for i in got:
        s = exact @ exact[i]
        s[i] = -np.inf
        hits += len(got[i] & set(np.argpartition(-s, 20)[:20].tolist()))
    assert len(got) == -(-len(x) // 400)
    return hits / (20 * len(got)), sum(verified.values()) / len(x) / len(got)


def test_recall_and_verified_share_by_default(spark, tmp_path):
    rng = np.random.default_rng(8)
    clustered = _unit(rng.standard_normal((500, 64))[rng.integers(0, 500, 50_000)] + 0.3 * rng.standard_normal((50_000, 64)))
    recall, share = _measured(spark, tmp_path / "clustered.parquet", clustered)
    assert recall >= 0.95 and share < 0.05, (recall, share)
    # no structure: the test can only hold late
    recall, share = _measured(spark, tmp_path / "gaussian.parquet", _unit(rng.standard_normal((50_000, 64))))
    assert recall >= 0.9 and share < 0.5, (recall, share)


def test_visits_of_clustered_vectors_do_not_grow_with_the_blocks(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((320, 64))
    shares = []
    for n in (8_000, 32_000):
        monkeypatch.setattr(ann, "CELL", 500)
        monkeypatch.setattr(ann, "BLOCK", 500)
        _, share = _measured(spark, tmp_path / f"{n}.parquet", _unit(centres[np.arange(n) % (n // 100)] + 0.2 * rng.standard_normal((n, 64))))
        shares.append(share * n)
    assert shares[1] < 2 * shares[0], shares


def test_large_and_small_components(spark):
    rows = [(0, [3e200, 4e200]), (1, [1e200, 0.0]), (2, [0.0, 2e200]), (3, [1e-300, 0.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in ann.neighbours(docs, docs.where("vec_id = 0").select("vec_id")).orderBy("rank").collect()]
    assert got == [(2, float("inf")), (1, float("inf"))]
    tiny = spark.createDataFrame([(0, [3e-100, 4e-100]), (1, [1e-100, 0.0]), (2, [0.0, 2e-100])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in ann.neighbours(tiny, tiny.where("vec_id = 0").select("vec_id")).orderBy("rank").collect()]
    assert got == [(2, 4e-100 * 2e-100), (1, 3e-100 * 1e-100)]
