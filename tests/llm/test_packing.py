import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import packing


def naive(sizes, capacity):
    rows, room = [], []
    for i, s in enumerate(sizes):
        fits = [(r, k) for k, r in enumerate(room) if r >= s]
        if fits:
            least = min(r for r, _ in fits)
            k = [k for r, k in fits if r == least][-1]
        else:
            k = len(rows)
            rows.append([])
            room.append(capacity)
        rows[k].append(i)
        room[k] -= s
    return rows


def test_best_fit_takes_the_least_room():
    rnd = random.Random(2)
    for _ in range(100):
        capacity = rnd.choice([1, 7, 16, 31, 100])
        sizes = sorted((rnd.randint(1, capacity) for _ in range(rnd.randint(0, 80))), reverse=True)
        got, want = packing.best_fit_decreasing(sizes, capacity), naive(sizes, capacity)
        fill = lambda rows: sorted(sum(sizes[i] for i in r) for r in rows)
        assert sorted(i for r in got for i in r) == list(range(len(sizes)))
        assert fill(got) == fill(want)


def test_rows_hold_every_id_once(spark):
    rnd = random.Random(4)
    rows = [(i if i else None, [rnd.randint(0, 60000) for _ in range(rnd.choice([0, 1, 5, 16, 40, 100]))], "x") for i in range(200)]
    rows += [(500, None, "x"), rows[3], rows[3]]
    encoded = spark.createDataFrame(rows, "doc_id long, ids array<int>, shard string")
    got = packing.pack(encoded, tokens=9_000_000, capacity=16, pad=7).collect()
    found = {}
    for r in got:
        ids, places = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(places) == 16 and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == 7).all()
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert places[a:b].tolist() == list(range(b - a))
            found.setdefault((d, s), []).append(ids[a:b].tolist())
    want = {}
    for d, ids, _ in rows:
        for a in range(0, len(ids or []), 16):
            want.setdefault((d, a), []).append(ids[a : a + 16])
    assert found == want


def test_empty_and_wrong(spark):
    encoded = spark.createDataFrame([], "doc_id long, ids array<int>")
    assert packing.digests(packing.pack(encoded, 0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(encoded, 0, capacity=70000)
    wide = spark.createDataFrame([(1, [5, 65_536])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="does not fit"):
        packing.pack(wide, 2).collect()
    assert np.frombuffer(packing.pack(wide, 2, width=4).collect()[0].ids, "<u4")[:2].tolist() == [5, 65_536]


def test_shards_are_partitions_and_written_rows_are_read_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 500)
    encoded = spark.createDataFrame([(i, list(range(i % 40))) for i in range(300)], "doc_id long, ids array<int>")
    packed = packing.pack(encoded, tokens=6000, capacity=64)
    of = packed.select("shard", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(of) == len({r.shard for r in of}) == len({r.p for r in of}) == 12
    packing.write(packed, str(tmp_path / "rows"))
    again = spark.read.parquet(str(tmp_path / "rows"))
    assert sorted(again.collect(), key=lambda r: (r.shard, r.row)) == sorted(packed.collect(), key=lambda r: (r.shard, r.row))
