"""The pipeline against what its operators say one by one."""

import corpus_pipeline
import public_tokenizers
import pytest

from folio.llm import bpe
from folio.llm.decontaminate import contamination
from folio.llm.neardup import near_duplicates
from folio.llm.pii import replace_pii
from folio.llm.quality import quality
from folio.llm.queries import DEMO_KEY

SF = "/root/testdata/sf0.001"


@pytest.fixture
def sf_dir():
    import os

    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    return SF


def test_pipeline_equals_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = lambda df, where: {r.doc_id for r in df.where(where).select("doc_id").collect()}
    kept = ids(quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "predicted = 1")
    left = docs.where(docs.doc_id.isin(list(kept)))
    kept = ids(near_duplicates(left), "kept")
    left = docs.where(docs.doc_id.isin(list(kept)))
    kept = ids(contamination(left, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "not contaminated")
    left = docs.where(docs.doc_id.isin(list(kept)))
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    want = bpe.digests(bpe.round_trip(replace_pii(left, DEMO_KEY), path, public_tokenizers.PATTERN)).collect()
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(got) == sorted(want) and 0 < len(got) < docs.count()


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == corpus_pipeline.COLUMNS
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_stages_take_odd_rows(spark, sf_dir):
    """Null and repeated ids, null, empty and very long texts, and further columns with names of the operators' own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    first = docs.first()
    odd = [(None, first.text, "en", "s", 1), (None, None, None, None, None), (first.doc_id, first.text, "en", "s", 1), (90001, "", "en", "s", 0), (90002, " ".join(f"u{i}" for i in range(50_000)), "en", "s", 9)]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    for name in ("score", "entities", "item_ids", "cls", "uid", "redrawn", "kept"):
        rows = rows.selectExpr("*", f"'x' as {name}")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, sf_dir).collect()
        assert 0 < len(out) <= rows.count(), name
        assert all(len(r) for r in out)
