"""Tables replaced in place, deletion along keys, stored fingerprints, files as a source, stale labels."""

import pytest
from pyspark.sql import functions as F

from folio.operators import evaluate, ingest
from folio.plans import tables
from folio.sources import files, store
from folio.streaming import jobs


def _stored(spark, at):
    return sorted((r.doc_id, r.chunk_id, r.content) for r in spark.read.parquet(at).collect())


def test_chunks_are_replaced_in_place(spark, tmp_path):
    at = f"file://{tmp_path}/chunks"
    rows = [(d, d * 10 + k, f"old {d}") for d in range(40) for k in range(3)]
    ingest.put_chunks(spark.createDataFrame(rows, "doc_id long, chunk_id long, content string"), at, buckets=8)
    files_before = {f: (tmp_path / "chunks" / f).stat().st_mtime_ns for f in (str(p.relative_to(tmp_path / "chunks")) for p in (tmp_path / "chunks").rglob("*.parquet"))}
    fresh = spark.createDataFrame([(3, 30, "new 3"), (3, 35, "new 3"), (7, 70, "new 7"), (99, 990, "of a document not asked for")], "doc_id long, chunk_id long, content string")
    ids = spark.createDataFrame([(3,), (7,), (8,), (3,), (77,)], "doc_id long")
    status, removed = ingest.replace_chunks(at, fresh, ids, buckets=8)
    want = sorted([r for r in rows if r[0] not in (3, 7)] + [(3, 30, "new 3"), (3, 35, "new 3"), (7, 70, "new 7")])
    assert _stored(spark, at) == want
    assert sorted(map(tuple, status.collect())) == [(3, "ready"), (7, "ready"), (8, "failed"), (77, "failed")]
    assert sorted((r.chunk_id, r.doc_id) for r in removed.collect()) == [(31, 3), (32, 3), (71, 7), (72, 7)]
    # buckets without such documents are not touched
    touched = {r[0] for r in ids.where("doc_id in (3, 7)").select(ingest.doc_bucket(8)).collect()}
    for f, time in files_before.items():
        if int(f.split("bucket=")[1].split("/")[0]) not in touched:
            assert (tmp_path / "chunks" / f).stat().st_mtime_ns == time
    # once more, it changes nothing
    ingest.replace_chunks(at, fresh, ids, buckets=8)
    assert _stored(spark, at) == want
    # a batch that fails leaves all as it was
    broken = fresh.withColumn("content", F.when(F.col("doc_id") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no"):
        ingest.replace_chunks(at, broken, ids, buckets=8)
    assert _stored(spark, at) == want
    assert ingest.replace_chunks(at, fresh.limit(0), ids, buckets=8)[0].where("status = 'failed'").count() == 4 and _stored(spark, at) == want


def test_deletion_along_keys(spark):
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    tables = {
        "knowledge_bases": make([("k",), ("o",)], "kb_id string"), "documents": make([(1, "k"), (2, "o"), (3, None)], "doc_id long, kb_id string"),
        "chunks": make([(10, 1), (20, 2), (30, None)], "chunk_id long, doc_id long"), "conversations": make([(5, "k"), (6, "o")], "conv_id long, kb_id string"),
        "messages": make([(50, 5), (60, 6)], "message_id long, conv_id long"), "citations": make([(500, 50, 20), (600, 60, 10)], "citation_id long, message_id long, chunk_id long"),
        "datasets": make([(7, "k"), (8, "o")], "dataset_id long, kb_id string"), "questions": make([(70, 7), (80, 8)], "question_id long, dataset_id long"),
        "runs": make([(71, 7), (81, 8)], "run_id long, dataset_id long"), "results": make([(710, 71, 80), (810, 81, 80), (811, 81, 70)], "result_id long, run_id long, question_id long"),
    }
    shown = lambda left: {t: sorted(str(r[0]) for r in df.collect()) for t, df in left.items()}
    got = shown(ingest.delete_rows(tables, "knowledge_bases", make([("k",), ("k",)], "kb_id string")))
    assert got == {"knowledge_bases": ["o"], "documents": ["2", "3"], "chunks": ["20", "30"], "conversations": ["6"], "messages": ["60"], "citations": ["600"], "datasets": ["8"], "questions": ["80"], "runs": ["81"], "results": ["810", "811"]}
    got = shown(ingest.delete_rows(tables, "documents", make([(1,)], "doc_id long")))
    assert got["documents"] == ["2", "3"] and got["chunks"] == ["20", "30"] and got["citations"] == ["500", "600"] and got["knowledge_bases"] == ["k", "o"]
    # results may hang on questions as well; then they lose the rows of both parents
    both = (*ingest.KEYS, ("results", "result_id", "questions", "question_id"))
    assert shown(ingest.delete_rows(tables, "datasets", make([(7,)], "dataset_id long"), both))["results"] == ["810"]
    assert shown(ingest.delete_rows(tables, "knowledge_bases", make([], "kb_id string"))) == shown(tables)


def test_batches_read_their_own_fingerprints(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, kb_id string, file_name string, content binary")
    jobs.ingest_batch(spark, make([(i, "k", f"{i}.txt", b"text %d." % i) for i in range(60)]), store, 0)
    known = ingest.admit(make([(100, "k", "a.txt", b"text 7."), (101, "o", "b.txt", b"text 7.")]))
    found = jobs.stored_fingerprints(known, store, 1)
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan.replace("isnotnull(bucket", "isnotnull(batch") and " IN (" in plan
    # of sixty stored ones, only those in two buckets
    assert 1 <= found.count() < 20 and jobs.stored_fingerprints(known, store, 0).count() == 0
    jobs.ingest_batch(spark, make([(100, "k", "a.txt", b"text 7."), (101, "o", "b.txt", b"text 7."), (102, "k", "c.txt", b"new")]), store, 1)
    assert sorted(r.doc_id for r in spark.read.parquet(f"{store}/documents").where("batch = 1").collect()) == [101, 102]


def test_files_written_and_read(spark, tmp_path):
    rows = [(1, "one\nline"), (2, ""), (3, None), (4, "é" * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text", F.when(F.col("doc_id") == 4, F.concat("text", F.expr("cast(X'FE' as string)"))).otherwise(F.col("text")))
    at = f"file://{tmp_path}/files"
    files.write_files(df, at)
    (tmp_path / "files" / "doc_id=9").mkdir()
    (tmp_path / "files" / "doc_id=9" / "x.pdf").write_bytes(b"%PDF")
    (tmp_path / "files" / "doc_id=8").mkdir()
    (tmp_path / "files" / "doc_id=8" / "read me.MD").write_bytes(b"# T")
    every = files.read_files(spark, at).where("file_name like '%.pdf'").count()
    found = ingest.admit(files.read_files(spark, at, "*.{txt,MD}")).withColumn("doc_id", files.key_of().cast("long"))
    assert every == 1 and found.where("file_type = 'pdf'").count() == 0
    assert sorted((r.doc_id, r.text) for r in files.text_pages(found).collect()) == [(1, "one\nline\n"), (2, "\n"), (3, "\n"), (4, "ééé�\n"), (8, "# T")]
    assert {r.name for r in found.where("doc_id = 8").collect()} == {"read_me.MD"}


def test_stale_and_unknown_labels(spark):
    asked = spark.createDataFrame([(1, 1, [5, 6, 5, 9]), (2, 2, [6])], "question_id long, dataset_id long, relevant_chunk_ids array<long>")
    datasets = spark.createDataFrame([(1, "k"), (2, "o")], "dataset_id long, kb_id string")
    documents = spark.createDataFrame([(3, "k")], "doc_id long, kb_id string")
    chunks = spark.createDataFrame([(5, 3)], "chunk_id long, doc_id long")
    removed = spark.createDataFrame([(6, 3), (6, 3)], "chunk_id long, doc_id long")
    clean, found = evaluate.check_labels(asked, datasets, documents, chunks, removed)
    # what one kb has lost was never a label of the other
    assert sorted(map(tuple, found.collect())) == [(1, 6, "stale"), (1, 9, "unknown"), (2, 6, "unknown")]
    assert clean.where("question_id = 1").first().relevant_chunk_ids == [5, 6, 9]


def test_many_files_take_few_folders(spark, tmp_path):
    df = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).repartition(3)
    at = f"file://{tmp_path}/files"
    files.write_files(df.unionByName(df.where("doc_id = 5")), at)
    folders = [p for p in (tmp_path / "files").rglob("*") if p.is_dir()]
    assert len(folders) <= 6 and not any(p.name.startswith("_") for p in folders)
    found = files.read_files(spark, at, "*.txt").select(files.key_of().cast("long").alias("doc_id"), files.decoded("content").alias("text"))
    assert sorted(map(tuple, found.collect())) == sorted([(i, f"text {i}\n") for i in range(600)] + [(5, "text 5\n")])
    with pytest.raises(FileExistsError):
        files.write_files(df, at)
    keys = spark.createDataFrame([("a.b", "x"), ("c", "y"), ("c", "z"), (None, "n")], "doc_id string, text string").coalesce(1)
    files.write_files(keys, f"file://{tmp_path}/keys")
    found = files.read_files(spark, f"file://{tmp_path}/keys").select(files.key_of(), files.decoded("content"))
    assert sorted(map(tuple, found.collect())) == [("__HIVE_DEFAULT_PARTITION__", "n\n"), ("a.b", "x\n"), ("c", "y\nz\n")]


def test_files_are_listed_by_tasks(spark, tmp_path):
    top = tmp_path / "in"
    names = ["a.txt", "b.md", "c.pdf", "_d.txt", ".e.txt", "_f=1.txt", "x.txt._COPYING_", "p=1/q/g.txt", "p=1/g h.txt", "_p/i.txt", ".p/j.txt", "_p=2/k.md", "é%20 [1].txt", "empty.txt", "p=1/A.TXT"]
    for name in names:
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(b"" if name == "empty.txt" else name.encode() + b"\xff")
    (top / "large.txt").write_bytes(b"x" * (files.READ_BYTES + 1))
    for path in (str(top), f"file://{top}", f"file:{top}/"):
        for glob in (None, "*.{txt,md}", "[a-c].*", "?.[^t]*", "none"):
            reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            want = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
            got = files.read_files(spark, path, glob)
            assert got.schema == want.selectExpr("path as file_name", "content").schema
            assert sorted((r.file_name, bytes(r.content)) for r in got.collect()) == sorted((r.path, bytes(r.content)) for r in want.collect())
            # no index of files, of which the driver would hold one entry for each
            assert not any(name.startswith(f"file://{top}") or name.startswith(f"file:{top}") for name in got.inputFiles())
    one = files.read_files(spark, f"{top}/a.txt")
    assert [bytes(r.content) for r in one.collect()] == [b"a.txt\xff"]


def test_one_row_group_is_dealt_out(spark, tmp_path):
    path = f"file://{tmp_path}/one"
    spark.range(0, 40000, 1, 1).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text")).write.parquet(path)
    shares = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = spark.read.parquet(path)
        # many splits, of which one has all rows
        assert df.rdd.getNumPartitions() > 8 and shares(df) == [40000]
        dealt = shares(store.spread(df))
        assert len(dealt) >= 4 and max(dealt) * 4 <= 2 * 40000 and sum(dealt) == 40000
        # rows that lie well stay
        dealt = store.written(df.repartition(16))
        assert store.parts_to_deal(dealt) == 0 and store.spread(dealt) is dealt
        assert shares(store.spread(dealt.where("doc_id < 0"))) == []
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_texts_for_vectors_are_dealt_evenly(spark, monkeypatch):
    # stored in splits of very different sizes
    rows = spark.range(0, 4000, 1, 1).union(spark.range(4000, 4100, 1, 1))
    stored = rows.select((F.col("id") * 10).alias("chunk_id"), F.col("id").alias("doc_id"), F.lit("en").alias("kb_id"), F.lit("text").alias("content"))
    monkeypatch.setattr(tables, "chunks", lambda *_: stored)
    monkeypatch.setattr(tables, "documents", lambda *_: rows.select(F.col("id").alias("doc_id"), F.when(F.col("id") % 17 == 0, "failed").otherwise("ready").alias("status")))
    found = [r["count"] for r in tables.ready_chunks(spark, "").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(found) == 4100 - 242 and len(found) >= 12 and max(found) * 4 <= 2 * sum(found)
