"""Text files as pages."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import islice
from urllib.parse import urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import exists, written

#: The columns of Spark's binary files, for streams.
BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


#: Bytes of files that a task hands on at a time, or one file.
READ_BYTES = 4 << 20
#: Files that a task reads, about; Spark's reader gives a task 32 small ones, so that tasks are as many as a thirtieth of the files.
FILES_A_TASK = 4096
LISTED = "file_name string, length long, folder boolean"


def _hidden(name: str) -> bool:
    """Whether Spark's readers pass over files and folders of this name."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def _lister(pattern: str | None, deep: bool):
    """(file_name, length, folder) of what lies in the folders of each batch: of all below them if ``deep``, else their own folders too. Names are handed on as they are found."""
    wanted = re.compile(pattern, re.DOTALL).fullmatch if pattern is not None else lambda _: True

    def entries(folder):
        left = [folder]
        while left:
            with os.scandir(left.pop()) as found:
                for entry in found:
                    if _hidden(entry.name):
                        continue
                    if not entry.is_dir():
                        size = entry.stat().st_size if wanted(entry.name) else 0
                        if size:
                            yield entry.path, size, False
                    elif deep:
                        left.append(entry.path)
                    else:
                        yield entry.path, 0, True

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (entry for folder in batch.column("file_name").to_pylist() for entry in entries(folder))
            while rows := list(islice(found, 10_000)):
                yield pa.RecordBatch.from_pydict(dict(zip(("file_name", "length", "folder"), map(list, zip(*rows)))))

    return listing


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file_name, content) of the files of each batch."""

    def out(names, contents):
        return pa.RecordBatch.from_arrays([pa.array(["file:" + n for n in names], pa.string()), pa.array(contents, pa.binary())], names=["file_name", "content"])

    for batch in batches:
        names, contents, size = [], [], 0
        for name in batch.column("file_name").to_pylist():
            with open(name, "rb") as f:
                content = f.read()
            if names and size + len(content) > READ_BYTES:
                yield out(names, contents)
                names, contents, size = [], [], 0
            names.append(name)
            contents.append(content)
            size += len(content)
        if names:
            yield out(names, contents)


def _bytes_of(spark: SparkSession, key: str) -> int:
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)))


def _read_mounted(spark: SparkSession, folder: str, names: str | None) -> DataFrame:
    pattern = spark._jvm.org.apache.hadoop.fs.GlobPattern(names).compiled().pattern() if names is not None else None
    top = spark.createDataFrame([(os.path.abspath(folder),)], "file_name string")
    top = written(top.coalesce(1).mapInArrow(_lister(pattern, False), LISTED))
    folders = top.where("folder").select("file_name").repartition(4 * spark.sparkContext.defaultParallelism)
    found = written(top.where("not folder").unionByName(folders.mapInArrow(_lister(pattern, True), LISTED)))
    most = _bytes_of(spark, "spark.sql.files.maxPartitionBytes")
    count, size = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    parts = max(spark.sparkContext.defaultParallelism, -(-size // most) + -(-count // FILES_A_TASK))
    return found.select("file_name").repartition(parts).mapInArrow(_reader, "file_name string, content binary")


def read_files(spark: SparkSession, path: str, names: str | None = None) -> DataFrame:
    """(file_name, content) of all files below a path whose names match the glob ``names``; files of no bytes are left out, as by Spark's reader.

    Names are looked at before anything is read. The files of a folder on a mounted file system, which all executors share, are listed and read by the tasks: their names are
    stored and dealt to as many tasks as spark.sql.files.maxPartitionBytes and FILES_A_TASK ask for, and none comes to the driver.
    Elsewhere Spark's reader, of which the driver lists all files and keeps about 1 KB for each, has them.
    """
    parsed = urlparse(path)
    folder = parsed.path if parsed.scheme else path
    if parsed.scheme in ("", "file") and os.path.isdir(folder):
        return _read_mounted(spark, folder, names)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if names is not None:
        reader = reader.option("pathGlobFilter", names)
    return reader.load(path).select(F.col("path").alias("file_name"), "content")


def _task_writer(folder: str, key: str):
    """Writes a task's files into a hidden folder that gets its name when all are there; of two attempts of a task one counts."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        at = os.path.join(folder, f"_part-{task.partitionId()}-{task.taskAttemptId()}")
        done, last, f, n = os.path.join(folder, f"part={task.partitionId()}"), None, None, 0
        try:
            for batch in batches:
                for name, text in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist()):
                    if f is None or name != last:
                        if f is not None:
                            f.close()
                        else:
                            os.makedirs(at, exist_ok=True)
                        last, f, n = name, open(os.path.join(at, f"{key}={name}.txt"), "wb"), n + 1
                    f.write(text + b"\n")
        finally:
            if f is not None:
                f.close()
        if n:
            try:
                os.rename(at, done)
            except OSError:
                if not os.path.isdir(done):
                    raise
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return write


def write_files(texts: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Write each text as a file of its own with its key in the path, with a line end after it; bytes that are not valid UTF-8 stay as they are.

    On a mounted file system, which all executors share, a task writes ``part=n/key=value.txt`` itself: Spark's writer starts processes and makes a folder for each
    file there. Elsewhere Spark writes ``key=value/part-n.txt``. Repeated keys of a task are lines of one file. What exists is not written over.
    """
    spark, value = texts.sparkSession, F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        texts.select(key, value.cast("string").alias("value")).sortWithinPartitions(key).write.partitionBy(key).text(path)
        return
    if exists(spark, path):
        raise FileExistsError(path)
    folder = parsed.path if parsed.scheme else path
    os.makedirs(folder)
    name = F.coalesce(F.url_encode(F.col(key).cast("string")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    named = texts.select(name.alias("name"), value.alias("value")).sortWithinPartitions("name")
    named.mapInArrow(_task_writer(folder, key), "n long").agg(F.sum("n")).collect()


def key_of(file_name: str = "file_name", key: str = "doc_id"):
    """The key that ``write_files`` put into a file's path."""
    return F.regexp_extract(file_name, rf"/{key}=([^/]*?)(?:/|\.[^./]*$)", 1)


def decoded(content):
    """Bytes as UTF-8, what is not valid replaced."""
    return F.make_valid_utf8(F.col(content).cast("string"))


def text_pages(files: DataFrame) -> DataFrame:
    """pages(doc_id, page_number, text) of files(doc_id, file_type, content): one page for each text or Markdown file."""
    return files.where(F.col("file_type").isin("txt", "md")).select("doc_id", F.lit(1).alias("page_number"), decoded("content").alias("text"))
