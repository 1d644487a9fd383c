"""Token counts: a separator scan over flat token files that have no index.

A token file is a run of little-endian ids without any boundary but the end-of-document id. The scan plans byte ranges
from the lengths of the files alone, and each task reads its ranges by position, so a file may have any size; a document
may span ranges and a range hold many documents. Each range is searched on its own for the end id; a prefix scan over
the ranges of a file gives every range the number of documents and ids before it and the place where its first document
began, so that the pieces meet.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import materialise, partitions, shared_folder, small_batches
from .packing import token_rows

#: Ids of a range.
BLOCK = 1 << 20


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, or any that Arrow knows, such as hdfs and s3) and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def write_tokens(docs: DataFrame, tokenizer: str, end: int, folder: str, key: str = "doc_id", text: str = "text", width: int = 32) -> tuple[DataFrame, DataFrame]:
    """(files, order): each task writes its documents as one flat file in ``folder``, which all executors share.

    ``files`` has (file, bytes); ``order`` has (file, ordinal, key), the document that was written n-th. A null or empty
    text is the end id alone. The name of a special token in a text is text like other, so no text holds the end id.
    Rows may repeat; other columns are not read. A task that runs again writes a file of its own: only the files that
    are listed count.
    """
    schema = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("ordinal", pa.int64()), ("doc_id", pa.int64())])

    def run(batches):
        name, ordinal, size, docs_ = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin", 0, 0, []

        def out():
            n = len(docs_)
            return pa.RecordBatch.from_arrays([pa.array([name] * n), pa.nulls(n, pa.int64()), pa.array(range(ordinal - n, ordinal), pa.int64()), pa.array(docs_, pa.int64())], schema=schema)

        file = None
        for doc, ids in token_rows(batches, tokenizer, end, literal=True):
            if file is None:
                where, path = store(name)
                where.create_dir(path.rpartition("/")[0], recursive=True)
                file = where.open_output_stream(path)
            if len(ids) and int(ids.max()) >> width:
                raise ValueError(f"an id does not fit into {width} bits")
            data = ids.astype(f"<u{width // 8}").tobytes()
            file.write(data)
            size, ordinal = size + len(data), ordinal + 1
            docs_.append(doc)
            if len(docs_) >= 20_000:
                yield out()
                docs_.clear()
        if file is not None:
            file.close()
            if docs_:
                yield out()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], schema=schema)

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    written = materialise(source.mapInArrow(run, "file string, bytes long, ordinal long, doc_id long"))
    return written.filter("bytes is not null").select("file", "bytes"), written.filter("bytes is null").select("file", "ordinal", F.col("doc_id").alias(key))


def token_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of the flat token files under ``path``; only their lengths are read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def scan(files: DataFrame, end: int, width: int = 32, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, start, n_tokens) of each document of the flat token files (file, bytes).

    ``width`` is the bits of an id, ``block`` the ids of a range. ``n_tokens`` counts the end id; ids behind the last end
    id of a file are a document without one. Bytes behind the last whole id, empty files and null lengths hold nothing.
    """
    kind, size = {16: "<u2", 32: "<u4", 64: "<u8"}[width], width // 8
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("ids", pa.int64()), ("n_ends", pa.int64()), ("last_end", pa.int64()), ("ends", pa.list_(pa.int64()))])
    step = block * size
    ranges = files.filter(f"bytes >= {size}").select("file", F.expr(f"bytes div {size} * {size}").alias("whole"), F.explode(F.expr(f"sequence(0L, bytes div {size} * {size} - 1, {step}L)")).alias("at"))
    ranges = ranges.select("file", F.expr(f"at div {step}").alias("block"), "at", F.expr(f"least(whole - at, {step})").alias("n"))

    def ends(batches) -> Iterator[pa.RecordBatch]:
        name = file = None
        for batch in batches:
            for path, number, at, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if path != name:
                    where, inner = store(path)
                    name, file = path, where.open_input_file(inner)
                ids = np.frombuffer(file.read_at(n, at), kind)
                if len(ids) * size != n:
                    raise OSError(f"{path} is shorter than listed")
                found = np.flatnonzero(ids == end) + 1
                one = [[path], [number], [len(ids)], [len(found)], [int(found[-1]) if len(found) else None], [found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(one, schema.types, strict=True)], schema=schema)

    dealt = ranges.repartition(partitions(files.sparkSession), F.xxhash64("file", F.expr("block div 4"))).sortWithinPartitions("file", "block")
    scanned = materialise(dealt.mapInArrow(ends, "file string, block long, ids long, n_ends long, last_end long, ends array<long>"))
    # the prefix scan runs over one small row for each range; the ends stay where they are
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = scanned.select("file", "block", "ids", "n_ends", "last_end")
    sums = sums.withColumn("base", F.coalesce(F.sum("ids").over(upto), F.lit(0))).withColumn("first", F.coalesce(F.sum("n_ends").over(upto), F.lit(0)))
    sums = sums.withColumn("opened", F.coalesce(F.last(F.expr("base + last_end"), ignorenulls=True).over(upto), F.lit(0)))
    placed = scanned.select("file", "block", "ends").join(sums.select("file", "block", "base", "first", "opened"), ["file", "block"])
    docs = placed.select("file", "base", "first", "opened", "ends", F.posexplode("ends").alias("n", "at"))
    start = F.expr("if(n = 0, opened, base + ends[n - 1])")
    closed = docs.select("file", (F.col("first") + F.col("n")).alias("ordinal"), start.alias("start"), (F.col("base") + F.col("at") - start).alias("n_tokens"))
    whole = sums.groupBy("file").agg(F.sum("ids").alias("ids"), F.sum("n_ends").alias("ordinal"), F.coalesce(F.max(F.expr("base + last_end")), F.lit(0)).alias("start"))
    rest = whole.filter("ids > start").select("file", "ordinal", "start", F.expr("ids - start").alias("n_tokens"))
    return closed.unionByName(rest)


def token_counts(docs: DataFrame, tokenizer: str, end: int, key: str = "doc_id", text: str = "text", width: int = 32, block: int = BLOCK) -> DataFrame:
    """(key, file, ordinal, start, n_tokens) of each row of ``docs``: written as flat token files, found by the scan."""
    small_batches(docs.sparkSession)
    files, order = write_tokens(docs, tokenizer, end, shared_folder(docs.sparkSession, "tokens"), key, text, width)
    return order.join(scan(files, end, width, block), ["file", "ordinal"]).select(key, "file", "ordinal", "start", "n_tokens")
