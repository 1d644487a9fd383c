"""Shared helpers: text slices, rolling fingerprints, written tables and gapless numbering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..tables import materialise, shared_folder

U = np.uint64
BASE = 0x9E3779B97F4A7C15
BASES = (BASE, 0xD6E8FEB86659FD93)
#: Bytes of text that one vectorised step works on; a longer text is a slice of its own.
SLICE_BYTES = 1 << 17
#: Bytes of text whose results are packed together.
GROUP_BYTES = 1 << 20
_powers: dict[str, np.ndarray] = {}
_byte_codes = np.random.default_rng(20).integers(1, 2**63, (2, 256), dtype=U) | U(1)


def powers(n: int, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """BASES[kind]**i and its inverse modulo 2**64 for i <= n."""
    p, q = f"p{kind}", f"q{kind}"
    if p not in _powers or len(_powers[p]) <= n:
        size = max(n + 1, SLICE_BYTES + (SLICE_BYTES >> 2))
        for key, base in ((p, BASES[kind]), (q, pow(BASES[kind], -1, 1 << 64))):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers[p], _powers[q]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public murmur3 constants)."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


class Rolling:
    """Fingerprints of substrings of one byte buffer, position independent; two kinds that are independent."""

    def __init__(self, data: np.ndarray, kind: int = 0):
        n = len(data)
        p, self.inv = powers(n, kind)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(_byte_codes[kind][data] * p[:n], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inv[start] + (end - start).astype(U))

    def grams(self, k: int) -> np.ndarray:
        """The fingerprint of every k bytes."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:-k]) * self.inv[:n] + U(k))


def slices(texts: Iterator[tuple], size: int = SLICE_BYTES) -> Iterator[list[tuple]]:
    """Groups (key, bytes) pairs so that a group holds about ``size`` bytes."""
    group, held = [], 0
    for key, data in texts:
        if group and held + len(data) > size:
            yield group
            group, held = [], 0
        group.append((key, data))
        held += len(data)
    if group:
        yield group


def rows_of(batches, key: str, text: str) -> Iterator[tuple]:
    """(key, UTF-8 bytes or None) of Arrow batches, one small run of rows at a time."""
    import pyarrow as pa

    for batch in batches:
        keys, texts = batch.column(batch.schema.get_field_index(key)), batch.column(batch.schema.get_field_index(text))
        for at in range(0, batch.num_rows, 256):
            yield from zip(keys.slice(at, 256).to_pylist(), texts.slice(at, 256).cast(pa.binary()).to_pylist(), strict=True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Holds Arrow batches of texts to so many rows, as the memory of the tasks needs; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers first, first + 1, ... of each of ``count``, one range after the other, and ``count``."""
    return np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count), count


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def discard(df: DataFrame) -> None:
    """Removes the table of a materialised ``df`` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, by: str, out: str) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... within each value of ``by``, without moving the rows.

    ``df`` must be materialised, with columns ``part`` (a value per writing task) and ``local`` (0, 1, ... for each
    value of ``by`` in that task). Only one count per task and value is shuffled, so a hot value costs nothing.
    """
    counts = df.groupBy(by, "part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(by, "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), F.sum("_n").over(Window.partitionBy(by)).alias("_of"))
    return df.join(first, [by, "part"], "left").withColumn(out, F.col("_first") + F.col("local")).drop("_first")


#: The places that a key of a salted join is dealt to, and the most rows that are broadcast instead.
SALTS, BROADCAST_ROWS = 16, 20_000


def salted_join(many: DataFrame, few: DataFrame, on: list[str], by: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``many`` joined with ``few``, whose keys are different, without a hot key.

    A ``few`` of at most BROADCAST_ROWS rows (counted, so it should be a written table) is broadcast. Of a larger one each
    row stands in ``salts`` places, so that a key of very many rows is met by as many tasks; ``by`` names a column of ``many``
    that differs among the rows of one key.
    """
    if few.count() <= BROADCAST_ROWS:
        return many.join(F.broadcast(few), on, how)
    spread = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``edges``; isolated nodes are not listed.

    Smallest labels spread to neighbours and then jump to the label of their label, so the rounds grow with the
    logarithm of a chain's length. Each round is a written table; only a sum of the labels comes to the driver.
    """
    one = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    two = one.select(F.col("other").alias("node"), F.col("node").alias("other"))
    both = one.unionByName(two)
    both = materialise(both.unionByName(both.select("node", F.col("node").alias("other"))).distinct())
    labels, before = materialise(both.groupBy("node").agg(F.min("other").alias("component"))), None
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("component"))
        # only labels that are not their own label lead on; a component of any size has one label, hence the salt
        hop = labels.filter("node <> component").select(F.col("node").alias("component"), F.col("component").alias("hop"))
        new = materialise(salted_join(near, hop, ["component"], "node", "left").select("node", F.least("component", "hop").alias("component")))
        after = new.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        discard(labels)
        labels = new
        if before == after:
            discard(both)
            return labels
        before = after
