"""Joins of values that many rows share."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..tables import materialise

#: The rows of one side that a block of a value holds, and the pairs that a task makes, about.
BLOCK_ROWS, TASK_PAIRS = 2048, 16_000_000


def value_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, left_by: str, right_by: str) -> DataFrame:
    """Every pair of rows with equal values, null with nothing; the columns of both, which differ in name.

    The pairs of a value grow with the product of its rows, however few bytes these have, so tasks are dealt by pairs: both
    sides of a frequent value are cut into blocks by the columns ``left_by`` and ``right_by``, which should differ among its
    rows, and each block meets each in a place of its own. Sides of few pairs are joined as they are.
    """
    count = lambda df, on, n: df.groupBy(F.col(on).alias("_value")).agg(F.count("*").alias(n))
    sizes = count(left, left_on, "_l").join(count(right, right_on, "_r").hint("merge"), "_value")
    sizes = materialise(sizes.withColumn("_pairs", F.col("_l") * F.col("_r")))
    total = sizes.agg(F.sum("_pairs")).first()[0] or 0
    if total <= TASK_PAIRS:
        return left.join(right, F.col(left_on) == F.col(right_on))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_ROWS)
    # a frequent value has 2 * BLOCK_ROWS rows at least, so they are few enough to be broadcast
    frequent = sizes.filter(F.col("_pairs") > BLOCK_ROWS * BLOCK_ROWS).select("_value", blocks("_l").alias("_ls"), blocks("_r").alias("_rs"))
    # both sides are dealt by one type
    kind = left.select(left_on).union(right.select(right_on)).schema[0].dataType
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_PAIRS))

    def dealt(df: DataFrame, on: str, by: str, side: str, own: str, other: str) -> DataFrame:
        """Each row with the block that it is in, once for each block that it meets."""
        at = df.join(F.broadcast(frequent), F.col(on) == F.col("_value"), "left")
        number = {own: F.pmod(F.xxhash64(by), F.coalesce(own, F.lit(1))), other: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1)) - 1))}
        at = at.select(*df.columns, F.col(on).cast(kind).alias(f"{side}0"), number["_ls"].alias(f"{side}1"), number["_rs"].alias(f"{side}2"))
        return at.repartition(tasks, f"{side}0", f"{side}1", f"{side}2")

    lefts, rights = dealt(left, left_on, left_by, "_a", "_ls", "_rs"), dealt(right, right_on, right_by, "_b", "_rs", "_ls")
    same = [F.col(f"_a{i}") == F.col(f"_b{i}") for i in range(3)]
    return lefts.join(rights.hint("merge"), same).select(*left.columns, *right.columns)
