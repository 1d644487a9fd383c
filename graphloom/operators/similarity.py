"""Similarity and rank over neighbour sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..tables import materialise


def neighbours(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def same_neighbors(edges: DataFrame, a, b) -> DataFrame:
    """(id): the common neighbours of two vertices."""
    near = neighbours(edges)
    return near.filter(F.col("src") == F.lit(a)).select(F.col("dst").alias("id")).intersect(near.filter(F.col("src") == F.lit(b)).select(F.col("dst").alias("id")))


def jaccard_pairs(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, jaccard) of the neighbour sets of given pairs; 0 if both are empty. Sets meet as rows, never as lists."""
    near, degree = neighbours(edges), neighbours(edges).groupBy("src").agg(F.count("*").alias("n"))
    shared = pairs.join(near.select(F.col("src").alias("a"), "dst"), "a").join(near.select(F.col("src").alias("b"), "dst"), ["b", "dst"]).groupBy("a", "b").agg(F.count("*").alias("both"))
    out = pairs.join(shared, ["a", "b"], "left").join(degree.select(F.col("src").alias("a"), F.col("n").alias("na")), "a", "left").join(degree.select(F.col("src").alias("b"), F.col("n").alias("nb")), "b", "left")
    union = F.expr("coalesce(na, 0) + coalesce(nb, 0) - coalesce(both, 0)")
    return out.select("a", "b", F.when(union > 0, F.coalesce("both", F.lit(0)) / union).otherwise(0.0).alias("jaccard"))


def jaccard_of_all(edges: DataFrame) -> DataFrame:
    """(a, b, jaccard) of all pairs a < b that share a neighbour; every other pair has 0."""
    near = neighbours(edges)
    pairs = near.select(F.col("src").alias("a"), "dst").join(near.select(F.col("src").alias("b"), "dst"), "dst").filter("a < b").select("a", "b").distinct()
    return jaccard_pairs(edges, pairs)


def jaccard_similars(edges: DataFrame, source, top: int) -> DataFrame:
    """(id, jaccard): the vertices one or two hops from ``source`` with the most similar neighbour sets."""
    near = neighbours(edges)
    one = near.filter(F.col("src") == F.lit(source)).select(F.col("dst").alias("id"))
    two = near.join(one, F.col("src") == F.col("id")).select(F.col("dst").alias("id"))
    pairs = one.union(two).distinct().filter(F.col("id") != F.lit(source)).select(F.lit(source).alias("a"), F.col("id").alias("b"))
    return jaccard_pairs(edges, pairs).select(F.col("b").alias("id"), "jaccard").orderBy(F.desc("jaccard"), "id").limit(top)


def fusiform(edges: DataFrame, alpha: float, min_neighbors: int = 1, min_similars: int = 1) -> DataFrame:
    """(a, b, score): vertices b that share at least ``alpha`` of the neighbours of a, for a with enough of both.

    A partner of a vertex with n neighbours has one of any n - ceil(alpha n) + 1 of them: candidates meet at the rarest
    of these alone, so a hub is met only by vertices with hardly any other neighbour, and are then counted in full.
    """
    near = neighbours(edges)
    degree = near.groupBy("src").agg(F.count("*").alias("n"))
    rarity = near.groupBy("dst").agg(F.count("*").alias("_in"))
    own = near.join(degree.filter(F.col("n") >= min_neighbors), "src").select(F.col("src").alias("a"), "n", "dst")
    place = F.row_number().over(Window.partitionBy("a").orderBy("_in", "dst"))
    rare = own.join(rarity, "dst").withColumn("_k", place).filter(F.col("_k") <= F.col("n") - F.ceil(F.lit(alpha) * F.col("n")) + 1)
    large = near.join(degree.filter(F.col("n") >= alpha * min_neighbors).select("src"), "src", "left_semi").select(F.col("src").alias("b"), "dst")
    pairs = rare.select("a", "dst").join(large, "dst").filter("a <> b").select("a", "b").distinct()
    shared = pairs.join(own, "a").join(large, ["b", "dst"]).groupBy("a", "n", "b").agg(F.count("*").alias("both"))
    found = shared.filter(F.col("both") >= alpha * F.col("n")).select("a", "b", (F.col("both") / F.col("n")).alias("score"))
    enough = found.groupBy("a").count().filter(F.col("count") >= min_similars).select("a")
    return found.join(enough, "a", "left_semi")


def personal_rank(edges: DataFrame, source, alpha: float, rounds: int) -> DataFrame:
    """(id, rank): random walks from ``source`` with restart over undirected edges; direct neighbours are left out."""
    near = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    out = materialise(near.join(near.groupBy("src").agg(F.count("*").alias("deg")), "src"))
    rank = out.sparkSession.range(1).select(F.lit(source).alias("id"), F.lit(1.0).alias("rank"))
    for _ in range(rounds):
        flow = rank.join(out, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("rank") * alpha / F.col("deg")).alias("rank"))
        root = out.sparkSession.range(1).select(F.lit(source).alias("id"), F.lit(1 - alpha).alias("rank"))
        rank = materialise(flow.unionByName(root).groupBy("id").agg(F.sum("rank").alias("rank")))
    direct = near.filter(F.col("src") == F.lit(source)).select(F.col("dst").alias("id"))
    return rank.filter(F.col("id") != F.lit(source)).join(direct, "id", "left_anti")


def neighbor_rank(source, steps: list[tuple[DataFrame, float, int]]) -> DataFrame:
    """(layer, id, rank): each step (edges, alpha, top) passes alpha of a rank on in equal shares; top per layer."""
    spark = steps[0][0].sparkSession
    rank, layers = spark.range(1).select(F.lit(source).alias("id"), F.lit(1.0).alias("rank")), None
    for i, (edges, alpha, top) in enumerate(steps, 1):
        near = neighbours(edges)
        share = near.join(near.groupBy("src").agg(F.count("*").alias("deg")), "src")
        rank = materialise(rank.join(share, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * alpha / F.col("deg")).alias("rank")))
        best = rank.orderBy(F.desc("rank"), "id").limit(top).withColumn("layer", F.lit(i))
        layers = best if layers is None else layers.unionByName(best)
    return layers.select("layer", "id", "rank")


def triadic(edges: DataFrame, closed: bool = False) -> DataFrame:
    """(a, b, via): friends of friends that are (or are not) direct friends."""
    near = neighbours(edges)
    two = near.select(F.col("src").alias("a"), F.col("dst").alias("via")).join(near.select(F.col("src").alias("via"), F.col("dst").alias("b")), "via").filter("a <> b")
    direct = near.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return two.join(direct, ["a", "b"], "left_semi" if closed else "left_anti")


def top_per(df: DataFrame, group: str, order, n: int) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_k") <= n).drop("_k")
