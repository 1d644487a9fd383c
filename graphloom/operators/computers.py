"""Whole-graph analytics as loops of joins and aggregations over (src, dst[, weight])."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..tables import materialise


def page_rank(edges: DataFrame, alpha: float = 0.15, rounds: int = 10, precision: float = 1e-4) -> DataFrame:
    """(id, rank): rank = alpha / n + (1 - alpha) * incoming, dangling ranks spread evenly; stops below ``precision``.

    Parallel edges count once. Only sums of ranks come to the driver.
    """
    edges = edges.select("src", "dst").distinct()
    nodes = materialise(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    out = materialise(edges.join(edges.groupBy("src").agg(F.count("*").alias("deg")), "src"))
    sinks = materialise(nodes.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti"))
    rank = nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        lost = rank.join(sinks, "id", "left_semi").agg(F.sum("rank")).first()[0] or 0.0
        flow = out.join(rank, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("deg")).alias("in"))
        new = rank.withColumnRenamed("rank", "old").join(flow, "id", "left").select("id", "old", (F.lit(alpha / n + (1 - alpha) * lost / n) + (1 - alpha) * F.coalesce("in", F.lit(0.0))).alias("rank"))
        new = materialise(new)
        moved = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        rank = new.select("id", "rank")
        if moved < precision:
            break
    return rank


#: The places that a label is dealt to, so that a giant component is no hot key, and the most rows that are broadcast.
SALTS, BROADCAST_ROWS = 16, 20_000


def _looked_up(many: DataFrame, few: DataFrame, on: str, by: str, how: str = "inner", salts: int = 1) -> DataFrame:
    """``many`` joined with ``few``, a written table with one row for a value of ``on``: broadcast if it has at most
    BROADCAST_ROWS rows, else merged, in ``salts`` places by ``by``. Rows are counted, since ids and labels shrink so well in
    files that their size says little of what a broadcast takes in the driver."""
    if few.count() <= BROADCAST_ROWS:
        return many.join(F.broadcast(few), on, how)
    if salts == 1:
        return many.join(few.hint("merge"), on, how)
    places = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(places, [on, "_salt"], how).drop("_salt")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that is reachable over undirected edges; labels spread and jump.

    Rounds run until no label changes, about the logarithm of the longest way. A vertex of many edges adds up before the
    shuffle; the look-up of a label's own label is salted, since a component of any size has one label. Only labels that
    some vertex has are looked up.
    """
    ends = F.array(*(F.struct(F.col(a).alias("id"), F.col(b).alias("near")) for a, b in (("src", "dst"), ("dst", "src"), ("src", "src"), ("dst", "dst"))))
    pair = materialise(edges.select(F.explode(ends).alias("e")).select("e.*").distinct())
    label = materialise(pair.groupBy("id").agg(F.min("near").alias("component")))
    while True:
        # a vertex is near itself, which tells the label that it had
        own = F.min(F.when(F.col("id") == F.col("near"), F.col("component"))).alias("was")
        spread = materialise(_looked_up(pair, label.withColumnRenamed("id", "near"), "near", "id").groupBy("id").agg(F.min("component").alias("component"), own))
        # only labels that are not their own label lead on
        held = spread.select("component").distinct().hint("merge")
        jump = materialise(label.filter("id <> component").select(F.col("id").alias("component"), F.col("component").alias("far")).join(held, "component", "left_semi"))
        joined = _looked_up(spread, jump, "component", "id", "left", SALTS)
        new = materialise(joined.select("id", F.least("component", "far").alias("component"), "was"))
        if new.filter("component <> was").isEmpty():
            return new.select("id", "component")
        label = new.select("id", "component")


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, label): each vertex takes the most frequent label of its neighbours, the smallest of equals, all at once."""
    pair = materialise(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    label = materialise(pair.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")))
    for _ in range(rounds):
        votes = _looked_up(pair, label.withColumnRenamed("id", "dst"), "dst", "src").groupBy("src", "label").agg(F.count("*").alias("n"))
        label = materialise(votes.groupBy("src").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label")).withColumnRenamed("src", "id"))
    return label


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c): each triangle of the undirected graph once. Edges point from the lower to the higher degree, which
    bounds the out-degree by the square root of the edges and keeps hubs from joining with themselves."""
    pair = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    degree = pair.select(F.col("a").alias("id")).union(pair.select("b")).groupBy("id").agg(F.count("*").alias("deg"))
    ranked = pair.join(degree.select(F.col("id").alias("a"), F.col("deg").alias("da")), "a").join(degree.select(F.col("id").alias("b"), F.col("deg").alias("db")), "b")
    forward = F.struct("da", "a") < F.struct("db", "b")
    arc = materialise(ranked.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("y")))
    wedge = arc.join(arc.withColumnRenamed("y", "z"), "x").filter("y < z")
    last = arc.select(F.least("x", "y").alias("y"), F.greatest("x", "y").alias("z"))
    found = wedge.join(last, ["y", "z"])
    return found.select(F.sort_array(F.array("x", "y", "z")).alias("t")).selectExpr("t[0] AS a", "t[1] AS b", "t[2] AS c")


def triangle_count(edges: DataFrame) -> DataFrame:
    """(id, triangles) for each vertex in a triangle."""
    return triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(modularity) of (id, community) over undirected weighted edges (src, dst, weight), each given once."""
    ends = edges.select(F.col("src").alias("id"), "weight").union(edges.select("dst", "weight"))
    total = edges.agg((2 * F.sum("weight")).alias("m2"))
    degree = ends.join(communities, "id").groupBy("community").agg(F.sum("weight").alias("d"))
    of = lambda end: communities.select(F.col("id").alias(end), F.col("community").alias(f"c_{end}"))
    inner = edges.join(of("src"), "src").join(of("dst"), "dst").filter("c_src = c_dst").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w"))
    spread = degree.crossJoin(total).agg(F.sum(F.pow(F.col("d") / F.col("m2"), 2)).alias("s"))  # total is one row
    return inner.crossJoin(total).crossJoin(spread).select((2 * F.col("w") / F.col("m2") - F.col("s")).alias("modularity"))


def louvain(edges: DataFrame, levels: int = 3, rounds: int = 6) -> DataFrame:
    """(id, community): greedy modularity gains, level by level (src, dst, weight; undirected, each edge once).

    In a round every vertex looks for the neighbouring community with the largest gain; only moves to a community with
    a smaller name happen in even rounds and to a larger one in odd rounds, so that two vertices do not swap for ever.
    Then communities become vertices of the next level, their inner weight a loop.
    """
    at = materialise(edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight")))
    names = None
    m2 = at.agg(2 * F.sum("weight")).first()[0]
    for _ in range(levels):
        ends = at.select("src", "dst", "weight").union(at.select("dst", "src", "weight"))
        degree = materialise(ends.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k")))
        pair = materialise(ends.filter("src <> dst"))
        many = degree.count() > BROADCAST_ROWS
        # tables with a row for a vertex; the size of their files says little of what a broadcast takes in the driver
        sized = lambda df, many=many: df.hint("merge") if many else df
        label = degree.select("id", F.col("id").alias("community"))
        for turn in range(rounds):
            size = label.join(sized(degree), "id").groupBy("community").agg(F.sum("k").alias("tot"))
            links = pair.join(sized(label.select(F.col("id").alias("dst"), F.col("community").alias("to"))), "dst").groupBy("src", "to").agg(F.sum("weight").alias("w"))
            here = label.join(sized(degree), "id").join(sized(size), "community").select(F.col("id").alias("src"), "community", "k", (F.col("tot") - F.col("k")).alias("rest"))
            own = links.withColumnRenamed("to", "community").withColumnRenamed("w", "w_own")
            gains = links.join(sized(here), "src").join(sized(own), ["src", "community"], "left").join(sized(size.withColumnRenamed("community", "to")), "to").filter(F.col("to") < F.col("community") if turn % 2 == 0 else F.col("to") > F.col("community"))
            gain = F.expr(f"w - k * tot / {m2} - (coalesce(w_own, 0) - k * rest / {m2})")
            best = gains.withColumn("gain", gain).filter("gain > 1e-9").groupBy("src").agg(F.min_by("to", F.struct(-F.col("gain"), F.col("to"))).alias("to"))
            new = materialise(label.join(sized(best), F.col("id") == F.col("src"), "left").select("id", F.coalesce("to", "community").alias("community")))
            still = new.join(sized(label), ["id", "community"], "left_anti").isEmpty()
            label = new
            if still and turn:
                break
        names = label if names is None else names.join(sized(label.select(F.col("id").alias("community"), F.col("community").alias("up"))), "community").select("id", F.col("up").alias("community"))
        names = materialise(names)
        of = lambda end, label=label, sized=sized: sized(label.select(F.col("id").alias(end), F.col("community").alias(f"c_{end}")))
        merged = at.join(of("src"), "src").join(of("dst"), "dst").groupBy(F.least("c_src", "c_dst").alias("src"), F.greatest("c_src", "c_dst").alias("dst")).agg(F.sum("weight").alias("weight"))
        at = materialise(merged)
    return names
