"""Neighbourhoods, paths, rings and rays: bounded loops of joins over an edge table (src, dst).

Edges are directed; pass ``both(edges)`` for undirected searches. Searches carry their source in a column, so many
sources run in one loop. Ids may be of any type. Loops have a depth bound or run until nothing changes. Searches that
keep what they have found write each round as a table; path expansions are one plan of as many joins as hops.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..tables import materialise


def both(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, parallel edges once."""
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def capped(edges: DataFrame, degree: int) -> DataFrame:
    """At most ``degree`` edges from each vertex, the smallest targets first."""
    return edges.withColumn("_k", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).filter(F.col("_k") <= degree).drop("_k")


def without_super_nodes(edges: DataFrame, most: int) -> DataFrame:
    """Drops the edges of vertices with more than ``most`` edges."""
    hubs = edges.groupBy("src").count().filter(F.col("count") > most).select("src")
    return edges.join(hubs, "src", "left_anti")


def distances(edges: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """(source, id, hops): vertices within ``depth`` hops of each source, the source itself at 0."""
    edges = edges.select("src", "dst").distinct()
    found = sources.select(F.col("source"), F.col("source").alias("id"), F.lit(0).alias("hops")).distinct()
    frontier = found
    for hop in range(1, depth + 1):
        near = frontier.join(edges, F.col("id") == F.col("src")).select("source", F.col("dst").alias("id")).distinct()
        frontier = materialise(near.join(found, ["source", "id"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def k_out(edges: DataFrame, sources: DataFrame, depth: int, nearest: bool = True) -> DataFrame:
    """(source, id): vertices at shortest distance ``depth``, or the ends of walks of that length if not ``nearest``."""
    if nearest:
        return distances(edges, sources, depth).filter(F.col("hops") == depth).select("source", "id")
    edges = edges.select("src", "dst").distinct()
    at = sources.select("source", F.col("source").alias("id")).distinct()
    for _ in range(depth):
        at = at.join(edges, F.col("id") == F.col("src")).select("source", F.col("dst").alias("id")).distinct().filter("id <> source")
    return at


def k_neighbor(edges: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """(source, id, hops): vertices within ``depth`` hops, without the source."""
    return distances(edges, sources, depth).filter("hops > 0")


def walks(edges: DataFrame, sources: DataFrame, low: int, high: int, simple: bool = True) -> DataFrame:
    """(source, id, hops, path): all paths of low .. high hops; no vertex repeats if ``simple``."""
    edges = edges.select("src", "dst")
    at = sources.select("source", F.col("source").alias("id"), F.lit(0).alias("hops"), F.array("source").alias("path"))
    parts = [at] if low == 0 else []
    for hop in range(1, high + 1):
        step = at.join(edges, F.col("id") == F.col("src"))
        step = step.filter(~F.array_contains("path", F.col("dst"))) if simple else step
        at = step.select("source", F.col("dst").alias("id"), F.lit(hop).alias("hops"), F.array_append("path", F.col("dst")).alias("path"))
        if hop >= low:
            parts.append(at)
    return reduce(DataFrame.unionByName, parts)


def trails(edges: DataFrame, sources: DataFrame, low: int, high: int) -> DataFrame:
    """(source, id, hops, path, rels): all paths of low .. high hops over edges (rid, src, dst) in which no relationship
    repeats; vertices may. ``path`` has the vertices and ``rels`` the ids of the relationships in order."""
    edges = edges.select("rid", "src", "dst")
    kind = edges.schema["rid"].dataType.simpleString()
    at = sources.select("source", F.col("source").alias("id"), F.lit(0).alias("hops"), F.array("source").alias("path"), F.array().cast(f"array<{kind}>").alias("rels"))
    parts = [at] if low == 0 else []
    for hop in range(1, high + 1):
        step = at.join(edges, F.col("id") == F.col("src")).filter(~F.array_contains("rels", F.col("rid")))
        at = step.select("source", F.col("dst").alias("id"), F.lit(hop).alias("hops"), F.array_append("path", F.col("dst")).alias("path"), F.array_append("rels", F.col("rid")).alias("rels"))
        if hop >= low:
            parts.append(at)
    return reduce(DataFrame.unionByName, parts)


def either_way(edges: DataFrame) -> DataFrame:
    """Each edge from both its ends with all its columns, parallel edges kept, a loop once."""
    back = edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(c for c in edges.columns if c not in ("src", "dst")))
    return edges.unionByName(back)


def find_paths(edges: DataFrame, source, target, most: int, kinds: list[str] | None = None, excluded: list[str] = ()) -> DataFrame:
    """(path): simple paths between two vertices of at most ``most`` hops, along edges of either direction.

    With ``kinds`` only edges whose ``type`` is among them count, without those ``excluded``. A path stops at the target;
    parallel edges give a path each.
    """
    spark = edges.sparkSession
    edges = edges.filter(F.col("type").isin(kinds)) if kinds is not None else edges
    edges = edges.filter(~F.col("type").isin(list(excluded))) if excluded else edges
    edges = either_way(edges.select("src", "dst")).filter(F.col("src") != F.lit(target))
    start = spark.range(1).select(F.lit(source).alias("source"))
    return walks(edges, start, 1, most).filter(F.col("id") == F.lit(target)).select("path")


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int, single: bool = False) -> DataFrame:
    """(source, target, path): all shortest paths of each pair, or the least one if ``single``.

    Rounds search from the source with visited vertices removed, so each vertex keeps its nearest predecessors only;
    paths are put together backwards from the target over these.
    """
    edges = edges.select("src", "dst").distinct()
    reach = materialise(distances(edges, pairs.select("source"), depth))
    at = pairs.join(reach.withColumnRenamed("id", "target"), ["source", "target"]).select("source", "target", "hops", F.array("target").alias("path"), F.col("target").alias("_at"))
    done = []
    for _ in range(depth + 1):
        done.append(at.filter("hops = 0"))
        step = at.filter("hops > 0").join(edges, F.col("_at") == F.col("dst"))
        before = reach.select("source", F.col("id").alias("src"), F.col("hops").alias("_h"))
        at = step.join(before, ["source", "src"]).filter("_h = hops - 1").select("source", "target", F.col("_h").alias("hops"), F.concat(F.array("src"), "path").alias("path"), F.col("src").alias("_at"))
    out = reduce(DataFrame.unionByName, done).select("source", "target", "path")
    return out.groupBy("source", "target").agg(F.min("path").alias("path")) if single else out


def weighted_distances(edges: DataFrame, sources: DataFrame, default: float = 1.0) -> DataFrame:
    """(source, id, distance): least sums of ``weight`` (null counts as ``default``) by relaxation until nothing falls.

    A negative weight is an error, since a cycle of them has no least sum.
    """
    edges = edges.groupBy("src", "dst").agg(F.min(F.coalesce("weight", F.lit(default))).alias("weight"))
    if not edges.filter("weight < 0").isEmpty():
        raise ValueError("weights must not be negative")
    found = materialise(sources.select("source", F.col("source").alias("id"), F.lit(0.0).alias("distance")).distinct())
    fresh = found
    while True:
        near = fresh.join(edges, F.col("id") == F.col("src")).groupBy("source", F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("weight")).alias("_new"))
        fresh = materialise(near.join(found, ["source", "id"], "left").filter("distance is null or _new < distance").select("source", "id", F.col("_new").alias("distance")))
        if fresh.isEmpty():
            break
        found = materialise(found.unionByName(fresh).groupBy("source", "id").agg(F.min("distance").alias("distance")))
    return found


def rings(edges: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """(source, path): simple cycles of 3 .. depth hops through each source, over undirected edges, once each."""
    pair = both(edges).filter("src <> dst")
    open_ = walks(pair, sources, 2, depth - 1)
    closed = open_.join(pair.select(F.col("src").alias("id"), F.col("dst").alias("source")), ["id", "source"])
    return closed.filter(F.expr("path[1] < path[size(path) - 1]")).select("source", F.array_append("path", F.col("source")).alias("path"))


def rays(edges: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """(source, path): simple paths that cannot go on, or have reached ``depth``."""
    leaves = walks(edges, sources, 1, depth)
    onward = leaves.filter(F.col("hops") < depth).join(edges.select("src", "dst"), F.col("id") == F.col("src")).filter(~F.array_contains("path", F.col("dst"))).select("source", "path").distinct()
    return leaves.join(onward, ["source", "path"], "left_anti").select("source", "path")


def steps(sources: DataFrame, edges: list[DataFrame], simple: bool = True, weight: bool = False) -> DataFrame:
    """(source, id, path[, weight]): one edge table for each step, as filtered by the caller (customised paths).

    With ``weight`` the ``weight`` columns of the steps are added up; a null counts 0.
    """
    at = sources.select("source", F.col("source").alias("id"), F.array("source").alias("path"), F.lit(0.0).alias("weight"))
    for table in edges:
        table = table if "weight" in table.columns else table.withColumn("weight", F.lit(0.0))
        step = at.join(table.select("src", "dst", F.col("weight").alias("_w")), F.col("id") == F.col("src"))
        step = step.filter(~F.array_contains("path", F.col("dst"))) if simple else step
        at = step.select("source", F.col("dst").alias("id"), F.array_append("path", F.col("dst")).alias("path"), (F.col("weight") + F.coalesce("_w", F.lit(0.0))).alias("weight"))
    return at if weight else at.drop("weight")


def template_paths(sources: DataFrame, targets: DataFrame, edges: list[tuple[DataFrame, int]]) -> DataFrame:
    """(source, id, path): steps that may repeat 1 .. n times each, ending at one of ``targets`` (column ``id``)."""
    state = sources.select("source", F.col("source").alias("id"), F.array("source").alias("path"))
    for table, most in edges:
        reached = []
        for _ in range(most):
            state = state.join(table.select("src", "dst"), F.col("id") == F.col("src")).filter(~F.array_contains("path", F.col("dst"))).select("source", F.col("dst").alias("id"), F.array_append("path", F.col("dst")).alias("path"))
            reached.append(state)
        state = reduce(DataFrame.unionByName, reached)
    return state.join(targets.select("id").distinct(), "id", "left_semi").select("source", "id", "path")


def crosspoints(sides: list[DataFrame]) -> DataFrame:
    """(id): the vertices at the end of every one of several searches."""
    return reduce(DataFrame.intersect, [x.select("id") for x in sides])


def step_counts(sources: DataFrame, edges: list[DataFrame], contains_traversed: bool = False) -> DataFrame:
    """(source, edges): the edges met by a list of steps; all of them, or those of the last step."""
    at, counted = sources.select("source", F.col("source").alias("id"), F.lit(1).cast("long").alias("n")), []
    for table in edges:
        at = at.join(table.select("src", "dst"), F.col("id") == F.col("src")).groupBy("source", F.col("dst").alias("id")).agg(F.sum("n").alias("n"))
        counted.append(at.select("source", "n"))
    counted = counted if contains_traversed else counted[-1:]
    return reduce(DataFrame.unionByName, counted).groupBy("source").agg(F.sum("n").alias("edges"))


def related_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose both ends are among ``ids``."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def customized_reach(sources: DataFrame, edges: list[DataFrame], nearest: bool = True) -> DataFrame:
    """(source, id, hops): the vertices after each of a list of steps, each with an edge table of its own.

    ``nearest`` leaves out vertices that an earlier step has reached, the source among them. Filter, cap or weight the
    edges of a step before (``capped``, ``without_super_nodes``).
    """
    found = sources.select("source", F.col("source").alias("id"), F.lit(0).alias("hops")).distinct()
    at, parts = found, []
    for hop, table in enumerate(edges, 1):
        near = at.join(table.select("src", "dst"), F.col("id") == F.col("src")).select("source", F.col("dst").alias("id")).distinct()
        at = materialise((near.join(found, ["source", "id"], "left_anti") if nearest else near).withColumn("hops", F.lit(hop)))
        parts.append(at)
        found = found.unionByName(at)
    return reduce(DataFrame.unionByName, parts)


def customized_k_out(sources: DataFrame, edges: list[DataFrame], nearest: bool = True) -> DataFrame:
    """(source, id): what the last step of ``customized_reach`` reaches."""
    return customized_reach(sources, edges, nearest).filter(F.col("hops") == len(edges)).select("source", "id")


def customized_k_neighbor(sources: DataFrame, edges: list[DataFrame]) -> DataFrame:
    """(source, id, hops): what any step reaches, at its first step."""
    return customized_reach(sources, edges)


def collection_paths(sources: DataFrame, targets: DataFrame, edges: DataFrame, depth: int, nearest: bool = False) -> DataFrame:
    """(source, target, path): simple paths of at most ``depth`` hops from any of some vertices to any of others.

    With ``nearest`` only the shortest of each pair. A path may pass other sources and targets.
    """
    ends = targets.select(F.col("target").alias("id")).distinct()
    found = walks(edges, sources.select("source").distinct(), 1, depth).join(ends, "id", "left_semi")
    if nearest:
        least = found.groupBy("source", "id").agg(F.min("hops").alias("hops"))
        found = found.join(least, ["source", "id", "hops"])
    return found.select("source", F.col("id").alias("target"), "path")


def neighbourhood(edges: DataFrame, ids: DataFrame, direction: str = "both", kinds: list[str] | None = None) -> DataFrame:
    """(origin, neighbour, rid, type): the edges (rid, type, src, dst) of each of ``ids`` as seen from it, a loop once."""
    edges = edges.filter(F.col("type").isin(kinds)) if kinds is not None else edges
    origin = ids.select(F.col("id").alias("origin")).distinct()
    sides = []
    if direction in ("out", "both"):
        sides.append(edges.select(F.col("src").alias("origin"), F.col("dst").alias("neighbour"), "rid", "type"))
    if direction in ("in", "both"):
        back = edges.filter("src <> dst") if direction == "both" else edges
        sides.append(back.select(F.col("dst").alias("origin"), F.col("src").alias("neighbour"), "rid", "type"))
    return reduce(DataFrame.unionByName, sides).join(origin, "origin")


def vertex_query(vertices: DataFrame, edges: DataFrame, ids: DataFrame, direction: str = "both", kinds: list[str] | None = None, where: Column | None = None, edge_where: Column | None = None) -> DataFrame:
    """The vertices next to any of ``ids`` that meet ``where``, each once: a search within a neighbourhood."""
    edges = edges.filter(edge_where) if edge_where is not None else edges
    near = neighbourhood(edges, ids, direction, kinds).select(F.col("neighbour").alias("id")).distinct()
    found = vertices.join(near, "id", "left_semi")
    return found.filter(where) if where is not None else found


def edge_query(edges: DataFrame, ids: DataFrame, direction: str = "both", kinds: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """The edges of any of ``ids`` that meet ``where``, each once."""
    near = neighbourhood(edges, ids, direction, kinds).select("rid", "type").distinct()
    found = edges.join(near, ["rid", "type"], "left_semi")
    return found.filter(where) if where is not None else found


def related_to_all(edges: DataFrame, ids: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(id, n): the vertices next to some of ``ids`` with the number of them; those themselves are left out."""
    near = neighbourhood(edges, ids, "both", kinds).groupBy(F.col("neighbour").alias("id")).agg(F.count_distinct("origin").alias("n"))
    return near.join(ids.select("id").distinct(), "id", "left_anti")
