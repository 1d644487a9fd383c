"""Writes as new versions: each function takes immutable frames and returns the frames after the write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def create(elements: DataFrame, new: DataFrame) -> DataFrame:
    """CREATE: appends rows; missing properties are null."""
    return elements.unionByName(new, allowMissingColumns=True)


def merge(elements: DataFrame, keys: DataFrame, on: list[str], on_create: dict[str, Column], on_match: dict[str, Column]) -> DataFrame:
    """MERGE: rows of ``keys`` that exist are matched and set, the others are created."""
    marked = keys.select(*on).distinct().withColumn("_m", F.lit(True))
    joined = elements.join(marked, on, "left")
    matched = joined.select(*(F.when(F.col("_m"), on_match[c]).otherwise(F.col(c)).alias(c) if c in on_match else F.col(c) for c in elements.columns))
    fresh = keys.select(*on).distinct().join(elements.select(*on), on, "left_anti")
    return matched.unionByName(fresh.select(*on, *(e.alias(c) for c, e in on_create.items() if c not in on)), allowMissingColumns=True)


def set_properties(elements: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """SET; a null value removes the property."""
    return elements.select(*(F.when(where, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in elements.columns), *(F.when(where, v).alias(c) for c, v in values.items() if c not in elements.columns))


def set_map(elements: DataFrame, where: Column, column: str, values: Column, replace: bool = False) -> DataFrame:
    """SET n = map or n += map, for properties kept in a map column; null values remove keys."""
    old = F.col(column)
    merged = values if replace else F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(values), k)), values)
    return elements.withColumn(column, F.when(where, F.map_filter(merged, lambda _, v: v.isNotNull())).otherwise(old))


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame, detach: bool = True) -> tuple[DataFrame, DataFrame]:
    """DELETE or DETACH DELETE: the nodes that stay, and the edges that stay if their ends do."""
    gone = ids.select("id").distinct()
    left = nodes.join(gone, "id", "left_anti")
    if not detach:
        return left, edges
    return left, edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")


def latest(changes: DataFrame, key: str, ts: str = "ts", until=None) -> DataFrame:
    """The live rows of a change log (columns key, ts, deleted): the last write of each key, up to a time if given.

    Of writes at the same time the one with the larger other columns counts, so the result does not change between runs.
    """
    changes = changes.filter(F.col(ts) <= until) if until is not None else changes
    order = F.struct(ts, *sorted(c for c in changes.columns if c not in (key, ts)))
    last = changes.groupBy(key).agg(F.max_by(F.struct(*changes.columns), order).alias("_l"))
    return last.select("_l.*").filter("not deleted")


def expired(elements: DataFrame, expires: str, now) -> DataFrame:
    """TTL: the rows that are still alive."""
    return elements.filter(F.col(expires).isNull() | (F.col(expires) > now))


def violations(elements: DataFrame, unique: list[str] = (), required: list[str] = ()) -> DataFrame:
    """(rule, n): rows that break uniqueness or existence constraints."""
    parts = []
    if unique:
        parts.append(elements.dropna(subset=list(unique)).groupBy(*unique).count().filter("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).select(F.lit("unique").alias("rule"), "n"))
    parts += [elements.agg(F.count(F.when(F.col(c).isNull(), 1)).alias("n")).select(F.lit(f"exists {c}").alias("rule"), "n") for c in required]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def merge_relationships(rels: DataFrame, pairs: DataFrame, rid: Column, on_create: dict[str, Column], on_match: dict[str, Column]) -> DataFrame:
    """MERGE of relationships by their ends: pairs (src, dst) that are linked are set, the others are linked.

    ``rid`` makes the id of a new relationship from src and dst.
    """
    return merge(rels, pairs, ["src", "dst"], {"rid": rid, **on_create}, on_match)


def delete_relationships(rels: DataFrame, ids: DataFrame) -> DataFrame:
    """DELETE r: the relationships that stay."""
    return rels.join(ids.select("rid").distinct(), "rid", "left_anti")


def delete_paths(nodes: DataFrame, rels: DataFrame, paths: DataFrame, detach: bool = False) -> tuple[DataFrame, DataFrame]:
    """DELETE p: the nodes and relationships that stay when those of ``paths`` (path, rels) go."""
    gone = paths.select(F.explode("path").alias("id"))
    left = delete_relationships(rels, paths.select(F.explode("rels").alias("rid")))
    return delete_nodes(nodes, left, gone, detach)


def delete_elements(nodes: DataFrame, rels: DataFrame, ids: DataFrame, rids: DataFrame, detach: bool = False) -> tuple[DataFrame, DataFrame]:
    """DELETE of whatever an expression gives: the nodes (id) and relationships (rid) that stay."""
    return delete_nodes(nodes, delete_relationships(rels, rids), ids, detach)


def set_labels(nodes: DataFrame, where: Column, names: list[str]) -> DataFrame:
    """SET n:A:B for nodes that keep their labels in an array ``labels``."""
    return nodes.withColumn("labels", F.when(where, F.array_union("labels", F.array(*(F.lit(x) for x in names)))).otherwise(F.col("labels")))


def remove_labels(nodes: DataFrame, where: Column, names: list[str]) -> DataFrame:
    """REMOVE n:A:B."""
    return nodes.withColumn("labels", F.when(where, F.array_except("labels", F.array(*(F.lit(x) for x in names)))).otherwise(F.col("labels")))


def foreach_set(elements: DataFrame, items: Column, column: str, update) -> DataFrame:
    """FOREACH (x IN items | SET n.column = update(n.column, x)): one after the other, within the row."""
    return elements.withColumn(column, F.aggregate(F.coalesce(items, F.array().cast(elements.select(items.alias("i")).schema["i"].dataType)), F.col(column), update))


def foreach_create(rows: DataFrame, items: Column, name: str, values: dict[str, Column]) -> DataFrame:
    """FOREACH (x IN items | CREATE (values)): the new elements; ``values`` may name the item."""
    return rows.select("*", F.explode(items).alias(name)).select(*(v.alias(c) for c, v in values.items()))


def change_events(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """(key, event, property, old, new): what a write has changed, between two versions of the elements.

    Events are added, deleted, property set, property changed and property removed; values are text.
    """
    names = [c for c in after.columns if c != key and c in before.columns]
    old = before.select(key, F.struct(*names).alias("_o"), F.lit(True).alias("_b"))
    new = after.select(key, F.struct(*names).alias("_n"), F.lit(True).alias("_a"))
    both = old.join(new, key, "full")
    value = lambda side, c: F.when(F.col(side).isNotNull(), F.col(f"{side}.{c}").cast("string"))
    whole = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "deleted")
    empty = F.lit(None).cast("string")
    parts = [F.struct(whole.alias("event"), empty.alias("property"), empty.alias("old"), empty.alias("new"))]
    for c in names:
        o, n = value("_o", c), value("_n", c)
        event = F.when(o.eqNullSafe(n) | F.col("_a").isNull(), empty).when(o.isNull(), "property set").when(n.isNull(), "property removed").otherwise("property changed")
        parts.append(F.struct(event.alias("event"), F.lit(c).alias("property"), o.alias("old"), n.alias("new")))
    return both.select(key, F.explode(F.array(*parts)).alias("e")).select(key, "e.*").filter("event is not null")


def history(changes: DataFrame, key: str, low=None, high=None, ts: str = "ts") -> DataFrame:
    """The writes of each key in a time range with ``until``, the time of the next write (null for the last one)."""
    order = Window.partitionBy(key).orderBy(ts, *sorted(c for c in changes.columns if c not in (key, ts)))
    found = changes.withColumn("until", F.lead(ts).over(order))
    found = found if low is None else found.filter(F.col(ts) >= F.lit(low))
    return found if high is None else found.filter(F.col(ts) <= F.lit(high))


def shown(elements: DataFrame, marks: DataFrame, key: str = "id", ts: str = "ts") -> DataFrame:
    """The elements that are not hidden: ``marks`` (key, ts, hidden) are hides and unhides, of which the last counts."""
    last = marks.groupBy(key).agg(F.max_by("hidden", F.struct(ts, "hidden")).alias("_h")).filter("_h").select(key)
    return elements.join(last, key, "left_anti")


def fetched(elements: DataFrame, properties: list[str], key: str = "id") -> DataFrame:
    """Fetch hints: only these properties, so that scans read no others."""
    return elements.select(key, *(c for c in properties if c in elements.columns))
