"""A fluent traversal over a property graph: each step is a DataFrame operation, nothing runs before the end."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..graph import PropertyGraph

#: Predicates for has(): between is [a, b), inside (a, b), outside below a or above b.
P = {
    "eq": lambda c, a: c == a,
    "neq": lambda c, a: c != a,
    "lt": lambda c, a: c < a,
    "lte": lambda c, a: c <= a,
    "gt": lambda c, a: c > a,
    "gte": lambda c, a: c >= a,
    "between": lambda c, a, b: (c >= a) & (c < b),
    "inside": lambda c, a, b: (c > a) & (c < b),
    "outside": lambda c, a, b: (c < a) | (c > b),
    "within": lambda c, *a: c.isin(*a),
    "without": lambda c, *a: ~c.isin(*a),
    "textcontains": lambda c, a: c.contains(a),
    "contains": lambda c, a: F.array_contains(c, a),
    "prefix": lambda c, a: c.startswith(a),
    "regex": lambda c, a: F.rlike(c, F.lit(f"^(?:{a})$")),
    "textcontainsany": lambda c, *a: F.coalesce(reduce(lambda x, y: x | y, [c.contains(w) for w in a]), F.lit(False)),
    "containskey": lambda c, a: F.map_contains_key(c, a),
    "containsvalue": lambda c, a: F.array_contains(F.map_values(c), a),
}


@dataclass(frozen=True)
class Traversal:
    """Traversers are rows (id, n): n of them stand on the node ``id`` of ``label``."""

    graph: PropertyGraph
    label: str
    at: DataFrame

    @staticmethod
    def V(graph: PropertyGraph, label: str, *ids) -> Traversal:  # noqa: N802
        df = graph.node(label)
        df = df.filter(F.col("id").isin(*ids)) if ids else df
        return Traversal(graph, label, df.select("id", F.lit(1).cast("long").alias("n")))

    def has(self, key: str, predicate: str, *values) -> Traversal:
        near = self.graph.node(self.label).filter(P[predicate](F.col(key), *values)).select("id")
        return replace(self, at=self.at.join(near, "id", "left_semi"))

    def where(self, condition: str | Column) -> Traversal:
        return replace(self, at=self.at.join(self.graph.node(self.label).filter(condition).select("id"), "id", "left_semi"))

    def _step(self, kind: str, label: str, near: str, far: str, source: str, target: str, rel_where: str | None) -> Traversal:
        rels = self.graph.rel(kind, source, target)
        rels = rels.filter(rel_where) if rel_where else rels
        # traversers on one node are one row with a count, so that hubs do not multiply rows
        moved = rels.select(F.col(near).alias("id"), F.col(far).alias("_f")).join(self.at, "id").groupBy(F.col("_f").alias("id")).agg(F.sum("n").alias("n"))
        return replace(self, label=label, at=moved)

    def out(self, kind: str, label: str, rel_where: str | None = None) -> Traversal:
        return self._step(kind, label, "src", "dst", self.label, label, rel_where)

    def in_(self, kind: str, label: str, rel_where: str | None = None) -> Traversal:
        return self._step(kind, label, "dst", "src", label, self.label, rel_where)

    def repeat(self, step, times: int) -> Traversal:
        out = self
        for _ in range(times):
            out = step(out)
        return out

    def dedup(self) -> Traversal:
        return replace(self, at=self.at.select("id").distinct().withColumn("n", F.lit(1).cast("long")))

    def count(self) -> DataFrame:
        return self.at.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"))

    def values(self, *keys: str) -> DataFrame:
        """(keys, n): the properties of the nodes with the traversers on them."""
        return self.at.join(self.graph.node(self.label), "id").select(*keys, "n")

    def group_count(self, key: str) -> DataFrame:
        return self.values(key).groupBy(key).agg(F.sum("n").alias("count"))

    def metric(self, key: str, kind: str) -> DataFrame:
        """max, min, sum or mean of a property over the traversers."""
        v = F.col(key)
        made = {"max": F.max(v), "min": F.min(v), "sum": F.sum(v * F.col("n")), "mean": F.sum(v * F.col("n")) / F.sum("n")}
        return self.values(key).agg(made[kind].alias(kind))

    def order(self, key: str, limit: int, descending: bool = False) -> DataFrame:
        """The first ``limit`` nodes by a property, ties by id."""
        rows = self.at.join(self.graph.node(self.label), "id")
        return rows.orderBy(F.desc_nulls_last(key) if descending else F.asc_nulls_last(key), "id").limit(limit).select("id", key, "n")

    def group(self, key: str, value: str) -> DataFrame:
        """(key, values): the sorted property values of the traversers by another property, one for each traverser."""
        rows = self.values(key, value).withColumn("_v", F.explode(F.array_repeat(value, F.col("n").cast("int"))))
        return rows.groupBy(key).agg(F.sort_array(F.collect_list("_v")).alias("values"))

    def project(self, **columns: str) -> DataFrame:
        """Named expressions over the properties of the nodes, with the traversers on them."""
        rows = self.at.join(self.graph.node(self.label), "id")
        return rows.select(*(F.expr(e).alias(k) for k, e in columns.items()), "n")

    def both(self, kind: str, label: str) -> Traversal:
        """Along a type in either direction, between nodes of this label and ``label``."""
        ways = [getattr(self, step)(kind, label) for step, ends in (("out", (self.label, label)), ("in_", (label, self.label))) if self.graph.has_rel(kind, *ends)]
        at = reduce(DataFrame.unionByName, [w.at for w in ways]).groupBy("id").agg(F.sum("n").alias("n"))
        return replace(self, label=label, at=at)

    def path(self, *steps: tuple[str, str, str]) -> DataFrame:
        """(path): the ids met on the way of steps (direction, type, label), one row for each way of each traverser."""
        rows = self.at.select("id", F.array("id").alias("path"), "n")
        near = self.label
        for direction, kind, label in steps:
            source, target, a, b = (near, label, "src", "dst") if direction == "out" else (label, near, "dst", "src")
            rels = self.graph.rel(kind, source, target).select(F.col(a).alias("id"), F.col(b).alias("_f"))
            rows = rows.join(rels, "id").select(F.col("_f").alias("id"), F.array_append("path", F.col("_f")).alias("path"), "n")
            near = label
        return rows.select("path", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("path")
