"""The property graph: typed node and relationship tables, and pattern matching over them as joins."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class RelSpec:
    """One table of relationships: columns rid, src, dst and properties, between nodes of two labels."""

    source: str
    target: str
    frame: DataFrame


@dataclass
class PropertyGraph:
    """Nodes by label (column ``id`` and properties) and relationships by type. A node has one label."""

    nodes: dict[str, DataFrame] = field(default_factory=dict)
    rels: dict[str, list[RelSpec]] = field(default_factory=dict)

    def node(self, label: str) -> DataFrame:
        return self.nodes[label]

    def all_nodes(self) -> DataFrame:
        """(label, id): every node."""
        parts = [df.select(F.lit(label).alias("label"), F.col("id").cast("long")) for label, df in self.nodes.items()]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def rel(self, kind: str, source: str | None = None, target: str | None = None) -> DataFrame:
        """Relationships of a type between labels; tables of other labels are not read."""
        parts = [x.frame for x in self.rels[kind] if source in (None, x.source) and target in (None, x.target)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out

    def has_rel(self, kind: str, source: str | None = None, target: str | None = None) -> bool:
        return any(source in (None, x.source) and target in (None, x.target) for x in self.rels[kind])

    def all_rels(self) -> DataFrame:
        """(type, source, src, target, dst): every relationship."""
        parts = [x.frame.select(F.lit(kind).alias("type"), F.lit(x.source).alias("source"), F.col("src").cast("long"), F.lit(x.target).alias("target"), F.col("dst").cast("long")) for kind, specs in self.rels.items() for x in specs]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def edges(self, *kinds: str) -> DataFrame:
        """(src, dst) with ids made unique over labels, as "label:id"; all types if none is named."""
        df = self.all_rels()
        df = df.filter(F.col("type").isin(*kinds)) if kinds else df
        return df.select(F.concat_ws(":", F.lower("source"), F.col("src")).alias("src"), F.concat_ws(":", F.lower("target"), F.col("dst")).alias("dst"), "type")


def relationships_by_ids(rels: DataFrame, ids: list, directed: bool = True) -> DataFrame:
    """(rid, start, end, ...) of the given relationships; undirected, each one from both ends (a loop once)."""
    found = rels.filter(F.col("rid").isin(ids)).withColumnsRenamed({"src": "start", "dst": "end"})
    if directed:
        return found
    back = found.filter("start <> end").select(F.col("end").alias("start"), F.col("start").alias("end"), *(c for c in found.columns if c not in ("start", "end")))
    return found.unionByName(back)


def relationships_in_range(rels: DataFrame, low, high, by: str = "rid") -> DataFrame:
    """The relationships with an id, or another property such as an end time, in a closed range; an open side is None."""
    found = rels if low is None else rels.filter(F.col(by) >= F.lit(low))
    return found if high is None else found.filter(F.col(by) <= F.lit(high))


def conditional_apply(rows: DataFrame, condition: str | Column, apply, otherwise=None) -> DataFrame:
    """Rows that meet the condition go through ``apply`` (a function of frames), the others through ``otherwise`` or on as
    they are; columns that one side lacks are null. A condition that is null is not met."""
    met = F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False))
    rest = rows.filter(~met)
    return apply(rows.filter(met)).unionByName(otherwise(rest) if otherwise else rest, allowMissingColumns=True)


def prop(var: str, name: str) -> Column:
    """A property of a pattern variable."""
    return F.col(f"{var}__{name}")


def bind(df: DataFrame, var: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{var}__{c}") for c in df.columns))


@dataclass(frozen=True)
class Match:
    """A pattern that grows by joins; immutable. Columns are ``variable__property``.

    Within a clause two variables never bind one relationship, nodes may repeat; ``clause`` begins another one, and an
    optional step is a clause of its own. A filter on a node or relationship goes below the join, so Catalyst pushes it
    into the scan and prunes the columns.
    """

    graph: PropertyGraph
    frame: DataFrame | None = None
    labels: tuple[tuple[str, str], ...] = ()
    used: tuple[tuple[str, str], ...] = ()
    steps: int = 0

    def clause(self) -> Match:
        """The next MATCH: its relationships may be those of the clauses before."""
        return replace(self, used=())

    def node(self, var: str, label: str, where: str | None = None) -> Match:
        """Starts a pattern, or adds a disconnected node: every combination, as in the pattern language."""
        df = self.graph.node(label)
        df = bind(df.filter(where) if where else df, var)
        frame = df if self.frame is None else self.frame.crossJoin(df)
        return replace(self, frame=frame, labels=(*self.labels, (var, label)))

    def _ends(self, kind: str, direction: str, near: str, far: str | None) -> DataFrame:
        """Relationships with the near end in _n and the far end in _f."""
        sides = []
        if direction in ("out", "both") and self.graph.has_rel(kind, near, far):
            sides.append(self.graph.rel(kind, near, far).withColumnsRenamed({"src": "_n", "dst": "_f"}))
        if direction in ("in", "both") and self.graph.has_rel(kind, far, near):
            back = self.graph.rel(kind, far, near).withColumnsRenamed({"dst": "_n", "src": "_f"})
            # a loop is met once from a node
            sides.append(back.filter("_n <> _f") if direction == "both" else back)
        return sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])

    def expand(self, start: str, kind: str, end: str, label: str | None = None, direction: str = "out", rel: str | None = None, where: str | None = None, rel_where: str | None = None, optional: bool = False) -> Match:
        """Follows relationships from a bound variable; ``end`` may be bound already (then both ends are joined)."""
        labels = dict(self.labels)
        label = labels.get(end, label)
        ends = self._ends(kind, direction, labels[start], label)
        ends = ends.filter(rel_where) if rel_where else ends
        rel = rel or f"_r{self.steps}"
        step = ends.select(F.col("_n").alias(f"_n_{rel}"), F.col("_f").alias(f"_f_{rel}"), *(F.col(c).alias(f"{rel}__{c}") for c in ends.columns if c not in ("_n", "_f")))
        on = F.col(f"{start}__id") == F.col(f"_n_{rel}")
        if end in labels:
            on = on & (F.col(f"{end}__id") == F.col(f"_f_{rel}"))
        else:
            if label is None:
                step = step.withColumnRenamed(f"_f_{rel}", f"{end}__id")
            else:
                node = self.graph.node(label)
                node = bind(node.filter(where) if where else node, end)
                step = step.join(node, F.col(f"_f_{rel}") == F.col(f"{end}__id")).drop(f"_f_{rel}")
        for other, other_kind in self.used:
            if other_kind == kind and not optional:
                on = on & (F.col(f"{rel}__rid") != F.col(f"{other}__rid"))
        frame = self.frame.join(step, on, "left" if optional else "inner").drop(f"_n_{rel}", f"_f_{rel}")
        return replace(self, frame=frame, labels=(*self.labels, *(((end, label or ""),) if end not in labels else ())), used=() if optional else (*self.used, (rel, kind)), steps=self.steps + 1)

    def endpoints(self, rel: DataFrame, kind: str, var: str, start: str, end: str, labels: tuple[str, str]) -> Match:
        """Binds given relationships of a type and both their nodes (ProjectEndpoints)."""
        bound = rel.select(F.col("src").alias(f"_s_{var}"), F.col("dst").alias(f"_t_{var}"), *(F.col(c).alias(f"{var}__{c}") for c in rel.columns if c not in ("src", "dst")))
        for name, label, column in ((start, labels[0], f"_s_{var}"), (end, labels[1], f"_t_{var}")):
            bound = bound.join(bind(self.graph.node(label), name), F.col(column) == F.col(f"{name}__id")).drop(column)
        return replace(self, frame=bound, labels=((start, labels[0]), (end, labels[1])), used=((var, kind),), steps=self.steps + 1)

    def same(self, a: str, b: str) -> Match:
        """Fails where two variables are bound to different nodes (AssertSameNode)."""
        check = F.when(F.col(f"{a}__id").eqNullSafe(F.col(f"{b}__id")), True).otherwise(F.raise_error(F.lit(f"{a} and {b} are different nodes")).cast("boolean"))
        return replace(self, frame=self.frame.filter(check))

    def where(self, condition: str | Column) -> Match:
        return replace(self, frame=self.frame.filter(condition))

    def _exists(self, start: str, kind: str, direction: str, label: str | None, where: str | None, rel_where: str | None) -> DataFrame:
        ends = self._ends(kind, direction, dict(self.labels)[start], label)
        ends = ends.filter(rel_where) if rel_where else ends
        if label and where:
            ends = ends.join(self.graph.node(label).filter(where).select(F.col("id").alias("_f")), "_f", "left_semi")
        return ends.select(F.col("_n").alias("_e"))

    def exists(self, start: str, kind: str, direction: str = "out", label: str | None = None, where: str | None = None, rel_where: str | None = None, negate: bool = False) -> Match:
        """Pattern predicate: keeps rows with (or without) such a relationship, as a semi or anti join."""
        ends = self._exists(start, kind, direction, label, where, rel_where)
        return replace(self, frame=self.frame.join(ends, F.col(f"{start}__id") == F.col("_e"), "left_anti" if negate else "left_semi"))

    def flag(self, name: str, start: str, kind: str, direction: str = "out", label: str | None = None, where: str | None = None, rel_where: str | None = None) -> Match:
        """Binds whether such a relationship exists, for use in OR and in results."""
        ends = self._exists(start, kind, direction, label, where, rel_where).distinct()
        frame = self.frame.join(ends, F.col(f"{start}__id") == F.col("_e"), "left").withColumn(name, F.col("_e").isNotNull()).drop("_e")
        return replace(self, frame=frame)

    def degree(self, name: str, start: str, kind: str, direction: str = "out", label: str | None = None) -> Match:
        """Binds the number of relationships; counted before the join."""
        ends = self._ends(kind, direction, dict(self.labels)[start], label).groupBy(F.col("_n").alias("_d")).agg(F.count("*").alias(name))
        frame = self.frame.join(ends, F.col(f"{start}__id") == F.col("_d"), "left").drop("_d").withColumn(name, F.coalesce(name, F.lit(0)))
        return replace(self, frame=frame)

    def roll_up(self, name: str, start: str, kind: str, value: str, direction: str = "out", label: str | None = None, where: str | None = None) -> Match:
        """Pattern comprehension: the sorted list of ``value`` over the matches from ``start``; empty if none."""
        ends = self._ends(kind, direction, dict(self.labels)[start], label)
        if label:
            node = self.graph.node(label)
            ends = ends.join((node.filter(where) if where else node).withColumnRenamed("id", "_f"), "_f")
        lists = ends.groupBy(F.col("_n").alias("_l")).agg(F.sort_array(F.collect_list(F.expr(value))).alias(name))
        frame = self.frame.join(lists, F.col(f"{start}__id") == F.col("_l"), "left").drop("_l")
        return replace(self, frame=frame.withColumn(name, F.coalesce(name, F.array().cast(frame.schema[name].dataType))))

    def select(self, **columns: str | Column) -> DataFrame:
        """RETURN: named expressions over the bound variables."""
        return self.frame.select(*((F.expr(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()))


def tpch_graph(spark: SparkSession, folder: str) -> PropertyGraph:
    """The star-schema tables as a graph; foreign keys and line items are the relationships."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    keys = {"Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Supplier": ("supplier", "s_suppkey"), "Part": ("part", "p_partkey"), "Order": ("orders", "o_orderkey")}
    nodes = {label: (df := read(table)).withColumn("id", F.col(key).cast("long")) for label, (table, key) in keys.items()}
    # a row has one foreign key of a kind, so its own key names the relationship; ``side`` tells two tables of a type apart
    link = lambda df, key, src, dst, side=0: df.select((F.col(key).cast("long") * 2 + side).alias("rid"), F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))
    items = read("lineitem")
    # line items have no key: order and line may repeat, the rest of the row tells them apart
    rid = F.struct("l_orderkey", "l_linenumber", F.xxhash64(*items.columns).alias("row")).alias("rid")
    props = [F.col(c).alias(c[2:]) for c in items.columns if c not in ("l_orderkey", "l_partkey", "l_suppkey")]
    item = lambda key: items.select(rid, F.col("l_orderkey").cast("long").alias("src"), F.col(key).cast("long").alias("dst"), *props)
    return PropertyGraph(
        nodes,
        {
            "IN_REGION": [RelSpec("Nation", "Region", link(nodes["Nation"], "n_nationkey", "n_nationkey", "n_regionkey"))],
            "FROM_NATION": [RelSpec("Customer", "Nation", link(nodes["Customer"], "c_custkey", "c_custkey", "c_nationkey")), RelSpec("Supplier", "Nation", link(nodes["Supplier"], "s_suppkey", "s_suppkey", "s_nationkey", 1))],
            "PLACED": [RelSpec("Customer", "Order", link(nodes["Order"], "o_orderkey", "o_custkey", "o_orderkey"))],
            "CONTAINS": [RelSpec("Order", "Part", item("l_partkey"))],
            "SHIPPED_BY": [RelSpec("Order", "Supplier", item("l_suppkey"))],
        },
    )
