"""Search runs: one call that filters, sorts, pages and counts elements by a plain dictionary of options."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import search as Q
from .aggregations import from_options, search_page

#: Options of a filter by predicate, as Columns over a property.
PREDICATES = {
    "=": lambda c, v: Q.compare(c, "EQUAL", v[0]),
    "!=": lambda c, v: Q.compare(c, "NOT_EQUAL", v[0]),
    ">": lambda c, v: Q.compare(c, "GREATER_THAN", v[0]),
    ">=": lambda c, v: Q.compare(c, "GREATER_THAN_EQUAL", v[0]),
    "<": lambda c, v: Q.compare(c, "LESS_THAN", v[0]),
    "<=": lambda c, v: Q.compare(c, "LESS_THAN_EQUAL", v[0]),
    "in": lambda c, v: Q.compare(c, "IN", v),
    "range": lambda c, v: Q.between(c, v[0], v[1]),
    "contains": lambda c, v: Q.text_contains(c, v[0]),
    "startsWith": lambda c, v: Q.compare(c, "STARTS_WITH", v[0]),
    "has": lambda c, v: Q.has(c),
    "hasNot": lambda c, v: Q.lacks(c),
}


def any_text(df: DataFrame, query: str) -> Column:
    """The words of a query string are all among the words of one or the other text property."""
    columns = [F.col(c) for c, t in df.dtypes if t == "string"]
    words = query.lower().split()
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [Q.term(c, w) for c in columns], F.lit(False)) for w in words], F.lit(True))


def condition(df: DataFrame, options: dict) -> Column:
    """What ``q`` and ``filter`` of the options ask for."""
    tests = [PREDICATES[f["predicate"]](F.col(f["propertyId"]), f.get("values", [])) for f in options.get("filter", [])]
    if options.get("q", "*") != "*":
        tests.append(any_text(df, options["q"]))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def run(df: DataFrame, options: dict, key: str = "id") -> DataFrame:
    """The page of the hits with ``total_hits``: q, filter, sort (["name:DESCENDING"]), offset and size (-1: all).

    Ties of the order are broken by the key, so that pages do not overlap.
    """
    hits = df.filter(condition(df, options))
    order = [(F.desc_nulls_last if way.startswith("DESC") else F.asc_nulls_last)(name) for name, _, way in (x.partition(":") for x in options.get("sort", []))]
    size = options.get("size", 100)
    if size == -1:
        return hits.crossJoin(hits.agg(F.count("*").alias("total_hits")))  # one row
    return search_page(hits, [*order, F.asc(key)], options.get("offset", 0), size)


def aggregations(df: DataFrame, options: dict) -> DataFrame:
    """(name, key, n, value): the aggregations of the options over all hits, whatever the page."""
    return from_options(df.filter(condition(df, options)), options["aggregations"])


def vertex_search(graph, options: dict) -> DataFrame:
    """A run over the nodes of a concept type (``conceptType``)."""
    return run(graph.node(options["conceptType"]), options)


def edge_search(graph, options: dict, key: str = "rid") -> DataFrame:
    """A run over the relationships of a type (``edgeLabel``)."""
    return run(graph.rel(options["edgeLabel"]), options, key)


def element_search(graph, options: dict) -> DataFrame:
    """(kind, type, id, total_hits): a run over the ids of all nodes and relationships that have these properties."""
    nodes = [(("vertex", label), df) for label, df in graph.nodes.items()]
    rels = [(("edge", kind), x.frame.withColumnRenamed("rid", "id")) for kind, specs in graph.rels.items() for x in specs]
    wanted = {f["propertyId"] for f in options.get("filter", [])}
    parts = [df.filter(condition(df, options)).select(F.lit(kind).alias("kind"), F.lit(name).alias("type"), F.col("id").cast("string").alias("id")) for (kind, name), df in nodes + rels if wanted <= set(df.columns)]
    return run(reduce(DataFrame.unionByName, parts), {k: v for k, v in options.items() if k not in ("filter", "q")})


def extended_data_search(rows: DataFrame, options: dict, key: str = "row_id") -> DataFrame:
    """A run over the rows of a child table."""
    return run(rows, options, key)
