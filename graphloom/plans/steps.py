"""Registered queries of traversal steps, versions, full text, enrichment and further joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, search as Q
from ..graph import Match, tpch_graph
from ..operators import aggregations as A, paths, writes
from ..streaming import enrichment
from .catalog import GEO_LAT, GEO_LON, TRADE, _places, _sources, match, nation_trade, query, table
from .traversal import Traversal

# ---- traversal steps


@query("SELECT n_nationkey AS id, array_to_string(list_sort(list(s_suppkey)), ',') AS values FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1 GROUP BY 1")
def traversal_group(spark, d):
    t = Traversal.V(tpch_graph(spark, d), "Nation").has("n_regionkey", "eq", 1).in_("FROM_NATION", "Supplier")
    out = t.group("s_nationkey", "s_suppkey")
    return out.select(F.col("s_nationkey").alias("id"), F.concat_ws(",", F.transform("values", lambda x: x.cast("string"))).alias("values"))


@query("SELECT c_name AS name, c_custkey || '>' || o_orderkey || '>' || l_partkey AS path FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_custkey < 20")
def traversal_path(spark, d):
    g = tpch_graph(spark, d)
    found = Traversal.V(g, "Customer").has("c_custkey", "lt", 20).path(("out", "PLACED", "Order"), ("out", "CONTAINS", "Part"))
    named = found.withColumn("id", F.get("path", F.lit(0))).join(g.node("Customer").select("id", "c_name"), "id")
    return named.select(F.col("c_name").alias("name"), F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))).alias("path"))


@query("SELECT p_partkey AS id, p_brand || '/' || p_size AS label, 1::BIGINT AS n FROM part WHERE (starts_with(p_brand, 'Brand#1') AND regexp_full_match(p_type, '[A-M].*')) AND (contains(p_name, 'a') OR contains(p_name, 'e') OR contains(p_name, '1'))")
def traversal_project(spark, d):
    t = Traversal.V(tpch_graph(spark, d), "Part").has("p_brand", "prefix", "Brand#1").has("p_type", "regex", "[A-M].*").has("p_name", "textcontainsany", "a", "e", "1")
    return t.project(id="id", label="concat(p_brand, '/', p_size)")


@query("SELECT count(*) AS count FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey JOIN nation c ON b.n_regionkey = c.n_regionkey WHERE a.n_nationkey = 3")
def traversal_repeat(spark, d):
    t = Traversal.V(tpch_graph(spark, d), "Nation", 3)
    return t.repeat(lambda x: x.both("IN_REGION", "Region").both("IN_REGION", "Nation"), 2).count()


@query("SELECT event_id AS id FROM events WHERE regexp_extract(props, ': ([0-9]+)', 1) IN ('1', '2', '3') AND event_type NOT IN ('click', 'view')")
def traversal_map_predicates(spark, d):
    from .traversal import P

    m = F.create_map(F.lit("k"), F.regexp_extract("props", ": ([0-9]+)", 1), F.lit("type"), F.col("event_type"))
    e = table(spark, d, "events").withColumn("m", m)
    some = P["containsvalue"](F.col("m"), "1") | P["containsvalue"](F.col("m"), "2") | P["containsvalue"](F.col("m"), "3")
    return e.filter(P["containskey"](F.col("m"), "k") & some & P["without"](F.col("event_type"), "click", "view")).select(F.col("event_id").alias("id"))


# ---- joins and paths


@query("SELECT c_custkey AS id, n_nationkey AS nation, CASE WHEN r_regionkey = 1 THEN r_regionkey END AS region FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def optional_expand_of_two(spark, d):
    m = match(spark, d).node("c", "Customer").expand("c", "FROM_NATION", "n", "Nation").expand("n", "IN_REGION", "r", "Region", where="r_regionkey = 1", optional=True)
    return m.select(id="c__id", nation=F.col("n__id").cast("int"), region=F.col("r__id").cast("int"))


@query("SELECT c_custkey AS id, s_suppkey AS supplier, c_nationkey = s_nationkey AS linked FROM customer, supplier WHERE c_custkey < 30 AND s_suppkey < 8")
def optional_expand_into(spark, d):
    g = tpch_graph(spark, d)
    m = Match(g).node("c", "Customer", "c_custkey < 30").node("s", "Supplier", "s_suppkey < 8").expand("c", "FROM_NATION", "n", "Nation").expand("s", "FROM_NATION", "n", optional=True, rel="back")
    return m.select(id="c__id", supplier="s__id", linked="back__rid is not null")


@query(f"WITH {TRADE}, one AS (SELECT dst AS v, [3, dst] AS p FROM hop WHERE src = 3 AND dst <> 3), two AS (SELECT dst AS v, list_append(p, dst) AS p FROM one JOIN hop ON src = v WHERE NOT list_contains(p, dst)), last AS (SELECT dst AS v, list_append(p, dst) AS p FROM (SELECT * FROM one UNION ALL SELECT * FROM two) JOIN hop ON src = v WHERE NOT list_contains(p, dst) AND dst < 6) SELECT array_to_string(p, '>') AS path FROM last WHERE v IN (4, 5)")
def template_paths(spark, d):
    edges = nation_trade(spark, d)
    targets = spark.createDataFrame([(4,), (5,)], "id int")
    found = paths.template_paths(_sources(spark, 3), targets, [(edges, 2), (edges.filter("dst < 6"), 1)])
    return found.select(F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))).alias("path"))


@query(f"WITH {TRADE} SELECT 3 AS origin, dst AS neighbour, 'out' AS way FROM hop WHERE src = 3 UNION ALL SELECT 3, src, 'in' FROM hop WHERE dst = 3")
def edge_infos(spark, d):
    edges = nation_trade(spark, d).withColumns({"rid": F.concat_ws(">", "src", "dst"), "type": F.lit("TRADES")})
    ids = spark.createDataFrame([(3,)], "id int")
    one = lambda way: paths.neighbourhood(edges, ids, way).select("origin", "neighbour", F.lit(way).alias("way"))
    return one("out").unionByName(one("in"))


# ---- versions and projections


@query("SELECT user_id AS id, event_id AS version, ts AS at, until FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM events) WHERE user_id < 20")
def versions_of_elements(spark, d):
    log = table(spark, d, "events").filter("user_id < 20").select(F.col("user_id").alias("id"), F.col("ts"), F.col("event_id").alias("version"))
    return writes.history(log, "id").select("id", "version", F.col("ts").alias("at"), "until")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def hidden_elements(spark, d):
    c = tpch_graph(spark, d).node("Customer").select("id")
    hides = c.filter("id % 3 = 0").select("id", F.lit(1).alias("ts"), F.lit(True).alias("hidden"))
    unhides = c.filter("id % 6 = 0").select("id", F.lit(2).alias("ts"), F.lit(False).alias("hidden"))
    return writes.shown(c, hides.unionByName(unhides))


@query("SELECT o_orderkey AS id, o_orderstatus FROM orders")
def fetch_hints(spark, d):
    return writes.fetched(tpch_graph(spark, d).node("Order"), ["o_orderstatus", "absent"])


@query("SELECT s_suppkey AS id, NULL::VARCHAR AS name, s_acctbal AS balance FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey % 2 = 1")
def remove_property(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return writes.set_properties(s, F.col("id") % 2 == 0, {"name": F.lit(None).cast("string")})


# ---- full text, shapes, ranges


@query(r"SELECT doc_id AS id, len(list_filter(w, lambda x: regexp_full_match(x, 'li[a-z]+e'))) > 0 AS re, regexp_matches(lower(text), '\bapache[^a-z0-9_]+(?:[a-z0-9_]+[^a-z0-9_]+){0,2}version\b') AS near, (CASE WHEN list_contains(w, 'apache') THEN 2.0 ELSE 0.0 END + CASE WHEN list_contains(w, 'mit') THEN 1.0 ELSE 0.0 END)::DOUBLE AS score FROM (SELECT doc_id, text, regexp_split_to_array(lower(text), '[^a-z0-9_]+') AS w FROM documents)")
def full_text_regex_slop_boost(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), Q.regex(t, "li[a-z]+e").alias("re"), Q.phrase(t, "apache version", slop=2).alias("near"), Q.boosted((Q.term(t, "apache"), 2.0), (Q.term(t, "mit"), 1.0)).alias("score"))


@query(f"SELECT id, lat BETWEEN 0 AND 40 AND lon BETWEEN 0 AND 60 AND lat > lon AS inside, round(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(10 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(10)) * pow(sin(radians(20 - lon) / 2), 2)))), 3) <= 3000 AS near FROM (SELECT c_custkey AS id, {GEO_LAT} AS lat, {GEO_LON} AS lon FROM customer) WHERE lat <> lon AND lat NOT IN (0, 40) AND lon <> 0")
def geo_shapes(spark, d):
    at = F.col("at")
    places = _places(spark, d).filter("at.latitude <> at.longitude and at.latitude not in (0, 40) and at.longitude <> 0")
    triangle = geo.in_polygon(at, [(0, 0), (40, 0), (40, 40)])
    return places.select("id", triangle.alias("inside"), geo.in_circle(at, geo.point(10, 20), 3000).alias("near"))


@query("SELECT event_id AS id, user_id AS worker_id, event_type AS kind FROM events WHERE event_type = 'purchase' UNION ALL SELECT event_id, user_id, 'large' FROM events WHERE value > 90")
def worker_dispatch(spark, d):
    workers = [
        enrichment.Worker("purchases", lambda df: F.col("event_type") == "purchase", lambda df: df.select("event_id", "user_id", F.col("event_type").alias("kind"))),
        enrichment.Worker("large", lambda df: F.col("value") > 90, lambda df: df.select("event_id", "user_id", F.lit("large").alias("kind"))),
    ]
    return enrichment.dispatch(table(spark, d, "events"), workers).select(F.col("event_id").alias("id"), F.col("user_id").alias("worker_id"), "kind")


@query("SELECT date_trunc('hour', ts) - o * INTERVAL 1 HOUR AS window_start, count(*) AS n FROM events, (VALUES (0), (1)) t(o) GROUP BY 1")
def sliding_windows(spark, d):
    return enrichment.windowed(table(spark, d, "events"), "ts", "2 hours", [], {"n": F.count("*")}, slide="1 hour")


@query("SELECT round(quantile_cont(l_quantity, 0.99), 4) AS cont, quantile_disc(l_quantity, 0.01) AS disc FROM lineitem")
def percentile_extremes(spark, d):
    items = table(spark, d, "lineitem")
    cont = A.percentiles(items, "l_quantity", [99]).select(F.round("value", 4).alias("cont"))
    return cont.crossJoin(A.percentiles(items, "l_quantity", [1], discrete=True).select(F.col("value").alias("disc")))  # one row each
