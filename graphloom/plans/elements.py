"""Registered queries of elements: seeks, paths as values, neighbourhood searches, constructors, writes and listings."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import geo, scalar as S, temporal as T
from ..graph import Match, conditional_apply, relationships_by_ids, relationships_in_range, tpch_graph
from ..operators import aggregations as A, paths, search_runs as runs, writes
from ..sources import procedures, tables as src
from ..tables import shared_folder
from .catalog import TRADE, TREE, _sources, match, nation_trade, query, table, tree

# ---- seeks and scans


@query("SELECT o_orderkey * 2 AS id, o_custkey AS \"start\", o_orderkey AS \"end\" FROM orders WHERE o_orderkey IN (1, 2, 3)")
def seek_relationships_directed(spark, d):
    return relationships_by_ids(tpch_graph(spark, d).rel("PLACED"), [2, 4, 6]).withColumnRenamed("rid", "id")


@query("SELECT o_orderkey * 2 AS id, o_custkey AS \"start\", o_orderkey AS \"end\" FROM orders WHERE o_orderkey IN (1, 2, 3) UNION ALL SELECT o_orderkey * 2, o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (1, 2, 3) AND o_orderkey <> o_custkey")
def seek_relationships_undirected(spark, d):
    return relationships_by_ids(tpch_graph(spark, d).rel("PLACED"), [2, 4, 6], directed=False).withColumnRenamed("rid", "id")


@query("SELECT o_orderkey * 2 AS id FROM orders WHERE o_orderkey BETWEEN 50 AND 90")
def scan_relationship_range(spark, d):
    return relationships_in_range(tpch_graph(spark, d).rel("PLACED"), 100, 180).select(F.col("rid").alias("id"))


@query("SELECT l_orderkey AS id, l_linenumber AS line FROM lineitem WHERE l_shipdate <= (SELECT min(l_shipdate) + INTERVAL 30 DAY FROM lineitem)")
def scan_relationships_until(spark, d):
    items = tpch_graph(spark, d).rel("CONTAINS")
    until = items.agg(F.expr("min(shipdate) + interval 30 days").alias("t")).first().t  # what a user would give
    return relationships_in_range(items, None, until, by="shipdate").select(F.col("src").alias("id"), F.col("linenumber").alias("line"))


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_name IS NOT NULL")
def scan_by_property(spark, d):
    return tpch_graph(spark, d).node("Supplier").filter("s_name is not null").select("id", F.col("s_name").alias("name"))


@query("SELECT 'Customer' AS label, c_custkey AS id FROM customer UNION ALL SELECT 'Supplier', s_suppkey FROM supplier")
def scan_union_of_labels(spark, d):
    return src.scan_labels(tpch_graph(spark, d), "Customer", "Supplier")


@query("SELECT l_orderkey AS orderkey, o_orderstatus AS status, p_brand AS brand, l_linenumber AS line FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_quantity = 50")
def project_endpoints(spark, d):
    g = tpch_graph(spark, d)
    m = Match(g).endpoints(g.rel("CONTAINS").filter("quantity = 50"), "CONTAINS", "l", "o", "p", ("Order", "Part"))
    return m.select(orderkey="o__id", status="o__o_orderstatus", brand="p__p_brand", line="l__linenumber")


@query("SELECT r_regionkey AS id, upper(r_name) AS name FROM region")
def load_csv_rows(spark, d):
    path = shared_folder(spark, "csv")
    table(spark, d, "region").write.option("header", True).csv(path)
    return src.load_csv(spark, path).select(S.to_integer(F.col("row")["r_regionkey"]).cast("int").alias("id"), F.upper(F.col("row")["r_name"]).alias("name"))


@query("SELECT r_regionkey AS id, r_name AS name FROM region WHERE r_regionkey > 0")
def load_csv_lists(spark, d):
    path = shared_folder(spark, "csv")
    table(spark, d, "region").filter("r_regionkey > 0").write.option("sep", ";").csv(path)
    return src.load_csv(spark, path, headers=False, separator=";").select(F.col("row")[0].cast("int").alias("id"), F.col("row")[1].alias("name"))


# ---- joins and applies


@query("SELECT s_suppkey AS supplier, c_custkey AS customer FROM supplier RIGHT JOIN customer ON s_suppkey = c_custkey AND s_acctbal > 0")
def right_outer_join(spark, d):
    g = tpch_graph(spark, d)
    left, right = g.node("Supplier").filter("s_acctbal > 0").select("id", F.col("s_suppkey").alias("supplier")), g.node("Customer").select("id", F.col("c_custkey").alias("customer"))
    return left.join(right, "id", "right").select("supplier", "customer")


@query("SELECT c_custkey AS id, o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 5000 UNION ALL SELECT c_custkey, NULL FROM customer WHERE NOT c_acctbal > 5000")
def conditional_apply_rows(spark, d):
    g = tpch_graph(spark, d)
    orders = g.rel("PLACED").select(F.col("src").alias("id"), F.col("dst").alias("o"))
    return conditional_apply(g.node("Customer").select("id", "c_acctbal"), "c_acctbal > 5000", lambda df: df.join(orders, "id")).select("id", "o")


@query("SELECT a.n_nationkey AS id, b.n_name AS name FROM nation a JOIN nation b USING (n_nationkey) WHERE a.n_regionkey = 1")
def assert_same_node(spark, d):
    m = match(spark, d).node("r", "Region", "r_regionkey = 1").expand("r", "IN_REGION", "a", "Nation", direction="in").clause().expand("r", "IN_REGION", "b", "Nation", direction="in")
    return m.where("a__id = b__id").same("a", "b").select(id="a__id", name="b__n_name")


@query("SELECT n1.n_name AS a, n2.n_name AS b FROM nation n1 JOIN nation n2 ON n1.n_regionkey = n2.n_regionkey")
def two_match_clauses(spark, d):
    m = match(spark, d).node("a", "Nation").expand("a", "IN_REGION", "r", "Region").clause().expand("r", "IN_REGION", "b", "Nation", direction="in")
    return m.select(a="a__n_name", b="b__n_name")


@query("SELECT c_custkey AS id, o.o_orderkey AS a, p.o_orderkey AS b FROM customer LEFT JOIN orders o ON o.o_custkey = c_custkey AND o.o_totalprice > 300000 LEFT JOIN orders p ON p.o_custkey = c_custkey AND p.o_totalprice > 350000")
def two_optional_matches(spark, d):
    m = match(spark, d).node("c", "Customer").expand("c", "PLACED", "a", "Order", where="o_totalprice > 300000", optional=True).expand("c", "PLACED", "b", "Order", where="o_totalprice > 350000", optional=True)
    return m.select(id="c__id", a="a__id", b="b__id")


@query("SELECT k AS nation, list_count AS n FROM (SELECT n_nationkey AS k, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 0) AS list_count FROM nation) WHERE list_count > 0")
def list_as_condition(spark, d):
    m = match(spark, d).node("n", "Nation").roll_up("rich", "n", "FROM_NATION", "_f", direction="in", label="Customer", where="c_acctbal > 0")
    return m.where(S.to_predicate(F.col("rich"), "list")).select(nation=F.col("n__id").cast("int"), n=F.size("rich").cast("long"))


# ---- paths as values


@query(f"WITH {TRADE} SELECT a.src || '>' || a.dst || '>' || b.dst AS nodes, (a.src * 1000 + a.dst) || ',' || (b.src * 1000 + b.dst) AS rels, 2 AS length, a.src AS first, b.dst AS last FROM hop a JOIN hop b ON a.dst = b.src WHERE a.src IN (3, 4) AND NOT (a.src = b.src AND a.dst = b.dst)")
def path_values(spark, d):
    edges = nation_trade(spark, d).withColumn("rid", F.col("src") * 1000 + F.col("dst"))
    p, r = F.col("path"), F.col("rels")
    text = lambda c, sep: F.concat_ws(sep, F.transform(c, lambda x: x.cast("string")))
    return paths.trails(edges, _sources(spark, 3, 4), 2, 2).select(text(S.path_nodes(p), ">").alias("nodes"), text(S.path_relationships(r), ",").alias("rels"), S.path_length(r).alias("length"), S.start_node(p).alias("first"), S.end_node(p).alias("last"))


@query(f"""WITH {TRADE}, u AS (SELECT src, dst, src * 1000 + dst AS rid FROM hop UNION ALL SELECT dst, src, src * 1000 + dst FROM hop WHERE src <> dst)
SELECT a.dst AS id, 1 AS hops, count(*) AS n FROM u a WHERE a.src = 3 GROUP BY 1 UNION ALL SELECT b.dst, 2, count(*) FROM u a JOIN u b ON a.dst = b.src AND a.rid <> b.rid WHERE a.src = 3 GROUP BY 1""")
def var_length_undirected(spark, d):
    edges = nation_trade(spark, d).withColumn("rid", F.col("src") * 1000 + F.col("dst"))
    return paths.trails(paths.either_way(edges), _sources(spark, 3), 1, 2).groupBy("id", "hops").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS id, 's_name=' || s_name || ';s_suppkey=' || s_suppkey AS props, 's_name,s_suppkey' AS names, s_name AS name, s_suppkey + 1 AS next FROM supplier")
def element_properties(spark, d):
    s = tpch_graph(spark, d).node("Supplier")
    columns = {c: F.col(c) for c in ("s_suppkey", "s_name")} | {"absent": F.lit(None).cast("string")}
    shown = F.array_sort(F.transform(F.map_entries(S.properties(columns)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    projection = S.map_projection(columns, chosen=["s_name"], next=F.col("s_suppkey") + 1)
    return s.select("id", F.concat_ws(";", shown).alias("props"), F.concat_ws(",", S.keys(columns)).alias("names"), projection["s_name"].alias("name"), projection["next"].alias("next"))


# ---- neighbourhoods


def _edges(g):
    """(rid, type, src, dst) of the tree with ids of all labels."""
    return g.edges("IN_REGION", "FROM_NATION").withColumn("rid", F.concat_ws(">", "src", "dst"))


@query(f"WITH {TREE} SELECT DISTINCT src AS id FROM tree WHERE dst IN ('nation:3', 'nation:5') AND src LIKE 'supplier:%'")
def vertex_query(spark, d):
    g = tpch_graph(spark, d)
    vertices = g.all_nodes().select(F.concat_ws(":", F.lower("label"), "id").alias("id"), "label")
    ids = spark.createDataFrame([("nation:3",), ("nation:5",)], "id string")
    return paths.vertex_query(vertices, _edges(g), ids, where=F.col("label") == "Supplier").select("id")


@query(f"WITH {TREE} SELECT src, dst FROM tree WHERE dst = 'nation:3' OR src = 'nation:3'")
def edge_query(spark, d):
    g = tpch_graph(spark, d)
    return paths.edge_query(_edges(g), spark.createDataFrame([("nation:3",)], "id string")).select("src", "dst")


@query(f"WITH {TRADE}, u AS (SELECT src AS a, dst AS b FROM hop UNION SELECT dst, src FROM hop) SELECT b AS id, count(DISTINCT a) AS n FROM u WHERE a IN (3, 5, 7) AND b NOT IN (3, 5, 7) GROUP BY 1")
def related_vertices(spark, d):
    edges = nation_trade(spark, d).withColumns({"rid": F.concat_ws(">", "src", "dst"), "type": F.lit("TRADES")})
    return paths.related_to_all(edges, spark.createDataFrame([(3,), (5,), (7,)], "id int"))


@query("SELECT DISTINCT c_custkey AS source, p_partkey AS id FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_acctbal > 9800 AND o_orderstatus = 'F' AND l_quantity > 45")
def customized_k_out(spark, d):
    g = tpch_graph(spark, d)
    name = lambda label, c: F.concat(F.lit(label + ":"), c)
    start = g.node("Customer").filter("c_acctbal > 9800").select(name("c", "id").alias("source"))
    done = g.node("Order").filter("o_orderstatus = 'F'").select(F.col("id").alias("dst"))
    placed = g.rel("PLACED").join(done, "dst", "left_semi").select(name("c", "src").alias("src"), name("o", "dst").alias("dst"))
    parts = g.rel("CONTAINS").filter("quantity > 45").select(name("o", "src").alias("src"), name("p", "dst").alias("dst"))
    key = lambda c: F.substring_index(c, ":", -1).cast("long").alias(c)
    return paths.customized_k_out(start, [placed, parts]).select(key("source"), key("id"))


@query(f"WITH {TRADE}, one AS (SELECT DISTINCT dst AS id FROM hop WHERE src = 3 AND dst <> 3), two AS (SELECT DISTINCT hop.dst AS id FROM one JOIN hop ON src = one.id WHERE hop.dst > 10) SELECT 3 AS source, id, 1 AS hops FROM one UNION ALL SELECT 3, id, 2 FROM two WHERE id <> 3 AND id NOT IN (SELECT id FROM one)")
def customized_k_neighbor(spark, d):
    edges = nation_trade(spark, d)
    return paths.customized_k_neighbor(_sources(spark, 3), [edges, edges.filter("dst > 10")])


@query(f"WITH {TRADE}, one AS (SELECT src AS s, dst AS t, src || '>' || dst AS path FROM hop WHERE src IN (3, 4) AND src <> dst), two AS (SELECT s, dst AS t, path || '>' || dst AS path FROM one JOIN hop ON src = t WHERE dst <> s AND dst <> t) SELECT s AS source, t AS target, path FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE t IN (5, 6)")
def collection_paths(spark, d):
    targets = spark.createDataFrame([(5,), (6,)], "target int")
    found = paths.collection_paths(_sources(spark, 3, 4), targets, nation_trade(spark, d), 2)
    return found.select("source", "target", F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))).alias("path"))


@query("SELECT o_orderkey AS element_id, l_linenumber AS row_id, l_quantity AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey < 20")
def extended_data_rows(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("element_id"), F.col("l_linenumber").alias("row_id"), F.col("l_quantity").alias("quantity"))
    return src.extended_data(rows, tpch_graph(spark, d).node("Order").filter("id < 20"))


@query("SELECT p_partkey AS id, true AS has FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 1) UNION ALL SELECT p_partkey, false FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 1)")
def has_extended_data(spark, d):
    parts = tpch_graph(spark, d).node("Part")
    rows = table(spark, d, "lineitem").filter("l_quantity = 1").select(F.col("l_partkey").alias("element_id"))
    one = lambda negate: src.has_extended_data(parts, rows, negate=negate).select("id", F.lit(not negate).alias("has"))
    return one(False).unionByName(one(True))


# ---- scores and aggregations by options


@query("SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS score FROM part WHERE p_brand = 'Brand#12' AND p_size >= 20")
def field_value_score(spark, d):
    return A.field_scores(table(spark, d, "part"), F.col("p_size"), F.col("p_brand") == "Brand#12", least=20).select(F.col("p_partkey").alias("id"), "score")


OPTIONS = [
    {"type": "term", "name": "brands", "field": "p_brand"},
    {"type": "histogram", "name": "sizes", "field": "p_size", "interval": 10},
    {"type": "statistics", "name": "prices", "field": "p_retailprice"},
    {"type": "max", "name": "largest", "field": "p_size"},
    {"type": "cardinality", "name": "types", "field": "p_type"},
]


@query("""SELECT 'brands' AS name, p_brand AS key, count(*) AS n, NULL::DOUBLE AS value FROM part GROUP BY 2 UNION ALL SELECT 'sizes', (p_size // 10 * 10) || '.0', count(*), NULL FROM part GROUP BY 2
UNION ALL SELECT 'prices', 'count', NULL, round(count(p_retailprice), 3) FROM part UNION ALL SELECT 'prices', 'sum', NULL, round(sum(p_retailprice), 3) FROM part UNION ALL SELECT 'prices', 'avg', NULL, round(avg(p_retailprice), 3) FROM part
UNION ALL SELECT 'prices', 'min', NULL, round(min(p_retailprice), 3) FROM part UNION ALL SELECT 'prices', 'max', NULL, round(max(p_retailprice), 3) FROM part UNION ALL SELECT 'largest', NULL, NULL, max(p_size) FROM part UNION ALL SELECT 'types', NULL, NULL, count(DISTINCT p_type) FROM part""")
def aggregations_from_options(spark, d):
    return A.from_options(table(spark, d, "part"), json.dumps(OPTIONS)).withColumn("value", F.round("value", 3))


# ---- functions


@query("""SELECT p_partkey AS id, abs(p_size - 30) AS a, -p_size AS minus, p_size * 3 + 1 AS times, round(exp(p_size / 10.0), 6) AS e1, round(log10(p_retailprice), 6) AS l10, round(sin(p_size), 6) AS s, round(cos(p_size), 6) AS c, round(tan(p_size), 6) AS t,
 round(1 / tan(p_size), 6) AS ct, round(asin(p_size / 51.0), 6) AS asn, round(acos(p_size / 51.0), 6) AS acs, round(atan(p_size), 6) AS atn, round(atan2(p_size, 7), 6) AS at2, round(degrees(p_size), 6) AS deg, round(radians(p_size), 6) AS rad, round(pi(), 6) AS p, round(exp(1), 6) AS e FROM part""")
def more_math(spark, d):
    s, p = F.col("p_size"), F.col("p_retailprice")
    r = lambda x: F.round(x, 6)
    share = s / F.lit(51.0)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.abs(s - 30).alias("a"), (-s).alias("minus"), (s * 3 + 1).alias("times"), r(F.exp(s / 10)).alias("e1"), r(S.log10(p)).alias("l10"), r(F.sin(s)).alias("s"), r(F.cos(s)).alias("c"), r(F.tan(s)).alias("t"), r(F.cot(s)).alias("ct"), r(F.asin(share)).alias("asn"), r(F.acos(share)).alias("acs"), r(F.atan(s)).alias("atn"), r(F.atan2(s, F.lit(7))).alias("at2"), r(F.degrees(s)).alias("deg"), r(F.radians(s)).alias("rad"), r(F.pi()).alias("p"), r(F.e()).alias("e"))


@query("SELECT p_partkey AS id, ltrim('  ' || p_name) AS l, rtrim(p_name || '  ') AS r, array_to_string(string_split(p_brand, '#'), '|') AS parts, CAST(p_size AS VARCHAR) AS size, p_name || '-' || p_brand AS plus, coalesce(NULL, p_type) AS kind, (p_size > 20) AS flag, p_retailprice IS NOT NULL AS has FROM part")
def more_strings(spark, d):
    n, b = F.col("p_name"), F.col("p_brand")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.ltrim(F.concat(F.lit("  "), n)).alias("l"), F.rtrim(F.concat(n, F.lit("  "))).alias("r"), F.concat_ws("|", S.split(b, "#")).alias("parts"), S.to_string(F.col("p_size")).alias("size"), F.concat(n, F.lit("-"), b).alias("plus"), F.coalesce(F.lit(None), F.col("p_type")).alias("kind"), S.to_boolean(F.when(F.col("p_size") > 20, " TRUE ").otherwise("false")).alias("flag"), S.to_float(F.col("p_retailprice")).isNotNull().alias("has"))


@query("SELECT event_id AS id, CAST(regexp_extract(props, ': ([0-9]+)', 1) AS DOUBLE) / 4 AS f, TRY_CAST(trunc(value) AS BIGINT) AS whole, value < 50 AS lt, value >= 50 AS ge, (value > 20) <> (value > 60) AS x FROM events")
def conversions_and_comparisons(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), (S.to_float(F.regexp_extract("props", ": ([0-9]+)", 1)) / 4).alias("f"), S.to_integer(v).alias("whole"), S.comparison(v, "<", 50.0).alias("lt"), S.comparison(v, ">=", 50.0).alias("ge"), S.xor(v > 20, v > 60).alias("x"))


@query("SELECT r_regionkey AS id, array_to_string(list_concat([1, 2], [r_regionkey]), ',') AS joined, array_to_string([1, 2, 9], ',') AS longer, array_to_string([0, 1, 2], ',') AS front, r_regionkey AS a, r_name AS b FROM region")
def list_and_map_building(spark, d):
    k, pair = F.col("r_regionkey"), F.array(F.lit(1), F.lit(2))
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    made = F.struct(k.alias("a"), F.col("r_name").alias("b"))
    return table(spark, d, "region").select(k.alias("id"), text(S.list_concat(pair, F.array(k))).alias("joined"), text(S.append(pair, 9)).alias("longer"), text(S.prepend(0, pair)).alias("front"), made["a"].alias("a"), made["b"].alias("b"))


@query("SELECT r_regionkey AS id, true AS r, true AS u, 36 AS size, true AS now FROM region")
def random_and_clock(spark, d):
    df = table(spark, d, "region").withColumns({"r": F.rand(), "u": F.uuid()})
    return df.select(F.col("r_regionkey").alias("id"), F.col("r").between(0, 1).alias("r"), F.rlike("u", F.lit("^[0-9a-f-]{36}$")).alias("u"), F.length("u").alias("size"), (F.unix_millis(F.current_timestamp()) > 1_500_000_000_000).alias("now"))


Y, M, D = "(2000 + event_id % 25)::INT", "(1 + event_id % 12)::INT", "(1 + event_id % 28)::INT"


@query(f"""SELECT event_id AS id, make_date({Y}, {M}, {D}) AS day, CAST(date_trunc('week', make_date({Y}, 1, 4)) + INTERVAL ((event_id % 52) * 7 + event_id % 7) DAY AS DATE) AS week, CAST(make_date({Y}, 1, 1) + INTERVAL (event_id % 365) DAY AS DATE) AS ordinal,
 CAST(make_date({Y}, ((event_id % 4) * 3 + 1)::INT, 1) + INTERVAL (event_id % 90) DAY AS DATE) AS quarter, make_timestamp({Y}, {M}, {D}, 10, 20, 30.5) AS local, make_timestamp({Y}, {M}, {D}, (event_id % 24)::INT, 5, 6) AS zoned, make_timestamp(event_id * 1000000 + 1) AS epoch, make_timestamp(event_id * 1000) AS millis FROM events""")
def temporal_constructors(spark, d):
    i = F.col("event_id")
    y, m, day = (2000 + i % 25).cast("int"), (1 + i % 12).cast("int"), (1 + i % 28).cast("int")
    plain = lambda t: t.cast("timestamp_ntz")
    return table(spark, d, "events").select(i.alias("id"), T.make_date(y, m, day).alias("day"), T.week_date(y, i % 52 + 1, i % 7 + 1).alias("week"), T.ordinal_date(y, i % 365 + 1).alias("ordinal"), T.quarter_date(y, i % 4 + 1, i % 90 + 1).alias("quarter"), T.local_datetime(y, m, day, 10, 20, 30.5).alias("local"), plain(T.zoned_datetime(y, m, day, (i % 24).cast("int"), 5, 6)).alias("zoned"), plain(T.from_epoch(i, 1000)).alias("epoch"), plain(T.from_epoch_millis(i)).alias("millis"))


@query("SELECT * FROM (VALUES ('2015-07-21', DATE '2015-07-21'), ('20150721', DATE '2015-07-21'), ('2015-07', DATE '2015-07-01'), ('2015', DATE '2015-01-01'), ('2015-202', DATE '2015-07-21'), ('2015-W30-2', DATE '2015-07-21'), ('2015-Q2-60', DATE '2015-05-30'), ('x', NULL)) t(text, day)")
def temporal_parsing(spark, d):
    texts = ["2015-07-21", "20150721", "2015-07", "2015", "2015-202", "2015-W30-2", "2015-Q2-60", "x"]
    return spark.createDataFrame([(x,) for x in texts], "text string").select("text", T.parse_date(F.col("text")).alias("day"))


@query("SELECT event_id AS id, strftime(make_timestamp(event_id % 86400 * 1000000), '%H:%M:%S') || '.000000007' AS made, '21:40:32.142000000' AS parsed, (event_id % 86400 - 3600) * 1000000000 + 7 AS utc FROM events")
def temporal_times(spark, d):
    s = F.col("event_id") % 86400
    t = T.local_time((s / 3600).cast("int"), (s / 60).cast("int") % 60, s % 60, 7)
    return table(spark, d, "events").select(F.col("event_id").alias("id"), T.time_text(t).alias("made"), T.time_text(T.parse_local_time(F.lit("21:40:32.142"))).alias("parsed"), T.time_with_offset(t, 3600)["utc"].alias("utc"))


@query("SELECT event_id AS id, strptime('2020-02-0' || (1 + event_id % 9) || ' 10:00', '%Y-%m-%d %H:%M') AS at, epoch_ms(strptime('2020-02-0' || (1 + event_id % 9) || ' 10:00', '%Y-%m-%d %H:%M')) // 86400000 AS days FROM events")
def temporal_patterns(spark, d):
    text = F.concat(F.lit("2020-02-0"), F.col("event_id") % 9 + 1, F.lit(" 10:00"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.to_timestamp(text, "yyyy-MM-dd HH:mm").cast("timestamp_ntz").alias("at"), T.parse_epoch(text, "yyyy-MM-dd HH:mm", "d").alias("days"))


_MONTHS, _DAYS, _SECONDS, _NANOS = "(event_id % 50)", "(event_id % 40)", "(event_id % 100000)", "(event_id * 1234567 % 1000000000)"
_PARTS = {
    "years": f"{_MONTHS} // 12", "quarters": f"{_MONTHS} // 3", "months": _MONTHS, "weeks": f"{_DAYS} // 7", "days": _DAYS, "hours": f"{_SECONDS} // 3600", "minutes": f"{_SECONDS} // 60", "seconds": _SECONDS,
    "milliseconds": f"{_SECONDS} * 1000 + {_NANOS} // 1000000", "microseconds": f"{_SECONDS} * 1000000 + {_NANOS} // 1000", "nanoseconds": f"{_SECONDS} * 1000000000 + {_NANOS}", "quartersOfYear": f"{_MONTHS} // 3 % 4", "monthsOfYear": f"{_MONTHS} % 12", "monthsOfQuarter": f"{_MONTHS} % 3",
    "daysOfWeek": f"{_DAYS} % 7", "minutesOfHour": f"{_SECONDS} // 60 % 60", "secondsOfMinute": f"{_SECONDS} % 60", "millisecondsOfSecond": f"{_NANOS} // 1000000", "microsecondsOfSecond": f"{_NANOS} // 1000", "nanosecondsOfSecond": _NANOS,
}


@query("SELECT event_id AS id, " + ", ".join(f'CAST({e} AS BIGINT) AS "{k}"' for k, e in _PARTS.items()) + " FROM events")
def duration_components(spark, d):
    i = F.col("event_id")
    span = T.duration(i % 50, i % 40, i % 100000, i * 1234567 % 1000000000)
    return table(spark, d, "events").withColumn("d", span).select(i.alias("id"), *(f(F.col("d")).cast("long").alias(k) for k, f in T.DURATION.items()))


@query("SELECT c_custkey AS id, CAST(c_custkey % 80 AS DOUBLE) AS latitude, CAST(c_custkey % 170 AS DOUBLE) AS longitude, CAST(c_custkey AS DOUBLE) AS height, CAST(c_custkey % 170 AS DOUBLE) AS x, CAST(c_custkey % 80 AS DOUBLE) AS y, CAST(c_custkey AS DOUBLE) AS z, CAST(c_custkey % 80 AS DOUBLE) AS parsed FROM customer")
def point_components(spark, d):
    k = F.col("c_custkey")
    p = geo.point_with_height(k % 80, k % 170, k)
    text = F.concat_ws(",", k % 80, k % 170)
    return table(spark, d, "customer").select(k.alias("id"), *(f(p).alias(c) for c, f in geo.COMPONENTS.items()), geo.parse_point(text)["latitude"].alias("parsed"))


@query("SELECT c_custkey AS id, true AS near FROM customer")
def geohash_round_trip(spark, d):
    k = F.col("c_custkey")
    p = geo.point(k % 160 - 80, k * 7 % 340 - 170)
    cells = table(spark, d, "customer").select(k.alias("id"), p.alias("p"), geo.geohash(p, 5).alias("cell"))
    centres = cells.select("id", "p", geo.geohash_centre(F.col("cell")).alias("c"))
    return centres.select("id", (geo.distance(F.col("p"), F.col("c")) < 4).alias("near"))


@query("SELECT r_regionkey AS id, CAST(r_regionkey * 3 + 1 AS BIGINT) AS v FROM region")
def user_function(spark, d):
    procedures.scalar(spark, "thrice_and_one", "x BIGINT", "BIGINT", "x * 3 + 1")
    return table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.expr("thrice_and_one(r_regionkey)").alias("v"))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey = 2")
def procedure_call(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("nation_of_procedure")
    procedures.procedure(spark, "nations_of", "region INT", "id INT, name STRING", "SELECT n_nationkey, n_name FROM nation_of_procedure WHERE n_regionkey = nations_of.region")
    return procedures.call(spark, "nations_of", 2)


@query("SELECT c_nationkey AS nation, round(exp(avg(ln(c_acctbal + 2000))), 4) AS v FROM customer GROUP BY 1")
def user_aggregation(spark, d):
    import numpy as np

    mean = procedures.aggregation(spark, "geometric_mean", lambda x: float(np.exp(np.log(x).mean())))
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.round(mean(F.col("c_acctbal") + 2000), 4).alias("v"))


# ---- writes


def _placed(spark, d):
    return tpch_graph(spark, d).rel("PLACED").select("rid", "src", "dst").withColumn("note", F.lit("old"))


@query("SELECT o_orderkey * 2 AS rid, o_custkey AS src, o_orderkey AS dst, CASE WHEN o_orderkey < 10 THEN 'seen' ELSE 'old' END AS note FROM orders UNION ALL SELECT -1, 1, 99999999, 'new'")
def merge_relationships(spark, d):
    rels = _placed(spark, d)
    pairs = rels.filter("dst < 10").select("src", "dst").unionByName(spark.createDataFrame([(1, 99999999)], "src long, dst long"))
    return writes.merge_relationships(rels, pairs, F.lit(-1).cast("long"), {"note": F.lit("new")}, {"note": F.lit("seen")})


@query("SELECT o_orderkey * 2 AS rid FROM orders WHERE o_orderkey >= 100")
def delete_relationships(spark, d):
    rels = _placed(spark, d)
    return writes.delete_relationships(rels, rels.filter("dst < 100")).select("rid")


@query(f"WITH {TREE}, gone AS (SELECT 'nation:' || n_nationkey AS id FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'region:1') SELECT (SELECT count(*) FROM (SELECT src AS id FROM tree UNION SELECT dst FROM tree) WHERE id NOT IN (SELECT id FROM gone)) AS nodes, (SELECT count(*) FROM tree WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)) AS rels")
def detach_delete_paths(spark, d):
    rels = _edges(tpch_graph(spark, d))
    nodes = rels.select(F.col("src").alias("id")).union(rels.select("dst")).distinct()
    found = paths.trails(paths.reverse(rels).withColumn("rid", F.concat_ws(">", "dst", "src")), _sources(spark, "region:1"), 1, 1)
    left, kept = writes.delete_paths(nodes, rels, found.filter("id like 'nation:%'"), detach=True)
    return left.agg(F.count("*").alias("nodes")).crossJoin(kept.agg(F.count("*").alias("rels")))  # one row each


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal > 5000 THEN 'Customer,Rich' WHEN c_acctbal < 0 THEN '' ELSE 'Customer' END AS labels FROM customer")
def set_and_remove_labels(spark, d):
    c = tpch_graph(spark, d).node("Customer").withColumn("labels", F.array(F.lit("Customer")))
    c = writes.remove_labels(writes.set_labels(c, F.col("c_acctbal") > 5000, ["Rich", "Customer"]), F.col("c_acctbal") < 0, ["Customer"])
    return c.select("id", F.concat_ws(",", F.array_sort("labels")).alias("labels"))


@query("SELECT r_regionkey AS id, CAST(((r_regionkey * 2 + 1) * 2 + 2) * 2 + 3 AS BIGINT) AS total FROM region")
def foreach_set(spark, d):
    df = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_regionkey").cast("long").alias("total"))
    return writes.foreach_set(df, F.array(*(F.lit(i).cast("long") for i in (1, 2, 3))), "total", lambda acc, x: acc * 2 + x)


@query("SELECT r_regionkey * 10 + i AS id, r_name || i AS name FROM region, (VALUES (1), (2)) t(i)")
def foreach_create(spark, d):
    df = table(spark, d, "region")
    return writes.foreach_create(df, F.array(F.lit(1), F.lit(2)), "i", {"id": F.col("r_regionkey") * 10 + F.col("i"), "name": F.concat("r_name", F.col("i").cast("string"))})


@query("SELECT s_suppkey AS id, 's_name=' || s_name || CASE WHEN s_suppkey % 2 = 0 THEN ';x=1' ELSE ';y=' || s_suppkey END AS props FROM supplier")
def set_map_of_properties(spark, d):
    s = tpch_graph(spark, d).node("Supplier").select("id", F.create_map(F.lit("s_name"), F.col("s_name"), F.lit("y"), F.col("s_suppkey").cast("string")).alias("props"))
    out = writes.set_map(s, F.col("id") % 2 == 0, "props", F.create_map(F.lit("x"), F.lit("1"), F.lit("y"), F.lit(None).cast("string")))
    return out.select("id", F.concat_ws(";", F.array_sort(F.transform(F.map_entries("props"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))).alias("props"))


@query("SELECT n_nationkey AS id, 'deleted' AS event, NULL AS property, NULL AS old, NULL AS new FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 100, 'added', NULL, NULL, NULL UNION ALL SELECT 100, 'property set', 'n_name', NULL, 'NOWHERE' UNION ALL SELECT n_nationkey, 'property changed', 'n_name', n_name, lower(n_name) FROM nation WHERE n_regionkey = 1 AND n_name <> lower(n_name) UNION ALL SELECT n_nationkey, 'property removed', 'n_name', n_name, NULL FROM nation WHERE n_regionkey = 2")
def change_events(spark, d):
    before = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), "n_name", "n_regionkey")
    name = F.when(F.col("n_regionkey") == 1, F.lower("n_name")).when(F.col("n_regionkey") != 2, F.col("n_name"))
    after = before.filter("n_regionkey <> 0").withColumn("n_name", name).unionByName(spark.createDataFrame([(100, "NOWHERE")], "id int, n_name string"), allowMissingColumns=True)
    return writes.change_events(before, after)


# ---- listings


@query("SELECT * FROM (VALUES ('Region', 2), ('Nation', 3), ('Customer', 5), ('Supplier', 4), ('Part', 6), ('Order', 6)) t(concept, properties)")
def db_schema_concepts(spark, d):
    return src.schema_concepts(tpch_graph(spark, d), spark)


@query("SELECT * FROM (VALUES ('IN_REGION', 'Nation', 'Region'), ('FROM_NATION', 'Customer', 'Nation'), ('FROM_NATION', 'Supplier', 'Nation'), ('PLACED', 'Customer', 'Order'), ('CONTAINS', 'Order', 'Part'), ('SHIPPED_BY', 'Order', 'Supplier')) t(relationship, source, target)")
def db_schema_relationships(spark, d):
    return src.schema_relationships(tpch_graph(spark, d), spark)


_NAMES = {"Region": "region", "Nation": "nation", "Customer": "customer", "Supplier": "supplier", "Part": "part", "Order": "orders"}
_KINDS = "CASE column_type WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END"


@query(" UNION ALL ".join(f"SELECT '{label}' AS owner, 'concept' AS kind, column_name AS property, {_KINDS} AS type FROM (DESCRIBE SELECT * FROM {name})" for label, name in _NAMES.items()) + "".join(f" UNION ALL SELECT '{kind}', 'relationship', column_name[3:], {_KINDS} FROM (DESCRIBE SELECT * FROM lineitem) WHERE column_name NOT IN ('l_orderkey', 'l_partkey', 'l_suppkey')" for kind in ("CONTAINS", "SHIPPED_BY")))
def db_schema_properties(spark, d):
    return src.schema_properties(tpch_graph(spark, d), spark)


@query(" UNION ALL ".join(f"SELECT '{label}' AS label, column_name AS \"propertyKey\", {_KINDS} AS type FROM (DESCRIBE SELECT * FROM {name})" for label, name in _NAMES.items()))
def db_property_keys(spark, d):
    return src.property_keys(tpch_graph(spark, d), spark)


@query(f"WITH {TREE} SELECT count(*) AS n FROM tree")
def tree_size(spark, d):
    return tree(spark, d).agg(F.count("*").alias("n"))


# ---- search runs


@query("SELECT p_partkey AS id, p_size AS size, (SELECT count(*) FROM part WHERE p_size >= 30 AND p_brand IN ('Brand#12', 'Brand#13')) AS total_hits FROM part WHERE p_size >= 30 AND p_brand IN ('Brand#12', 'Brand#13') ORDER BY p_size DESC, id LIMIT 20 OFFSET 2")
def vertex_search(spark, d):
    options = {"conceptType": "Part", "filter": [{"propertyId": "p_size", "predicate": ">=", "values": [30]}, {"propertyId": "p_brand", "predicate": "in", "values": ["Brand#12", "Brand#13"]}], "sort": ["p_size:DESCENDING"], "offset": 2, "size": 20}
    return runs.vertex_search(tpch_graph(spark, d), options).select("id", F.col("p_size").alias("size"), "total_hits")


@query("SELECT l_orderkey AS \"order\", l_partkey AS part, (SELECT count(*) FROM lineitem WHERE l_quantity = 50 AND l_returnflag <> 'N') AS total_hits FROM lineitem WHERE l_quantity = 50 AND l_returnflag <> 'N'")
def edge_search(spark, d):
    options = {"edgeLabel": "CONTAINS", "filter": [{"propertyId": "quantity", "predicate": "=", "values": [50]}, {"propertyId": "returnflag", "predicate": "!=", "values": ["N"]}], "size": -1}
    return runs.edge_search(tpch_graph(spark, d), options).select(F.col("src").alias("order"), F.col("dst").alias("part"), "total_hits")


@query("SELECT 'vertex' AS kind, 'Supplier' AS type, s_suppkey::VARCHAR AS id, (SELECT count(*) FROM supplier WHERE s_acctbal BETWEEN 0 AND 5000) AS total_hits FROM supplier WHERE s_acctbal BETWEEN 0 AND 5000")
def element_search(spark, d):
    options = {"filter": [{"propertyId": "s_acctbal", "predicate": "range", "values": [0, 5000]}], "size": -1}
    return runs.element_search(tpch_graph(spark, d), options)


@query("SELECT l_orderkey AS element_id, l_linenumber AS row_id, l_quantity AS quantity, (SELECT count(*) FROM lineitem WHERE l_quantity > 49) AS total_hits FROM lineitem WHERE l_quantity > 49")
def extended_data_search(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("element_id"), F.col("l_linenumber").alias("row_id"), F.col("l_quantity").alias("quantity"))
    return runs.extended_data_search(rows, {"filter": [{"propertyId": "quantity", "predicate": ">", "values": [49]}], "size": -1})


@query(r"SELECT doc_id AS id FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), 'apache') AND (list_contains(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), 'license'))")
def query_string_over_texts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.filter(runs.any_text(docs, "Apache license")).select(F.col("doc_id").alias("id"))


@query("SELECT 'brands' AS name, p_brand AS key, count(*) AS n, NULL::DOUBLE AS value FROM part WHERE p_size < 20 GROUP BY 2 UNION ALL SELECT 'smallest', NULL, NULL, min(p_size) FROM part WHERE p_size < 20")
def aggregations_of_a_search(spark, d):
    options = {"filter": [{"propertyId": "p_size", "predicate": "<", "values": [20]}], "aggregations": [{"type": "term", "name": "brands", "field": "p_brand"}, {"type": "min", "name": "smallest", "field": "p_size"}]}
    return runs.aggregations(table(spark, d, "part"), options)


@query("SELECT (SELECT count(*) FROM customer WHERE c_custkey >= 10) AS nodes, (SELECT count(*) FROM orders WHERE o_custkey >= 10 AND o_orderkey >= 50) AS rels")
def delete_elements(spark, d):
    g = tpch_graph(spark, d)
    rels = g.rel("PLACED").select("rid", F.concat(F.lit("c"), "src").alias("src"), F.concat(F.lit("o"), "dst").alias("dst"))
    nodes = g.node("Customer").select(F.concat(F.lit("c"), "id").alias("id"))
    gone = g.node("Customer").filter("id < 10").select(F.concat(F.lit("c"), "id").alias("id"))
    left, kept = writes.delete_elements(nodes, rels, gone, g.rel("PLACED").filter("dst < 50"), detach=True)
    return left.agg(F.count("*").alias("nodes")).crossJoin(kept.agg(F.count("*").alias("rels")))  # one row each
