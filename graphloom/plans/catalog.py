"""Registered queries: the operators applied to the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geo, scalar as S, search as Q, temporal as T
from ..graph import Match, prop, tpch_graph
from ..operators import aggregations as A, computers, joins, paths, security, similarity, writes
from ..sources import tables as src
from ..streaming import enrichment
from .traversal import Traversal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def match(spark: SparkSession, folder: str) -> Match:
    return Match(tpch_graph(spark, folder))


#: Revenue of a line item variable.
REVENUE = "sum(l__extendedprice * (1 - l__discount))"


# ---- patterns


@query("""SELECT p_brand AS brand, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON o_custkey = c_custkey
 JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1 ORDER BY revenue DESC, brand LIMIT 10""")
def flagship_brand_revenue(spark, d):
    m = match(spark, d).node("c", "Customer", "c_mktsegment = 'BUILDING'").expand("c", "PLACED", "o", "Order").expand("o", "CONTAINS", "p", "Part", rel="l")
    out = m.frame.groupBy(prop("p", "p_brand").alias("brand")).agg(F.round(F.expr(REVENUE), 2).alias("revenue"))
    return out.orderBy(F.desc("revenue"), "brand").limit(10)


@query("SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders")
def scan_all_nodes_count(spark, d):
    return tpch_graph(spark, d).all_nodes().groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT 'IN_REGION' AS type, count(*) AS n FROM nation UNION ALL SELECT 'FROM_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'SHIPPED_BY', count(*) FROM lineitem")
def count_relationships_by_type(spark, d):
    return tpch_graph(spark, d).all_rels().groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier")
def scan_label(spark, d):
    return tpch_graph(spark, d).node("Supplier").select("id", F.col("s_name").alias("name"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey IN (1, 7, 42, 99999999)")
def seek_by_ids(spark, d):
    return src.by_ids(tpch_graph(spark, d).node("Customer"), [1, 7, 42, 99999999]).select("id", F.col("c_name").alias("name"))


@query("SELECT * FROM (VALUES (0, 42), (1, 7), (2, 1)) t(place, id) WHERE id IN (SELECT c_custkey FROM customer)")
def scan_in_order(spark, d):
    found = src.in_order(tpch_graph(spark, d).node("Customer"), [42, 7, 1], place="place")
    return found.select("place", F.col("id").cast("int").alias("id"))


@query("SELECT i AS id, i IN (SELECT c_custkey FROM customer) AS found FROM (VALUES (1), (2), (99999999)) t(i)")
def exist_by_ids(spark, d):
    return src.exist(tpch_graph(spark, d).node("Customer").select("id"), [1, 2, 99999999])


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey BETWEEN 10 AND 30")
def scan_id_range(spark, d):
    return src.by_range(tpch_graph(spark, d).node("Customer"), 10, 30).select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey > 100 ORDER BY id LIMIT 25")
def scan_next_page(spark, d):
    return src.next_page(tpch_graph(spark, d).node("Order"), 100, 25).select("id")


@query("SELECT p_partkey AS id, p_size AS size FROM part WHERE p_size BETWEEN 10 AND 12 AND p_brand = 'Brand#12'")
def seek_composite(spark, d):
    return tpch_graph(spark, d).node("Part").filter("p_size between 10 and 12 and p_brand = 'Brand#12'").select("id", F.col("p_size").alias("size"))


@query("SELECT p_partkey AS id, starts_with(p_brand, 'Brand#1') AS s, contains(p_type, 'A') AS c, suffix(p_brand, '2') AS e FROM part WHERE starts_with(p_brand, 'Brand#1') OR contains(p_type, 'N') OR suffix(p_brand, '2')")
def filter_strings(spark, d):
    p, brand, kind = tpch_graph(spark, d).node("Part"), F.col("p_brand"), F.col("p_type")
    hits = p.filter(brand.startswith("Brand#1") | kind.contains("N") | brand.endswith("2"))
    return hits.select("id", brand.startswith("Brand#1").alias("s"), kind.contains("A").alias("c"), brand.endswith("2").alias("e"))


@query("SELECT c_custkey AS id, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def expand_two_hops(spark, d):
    m = match(spark, d).node("c", "Customer").expand("c", "FROM_NATION", "n", "Nation").expand("n", "IN_REGION", "r", "Region")
    return m.select(id="c__id", nation="n__n_name", region="r__r_name")


@query("SELECT n_name AS nation, c_custkey AS customer FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9000")
def expand_incoming(spark, d):
    m = match(spark, d).node("n", "Nation").expand("n", "FROM_NATION", "c", "Customer", direction="in", where="c_acctbal > 9000")
    return m.select(nation="n__n_name", customer="c__id")


@query("SELECT DISTINCT o_orderkey AS id, s_suppkey AS supplier FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = c_nationkey")
def expand_into_bound(spark, d):
    m = match(spark, d).node("c", "Customer").expand("c", "PLACED", "o", "Order").expand("o", "SHIPPED_BY", "s", "Supplier").expand("c", "FROM_NATION", "n", "Nation").expand("s", "FROM_NATION", "n")
    return m.select(id="o__id", supplier="s__id").distinct()


@query("SELECT c_custkey AS id, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000")
def optional_expand(spark, d):
    m = match(spark, d).node("c", "Customer").expand("c", "PLACED", "o", "Order", where="o_totalprice > 400000", optional=True)
    return m.select(id="c__id", o="o__id")


@query("SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_semi_apply(spark, d):
    return match(spark, d).node("c", "Customer").exists("c", "PLACED", label="Order", where="o_orderstatus = 'F'", negate=True).select(id="c__id")


@query("SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_apply(spark, d):
    return match(spark, d).node("c", "Customer").exists("c", "PLACED", label="Order", where="o_orderpriority = '1-URGENT'").select(id="c__id")


@query("SELECT c_custkey AS id, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def let_semi_apply(spark, d):
    return match(spark, d).node("c", "Customer").flag("has_orders", "c", "PLACED").select(id="c__id", has_orders="has_orders")


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def select_or_semi_apply(spark, d):
    return match(spark, d).node("c", "Customer").flag("rich", "c", "PLACED", label="Order", where="o_totalprice > 450000").where("c__c_acctbal < 0 or rich").select(id="c__id")


@query("SELECT c_custkey AS id, coalesce(n, 0) AS degree FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def degree_of_nodes(spark, d):
    return match(spark, d).node("c", "Customer").degree("degree", "c", "PLACED").select(id="c__id", degree="degree")


@query("SELECT s_suppkey AS id, coalesce(array_to_string(l, ','), '') AS sizes FROM supplier LEFT JOIN (SELECT l_suppkey, list_sort(list(p_size)) AS l FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 50 GROUP BY 1) ON l_suppkey = s_suppkey")
def roll_up_pattern_comprehension(spark, d):
    g = tpch_graph(spark, d)
    # the comprehension runs over supplied parts: two relationship types of one line item
    parts = g.rel("SHIPPED_BY").filter("quantity >= 50").select("rid", "src", F.col("dst").alias("supplier")).join(g.rel("CONTAINS").select("rid", F.col("dst").alias("part")), "rid")
    sizes = parts.join(g.node("Part"), F.col("part") == F.col("id")).groupBy("supplier").agg(F.sort_array(F.collect_list("p_size")).alias("l"))
    return g.node("Supplier").join(sizes, F.col("id") == F.col("supplier"), "left").select("id", F.coalesce(F.concat_ws(",", "l"), F.lit("")).alias("sizes"))


@query("SELECT c_custkey AS id, coalesce(array_to_string(l, ','), '') AS orders FROM customer LEFT JOIN (SELECT o_custkey, list_sort(list(o_orderkey)) AS l FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def roll_up_apply(spark, d):
    m = match(spark, d).node("c", "Customer").roll_up("orders", "c", "PLACED", "_f")
    return m.select(id="c__id", orders="concat_ws(',', transform(orders, x -> cast(x as string)))")


@query("""SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey WHERE a.o_orderpriority = '1-URGENT' AND b.o_orderpriority = '2-HIGH'""")
def relationship_uniqueness(spark, d):
    m = match(spark, d).node("a", "Order", "o_orderpriority = '1-URGENT'").expand("a", "PLACED", "c", "Customer", direction="in").expand("c", "PLACED", "b", "Order", where="o_orderpriority = '2-HIGH'")
    return m.where("a__id < b__id").select(a="a__id", b="b__id")


@query("SELECT r.r_name AS region, n.n_name AS nation FROM region r, nation n WHERE r.r_regionkey <> n.n_regionkey")
def cartesian_product(spark, d):
    m = match(spark, d).node("r", "Region").node("n", "Nation").where("r__id <> n__n_regionkey")
    return m.select(region="r__r_name", nation="n__n_name")


@query("SELECT p.p_partkey AS part, s.s_suppkey AS supplier FROM part p JOIN supplier s ON p.p_size = s.s_nationkey WHERE p.p_retailprice > (SELECT avg(p_retailprice) FROM part)")
def value_hash_join(spark, d):
    g = tpch_graph(spark, d)
    mean = g.node("Part").agg(F.avg("p_retailprice").alias("mean"))  # one row
    parts = g.node("Part").crossJoin(mean).filter("p_retailprice > mean").select(F.col("p_partkey").alias("part"), "p_size")
    suppliers = g.node("Supplier").select(F.col("s_suppkey").alias("supplier"), "s_nationkey")
    return joins.value_join(parts, suppliers, "p_size", "s_nationkey", "part", "supplier").select("part", "supplier")


@query("""WITH hop AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R' AND l_quantity > 49)
SELECT DISTINCT x.a AS a, y.b AS b FROM hop x JOIN hop y ON x.b = y.a WHERE x.a <> y.b AND NOT EXISTS (SELECT 1 FROM hop z WHERE z.a = x.a AND z.b = y.b)""")
def triadic_selection(spark, d):
    return similarity.triadic(nation_trade(spark, d)).select("a", "b").distinct()


def nation_trade(spark, d):
    """(src, dst): nations of customers that returned large items of suppliers of a nation."""
    m = match(spark, d).node("c", "Customer").expand("c", "PLACED", "o", "Order").expand("o", "SHIPPED_BY", "s", "Supplier", rel="l", rel_where="returnflag = 'R' and quantity > 49")
    return m.frame.select(F.col("c__c_nationkey").alias("src"), F.col("s__s_nationkey").alias("dst")).distinct()


@query("""SELECT n1.n_name AS a, n2.n_name AS b FROM nation n1 JOIN nation n2 ON n1.n_regionkey = n2.n_regionkey WHERE n1.n_nationkey <> n2.n_nationkey""")
def undirected_two_hops(spark, d):
    m = match(spark, d).node("a", "Nation").expand("a", "IN_REGION", "r", "Region", direction="both").expand("r", "IN_REGION", "b", "Nation", direction="in")
    return m.select(a="a__n_name", b="b__n_name")


# ---- projections, predicates, sets, lists


@query("SELECT c_custkey AS id, x FROM customer, (VALUES (1), (2), (3)) t(x) WHERE c_acctbal > 9500")
def unwind_list(spark, d):
    df = table(spark, d, "customer").filter("c_acctbal > 9500")
    return df.select(F.col("c_custkey").alias("id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("x"))


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS class, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS seg FROM customer")
def case_expressions(spark, d):
    b, seg = F.col("c_acctbal"), F.col("c_mktsegment")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(b < 0, "debt").when(b < 5000, "low").otherwise("high").alias("class"), F.when(seg == "BUILDING", 1).when(seg == "MACHINERY", 2).otherwise(0).alias("seg"))


@query("SELECT o_orderkey AS id FROM orders WHERE regexp_full_match(o_orderpriority, '[12]-.*')")
def regex_full_match(spark, d):
    return table(spark, d, "orders").filter(S.matches(F.col("o_orderpriority"), "[12]-.*")).select(F.col("o_orderkey").alias("id"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))).distinct()


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT DISTINCT c_mktsegment AS segment, c_nationkey AS nation FROM customer")
def distinct_rows(spark, d):
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).distinct()


@query("SELECT vec_id AS id, len(list_filter(embedding, lambda x: x > 0)) = len(embedding) AS every, len(list_filter(embedding, lambda x: x > 0.2)) > 0 AS some, len(list_filter(embedding, lambda x: x > 0.3)) = 0 AS nothing, len(list_filter(embedding, lambda x: x > 0.25)) = 1 AS one FROM embeddings")
def list_quantifiers(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), S.all_of(e, lambda x: x > 0).alias("every"), S.any_of(e, lambda x: x > 0.2).alias("some"), S.none_of(e, lambda x: x > 0.3).alias("nothing"), S.single_of(e, lambda x: x > 0.25).alias("one"))


@query("SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[-1] AS DOUBLE) AS last, len(embedding[2:]) AS rest, CAST(len(embedding[2:4]) AS INT) AS part, CAST(embedding[3] AS DOUBLE) AS third, CAST(NULL AS DOUBLE) AS beyond FROM embeddings")
def list_access(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), S.head(e).cast("double").alias("first"), S.last(e).cast("double").alias("last"), F.size(S.tail(e)).cast("long").alias("rest"), F.size(S.list_slice(e, 1, 4)).alias("part"), S.index(e, 2).cast("double").alias("third"), S.index(e, 100000).cast("double").alias("beyond"))


@query("SELECT vec_id AS id, round(list_sum(list_transform(list_filter(embedding, lambda x: x > 0), lambda x: CAST(x AS DOUBLE) * x)), 4) AS positive FROM embeddings")
def list_comprehension_reduce(spark, d):
    squares = S.comprehension(F.col("embedding"), lambda x: x > 0, lambda x: x.cast("double") * x)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(S.fold(squares, F.lit(0.0), lambda a, x: a + x), 4).alias("positive"))


@query("SELECT p_partkey AS id, substr(p_name, 2, 3) AS mid, left(p_name, 4) AS lead, right(p_name, 2) AS tail, upper(p_name) AS up, lower(p_type) AS low, reverse(p_brand) AS back, replace(p_type, 'A', 'a') AS swapped, CAST(length(p_name) AS INT) AS size, trim('  x ') AS trimmed FROM part")
def string_functions(spark, d):
    n, t = F.col("p_name"), F.col("p_type")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.substring(n, 1, 3).alias("mid"), S.left(n, 4).alias("lead"), S.right(n, 2).alias("tail"), F.upper(n).alias("up"), F.lower(t).alias("low"), F.reverse("p_brand").alias("back"), F.replace(t, F.lit("A"), F.lit("a")).alias("swapped"), F.char_length(n).alias("size"), S.trim(F.lit("  x ")).alias("trimmed"))


@query("SELECT p_partkey AS id, CAST(ceil(p_retailprice / 7) AS DOUBLE) AS up, CAST(floor(p_retailprice / 7) AS DOUBLE) AS down, CAST(floor(p_retailprice / 7 + 0.5) AS DOUBLE) AS near, CAST(sign(p_size - 25) AS BIGINT) AS side, round(sqrt(p_retailprice), 6) AS root, round(ln(p_retailprice), 6) AS logged, p_size // 7 AS whole, p_size % 7 AS part, CAST(pow(p_size, 2) AS DOUBLE) AS square, round((1 - cos(p_size)) / 2, 6) AS hav FROM part")
def math_functions(spark, d):
    p, s = F.col("p_retailprice"), F.col("p_size")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.ceil(p / 7).alias("up"), S.floor(p / 7).alias("down"), S.round_half_up(p / 7).alias("near"), S.sign(s - 25).alias("side"), F.round(F.sqrt(p), 6).alias("root"), F.round(S.log(p), 6).alias("logged"), S.int_div(s, F.lit(7)).cast("int").alias("whole"), S.remainder(s, 7).alias("part"), S.power(s, 2).alias("square"), F.round(S.haversin(s), 6).alias("hav"))


@query("SELECT event_id AS id, TRY_CAST(regexp_extract(props, ': ([0-9]+)', 1) AS BIGINT) AS k, TRY_CAST(event_type AS BIGINT) AS none, CAST(trunc(value) AS BIGINT) AS whole FROM events")
def conversions(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), S.to_integer(F.regexp_extract("props", ": ([0-9]+)", 1)).alias("k"), S.to_integer(F.col("event_type")).alias("none"), S.to_integer(F.col("value")).alias("whole"))


@query("SELECT r_regionkey AS id, array_to_string(range(0, r_regionkey + 1), ',') AS up, array_to_string(range(r_regionkey, -3, -2), ',') AS down, '' AS away FROM region")
def range_function(spark, d):
    k = F.col("r_regionkey")
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    return table(spark, d, "region").select(k.alias("id"), text(S.int_range(F.lit(0), k)).alias("up"), text(S.int_range(k, -2, -2)).alias("down"), text(S.int_range(k, F.lit(-1))).alias("away"))


@query("SELECT event_id AS id, year(ts) AS y, quarter(ts) AS q, month(ts) AS m, week(ts) AS w, dayofyear(ts) AS doy, isodow(ts) AS dow, hour(ts) AS h, date_trunc('month', ts) AS month_start, make_timestamp((year(ts) // 10) * 10, 1, 1, 0, 0, 0) AS decade_start, CAST(floor(epoch(ts)) AS BIGINT) AS epoch FROM events")
def temporal_components(spark, d):
    t = F.col("ts")
    names = {"y": "year", "q": "quarter", "m": "month", "w": "week", "doy": "dayOfYear", "dow": "dayOfWeek", "h": "hour"}
    return table(spark, d, "events").select(F.col("event_id").alias("id"), *(T.COMPONENTS[c](t).cast("long").alias(k) for k, c in names.items()), T.truncate("month", t).alias("month_start"), T.truncate("decade", t).alias("decade_start"), T.COMPONENTS["epochSeconds"](t).alias("epoch"))


@query("SELECT o_orderkey AS id, o_orderdate + INTERVAL 1 MONTH + INTERVAL 3 DAY + INTERVAL 3600 SECOND AS due, date_diff('day', o_orderdate, TIMESTAMP '2000-01-01') AS days FROM orders WHERE o_orderdate = date_trunc('day', o_orderdate)")
def duration_arithmetic(spark, d):
    t = F.col("o_orderdate")
    far = F.lit("2000-01-01").cast("timestamp_ntz")
    return table(spark, d, "orders").filter(t == F.date_trunc("day", t)).select(F.col("o_orderkey").alias("id"), T.plus(t, T.duration_of("P1M3DT1H")).cast("timestamp_ntz").alias("due"), T.between_days(t, far).alias("days"))


GEO_LAT, GEO_LON = "CAST(c_custkey % 160 - 80 AS DOUBLE)", "CAST(c_custkey * 7 % 340 - 170 AS DOUBLE)"


def _places(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), geo.point(k % 160 - 80, k * 7 % 340 - 170).alias("at"))


@query(f"SELECT id, round(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(48.85 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48.85)) * pow(sin(radians(2.35 - lon) / 2), 2)))), 3) AS km FROM (SELECT c_custkey AS id, {GEO_LAT} AS lat, {GEO_LON} AS lon FROM customer)")
def geo_distance(spark, d):
    return _places(spark, d).select("id", F.round(geo.distance(F.col("at"), geo.point(48.85, 2.35)), 3).alias("km"))


@query(f"SELECT id FROM (SELECT c_custkey AS id, {GEO_LAT} AS lat, {GEO_LON} AS lon FROM customer) WHERE lat BETWEEN 10 AND 60 AND lon BETWEEN -20 AND 40")
def geo_within_box(spark, d):
    return _places(spark, d).filter(geo.in_box(F.col("at"), 60, -20, 10, 40)).select("id")


def _geohash_sql(digits: int) -> str:
    """The geohash of lat and lon, bits of longitude and latitude in turn."""
    bits = 5 * digits
    cell = lambda v, low, width, n: f"least(CAST(floor(({v} - {low}) / {width} * {1 << n}) AS BIGINT), {(1 << n) - 1})"
    out = []
    for digit in range(digits):
        value = []
        for i in range(5 * digit, 5 * digit + 5):
            v, low, width, n = ("lon", "-180.0", "360.0", (bits + 1) // 2) if i % 2 == 0 else ("lat", "-90.0", "180.0", bits // 2)
            value.append(f"(({cell(v, low, width, n)} >> {n - 1 - i // 2}) & 1) * {1 << (4 - i % 5)}")
        out.append(f"substr('{geo.DIGITS}', CAST({' + '.join(value)} AS INT) + 1, 1)")
    return " || ".join(out)


@query(f"SELECT key, count(*) AS n, round(avg(lat), 6) AS latitude, round(avg(lon), 6) AS longitude FROM (SELECT {_geohash_sql(3)} AS key, lat, lon FROM (SELECT {GEO_LAT} AS lat, {GEO_LON} AS lon FROM customer)) GROUP BY key")
def geohash_buckets(spark, d):
    cells = _places(spark, d).withColumn("cell", geo.geohash(F.col("at"), 3))
    found = A.geohashes(cells, F.col("cell"), F.col("at.latitude"), F.col("at.longitude"))
    return found.withColumns({"latitude": F.round("latitude", 6), "longitude": F.round("longitude", 6)})


# ---- aggregations


@query("SELECT c_mktsegment AS segment, count(*) AS n, count(DISTINCT c_nationkey) AS nations, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 4) AS mean, min(c_acctbal) AS low, max(c_acctbal) AS high, round(stddev_samp(c_acctbal), 4) AS sd, round(stddev_pop(c_acctbal), 4) AS sdp FROM customer GROUP BY 1")
def group_aggregates(spark, d):
    b = F.col("c_acctbal")
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.count_distinct("c_nationkey").alias("nations"), F.round(S.total(b), 2).alias("total"), F.round(F.avg(b), 4).alias("mean"), F.min(b).alias("low"), F.max(b).alias("high"), F.round(S.stdev(b), 4).alias("sd"), F.round(S.stdevp(b), 4).alias("sdp"))


@query("SELECT count(*) AS n, coalesce(sum(c_acctbal), 0) AS total, avg(c_acctbal) AS mean, 0.0::DOUBLE AS sd FROM customer WHERE c_custkey < 0")
def aggregates_of_nothing(spark, d):
    b = F.col("c_acctbal")
    return table(spark, d, "customer").filter("c_custkey < 0").agg(F.count("*").alias("n"), S.total(b).alias("total"), F.avg(b).alias("mean"), S.stdev(b).alias("sd"))


@query("SELECT l_returnflag AS flag, round(quantile_cont(l_quantity, 0.3), 4) AS cont, quantile_disc(l_quantity, 0.3) AS disc FROM lineitem GROUP BY 1")
def percentile_aggregates(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity")
    cont = A.percentiles(items, "l_quantity", [30], ["flag"]).select("flag", F.round("value", 4).alias("cont"))
    return cont.join(A.percentiles(items, "l_quantity", [30], ["flag"], discrete=True).select("flag", F.col("value").alias("disc")), "flag")


@query("SELECT s_nationkey AS nation, array_to_string(list_sort(list(s_suppkey)), ',') AS suppliers FROM supplier GROUP BY 1")
def collect_lists(spark, d):
    return table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("s_suppkey")), lambda x: x.cast("string"))).alias("suppliers"))


@query("SELECT p_brand AS key, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM part GROUP BY 1 ORDER BY n DESC, key LIMIT 10")
def terms_aggregation(spark, d):
    return A.terms(table(spark, d, "part"), F.col("p_brand"), size=10, metrics={"price": F.round(F.avg("p_retailprice"), 4)})


@query("SELECT min(v) AS key, CAST(sum(n) AS BIGINT) AS n FROM (SELECT lower(event_type) AS f, event_type AS v, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY f")
def terms_folded(spark, d):
    return A.terms(table(spark, d, "events"), F.col("event_type"), fold_case=True)


@query("SELECT p_brand AS brand, p_type AS type, count(*) AS n, max(p_size) AS size FROM part GROUP BY 1, 2")
def nested_terms(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("type")).agg(F.count("*").alias("n"), F.max("p_size").alias("size"))


@query("SELECT CAST(g * 10 AS DOUBLE) AS key, count(p_partkey) AS n FROM range(0, 8) t(g) LEFT JOIN part ON p_size // 10 = g GROUP BY 1")
def histogram_with_bounds(spark, d):
    return A.histogram(table(spark, d, "part"), F.col("p_size"), 10.0, bounds=(0, 79))


@query("SELECT date_trunc('month', o_orderdate) AS key, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def date_histogram(spark, d):
    return A.date_histogram(table(spark, d, "orders"), F.col("o_orderdate"), "month", {"total": F.round(F.sum("o_totalprice"), 2)})


@query("SELECT CAST(hour(ts) AS INT) AS key, count(*) AS n FROM events GROUP BY 1")
def chrono_hour_of_day(spark, d):
    return A.chrono_field(table(spark, d, "events"), F.col("ts"), "HOUR_OF_DAY")


@query("SELECT CAST(dayofweek(ts) + 1 AS INT) AS key, count(*) AS n FROM events GROUP BY 1")
def chrono_day_of_week(spark, d):
    return A.chrono_field(table(spark, d, "events"), F.col("ts"), "DAY_OF_WEEK")


@query("SELECT 'low' AS key, count(*) AS n FROM orders WHERE o_totalprice < 100000 UNION ALL SELECT 'mid', count(*) FROM orders WHERE o_totalprice >= 50000 AND o_totalprice < 200000 UNION ALL SELECT 'high', count(*) FROM orders WHERE o_totalprice >= 200000")
def range_aggregation(spark, d):
    return A.ranges(table(spark, d, "orders"), F.col("o_totalprice"), [("low", None, 100000), ("mid", 50000, 200000), ("high", 200000, None)])


@query("SELECT count(DISTINCT o_custkey) AS n FROM orders")
def cardinality_aggregation(spark, d):
    return A.cardinality(table(spark, d, "orders"), F.col("o_custkey"))


@query("SELECT l_linestatus, count(l_quantity) AS n, min(l_quantity) AS low, max(l_quantity) AS high, sum(l_quantity) AS total, round(avg(l_quantity), 6) AS average, round(stddev_pop(l_quantity), 6) AS deviation FROM lineitem GROUP BY 1")
def statistics_aggregation(spark, d):
    return A.statistics(table(spark, d, "lineitem"), F.col("l_quantity"), ["l_linestatus"]).withColumns({"average": F.round("average", 6), "deviation": F.round("deviation", 6)})


@query(" UNION ALL ".join(f"SELECT {p}::DOUBLE AS percentile, round(quantile_cont(l_extendedprice, {p / 100}), 3) AS value FROM lineitem" for p in (5, 50, 95)))
def percentiles_aggregation(spark, d):
    return A.percentiles(table(spark, d, "lineitem"), "l_extendedprice", [5, 50, 95]).withColumn("value", F.round("value", 3))


@query("SELECT o_custkey AS id, max(o_totalprice) AS high, min(o_totalprice) AS low, round(sum(o_totalprice), 2) AS total, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS latest, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS priorities FROM orders GROUP BY 1")
def write_time_merge(spark, d):
    changes = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.struct("o_orderdate", "o_orderkey").alias("ts"), F.col("o_totalprice").alias("high"), F.col("o_totalprice").alias("low"), F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("latest"), F.col("o_orderpriority").alias("priorities"))
    out = A.upsert(changes, "id", {"high": "MAX", "low": "MIN", "total": "SUM", "latest": "NONE", "priorities": "SET"})
    return out.withColumns({"total": F.round("total", 2), "priorities": F.concat_ws(",", "priorities")})


# ---- order, pages, scores


@query("SELECT c_custkey AS id, c_acctbal AS b FROM customer ORDER BY b DESC NULLS FIRST, id LIMIT 20")
def top_n(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("b")).orderBy(S.desc(F.col("b")), "id").limit(20)


@query("SELECT c_custkey AS id FROM customer ORDER BY c_acctbal, id LIMIT 10 OFFSET 5")
def skip_limit(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal").orderBy("c_acctbal", "id").offset(5).limit(10).select("id")


@query("SELECT p_brand AS brand, p_partkey AS id FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part) WHERE r = 1")
def top_with_ties(spark, d):
    return A.top_with_ties(table(spark, d, "part"), "p_size", by=["p_brand"]).select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"))


@query("SELECT p_partkey AS id, (SELECT count(*) FROM part WHERE p_size > 40) AS total_hits FROM part WHERE p_size > 40 ORDER BY p_retailprice DESC, id LIMIT 10 OFFSET 3")
def search_page(spark, d):
    hits = table(spark, d, "part").filter("p_size > 40").select(F.col("p_partkey").alias("id"), "p_retailprice")
    return A.search_page(hits, [F.desc("p_retailprice"), F.asc("id")], 3, 10).select("id", "total_hits")


@query("SELECT p_partkey AS id FROM part ORDER BY length(p_name), p_name, id LIMIT 15")
def sort_by_length(spark, d):
    return table(spark, d, "part").orderBy(F.length("p_name"), "p_name", "p_partkey").limit(15).select(F.col("p_partkey").alias("id"))


@query("SELECT doc_id AS id, 4 * 8 - bit_count(xor(('0x' || left(md5(source), 8))::BIGINT, 2309737967::BIGINT)) AS score FROM documents")
def hamming_scores(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), Q.hamming_score(F.left(F.md5(F.col("source").cast("binary")), F.lit(8)), "89abcdef").cast("int").alias("score"))


# ---- search


@query("SELECT c_custkey AS id FROM customer WHERE (c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 1000 AND c_acctbal < 3000) OR NOT (c_nationkey <> 7)")
def bool_query(spark, d):
    c = table(spark, d, "customer")
    hit = Q.should(Q.must(Q.compare(F.col("c_mktsegment"), "IN", ["BUILDING", "MACHINERY"]), Q.between(F.col("c_acctbal"), 1000, 3000, high_inclusive=False)), Q.must_not(Q.compare(F.col("c_nationkey"), "NOT_EQUAL", 7)))
    return c.filter(hit).select(F.col("c_custkey").alias("id"))


@query(r"SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'the ') AND NOT list_contains(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), 'of')")
def text_predicates(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").filter(Q.text_contains(t, "The ") & Q.text_lacks(t, "of")).select(F.col("doc_id").alias("id"))


@query(r"SELECT doc_id AS id, list_contains(w, 'license') AS term, len(list_filter(w, lambda x: starts_with(x, 'licens'))) > 0 AS prefix, len(list_filter(w, lambda x: regexp_full_match(x, 'l.c.*'))) > 0 AS wild FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z0-9_]+') AS w FROM documents)")
def full_text_terms(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), Q.term(t, "license").alias("term"), Q.prefix(t, "licens").alias("prefix"), Q.wildcard(t, "l?c*").alias("wild"))


@query(r"SELECT doc_id AS id FROM documents WHERE regexp_matches(lower(text), '\bapache[^a-z0-9_]+license\b')")
def phrase_search(spark, d):
    return table(spark, d, "documents").filter(Q.phrase(F.col("text"), "Apache License")).select(F.col("doc_id").alias("id"))


@query(r"SELECT doc_id AS id FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS w FROM documents) WHERE w <> '' GROUP BY doc_id HAVING min(levenshtein(w, 'licence')) <= 1")
def fuzzy_search(spark, d):
    return table(spark, d, "documents").filter(Q.fuzzy(F.col("text"), "licence", 1)).select(F.col("doc_id").alias("id"))


@query(r"""WITH q AS (SELECT w, count(*) AS q FROM (SELECT unnest(regexp_split_to_array(lower('Licensed under the Apache License, Version 2.0. All rights reserved.'), '[^a-z0-9_]+')) AS w) WHERE w <> '' GROUP BY w),
words AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS w FROM documents) WHERE w IN (SELECT w FROM q) GROUP BY doc_id, w),
idf AS (SELECT w, q, ln((SELECT count(*) FROM documents)::DOUBLE / count(*)) AS idf FROM words JOIN q USING (w) GROUP BY w, q)
SELECT doc_id, round(sum(tf * q * idf * idf), 6) AS score FROM words JOIN idf USING (w) GROUP BY doc_id""")
def more_like_this(spark, d):
    sample = "Licensed under the Apache License, Version 2.0. All rights reserved."
    return Q.more_like_this(table(spark, d, "documents"), "doc_id", "text", sample).withColumn("score", F.round("score", 6))


@query("SELECT doc_id AS id FROM documents WHERE source = 'src3' OR lang = 'fr' OR (source IS NULL AND lang IS NULL)")
def value_of_any_property(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    return docs.filter(Q.has_value_of_type(docs, "string", lambda c: c.isin("src3", "fr")) | Q.lacks(F.col("source"), F.col("lang"))).select(F.col("doc_id").alias("id"))


# ---- visibility


VISIBILITY = "CASE c_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'a&b' ELSE '(a&b)|c' END"


@query("SELECT c_custkey AS id FROM customer WHERE c_nationkey % 4 IN (0, 1)")
def visibility_filter(spark, d):
    c = table(spark, d, "customer").withColumn("visibility", F.expr(VISIBILITY))
    return security.authorised(c, "visibility", ["a"]).select(F.col("c_custkey").alias("id"))


@query("SELECT c_custkey AS id FROM customer WHERE c_nationkey % 4 IN (2, 3)")
def visibility_mentions(spark, d):
    c = table(spark, d, "customer").withColumn("visibility", F.expr(VISIBILITY))
    return security.mentions(c, "visibility", "b").select(F.col("c_custkey").alias("id"))


# ---- writes


@query("SELECT r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT 100, 'ATLANTIS'")
def create_nodes(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return writes.create(r, spark.createDataFrame([(100, "ATLANTIS")], "id int, name string"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) THEN 'matched' ELSE n_name END AS name FROM nation UNION ALL SELECT 500, 'created'")
def merge_nodes(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    keys = table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("id")).union(spark.createDataFrame([(500,)], "id int"))
    return writes.merge(n, keys, ["id"], {"name": F.lit("created")}, {"name": F.lit("matched")})


@query("SELECT s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS balance FROM supplier")
def set_property(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return writes.set_properties(s, F.col("balance") < 0, {"balance": F.lit(0.0)})


@query("SELECT (SELECT count(*) FROM customer WHERE c_acctbal >= 0) AS nodes, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0) AS edges")
def detach_delete(spark, d):
    g = tpch_graph(spark, d)
    gone = g.node("Customer").filter("c_acctbal < 0").select("id")
    orders = g.rel("PLACED").select(F.concat(F.lit("c"), "src").alias("src"), F.concat(F.lit("o"), "dst").alias("dst"))
    nodes, edges = writes.delete_nodes(g.node("Customer").select(F.concat(F.lit("c"), "id").alias("id")), orders, gone.select(F.concat(F.lit("c"), "id").alias("id")))
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each


@query("SELECT user_id AS id, event_type AS kind FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'purchase'")
def latest_versions(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("ts"), F.col("event_type").alias("kind"), (F.col("event_type") == "purchase").alias("deleted"))
    return writes.latest(log, "id").select("id", "kind")


@query("SELECT 'unique' AS rule, coalesce(sum(n), 0)::BIGINT AS n FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'exists l_shipdate', count(*) FILTER (l_shipdate IS NULL) FROM lineitem")
def constraint_violations(spark, d):
    return writes.violations(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate"])


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderdate + INTERVAL 365 DAY > TIMESTAMP '1998-01-01'")
def ttl_alive(spark, d):
    o = table(spark, d, "orders").withColumn("expires", F.expr("o_orderdate + interval 365 days"))
    return writes.expired(o, "expires", F.lit("1998-01-01").cast("timestamp_ntz")).select(F.col("o_orderkey").alias("id"))


# ---- catalog


@query("SELECT * FROM (VALUES ('Region'), ('Nation'), ('Customer'), ('Supplier'), ('Part'), ('Order')) t(label)")
def db_labels(spark, d):
    return src.labels(tpch_graph(spark, d))


@query("SELECT * FROM (VALUES ('IN_REGION'), ('FROM_NATION'), ('PLACED'), ('CONTAINS'), ('SHIPPED_BY')) t(relationshipType)")
def db_relationship_types(spark, d):
    return src.relationship_types(tpch_graph(spark, d))


# ---- traversal


@query("SELECT count(*) AS count FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND l_quantity > 40")
def traversal_count(spark, d):
    g = tpch_graph(spark, d)
    return Traversal.V(g, "Customer").has("c_mktsegment", "eq", "BUILDING").out("PLACED", "Order").out("CONTAINS", "Part", "quantity > 40").count()


@query("SELECT n_name, count(*) AS count FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal >= 1000 AND s_acctbal < 5000 GROUP BY 1")
def traversal_group_count(spark, d):
    g = tpch_graph(spark, d)
    t = Traversal.V(g, "Supplier").has("s_acctbal", "between", 1000, 5000)
    items = g.rel("SHIPPED_BY").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("k"))
    at = t.at.join(items, "id").select("id", (F.col("n") * F.col("k")).alias("n"))
    return Traversal(g, "Supplier", at).out("FROM_NATION", "Nation").group_count("n_name")


@query("SELECT max(p_retailprice) AS max FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = 4)")
def traversal_max(spark, d):
    return Traversal.V(tpch_graph(spark, d), "Customer", 4).out("PLACED", "Order").out("CONTAINS", "Part").dedup().metric("p_retailprice", "max")


@query("SELECT c_custkey AS id, c_acctbal, 1::BIGINT AS n FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000 ORDER BY c_acctbal DESC, id LIMIT 12")
def traversal_order(spark, d):
    return Traversal.V(tpch_graph(spark, d), "Customer").has("c_acctbal", "outside", 0, 9000).order("c_acctbal", 12, descending=True)


# ---- paths and neighbourhoods


TRADE = """hop AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R' AND l_quantity > 49)"""
#: The nations, regions, customers and suppliers as one tree of ids.
TREE = """tree AS (SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation UNION SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier)"""


def tree(spark, d):
    return tpch_graph(spark, d).edges("IN_REGION", "FROM_NATION").select("src", "dst")


def _sources(spark, *ids):
    kind = "int" if isinstance(ids[0], int) else "string"
    return spark.createDataFrame([(i,) for i in ids], f"source {kind}")


@query(f"WITH RECURSIVE {TREE}, e AS (SELECT src, dst FROM tree UNION SELECT dst, src FROM tree), b AS (SELECT 'nation:3' AS id, 0 AS hops UNION SELECT e.dst, b.hops + 1 FROM b JOIN e ON e.src = b.id WHERE b.hops < 3) SELECT 'nation:3' AS source, id, min(hops) AS hops FROM b GROUP BY id HAVING min(hops) > 0")
def k_neighbor_three(spark, d):
    return paths.k_neighbor(paths.both(tree(spark, d)), _sources(spark, "nation:3"), 3)


@query(f"WITH RECURSIVE {TREE}, e AS (SELECT src, dst FROM tree UNION SELECT dst, src FROM tree), b AS (SELECT 'nation:3' AS id, 0 AS hops UNION SELECT e.dst, b.hops + 1 FROM b JOIN e ON e.src = b.id WHERE b.hops < 2) SELECT 'nation:3' AS source, id FROM b GROUP BY id HAVING min(hops) = 2")
def k_out_nearest(spark, d):
    return paths.k_out(paths.both(tree(spark, d)), _sources(spark, "nation:3"), 2)


@query(f"WITH {TRADE}, a AS (SELECT DISTINCT dst AS id FROM hop WHERE src = 3 AND dst <> 3) SELECT DISTINCT 3 AS source, hop.dst AS id FROM a JOIN hop ON hop.src = a.id WHERE hop.dst <> 3")
def k_out_walk(spark, d):
    return paths.k_out(nation_trade(spark, d), _sources(spark, 3), 2, nearest=False)


@query(f"WITH {TRADE}, u AS (SELECT src, dst FROM hop UNION ALL SELECT dst, src FROM hop WHERE src <> dst), one AS (SELECT src AS source, [src, dst] AS path, dst AS v FROM u WHERE src = 3 AND dst <> 3), two AS (SELECT source, list_append(path, dst) AS path, dst AS v FROM one JOIN u ON src = v WHERE NOT list_contains(path, dst) AND v <> 5) SELECT array_to_string(path, '>') AS path FROM one WHERE v = 5 UNION ALL SELECT array_to_string(path, '>') FROM two WHERE v = 5")
def find_paths_two_hops(spark, d):
    found = paths.find_paths(nation_trade(spark, d), 3, 5, 2)
    return found.select(F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))).alias("path"))


@query(f"WITH {TREE} SELECT 'customer:' || c_custkey AS source, 'region:' || n_regionkey AS target, 'customer:' || c_custkey || '>nation:' || c_nationkey || '>region:' || n_regionkey AS path FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey IN (1, 2, 3)")
def shortest_paths_in_tree(spark, d):
    edges = paths.both(tree(spark, d))
    g = tpch_graph(spark, d)
    pairs = g.node("Customer").filter("c_custkey in (1, 2, 3)").join(g.node("Nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("customer:"), "c_custkey").alias("source"), F.concat(F.lit("region:"), "n_regionkey").alias("target"))
    return paths.shortest_paths(edges, pairs, 4, single=True).select("source", "target", F.concat_ws(">", "path").alias("path"))


@query(f"WITH {TRADE}, two AS (SELECT a.src AS s, a.dst AS v, b.dst AS t FROM hop a JOIN hop b ON a.dst = b.src WHERE a.src = 3) SELECT 3 AS source, t AS target, s || '>' || v || '>' || t AS path FROM two WHERE t NOT IN (SELECT dst FROM hop WHERE src = 3) AND t <> 3 UNION ALL SELECT 3, dst, '3>' || dst FROM hop WHERE src = 3 AND dst <> 3")
def all_shortest_paths(spark, d):
    edges = nation_trade(spark, d)
    targets = table(spark, d, "nation").filter("n_nationkey <> 3").select(F.lit(3).alias("source"), F.col("n_nationkey").alias("target"))
    return paths.shortest_paths(edges, targets, 2).select("source", "target", F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))).alias("path"))


def weighted_trade(spark, d):
    """(src, dst, weight): between nations of customers and suppliers, the cheapest item."""
    m = match(spark, d).node("c", "Customer").expand("c", "PLACED", "o", "Order").expand("o", "SHIPPED_BY", "s", "Supplier", rel="l", rel_where="returnflag = 'R' and quantity > 49")
    return m.frame.groupBy(F.col("c__c_nationkey").alias("src"), F.col("s__s_nationkey").alias("dst")).agg(F.floor(F.min("l__extendedprice")).cast("double").alias("weight"))


@query("""WITH RECURSIVE w AS (SELECT c_nationkey AS src, s_nationkey AS dst, CAST(floor(min(l_extendedprice)) AS DOUBLE) AS weight FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R' AND l_quantity > 49 GROUP BY 1, 2),
b AS (SELECT 3 AS id, CAST(0 AS DOUBLE) AS dist, 0 AS h UNION ALL SELECT * FROM (SELECT w.dst, min(b.dist + w.weight), b.h + 1 FROM b JOIN w ON w.src = b.id WHERE b.h < 25 GROUP BY w.dst, b.h)) SELECT 3 AS source, id, min(dist) AS distance FROM b GROUP BY id""")
def weighted_shortest_distances(spark, d):
    return paths.weighted_distances(weighted_trade(spark, d), _sources(spark, 3))


@query(f"WITH {TRADE}, u AS (SELECT src, dst FROM hop WHERE src <> dst UNION SELECT dst, src FROM hop WHERE src <> dst) SELECT 3 AS source, '3>' || a.dst || '>' || b.dst || '>3' AS path FROM u a JOIN u b ON a.dst = b.src JOIN u c ON b.dst = c.src WHERE a.src = 3 AND c.dst = 3 AND b.dst <> 3 AND a.dst < b.dst")
def rings_of_three(spark, d):
    return paths.rings(nation_trade(spark, d), _sources(spark, 3), 3).select("source", F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))).alias("path"))


@query(f"WITH {TREE} SELECT 'supplier:' || s_suppkey AS source, 'supplier:' || s_suppkey || '>nation:' || s_nationkey || '>region:' || n_regionkey AS path FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def rays_to_leaves(spark, d):
    sources = tpch_graph(spark, d).node("Supplier").select(F.concat(F.lit("supplier:"), "id").alias("source"))
    return paths.rays(tree(spark, d), sources, 5).select("source", F.concat_ws(">", "path").alias("path"))


@query("SELECT c_custkey AS source, s_suppkey AS id, round(sum(o_totalprice), 2) AS weight FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_acctbal > 9900 AND l_quantity > 48 GROUP BY 1, 2")
def customized_paths(spark, d):
    g = tpch_graph(spark, d)
    start = g.node("Customer").filter("c_acctbal > 9900").select(F.concat(F.lit("customer:"), "id").alias("source"))
    name = lambda label, c: F.concat(F.lit(label + ":"), c)
    placed = g.rel("PLACED").join(g.node("Order").select(F.col("id").alias("dst"), F.col("o_totalprice").alias("weight")), "dst").select(name("customer", "src").alias("src"), name("order", "dst").alias("dst"), "weight")
    shipped = g.rel("SHIPPED_BY").filter("quantity > 48").select(name("order", "src").alias("src"), name("supplier", "dst").alias("dst"))
    found = paths.steps(start, [placed, shipped], weight=True)
    key = lambda c: F.substring_index(c, ":", -1).cast("long")
    return found.groupBy(key("source").alias("source"), key("id").alias("id")).agg(F.round(F.sum("weight"), 2).alias("weight"))


@query("SELECT c_custkey AS source, count(*) AS edges FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def multi_step_count(spark, d):
    g = tpch_graph(spark, d)
    start = g.node("Customer").filter("c_mktsegment = 'BUILDING'").select(F.col("id").alias("source"))
    return paths.step_counts(start, [g.rel("PLACED"), g.rel("CONTAINS")])


@query(f"WITH {TRADE}, a AS (SELECT dst AS id FROM hop WHERE src = 3), b AS (SELECT src AS id FROM hop WHERE dst = 5) SELECT id FROM a INTERSECT SELECT id FROM b")
def crosspoints_of_two(spark, d):
    edges = nation_trade(spark, d)
    return paths.crosspoints([paths.walks(edges, _sources(spark, 3), 1, 1, simple=False), paths.walks(paths.reverse(edges), _sources(spark, 5), 1, 1, simple=False)])


@query(f"WITH {TRADE} SELECT src, dst FROM hop WHERE src IN (1, 3, 5, 7) AND dst IN (1, 3, 5, 7)")
def related_edges(spark, d):
    return paths.related_edges(nation_trade(spark, d), spark.createDataFrame([(1,), (3,), (5,), (7,)], "id int"))


@query(f"WITH {TRADE} SELECT 3 AS source, dst AS id, 1 AS hops, count(*) AS n FROM hop WHERE src = 3 GROUP BY 2 UNION ALL SELECT 3, b.dst, 2, count(*) FROM hop a JOIN hop b ON a.dst = b.src WHERE a.src = 3 AND NOT (a.src = b.src AND a.dst = b.dst) GROUP BY 2 UNION ALL SELECT 3, c.dst, 3, count(*) FROM hop a JOIN hop b ON a.dst = b.src JOIN hop c ON b.dst = c.src WHERE a.src = 3 AND NOT (a.src = b.src AND a.dst = b.dst) AND NOT (a.src = c.src AND a.dst = c.dst) AND NOT (b.src = c.src AND b.dst = c.dst) GROUP BY 2")
def var_length_expand(spark, d):
    edges = nation_trade(spark, d).withColumn("rid", F.struct("src", "dst"))
    found = paths.trails(edges, _sources(spark, 3), 1, 3)
    return found.groupBy("source", "id", "hops").agg(F.count("*").alias("n"))


# ---- similarity and ranks


@query(f"WITH {TRADE} SELECT dst AS id FROM hop WHERE src = 3 INTERSECT SELECT dst FROM hop WHERE src = 5")
def same_neighbors(spark, d):
    return similarity.same_neighbors(nation_trade(spark, d), 3, 5)


@query(f"WITH {TRADE}, n AS (SELECT src, list(DISTINCT dst) AS l FROM hop GROUP BY 1) SELECT a.src AS a, b.src AS b, round(len(list_intersect(a.l, b.l))::DOUBLE / len(list_distinct(list_concat(a.l, b.l))), 6) AS jaccard FROM n a, n b WHERE a.src < b.src AND list_has_any(a.l, b.l)")
def jaccard_of_pairs(spark, d):
    return similarity.jaccard_of_all(nation_trade(spark, d)).withColumn("jaccard", F.round("jaccard", 6))


@query("""WITH near AS (SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 49), deg AS (SELECT src, count(*) AS n FROM near GROUP BY 1 HAVING count(*) >= 3)
SELECT x.src AS a, y.src AS b, round(count(*)::DOUBLE / any_value(deg.n), 6) AS score FROM near x JOIN deg ON deg.src = x.src JOIN near y ON x.dst = y.dst AND x.src <> y.src GROUP BY 1, 2 HAVING count(*) >= 0.6 * any_value(deg.n)""")
def fusiform_similarity(spark, d):
    m = match(spark, d).node("c", "Customer").expand("c", "PLACED", "o", "Order").expand("o", "SHIPPED_BY", "s", "Supplier", rel="l", rel_where="quantity > 49")
    near = m.frame.select(F.col("c__id").alias("src"), F.col("s__id").alias("dst"))
    return similarity.fusiform(near, 0.6, min_neighbors=3).withColumn("score", F.round("score", 6))


@query(f"""WITH {TRADE}, near AS (SELECT dst AS id FROM hop WHERE src = 3 UNION SELECT b.dst FROM hop a JOIN hop b ON a.dst = b.src WHERE a.src = 3),
n AS (SELECT src, list(DISTINCT dst) AS l FROM hop GROUP BY 1)
SELECT id, round(len(list_intersect(coalesce(b.l, []), a.l))::DOUBLE / len(list_distinct(list_concat(coalesce(b.l, []), a.l))), 6) AS jaccard FROM near JOIN n a ON a.src = 3 LEFT JOIN n b ON b.src = id WHERE id <> 3 ORDER BY jaccard DESC, id LIMIT 10""")
def jaccard_similar_vertices(spark, d):
    return similarity.jaccard_similars(nation_trade(spark, d), 3, 10).withColumn("jaccard", F.round("jaccard", 6))


_WALK = ", ".join(f"r{i + 1} AS (SELECT id, sum(rank) AS rank FROM (SELECT o.dst AS id, r.rank * 0.85 / o.deg AS rank FROM r{i} r JOIN o ON o.src = r.id UNION ALL SELECT 'nation:3', 1 - 0.85) GROUP BY id)" for i in range(5))


@query(f"WITH {TREE}, e AS (SELECT src, dst FROM tree UNION SELECT dst, src FROM tree), o AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS deg FROM e), r0 AS (SELECT 'nation:3' AS id, 1.0::DOUBLE AS rank), {_WALK} SELECT id, round(rank, 8) AS rank FROM r5 WHERE id <> 'nation:3' AND id NOT IN (SELECT dst FROM e WHERE src = 'nation:3')")
def personal_rank(spark, d):
    return similarity.personal_rank(tree(spark, d), "nation:3", 0.85, 5).withColumn("rank", F.round("rank", 8))


@query("SELECT 1 AS layer, 'nation:' || c_nationkey AS id, 0.8::DOUBLE AS rank FROM customer WHERE c_custkey = 1 UNION ALL SELECT 2, 'region:' || n_regionkey, round(0.8 * 0.5, 6)::DOUBLE FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 1")
def neighbor_rank(spark, d):
    g = tpch_graph(spark, d)
    out = similarity.neighbor_rank("customer:1", [(g.edges("FROM_NATION"), 0.8, 10), (g.edges("IN_REGION"), 0.5, 10)])
    return out.withColumn("rank", F.round("rank", 6))


# ---- whole-graph analytics


_RANKS = ", ".join(f"r{i + 1} AS (SELECT v.id, 0.15 / m.n + 0.85 * coalesce((SELECT sum(rank) FROM r{i} WHERE id NOT IN (SELECT src FROM hop)), 0) / m.n + 0.85 * coalesce(f.s, 0) AS rank FROM v CROSS JOIN m LEFT JOIN (SELECT o.dst AS id, sum(r.rank / o.deg) AS s FROM r{i} r JOIN o ON o.src = r.id GROUP BY 1) f ON f.id = v.id)" for i in range(10))


@query(f"WITH {TRADE}, v AS (SELECT src AS id FROM hop UNION SELECT dst FROM hop), m AS (SELECT count(*)::DOUBLE AS n FROM v), o AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS deg FROM hop), r0 AS (SELECT id, 1 / m.n AS rank FROM v CROSS JOIN m), {_RANKS} SELECT id, round(rank, 8) AS rank FROM r10")
def page_rank(spark, d):
    return computers.page_rank(nation_trade(spark, d), rounds=10, precision=0).withColumn("rank", F.round("rank", 8))


@query(f"WITH RECURSIVE {TREE} SELECT id, 'customer:' || (SELECT min('' || c_custkey) FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = r) AS component FROM (SELECT 'region:' || r_regionkey AS id, r_regionkey AS r FROM region UNION ALL SELECT 'nation:' || n_nationkey, n_regionkey FROM nation UNION ALL SELECT 'customer:' || c_custkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'supplier:' || s_suppkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey)")
def weakly_connected_components(spark, d):
    return computers.connected_components(tree(spark, d))


@query(f"WITH {TRADE}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM hop WHERE src <> dst) SELECT x.a AS a, x.b AS b, y.b AS c FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b")
def triangles(spark, d):
    return computers.triangles(nation_trade(spark, d))


@query(f"WITH {TRADE}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM hop WHERE src <> dst), t AS (SELECT x.a AS a, x.b AS b, y.b AS c FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b) SELECT id, count(*) AS triangles FROM (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY id")
def triangle_count(spark, d):
    return computers.triangle_count(nation_trade(spark, d))


_VOTES = ", ".join(f"l{i + 1} AS (SELECT id, label FROM (SELECT e.src AS id, l.label AS label, row_number() OVER (PARTITION BY e.src ORDER BY count(*) DESC, l.label) AS k FROM e JOIN l{i} l ON l.id = e.dst GROUP BY e.src, l.label) WHERE k = 1)" for i in range(4))


@query(f"WITH {TREE}, e AS (SELECT src, dst FROM tree UNION SELECT dst, src FROM tree), l0 AS (SELECT DISTINCT src AS id, src AS label FROM e), {_VOTES} SELECT id, label FROM l4")
def label_propagation(spark, d):
    return computers.label_propagation(tree(spark, d), 4)


@query()
def louvain(spark, d):
    return computers.louvain(tree(spark, d).withColumn("weight", F.lit(1.0)), levels=2, rounds=4)


# ---- enrichment


@query(r"""SELECT doc_id, 'email' AS kind, CAST(i - 1 AS INT) AS n, m[i] AS value FROM (SELECT doc_id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS m FROM documents))
UNION ALL SELECT doc_id, 'ipv4', CAST(i - 1 AS INT), m[i] FROM (SELECT doc_id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b') AS m FROM documents))
UNION ALL SELECT doc_id, 'url', CAST(i - 1 AS INT), m[i] FROM (SELECT doc_id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, 'https?://[^\s"''<>]+') AS m FROM documents))""")
def term_mentions(spark, d):
    return enrichment.term_mentions(table(spark, d, "documents"), "doc_id", "text")


@query(r"SELECT page_id AS id, CASE WHEN regexp_matches(html, '(?i)^\s*(?:<!doctype html|<html)') THEN 'text/html' ELSE 'text/plain' END AS mime FROM pages")
def mime_types(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), enrichment.mime_type(F.col("html")).alias("mime"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, d):
    return enrichment.windowed(table(spark, d, "events"), "ts", "1 hour", ["event_type"], {"n": F.count("*"), "total": F.round(F.sum("value"), 2)})


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM g GROUP BY user_id, k""")
def session_windows(spark, d):
    return enrichment.sessions(table(spark, d, "events"), "ts", "30 minutes", ["user_id"], {"n": F.count("*")})


@query("SELECT event_id AS id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) >= 3)")
def watch_list(spark, d):
    events = table(spark, d, "events")
    watched = events.filter("event_type = 'purchase'").groupBy("user_id").count().filter("count >= 3").select("user_id")
    return enrichment.watch(events, watched, ["user_id"]).select(F.col("event_id").alias("id"), "user_id")
