"""Tiny graphs: chain, diamond, ring, parallel edges, two components."""

import pytest
from pyspark.sql import functions as F

from graphloom.graph import Match, PropertyGraph, RelSpec
from graphloom.operators import computers, joins, paths, similarity
from graphloom.plans import catalog


@pytest.fixture
def edges(spark):
    return lambda *pairs: spark.createDataFrame([tuple(p) for p in pairs], "src string, dst string")


@pytest.fixture
def at(spark):
    return lambda *ids: spark.createDataFrame([(i,) for i in ids], "source string")


def words(df, *cols):
    return sorted(tuple("".join(v) if isinstance(v, list) else v for v in row) for row in df.select(*cols).collect())


CHAIN, DIAMOND, RING = ("ab", "bc", "cd", "de"), ("ab", "ac", "bd", "cd"), ("ab", "bc", "cd", "da", "aa")


def test_distances_and_k_out(edges, at):
    assert words(paths.distances(edges(*CHAIN), at("a"), 3), "id", "hops") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert words(paths.k_out(edges(*RING), at("a"), 2), "id") == [("c",)]
    assert words(paths.k_out(edges("ab", "ba", "bc"), at("a"), 3, nearest=False), "id") == []
    assert words(paths.k_neighbor(edges(*DIAMOND), at("a", "b"), 2), "source", "id", "hops") == [("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("b", "d", 1)]


def test_paths(edges, at, spark):
    assert words(paths.find_paths(edges(*DIAMOND), "a", "d", 3), "path") == [("abd",), ("acd",)]
    assert words(paths.find_paths(edges("ab", "ab", "bc"), "a", "c", 3), "path") == [("abc",), ("abc",)]  # parallel edges
    pair = spark.createDataFrame([("a", "d"), ("a", "a"), ("d", "a")], "source string, target string")
    assert words(paths.shortest_paths(edges(*DIAMOND), pair, 3), "path") == [("a",), ("abd",), ("acd",)]
    assert words(paths.shortest_paths(edges(*DIAMOND), pair, 3, single=True), "path") == [("a",), ("abd",)]
    assert words(paths.walks(edges(*RING), at("a"), 0, 2), "path") == [("a",), ("ab",), ("abc",)]


def test_weighted(spark, at):
    e = spark.createDataFrame([("a", "b", 5.0), ("a", "c", 1.0), ("c", "b", 1.0), ("b", "d", None), ("d", "a", 0.5)], "src string, dst string, weight double")
    assert words(paths.weighted_distances(e, at("a")), "id", "distance") == [("a", 0.0), ("b", 2.0), ("c", 1.0), ("d", 3.0)]


def test_rings_and_rays(edges, at):
    assert words(paths.rings(edges(*RING), at("a"), 4), "path") == [("abcda",)]
    assert words(paths.rings(edges("ab", "ba"), at("a"), 4), "path") == []
    assert words(paths.rays(edges(*DIAMOND), at("a"), 5), "path") == [("abd",), ("acd",)]
    assert words(paths.rays(edges(*CHAIN), at("a"), 2), "path") == [("abc",)]


def test_steps_templates_and_counts(edges, at, spark):
    ab, bd = edges("ab", "ac"), edges("bd", "cd")
    assert words(paths.steps(at("a"), [ab, bd]), "path") == [("abd",), ("acd",)]
    targets = spark.createDataFrame([("d",)], "id string")
    assert words(paths.template_paths(at("a"), targets, [(edges(*CHAIN), 3)]), "path") == [("abcd",)]
    assert words(paths.step_counts(at("a"), [ab, bd]), "source", "edges") == [("a", 2)]
    assert words(paths.step_counts(at("a"), [ab, bd], contains_traversed=True), "source", "edges") == [("a", 4)]
    assert words(paths.crosspoints([paths.k_out(ab, at("a"), 1), paths.k_out(paths.reverse(bd), at("d"), 1)]), "id") == [("b",), ("c",)]
    assert paths.capped(edges("ab", "ac", "ad", "bc"), 2).count() == 3
    assert words(paths.without_super_nodes(edges("ab", "ac", "ad", "bc"), 2), "src", "dst") == [("b", "c")]


def test_similarity(edges, spark):
    e = edges("ax", "ay", "bx", "by", "bz", "cz")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("q", "r")], "a string, b string")
    assert words(similarity.jaccard_pairs(e, pairs), "a", "b", "jaccard") == [("a", "b", 2 / 3), ("a", "c", 0.0), ("q", "r", 0.0)]
    assert words(similarity.same_neighbors(e, "a", "b"), "id") == [("x",), ("y",)]
    assert words(similarity.fusiform(e, 0.9), "a", "b", "score") == [("a", "b", 1.0), ("c", "b", 1.0)]
    assert words(similarity.triadic(edges("ab", "bc", "cd", "ac")), "a", "b", "via") == [("a", "d", "c"), ("b", "d", "c")]
    total = similarity.personal_rank(e, "a", 0.85, 30).agg(F.sum("rank")).first()[0]
    assert 0 < total < 1


def test_computers(edges, spark):
    two = edges("ab", "bc", "xy")
    assert words(computers.connected_components(two), "id", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    rank = {x.id: x["rank"] for x in computers.page_rank(edges("ab", "bc", "ca", "da"), rounds=60, precision=1e-12).collect()}
    assert sum(rank.values()) == pytest.approx(1) and rank["a"] > rank["b"] > rank["d"]
    assert words(computers.triangles(edges("ab", "bc", "ca", "cd", "ba", "aa")), "a", "b", "c") == [("a", "b", "c")]
    assert words(computers.triangle_count(edges("ab", "bc", "ca", "bd", "cd")), "id", "triangles") == [("a", 1), ("b", 2), ("c", 2), ("d", 1)]
    cliques = [(x + y, 1.0) for g in ("abcd", "wxyz") for i, x in enumerate(g) for y in g[i + 1 :]] + [("dw", 1.0)]
    e = spark.createDataFrame([(p[0], p[1], w) for p, w in cliques], "src string, dst string, weight double")
    found = {x.id: x.community for x in computers.louvain(e).collect()}
    assert len({found[c] for c in "abcd"}) == 1 and len({found[c] for c in "wxyz"}) == 1 and found["a"] != found["z"]
    assert computers.modularity(e, computers.louvain(e)).first()[0] == pytest.approx(0.4231, abs=1e-4)
    assert len({x.label for x in computers.label_propagation(edges("ab", "bc", "ca"), 5).collect()}) == 1


@pytest.fixture
def graph(spark):
    person = spark.createDataFrame([(1, "ann"), (2, "bob"), (3, "cy")], "id long, name string")
    knows = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 1, 2), (4, 3, 3)], "rid long, src long, dst long")
    return PropertyGraph({"P": person}, {"KNOWS": [RelSpec("P", "P", knows)]})


def test_match(graph):
    m = Match(graph).node("a", "P")
    two = m.expand("a", "KNOWS", "b", "P").expand("b", "KNOWS", "c", "P")
    assert words(two.select(p="concat(a__name, b__name, c__name)"), "p") == [("annbobcy",), ("annbobcy",), ("bobcycy",)]
    back = m.expand("a", "KNOWS", "b", "P").expand("b", "KNOWS", "c", "P", direction="in")
    assert words(back.select(p="concat(a__name, b__name, c__name)"), "p") == [("annbobann",), ("annbobann",), ("bobcycy",), ("cycybob",)]
    assert m.expand("a", "KNOWS", "b", "P", direction="both").frame.count() == 7  # the loop once
    assert m.expand("a", "KNOWS", "b", "P", where="name = 'zed'", optional=True).frame.filter("b__id is null").count() == 3
    assert words(m.exists("a", "KNOWS", label="P", where="name = 'bob'").select(n="a__name"), "n") == [("ann",)]
    assert words(m.degree("d", "a", "KNOWS", "in").select(n="a__name", d="d"), "n", "d") == [("ann", 0), ("bob", 2), ("cy", 2)]
    assert words(m.roll_up("l", "a", "KNOWS", "name", label="P").select(n="a__name", l="concat_ws(',', l)"), "n", "l") == [("ann", "bob,bob"), ("bob", "cy"), ("cy", "cy")]
    assert m.flag("f", "a", "KNOWS", label="P", where="name = 'bob'").frame.filter("f").count() == 1
    assert m.expand("a", "KNOWS", "a").frame.count() == 1


def test_trails_repeat_vertices_but_no_relationship(spark, at):
    e = spark.createDataFrame([(1, "a", "b"), (2, "b", "a"), (3, "a", "b")], "rid long, src string, dst string")
    assert words(paths.trails(e, at("a"), 1, 2), "path") == [("ab",), ("ab",), ("aba",), ("aba",)]
    assert words(paths.trails(paths.either_way(e), at("a"), 2, 2), "path") == [("aba",)] * 6
    loop = spark.createDataFrame([(1, "a", "a")], "rid long, src string, dst string")
    assert words(paths.trails(loop, at("a"), 0, 3), "path") == [("a",), ("aa",)]


def test_find_paths_goes_either_way_by_kinds(spark):
    e = spark.createDataFrame([("a", "b", "x"), ("c", "b", "x"), ("a", "c", "y")], "src string, dst string, type string")
    assert words(paths.find_paths(e, "a", "c", 2), "path") == [("abc",), ("ac",)]
    assert words(paths.find_paths(e, "a", "c", 2, kinds=["x"]), "path") == [("abc",)]
    assert words(paths.find_paths(e, "a", "c", 2, excluded=["x"]), "path") == [("ac",)]


def test_negative_weights_are_refused(spark, at):
    e = spark.createDataFrame([("a", "b", -1.0)], "src string, dst string, weight double")
    with pytest.raises(ValueError, match="negative"):
        paths.weighted_distances(e, at("a"))


def test_long_chains_converge(spark, at):
    names = [f"{i:03d}" for i in range(70)]
    e = spark.createDataFrame(list(zip(names, names[1:], strict=False)), "src string, dst string")
    assert {x.component for x in computers.connected_components(e).collect()} == {"000"}
    weighted = e.withColumn("weight", F.lit(1.0))
    assert max(x.distance for x in paths.weighted_distances(weighted, at("000")).collect()) == 69.0


def test_fusiform_with_a_hub(edges):
    pairs = [f"{a}h" for a in "abcdefg"] + ["ax", "ay", "bx", "by", "cx"]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    want = sorted((a, b, len(near[a] & near[b]) / len(near[a])) for a in near for b in near if a != b and len(near[a] & near[b]) >= 0.6 * len(near[a]))
    assert words(similarity.fusiform(edges(*pairs), 0.6), "a", "b", "score") == want


def test_clauses_and_optional_steps(spark):
    person = spark.createDataFrame([(1,), (2,)], "id long")
    one = spark.createDataFrame([(1, 1, 2)], "rid long, src long, dst long")
    m = Match(PropertyGraph({"P": person}, {"X": [RelSpec("P", "P", one)]})).node("a", "P", "id = 1")
    twice = m.expand("a", "X", "b", "P", optional=True).expand("a", "X", "c", "P", optional=True)
    assert [tuple(x) for x in twice.select(b="b__id", c="c__id").collect()] == [(2, 2)]
    missed = m.expand("a", "X", "b", "P", where="id = 9", optional=True).expand("a", "X", "c", "P", optional=True)
    assert [tuple(x) for x in missed.select(b="b__id", c="c__id").collect()] == [(None, 2)]
    assert m.expand("a", "X", "b", "P").expand("a", "X", "c", "P").frame.count() == 0
    assert m.expand("a", "X", "b", "P").clause().expand("a", "X", "c", "P").frame.count() == 1
    with pytest.raises(Exception, match="different nodes"):
        m.expand("a", "X", "b", "P").same("a", "b").frame.collect()


@pytest.mark.parametrize("rows", [-1, 20_000])
def test_components_broadcast_only_few_rows(spark, monkeypatch, rows):
    """Labels shrink to almost nothing in a file; only counted rows decide on a broadcast."""
    plans, write = [], computers.materialise
    monkeypatch.setattr(computers, "materialise", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    monkeypatch.setattr(computers, "BROADCAST_ROWS", rows, raising=False)
    star, chain = [("hub", f"leaf{i}") for i in range(300)], [(f"v{i:02d}", f"v{i + 1:02d}") for i in range(30)]
    e = spark.createDataFrame([*star, *chain, ("z", "z")], "src string, dst string")
    found = {x.id: x.component for x in computers.connected_components(e).collect()}
    assert found == {"hub": "hub", "z": "z"} | {b: "hub" for _, b in star} | {v: "v00" for pair in chain for v in pair}
    assert any("BroadcastHashJoin" in p for p in plans) == (rows > 0)


def test_value_join_is_dealt_by_pairs(spark, tmp_path):
    """Few rows of one value make many pairs, which no single task may make."""
    frames = {name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet") for name in ("region", "nation", "customer", "orders", "lineitem")}
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    ids = spark.range(0, 8001, 1, 1)  # the last is below the mean
    frames["part"] = ids.select(*(F.col("id").cast(part.schema[c].dataType).alias(c) if c == "p_partkey" else F.lit(5).alias(c) if c == "p_size" else F.when(F.col("id") < 8000, 20.0).otherwise(1.0).alias(c) if c == "p_retailprice" else F.lit("x").alias(c) for c in part.columns))
    frames["supplier"] = spark.range(0, 4000, 1, 1).select(F.col("id").alias("s_suppkey"), F.lit("x").alias("s_name"), F.lit(5).alias("s_nationkey"), F.lit(1.0).alias("s_acctbal"))
    for name, df in frames.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    out = catalog.QUERIES["value_hash_join"](spark, str(tmp_path))
    by_task = out.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.sum("part").alias("part"), F.sum("supplier").alias("supplier")).collect()
    assert sum(x.n for x in by_task) == 8000 * 4000
    assert sum(x.part for x in by_task) == 4000 * sum(range(8000)) and sum(x.supplier for x in by_task) == 8000 * sum(range(4000))
    assert max(x.n for x in by_task) < 0.75 * 8000 * 4000


def test_value_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK_ROWS", 4)
    monkeypatch.setattr(joins, "TASK_PAIRS", 10)
    left = [(i, v) for i, v in enumerate([1] * 30 + [2] * 20 + [3, 4, None, None] + [5] * 9)]
    right = [(i, v) for i, v in enumerate([1] * 10 + [2] + [4, 4, 6, None] + [5] * 40)]
    a, b = spark.createDataFrame(left, "a long, x int"), spark.createDataFrame(right, "b long, y long")
    want = sorted((i, j) for i, v in left for j, w in right if v is not None and v == w)
    assert words(joins.value_join(a, b, "x", "y", "a", "b"), "a", "b") == want
    assert words(joins.value_join(b, a, "y", "x", "b", "a"), "a", "b") == want
    # rows that ``by`` does not tell apart are all kept
    assert joins.value_join(a.withColumn("c", F.lit(0)), b, "x", "y", "c", "b").count() == len(want)
    assert joins.value_join(a.filter("x = 3"), b, "x", "y", "a", "b").count() == 0


def test_label_loops_broadcast_only_few_rows(spark, monkeypatch):
    star = [("hub", f"leaf{i}", 1.0) for i in range(40)] + [(f"v{i:02d}", f"v{i + 1:02d}", 1.0) for i in range(20)]
    e = spark.createDataFrame(star, "src string, dst string, weight double")
    runs = {"label_propagation": lambda: computers.label_propagation(e.select("src", "dst"), 3), "louvain": lambda: computers.louvain(e, levels=1, rounds=2)}
    want = {name: sorted(map(tuple, run().collect())) for name, run in runs.items()}
    plans, write = [], computers.materialise
    monkeypatch.setattr(computers, "materialise", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    monkeypatch.setattr(computers, "BROADCAST_ROWS", -1)
    assert {name: sorted(map(tuple, run().collect())) for name, run in runs.items()} == want
    assert plans and not any("BroadcastHashJoin" in p for p in plans)
