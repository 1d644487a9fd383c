import pytest
from pyspark.sql import functions as F

from graphloom.functions import geo, scalar as S, search as Q, temporal as T
from graphloom.operators import aggregations as A, security, writes
from graphloom.sources import tables
from graphloom.streaming import enrichment


@pytest.fixture
def value(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("v")).first().v


def test_scalars(value):
    lit = F.lit
    assert value(S.round_half_up(lit(-2.5))) == -2.0 and value(S.round_half_up(lit(2.5))) == 3.0
    assert value(S.int_div(lit(-7), lit(2))) == -3 and value(S.remainder(lit(-7), lit(3))) == -1
    assert value(S.log(lit(0.0))) == float("-inf") and value(S.log(lit(-1.0))) != value(S.log(lit(-1.0)))
    assert value(S.int_range(1, 7, 3)) == [1, 4, 7] and value(S.int_range(3, 1)) == [] and value(S.int_range(3, 1, -1)) == [3, 2, 1]
    assert value(S.substring(lit("hello"), 1, 3)) == "ell" and value(S.split(lit("a.b.c"), ".")) == ["a", "b", "c"]
    assert value(S.to_integer(lit("12.9"))) == 12 and value(S.to_integer(lit("x"))) is None and value(S.to_float(lit("1e3"))) == 1000.0
    assert value(S.to_boolean(lit(" TRUE "))) is True and value(S.to_boolean(lit("yes"))) is None
    items = F.array(lit(1), lit(2), lit(3))
    assert value(S.index(items, -1)) == 3 and value(S.index(items, 9)) is None and value(S.tail(items)) == [2, 3]
    assert value(S.list_slice(items, -2)) == [2, 3] and value(S.list_slice(items, 1, 99)) == [2, 3] and value(S.list_slice(items, 2, 1)) == []
    some = F.array(lit(1), lit(None).cast("int"))
    assert value(S.single_of(items, lambda x: x == 2)) is True and value(S.single_of(some, lambda x: x == 1)) is None
    assert value(S.any_of(some, lambda x: x == 1)) is True and value(S.all_of(some, lambda x: x == 1)) is None
    assert value(S.matches(lit("abc"), "ab")) is False and value(S.matches(lit("abc"), "a.*")) is True
    assert value(S.ordered(lit(float("nan")), lit(1.0), lambda a, b: a < b)) is None
    assert value(S.trim(lit("\t x ")) == "x")
    with pytest.raises(Exception, match="negative"):
        value(S.left(lit("abc"), -1))


def test_temporal_and_geo(value):
    t = F.lit("2017-11-19 10:30:00").cast("timestamp_ntz")
    assert str(value(T.truncate("century", t))) == "2000-01-01 00:00:00" and value(T.COMPONENTS["dayOfQuarter"](t)) == 50
    d = value(T.duration_of("P1Y2M10DT2H30M1.5S"))
    assert (d.months, d.days, d.seconds, d.nanos) == (14, 10, 9001, 500_000_000)
    assert str(value(T.plus(t, T.duration_of("P1M-1D")).cast("string"))) == "2017-12-18 10:30:00"
    with pytest.raises(ValueError, match="duration"):
        T.duration_of("1Y")
    berlin, paris = geo.point(52.52, 13.405), geo.parse_point(F.lit("48.8566, 2.3522"))
    assert value(geo.distance(berlin, paris)) == pytest.approx(877.5, abs=1) and value(geo.point(F.lit(None), F.lit(1))) is None
    assert value(geo.geohash(geo.point(57.64911, 10.40744), 11)) == "u4pruydqqvj"
    square = [(0, 0), (0, 10), (10, 10), (10, 0)]
    assert value(geo.in_polygon(geo.point(5, 5), square)) and not value(geo.in_polygon(geo.point(15, 5), square))
    assert value(geo.in_circle(berlin, paris, 900)) and value(geo.in_box(berlin, 60, 0, 40, 20))


def test_search(spark, value):
    text, none = F.lit("The quick brown fox"), F.lit(None).cast("string")
    assert value(Q.term(text, "QUICK")) and value(Q.phrase(text, "quick brown")) and not value(Q.phrase(text, "quick fox")) and value(Q.phrase(text, "quick fox", slop=1))
    assert value(Q.prefix(text, "bro")) and value(Q.wildcard(text, "f?x")) and value(Q.regex(text, "br.*n")) and value(Q.fuzzy(text, "quack", 1))
    assert value(Q.text_lacks(text, "qui")) and value(Q.text_lacks(none, "x")) and not value(Q.text_contains(none, "x"))
    many = F.array(F.lit(1), F.lit(5))
    assert value(Q.compare(many, "GREATER_THAN", 4, many=True)) and value(Q.compare(none, "NOT_EQUAL", "a")) and value(Q.compare(none, "NOT_IN", ["a"]))
    assert value(Q.hamming_score(F.lit("00ff"), "00fe")) == 15
    docs = spark.createDataFrame([(1, "apache license"), (2, "license text"), (3, "nothing here")], "id int, t string")
    got = {x.id: x.score for x in Q.more_like_this(docs, "id", "t", "Apache license").collect()}
    assert got[1] > got[2] and 3 not in got


def test_aggregations(spark):
    df = spark.createDataFrame([("Joe", 1), ("joe", 2), ("joe", 13), (None, 25)], "n string, x int")
    assert [tuple(x) for x in A.terms(df, F.col("n"), fold_case=True).collect()] == [("joe", 3)]
    assert sorted(map(tuple, A.terms(df, F.col("n"), missing="none", excluded="J.*").collect())) == [("joe", 2), ("none", 1)]
    assert sorted(map(tuple, A.histogram(df, F.col("x"), 10, (0, 39)).collect())) == [(0, 2), (10, 1), (20, 1), (30, 0)]
    assert sorted(map(tuple, A.ranges(df, F.col("x"), [("a", None, 2), ("b", 1, 20)]).collect())) == [("a", 1), ("b", 3)]
    assert A.top_with_ties(df, "n").count() == 2


def test_visibility(spark):
    see = lambda e, *a: security.visible(e, frozenset(a))
    assert see("") and see("a", "a") and not see("a&b", "a") and see("a|b", "b") and see("(a&b)|c", "c") and see('"x y"&a', "x y", "a")
    for bad in ("a&b|c", "(a", "a&", "&a", "a b", "a)"):
        with pytest.raises(ValueError, match="visibility"):
            see(bad, "a")
    df = spark.createDataFrame([(1, ""), (2, "a"), (3, "a&b"), (4, None)], "id int, v string")
    assert sorted(x.id for x in security.authorised(df, "v", ["a"]).collect()) == [1, 2, 4]
    assert [x.id for x in security.mentions(df, "v", "b").collect()] == [3]


def test_writes(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int")
    edges = spark.createDataFrame([("a", "b"), ("b", "b")], "src string, dst string")
    merged = writes.merge(nodes, spark.createDataFrame([("a",), ("c",), ("c",)], "id string"), ["id"], {"x": F.lit(0)}, {"x": F.col("x") + 10})
    assert sorted(map(tuple, merged.collect())) == [("a", 11), ("b", 2), ("c", 0)]
    left, kept = writes.delete_nodes(nodes, edges, spark.createDataFrame([("a",)], "id string"))
    assert [tuple(x) for x in left.collect()] == [("b", 2)] and [tuple(x) for x in kept.collect()] == [("b", "b")]
    log = spark.createDataFrame([("a", 1, "x", False), ("a", 2, "y", False), ("b", 1, "z", False), ("b", 3, "", True)], "id string, ts int, v string, deleted boolean")
    assert [(x.id, x.v) for x in writes.latest(log, "id").collect()] == [("a", "y")]
    assert sorted((x.id, x.v) for x in writes.latest(log, "id", until=1).collect()) == [("a", "x"), ("b", "z")]
    maps = spark.createDataFrame([({"a": 1, "b": 2},)], "m map<string,int>")
    new = F.create_map(F.lit("b"), F.lit(None).cast("int"), F.lit("c"), F.lit(3))
    assert writes.set_map(maps, F.lit(True), "m", new).first().m == {"a": 1, "c": 3}
    assert writes.set_map(maps, F.lit(True), "m", new, replace=True).first().m == {"c": 3}


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,name\n1,"a ""q"""\n2,\n')
    assert [x.row for x in tables.load_csv(spark, str(tmp_path / "x.csv")).collect()] == [{"id": "1", "name": 'a "q"'}, {"id": "2", "name": None}]
    assert tables.load_csv(spark, str(tmp_path / "x.csv"), headers=False).first().row == ["id", "name"]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", "event_type", "ts", "value")
    for i in range(3):
        events.filter(F.col("event_id") % 3 == i).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    workers = [enrichment.Worker("big", lambda d: d.value > 50, lambda d: d.select("event_id")), enrichment.Worker("all", lambda d: F.lit(True), lambda d: d.select("event_id", "user_id"))]
    enrichment.drain(stream, lambda df, _: enrichment.dispatch(df, workers).write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "check"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("worker", "event_id").collect()))
    assert got == sorted(map(tuple, enrichment.dispatch(events, workers).select("worker", "event_id").collect()))


def test_windows_with_watermark(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_type", "ts", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    live = enrichment.windowed(stream, "ts", "1 day", ["event_type"], {"n": F.count("*")}, late="1 hour")
    live.writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).start().awaitTermination()
    batch = enrichment.windowed(events, "ts", "1 day", ["event_type"], {"n": F.count("*")})
    assert sorted(map(tuple, spark.sql("SELECT * FROM live").collect())) == sorted(map(tuple, batch.collect()))
