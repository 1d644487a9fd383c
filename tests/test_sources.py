"""Sources that need a store of their own: databases and files."""

from graphloom.sources import tables as src


def test_jdbc_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(50)], "id int, name string")
    src.save_jdbc(rows, url, "people", mode="overwrite", driver="org.apache.derby.jdbc.EmbeddedDriver")
    src.save_jdbc(rows.filter("id < 5").selectExpr("id + 100 AS id", "name"), url, "people", driver="org.apache.derby.jdbc.EmbeddedDriver")
    whole = src.load_jdbc(spark, url, "people", partition=("id", 0, 110, 4), driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert whole.count() == 55 and whole.rdd.getNumPartitions() == 4
    some = src.load_jdbc(spark, url, "SELECT * FROM people WHERE \"id\" >= 100", driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert sorted(x[0] for x in some.collect()) == [100, 101, 102, 103, 104]


def test_csv_quotes_and_missing_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"a ""quoted"", name"\n2,NULL\n3,\n')
    rows = src.load_csv(spark, str(tmp_path / "a.csv"), null_text="NULL").collect()
    assert [x.row["name"] for x in rows][:2] == ['a "quoted", name', None]
