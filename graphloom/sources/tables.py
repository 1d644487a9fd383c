"""Readers and scans: CSV rows as maps or lists, JDBC, id lookups, catalog listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def load_csv(spark: SparkSession, path: str, headers: bool = True, separator: str = ",", null_text: str | None = None) -> DataFrame:
    """One column ``row``: a map by header, or a list without headers; every value a string, missing ones null."""
    reader = spark.read.option("header", headers).option("sep", separator).option("quote", '"').option("escape", '"')
    reader = reader.option("nullValue", null_text) if null_text is not None else reader
    df = reader.csv(path)
    if headers:
        return df.select(F.map_from_arrays(F.array(*(F.lit(c) for c in df.columns)), F.array(*(F.col(f"`{c}`") for c in df.columns))).alias("row"))
    return df.select(F.array(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def load_jdbc(spark: SparkSession, url: str, table_or_query: str, fetch_size: int = 5000, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A bare name reads the table, anything with a space is a query. ``partition``: column, low, high, number."""
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_size).options(**options)
    reader = reader.option("query", table_or_query) if " " in table_or_query.strip() else reader.option("dbtable", table_or_query)
    if partition:
        column, low, high, number = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", number)
    return reader.load()


def by_ids(df: DataFrame, ids: list, key: str = "id") -> DataFrame:
    return df.filter(F.col(key).isin(ids))


def in_order(df: DataFrame, ids: list, key: str = "id", place: str | None = None) -> DataFrame:
    """The rows of the given ids, in the order of the list, with their place in it in the column ``place`` if named."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(ids)), f"_at int, {key} {df.schema[key].dataType.simpleString()}")
    found = df.join(F.broadcast(wanted), key).orderBy("_at")  # the list is the caller's
    return found.withColumnRenamed("_at", place) if place else found.drop("_at")


def exist(df: DataFrame, ids: list, key: str = "id") -> DataFrame:
    """(id, found) for each asked id."""
    wanted = df.sparkSession.createDataFrame([(i,) for i in ids], f"{key} {df.schema[key].dataType.simpleString()}")
    return wanted.join(df.select(key).distinct().withColumn("_f", F.lit(True)), key, "left").select(key, F.col("_f").isNotNull().alias("found"))


def by_prefix(df: DataFrame, prefix: str, key: str = "id") -> DataFrame:
    return df.filter(F.col(key).startswith(prefix))


def by_range(df: DataFrame, low, high, key: str = "id") -> DataFrame:
    return df.filter(F.col(key).between(low, high))


def next_page(df: DataFrame, after, size: int, key: str = "id") -> DataFrame:
    """Keyset paging: the rows behind the last key of the page before."""
    df = df.filter(F.col(key) > after) if after is not None else df
    return df.orderBy(key).limit(size)


def labels(graph) -> DataFrame:
    return graph.all_nodes().select("label").distinct()


def relationship_types(graph) -> DataFrame:
    return graph.all_rels().select(F.col("type").alias("relationshipType")).distinct()


def property_keys(graph, spark: SparkSession) -> DataFrame:
    """(label, propertyKey, type): from the schemas alone."""
    rows = [(label, c, t) for label, df in graph.nodes.items() for c, t in df.dtypes if c != "id"]
    return spark.createDataFrame(rows, "label string, propertyKey string, type string")


def schema_json(graph, spark: SparkSession) -> DataFrame:
    keys = property_keys(graph, spark).groupBy("label").agg(F.sort_array(F.collect_list("propertyKey")).alias("properties"))
    return keys.select(F.to_json(F.struct("label", "properties")).alias("json"))


def save_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch_size: int = 1000, **options) -> None:
    """Writes rows to a table of a database, a connection for each partition."""
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch_size).options(**options).mode(mode).save()


def scan_labels(graph, *names: str) -> DataFrame:
    """(label, id): the nodes with any of the labels, each once."""
    return graph.all_nodes().filter(F.col("label").isin(*names)).distinct()


def schema_concepts(graph, spark: SparkSession) -> DataFrame:
    """(concept, properties): the labels with the number of their properties, from the schemas alone."""
    return spark.createDataFrame([(label, len(df.columns) - 1) for label, df in graph.nodes.items()], "concept string, properties int")


def schema_relationships(graph, spark: SparkSession) -> DataFrame:
    """(relationship, source, target): which labels a type links."""
    return spark.createDataFrame([(kind, x.source, x.target) for kind, specs in graph.rels.items() for x in specs], "relationship string, source string, target string")


def schema_properties(graph, spark: SparkSession) -> DataFrame:
    """(owner, kind, property, type): the properties of labels and of relationship types."""
    rows = [(label, "concept", c, t) for label, df in graph.nodes.items() for c, t in df.dtypes if c != "id"]
    rows += sorted({(kind, "relationship", c, t) for kind, specs in graph.rels.items() for x in specs for c, t in x.frame.dtypes if c not in ("rid", "src", "dst")})
    return spark.createDataFrame(rows, "owner string, kind string, property string, type string")


def extended_data(rows: DataFrame, ids: DataFrame | None = None, owner: str = "element_id") -> DataFrame:
    """The rows of an element's child table (``owner`` names the element), of all elements or of those in ``ids``."""
    return rows if ids is None else rows.join(ids.select(F.col("id").alias(owner)).distinct(), owner, "left_semi")


def has_extended_data(elements: DataFrame, rows: DataFrame, owner: str = "element_id", negate: bool = False) -> DataFrame:
    """The elements with (or without) a row in a child table."""
    keys = rows.select(F.col(owner).alias("_e"))
    return elements.join(keys, F.col("id") == F.col("_e"), "left_anti" if negate else "left_semi")
