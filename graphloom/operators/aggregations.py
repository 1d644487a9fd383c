"""Bucket and metric aggregations of the search API, with nested ones as further grouping keys."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..tables import materialise


def terms(df: DataFrame, field: Column, size: int | None = None, fold_case: bool = False, missing=None, excluded: str | None = None, min_count: int = 1, metrics: dict[str, Column] | None = None) -> DataFrame:
    """(key, n, metrics): buckets by value, largest first. With ``fold_case`` the most frequent spelling is the key."""
    value = F.coalesce(field, F.lit(missing)) if missing is not None else field
    metrics = metrics or {}
    rows = df.withColumn("_v", value).filter("_v is not null")
    rows = rows.filter(~F.rlike("_v", F.lit(f"^(?:{excluded})$"))) if excluded else rows
    if fold_case:
        spelled = rows.groupBy(F.lower("_v").alias("_f"), "_v").agg(F.count("*").alias("_n"))
        out = spelled.groupBy("_f").agg(F.min_by("_v", F.struct(-F.col("_n"), F.col("_v"))).alias("key"), F.sum("_n").alias("n")).drop("_f")
    else:
        out = rows.groupBy(F.col("_v").alias("key")).agg(F.count("*").alias("n"), *(m.alias(k) for k, m in metrics.items()))
    out = out.filter(F.col("n") >= min_count)
    return out.orderBy(F.desc("n"), "key").limit(size) if size else out


def histogram(df: DataFrame, field: Column, interval: float, bounds: tuple[float, float] | None = None, min_count: int = 0, missing=None, metrics: dict[str, Column] | None = None) -> DataFrame:
    """(key, n, metrics): buckets [key, key + interval); ``bounds`` adds the empty buckets between them."""
    value = F.coalesce(field, F.lit(missing)) if missing is not None else field
    out = df.select("*", (F.floor(value / interval) * interval).alias("key")).filter("key is not null").groupBy("key").agg(F.count("*").alias("n"), *(m.alias(k) for k, m in (metrics or {}).items()))
    if bounds:
        low, high = int(bounds[0] // interval), int(bounds[1] // interval)
        empty = df.sparkSession.range(low, high + 1).select((F.col("id") * interval).alias("key"))
        out = out.join(empty, "key", "full").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.filter(F.col("n") >= min_count)


def date_histogram(df: DataFrame, field: Column, unit: str, metrics: dict[str, Column] | None = None) -> DataFrame:
    return df.groupBy(F.date_trunc(unit, field).cast("timestamp_ntz").alias("key")).agg(F.count("*").alias("n"), *(m.alias(k) for k, m in (metrics or {}).items()))


#: Calendar fields.
FIELDS = {"HOUR_OF_DAY": F.hour, "DAY_OF_WEEK": lambda t: F.dayofweek(t), "DAY_OF_MONTH": F.dayofmonth, "MONTH": F.month, "YEAR": F.year}


def chrono_field(df: DataFrame, field: Column, unit: str, zone: str = "UTC", metrics: dict[str, Column] | None = None) -> DataFrame:
    """(key, n, metrics) by a calendar field in a time zone; days of the week count from Sunday = 1."""
    local = field if zone == "UTC" else F.from_utc_timestamp(field.cast("timestamp"), zone)
    return df.groupBy(FIELDS[unit](local).alias("key")).agg(F.count("*").alias("n"), *(m.alias(k) for k, m in (metrics or {}).items()))


def ranges(df: DataFrame, field: Column, buckets: list[tuple[str, float | None, float | None]]) -> DataFrame:
    """(key, n): named buckets [low, high), which may overlap; one pass of conditional counts."""
    inside = lambda low, high: (F.lit(True) if low is None else field >= low) & (F.lit(True) if high is None else field < high)
    row = df.agg(*(F.count(F.when(inside(low, high), 1)).alias(name) for name, low, high in buckets))
    names = ", ".join(f"'{name}', `{name}`" for name, _, _ in buckets)
    return row.select(F.expr(f"stack({len(buckets)}, {names}) AS (key, n)"))


def geohashes(df: DataFrame, cell: Column, latitude: Column, longitude: Column) -> DataFrame:
    """(key, n, latitude, longitude): cells with the centre of their points."""
    return df.groupBy(cell.alias("key")).agg(F.count("*").alias("n"), F.avg(latitude).alias("latitude"), F.avg(longitude).alias("longitude"))


def cardinality(df: DataFrame, field: Column, exact: bool = True) -> DataFrame:
    return df.agg((F.count_distinct(field) if exact else F.approx_count_distinct(field)).alias("n"))


def statistics(df: DataFrame, field: Column, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count(field).alias("n"), F.min(field).alias("low"), F.max(field).alias("high"), F.sum(field).alias("total"), F.avg(field).alias("average"), F.stddev_pop(field).alias("deviation"))


def percentiles(df: DataFrame, field: str, percents: list[float] = (1, 5, 25, 50, 75, 95, 99), by: list[str] = (), discrete: bool = False) -> DataFrame:
    """(by, percentile, value): exact, interpolated between the two nearest values or the lower of them if ``discrete``.

    Values are counted first and dealt by range, so a group of any size is spread over tasks: the places of a task's
    values follow from one total for each task and group. Nulls do not count.
    """
    by = list(by)
    value = F.expr(field).alias("_v")
    counts = df.select(*by, value).filter("_v is not null").groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    dealt = materialise(counts.repartitionByRange("_v").withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy(*by, "_part").agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy(*by)).alias("_all"))
    upto = Window.partitionBy(*by, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.join(base, [*by, "_part"]).withColumn("_end", F.col("_base") + F.sum("_n").over(upto))
    # the places wanted: for p of n values (n - 1) p, between its floor and its ceiling; the discrete one is n p, rounded up
    wanted = F.explode(F.array(*(F.lit(float(p)) for p in percents))).alias("percentile")
    at = base.select(*by, "_all").distinct().select(*by, "_all", wanted)
    place = F.greatest(F.ceil(F.col("_all") * F.col("percentile") / 100 - 1e-9) - 1, F.lit(0)).cast("double") if discrete else (F.col("_all") - 1) * F.col("percentile") / 100
    at = at.withColumn("_at", place).select(*by, "percentile", "_at", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_k"))
    met = placed.select(*by, "_v", "_end", (F.col("_end") - F.col("_n")).alias("_start"))
    near = (at.join(met, by) if by else at.crossJoin(met)).filter("_k >= _start and _k < _end")  # a few places for each group
    share = F.when(F.floor("_at") == F.ceil("_at"), F.lit(1.0)).otherwise(1 - F.abs(F.col("_at") - F.col("_k")))
    return near.groupBy(*by, "percentile").agg(F.sum(F.col("_v") * share).alias("value"))


def search_page(df: DataFrame, order: list[Column], skip: int, limit: int) -> DataFrame:
    """The rows of a page with the total hits, which ignore the limit."""
    return df.orderBy(*order).offset(skip).limit(limit).crossJoin(df.agg(F.count("*").alias("total_hits")))  # one row


def top_with_ties(df: DataFrame, column: str, descending: bool = True, by: list[str] = ()) -> DataFrame:
    """The rows with the largest (or smallest) value of each group; the value comes first, so no group is gathered."""
    best = df.groupBy(*by).agg((F.max if descending else F.min)(column).alias(column))
    return df.join(best, [*by, column], "left_semi")


def field_scores(df: DataFrame, field: Column, hit: Column | None = None, least: float | None = None) -> DataFrame:
    """``df`` with ``score``: the value of a numeric field, 0 where it is absent; rows under ``least`` go."""
    rows = df.filter(hit) if hit is not None else df
    rows = rows.withColumn("score", F.coalesce(field.cast("double"), F.lit(0.0)))
    return rows.filter(F.col("score") >= least) if least is not None else rows


#: Aggregations by the name that search options give them: a function of (frame, options).
NAMED = {
    "term": lambda df, o: terms(df, F.col(o["field"]), size=o.get("size"), missing=o.get("missing")),
    "histogram": lambda df, o: histogram(df, F.col(o["field"]), float(o["interval"]), min_count=o.get("minDocumentCount", 1)),
    "calendar": lambda df, o: chrono_field(df, F.col(o["field"]), o["calendarField"], o.get("timeZone", "UTC")),
    "statistics": lambda df, o: df.agg(*(f(o["field"]).cast("double").alias(k) for k, f in METRICS.items())).select(F.explode(F.map_from_arrays(F.array(*(F.lit(k) for k in METRICS)), F.array(*METRICS))).alias("key", "value")),
    **{k: lambda df, o, k=k: df.agg(METRICS[k](o["field"]).cast("double").alias("value")) for k in ("sum", "avg", "min", "max")},
    "cardinality": lambda df, o: cardinality(df, F.col(o["field"])).withColumnRenamed("n", "value"),
}
#: Metrics of one field.
METRICS = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def from_options(df: DataFrame, options: str | list[dict]) -> DataFrame:
    """(name, key, n, value) of several aggregations given as search options: JSON objects with type, name and field.

    Keys and values are what the aggregation of that type returns, keys as text; what it has not is null.
    """
    out = None
    for o in json.loads(options) if isinstance(options, str) else options:
        found = NAMED[o["type"]](df, o)
        pick = lambda c, t, found=found: (F.col(c).cast(t) if c in found.columns else F.lit(None).cast(t)).alias(c)
        one = found.select(F.lit(o["name"]).alias("name"), pick("key", "string"), pick("n", "long"), pick("value", "double"))
        out = one if out is None else out.unionByName(one)
    return out


#: Write-time merges of property values by aggregate type; ``ts`` orders the writes.
MERGES = {"NONE": "max_by({c}, ts)", "MAX": "max({c})", "MIN": "min({c})", "SUM": "sum({c})", "OLD": "min_by({c}, ts)", "SET": "sort_array(collect_set({c}))", "LIST": "collect_list({c})"}


def upsert(changes: DataFrame, key: str, kinds: dict[str, str]) -> DataFrame:
    """One row for each key from all writes, each property merged by its aggregate type."""
    return changes.groupBy(key).agg(*(F.expr(MERGES[kind].format(c=c)).alias(c) for c, kind in kinds.items()))
