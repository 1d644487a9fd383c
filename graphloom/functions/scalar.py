"""Scalar functions of the pattern language where they differ from Spark's. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def int_div(a, b) -> Column:
    """Integer division truncates; by zero it is an error."""
    return F.call_function("div", _c(a), _c(b))


def remainder(a, b) -> Column:
    return _c(a) % _c(b)


def power(a, b) -> Column:
    return F.pow(_c(a).cast("double"), _c(b).cast("double"))


def ceil(x) -> Column:
    return F.ceil(x).cast("double")


def floor(x) -> Column:
    return F.floor(x).cast("double")


def round_half_up(x) -> Column:
    """floor(x + 0.5), as a double."""
    return F.floor(_c(x) + 0.5).cast("double")


def sign(x) -> Column:
    return F.signum(x).cast("long")


def log(x) -> Column:
    """Natural logarithm; of 0 minus infinity, below NaN."""
    x = _c(x).cast("double")
    return F.when(x > 0, F.log(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan")))


def log10(x) -> Column:
    x = _c(x).cast("double")
    return F.when(x > 0, F.log10(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan")))


def haversin(x) -> Column:
    return (1 - F.cos(x)) / 2


def int_range(low, high, step=1) -> Column:
    """Inclusive range; empty where the step leads away; a step of 0 is an error."""
    low, high, step = _c(low).cast("long"), _c(high).cast("long"), _c(step).cast("long")
    leads = ((step > 0) & (low <= high)) | ((step < 0) & (low >= high))
    return F.when(step == 0, F.raise_error(F.lit("step must not be 0")).cast("array<bigint>")).when(leads, F.sequence(low, high, step)).otherwise(F.array().cast("array<bigint>"))


def left(s, n) -> Column:
    return F.when(_c(n) < 0, F.raise_error(F.lit("negative length"))).otherwise(F.left(s, _c(n)))


def right(s, n) -> Column:
    return F.when(_c(n) < 0, F.raise_error(F.lit("negative length"))).otherwise(F.right(s, _c(n)))


def substring(s, start, length=None) -> Column:
    """0-based."""
    return F.substr(s, _c(start) + 1, F.char_length(s) if length is None else _c(length))


def split(s, separator: str) -> Column:
    """By a literal separator."""
    return F.split(s, "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)


def trim(s) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def to_integer(s) -> Column:
    """Null where it is no number; fractions are cut."""
    s = _c(s).cast("string")
    return F.coalesce(s.try_cast("long"), s.try_cast("double").try_cast("long"))


def to_float(s) -> Column:
    return _c(s).cast("string").try_cast("double")


def to_boolean(s) -> Column:
    low = F.lower(F.trim(s))
    return F.when(low == "true", True).when(low == "false", False)


def head(items) -> Column:
    return F.try_element_at(items, F.lit(1))


def last(items) -> Column:
    return F.try_element_at(items, F.lit(-1))


def tail(items) -> Column:
    return F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0)))


def index(items, i) -> Column:
    """0-based, negative from the end, null outside."""
    i = _c(i)
    return F.try_element_at(items, F.when(i >= 0, i + 1).otherwise(i).cast("int"))


def list_slice(items, low=None, high=None) -> Column:
    """Half-open, negative places from the end, cut to the list."""
    n = F.size(items)
    place = lambda x, default: default if x is None else F.greatest(F.lit(0), F.least(n, F.when(_c(x) < 0, n + _c(x)).otherwise(_c(x))))
    a, b = place(low, F.lit(0)), place(high, n)
    return F.slice(items, a + 1, F.greatest(b - a, F.lit(0)))


def all_of(items, test) -> Column:
    return F.forall(items, test)


def any_of(items, test) -> Column:
    return F.exists(items, test)


def none_of(items, test) -> Column:
    return ~F.exists(items, test)


def single_of(items, test) -> Column:
    """Exactly one; null where unknown tests could decide."""
    true, unknown = F.size(F.filter(items, test)), F.size(F.filter(items, lambda x: test(x).isNull()))
    return F.when((unknown > 0) & (true < 2), F.lit(None).cast("boolean")).otherwise(true == 1)


def comprehension(items, test, value) -> Column:
    return F.transform(F.filter(items, test), value)


def fold(items, start, merge) -> Column:
    return F.aggregate(items, start, merge)


def matches(s, pattern: str) -> Column:
    """The whole string matches."""
    return F.rlike(s, F.lit(f"^(?:{pattern})$"))


def ordered(a, b, compare) -> Column:
    """A comparison that is unknown for NaN."""
    return F.when(~F.isnan(_c(a).cast("double")) & ~F.isnan(_c(b).cast("double")), compare(_c(a), _c(b)))


# aggregates that differ from Spark's on empty and single groups


def total(x) -> Column:
    return F.coalesce(F.sum(x), F.lit(0))


def stdev(x) -> Column:
    return F.when(F.count(x) < 2, 0.0).otherwise(F.stddev_samp(x))


def stdevp(x) -> Column:
    return F.coalesce(F.stddev_pop(x), F.lit(0.0))


def percentile_cont(x: str, p: float) -> Column:
    return F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY {x})")


def percentile_disc(x: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {x})")


def asc(x) -> Column:
    """Null is the largest value."""
    return _c(x).asc_nulls_last()


def desc(x) -> Column:
    return _c(x).desc_nulls_first()


def type_rank(x, kind: str) -> Column:
    """A sort key for columns of one type among mixed ones: strings before booleans before numbers, null last."""
    rank = {"map": 0, "list": 1, "string": 2, "boolean": 3, "number": 4}[kind]
    return F.when(x.isNull(), 9).otherwise(rank)


def to_string(x) -> Column:
    """Text of a number, boolean or instant; doubles with a fraction, as in 1.0."""
    return _c(x).cast("string")


def list_concat(a, b) -> Column:
    """Null if either list is null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(a, b))


def append(items, x) -> Column:
    return F.when(items.isNotNull(), F.concat(items, F.array(_c(x))))


def prepend(x, items) -> Column:
    return F.when(items.isNotNull(), F.concat(F.array(_c(x)), items))


def to_predicate(x, kind: str) -> Column:
    """A value where a condition is asked for: a list holds if it is not empty, a boolean as it is; null is unknown."""
    if kind == "boolean":
        return x
    if kind == "list":
        return F.when(x.isNotNull(), F.size(x) > 0)
    raise ValueError(f"a {kind} is no condition")


def comparison(a, op: str, b) -> Column:
    """< <= > >= with null and NaN as unknown."""
    return ordered(a, b, {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op])


def xor(*parts: Column) -> Column:
    """Exclusive or, unknown if any part is."""
    out = parts[0]
    for part in parts[1:]:
        out = F.when(out.isNotNull() & part.isNotNull(), out != part)
    return out


# elements: properties are the columns of a node or relationship


def properties(columns: dict[str, Column]) -> Column:
    """A map of the properties that are present, values as text."""
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in columns.items()))
    return F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull()))


def keys(columns: dict[str, Column]) -> Column:
    """The names of the properties that are present, sorted."""
    return F.sort_array(F.map_keys(properties(columns)))


def map_projection(columns: dict[str, Column], all_of_them: bool = False, chosen: list[str] = (), **more: Column) -> Column:
    """n {.a, .b, name: value, .*} as a struct; later entries win."""
    picked = dict(columns) if all_of_them else {k: columns.get(k, F.lit(None).cast("string")) for k in chosen}
    return F.struct(*(v.alias(k) for k, v in {**picked, **more}.items()))


# paths: an array of vertices and an array of relationships


def path_nodes(path) -> Column:
    return path


def path_relationships(rels) -> Column:
    return rels


def path_length(rels) -> Column:
    return F.size(rels)


def start_node(path) -> Column:
    return head(path)


def end_node(path) -> Column:
    return last(path)
