"""Search predicates as Columns: comparisons over properties, bool queries, full text, similarity.

Properties may hold many values (an array column): a comparison holds if any value matches. Negative comparisons also
hold where the property is absent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def compare(c: Column, op: str, value, many: bool = False) -> Column:
    """op: EQUAL, NOT_EQUAL, GREATER_THAN(_EQUAL), LESS_THAN(_EQUAL), STARTS_WITH, ENDS_WITH, IN, NOT_IN."""
    tests = {
        "EQUAL": lambda x: x == value,
        "GREATER_THAN": lambda x: x > value,
        "GREATER_THAN_EQUAL": lambda x: x >= value,
        "LESS_THAN": lambda x: x < value,
        "LESS_THAN_EQUAL": lambda x: x <= value,
        "STARTS_WITH": lambda x: x.startswith(value),
        "ENDS_WITH": lambda x: x.endswith(value),
        "IN": lambda x: x.isin(value),
    }
    if op in ("NOT_EQUAL", "NOT_IN"):
        return ~compare(c, "EQUAL" if op == "NOT_EQUAL" else "IN", value, many)
    found = F.exists(c, tests[op]) if many else tests[op](c)
    return F.coalesce(found, F.lit(False))


def between(c: Column, low=None, high=None, low_inclusive: bool = True, high_inclusive: bool = True) -> Column:
    tests = []
    if low is not None:
        tests.append(c >= low if low_inclusive else c > low)
    if high is not None:
        tests.append(c <= high if high_inclusive else c < high)
    return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)) & c.isNotNull(), F.lit(False))


def has(*columns: Column) -> Column:
    """Any of the properties is present."""
    return reduce(lambda a, b: a | b, [c.isNotNull() for c in columns])


def lacks(*columns: Column) -> Column:
    return ~has(*columns)


def has_value_of_type(df: DataFrame, kind: str, test) -> Column:
    """``test`` over every column of a type, e.g. "string"."""
    return reduce(lambda a, b: a | b, [F.coalesce(test(F.col(c)), F.lit(False)) for c, t in df.dtypes if t == kind], F.lit(False))


def must(*parts: Column) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def should(*parts: Column) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def must_not(*parts: Column) -> Column:
    return ~should(*parts)


def tokens(c: Column) -> Column:
    """The full-text view of a property: lower-case words."""
    return F.filter(F.split(F.lower(c), r"\W+"), lambda w: w != "")


def text_contains(c: Column, value: str) -> Column:
    return F.coalesce(F.lower(c).contains(value.lower()), F.lit(False))


def text_lacks(c: Column, word: str) -> Column:
    """The word is not among the words; holds where the property is absent."""
    return ~F.coalesce(F.array_contains(tokens(c), word.lower()), F.lit(False))


def term(c: Column, word: str) -> Column:
    return F.coalesce(F.array_contains(tokens(c), word.lower()), F.lit(False))


def _quoted(text: str) -> str:
    return "".join(x if x.isalnum() else f"\\{x}" for x in text)


def phrase(c: Column, text: str, slop: int = 0) -> Column:
    """The words in this order, with at most ``slop`` words between neighbours."""
    gap = r"\W+" if not slop else rf"\W+(?:\w+\W+){{0,{slop}}}"
    return F.coalesce(F.rlike(F.lower(c), F.lit(r"\b" + gap.join(_quoted(w) for w in text.lower().split()) + r"\b")), F.lit(False))


def prefix(c: Column, start: str) -> Column:
    return F.coalesce(F.exists(tokens(c), lambda w: w.startswith(start.lower())), F.lit(False))


def wildcard(c: Column, pattern: str) -> Column:
    """* any characters, ? one, against whole words."""
    regex = "".join(".*" if x == "*" else "." if x == "?" else _quoted(x) for x in pattern.lower())
    return F.coalesce(F.exists(tokens(c), lambda w: F.rlike(w, F.lit(f"^{regex}$"))), F.lit(False))


def regex(c: Column, pattern: str) -> Column:
    return F.coalesce(F.exists(tokens(c), lambda w: F.rlike(w, F.lit(f"^(?:{pattern})$"))), F.lit(False))


def fuzzy(c: Column, word: str, edits: int = 2) -> Column:
    return F.coalesce(F.exists(tokens(c), lambda w: F.levenshtein(w, F.lit(word.lower()), edits) >= 0), F.lit(False))


def boosted(*parts: tuple[Column, float]) -> Column:
    """The score of a bool query: the boosts of the parts that match."""
    return reduce(lambda a, b: a + b, [F.when(c, boost).otherwise(0.0) for c, boost in parts])


def more_like_this(df: DataFrame, key: str, text: str, sample: str, min_term_freq: int = 1, max_terms: int = 25, min_doc_freq: int = 1) -> DataFrame:
    """(key, score): rows by the summed TF-IDF of the sample's best terms, with no row left out that has one.

    Frequencies cover all rows; the sample's terms (at most ``max_terms``) are what is broadcast.
    """
    spark = df.sparkSession
    wanted = spark.createDataFrame([(sample,)], "s string").select(F.explode(tokens(F.col("s"))).alias("w")).groupBy("w").count().filter(F.col("count") >= min_term_freq)
    words = df.select(key, F.explode(tokens(F.col(text))).alias("w")).join(F.broadcast(wanted.select("w")), "w", "left_semi").groupBy(key, "w").agg(F.count("*").alias("tf"))
    n = df.select(F.count("*").alias("n"))
    freq = words.groupBy("w").agg(F.count("*").alias("df")).filter(F.col("df") >= min_doc_freq)
    idf = freq.crossJoin(n).join(wanted.withColumnRenamed("count", "q"), "w").select("w", F.log(F.col("n") / F.col("df")).alias("idf"), "q")  # n is one row
    best = idf.orderBy(F.desc(F.col("q") * F.col("idf")), "w").limit(max_terms)
    return words.join(F.broadcast(best), "w").groupBy(key).agg(F.sum(F.col("tf") * F.col("q") * F.col("idf") * F.col("idf")).alias("score"))


def hamming_score(c: Column, hexes: str) -> Column:
    """4 * the shorter length - differing bits, over hex digits."""
    n = F.least(F.length(c), F.lit(len(hexes)))
    bits = F.lit(0).cast("long")
    for at in range(0, len(hexes), 8):
        size = F.greatest(F.lit(0), F.least(F.lit(8), n - at))
        mine, other = F.substr(c, F.lit(at + 1), size), F.substr(F.lit(hexes), F.lit(at + 1), size)
        number = lambda x: F.coalesce(F.conv(F.when(x != "", x), 16, 10).cast("long"), F.lit(0))
        bits = bits + F.bit_count(number(mine).bitwiseXOR(number(other)))
    return 4 * n - bits
