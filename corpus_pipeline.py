"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from graphloom.llm import decontaminate, jaccard_join, packing, quality_rules, queries, suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Names a row: a doc_id may be null or stand on several texts.
ROW = "xxhash64(doc_id, text)"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others keep the lines that pass."""
    judged = quality_rules.quality_rules(docs, carry=["lang", "source"]).filter("kept")
    return judged.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays, the one with the smallest doc_id; documents without words all stay.

    Rows are told apart by doc_id and text: texts that share a doc_id, or have none, stay unless something links them. A
    null doc_id comes after all others. Of rows equal in both the first by lang, source and n_chars stays.
    """
    named = docs.withColumn("_row", F.expr(ROW))
    found = jaccard_join.jaccard_join(named, "_row").distinct()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("least")
    stay = named.select("doc_id", "_row").distinct().join(found, "_row").groupBy("component_id").agg(least, F.max("n_shingles").alias("_n")).select("least._row", "_n")
    place = F.row_number().over(Window.partitionBy("_row").orderBy("lang", "source", "n_chars"))
    return named.join(stay, "_row").withColumn("_place", place).filter("_n = 0 or _place = 1").select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 200 bytes that start elsewhere too go; a character cut in two goes whole."""
    kept = suffix_dedup.suffix_dedup(docs, carry=["lang", "source"], decode=True)
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, each row by its own text."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, benchmark).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 ids."""
    return packing.pack(docs, queries.tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("packing", packed),
]

#: Not in SQL: shingle components, suffix sorting and alignment. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
