"""The registered queries of the training-data operators: thin views with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, html_extract, jaccard_join, kneser_ney, packing, quality_rules, sharding, suffix_dedup, token_counts, warc
from .common import shared_folder

#: Fixed value: the end-of-document id of word_bpe_49k.
END_OF_TEXT = 49407


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"))


def op2_line_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, folder, "documents")).drop("clean_text")


def op3_kneser_ney_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    trusted = _table(spark, folder, "labels").filter("quality = 1 and toxic = 0").select("doc_id")
    return kneser_ney.perplexity_filter(_table(spark, folder, "documents"), trusted)


def op4_warc_chunked_records(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc.write_archives(_table(spark, folder, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op5_jump_hash_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, folder, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.benchmark_matches(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op7_html_tree_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract(_table(spark, folder, "pages"))


def op8_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_join(_table(spark, folder, "documents"))


def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = suffix_dedup.suffix_dedup(_table(spark, folder, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_separator_scan(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.token_counts(_table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"), END_OF_TEXT, width=16)  # 49408 ids
    return counted.select("doc_id", "n_tokens")


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_quality_rules": quality_rules.ORACLE_SQL, "op8_ngram_jaccard_join": jaccard_join.ORACLE_SQL}
