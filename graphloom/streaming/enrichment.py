"""Enrichment of a stream of changes: workers, term mentions, watch lists, windows. The same functions serve batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: What the first bytes of a text tell of its type.
MAGIC = [("application/pdf", r"^%PDF"), ("text/html", r"(?i)^\s*(?:<!doctype html|<html)"), ("application/xml", r"^\s*<\?xml"), ("application/json", r"^\s*[\[{]")]
#: Patterns of entities.
ENTITIES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "url": r"https?://[^\s\"'<>]+"}


@dataclass(frozen=True)
class Worker:
    """``handles`` chooses rows, ``run`` adds to them; both are plain DataFrame expressions."""

    name: str
    handles: Callable[[DataFrame], Column]
    run: Callable[[DataFrame], DataFrame]


def dispatch(changes: DataFrame, workers: list[Worker]) -> DataFrame:
    """(worker, ...): the output of every worker over the rows that it handles."""
    out = None
    for worker in workers:
        part = worker.run(changes.filter(worker.handles(changes))).withColumn("worker", F.lit(worker.name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def mime_type(text: Column) -> Column:
    kind = F.lit("text/plain")
    for name, pattern in reversed(MAGIC):
        kind = F.when(F.rlike(text, F.lit(pattern)), name).otherwise(kind)
    return kind


def term_mentions(df: DataFrame, key: str, text: str, kinds: dict[str, str] = ENTITIES) -> DataFrame:
    """(key, kind, n, value): every match of each pattern, numbered in order of appearance."""
    parts = None
    for kind, pattern in kinds.items():
        found = df.select(key, F.lit(kind).alias("kind"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(f"({pattern})"))).alias("n", "value"))
        parts = found if parts is None else parts.unionByName(found)
    return parts


def watch(changes: DataFrame, watched: DataFrame, on: list[str]) -> DataFrame:
    """Stream-static join: the changes that someone watches."""
    return changes.join(watched, on)


def windowed(events: DataFrame, ts: str, width: str, keys: list[str], metrics: dict[str, Column], slide: str | None = None, late: str | None = None) -> DataFrame:
    """Tumbling or sliding windows; ``late`` is the watermark of a stream."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    events = events.withWatermark(ts, late) if late else events
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = events.groupBy(window.alias("_w"), *keys).agg(*(m.alias(k) for k, m in metrics.items()))
    return out.select(F.col("_w.start").cast("timestamp_ntz").alias("window_start"), *keys, *metrics)


def sessions(events: DataFrame, ts: str, gap: str, keys: list[str], metrics: dict[str, Column], late: str | None = None) -> DataFrame:
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    events = events.withWatermark(ts, late) if late else events
    out = events.groupBy(F.session_window(ts, gap).alias("_w"), *keys).agg(*(m.alias(k) for k, m in metrics.items()))
    return out.select(F.col("_w.start").cast("timestamp_ntz").alias("session_start"), F.col("_w.end").cast("timestamp_ntz").alias("session_end"), *keys, *metrics)


def drain(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs a stream over what is there, batch by batch, with exactly-once offsets in ``checkpoint``."""
    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
