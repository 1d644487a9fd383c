"""Suffix-array deduplication: removes every byte covered by a string of ``length`` bytes that starts elsewhere too.

A suffix array of the whole corpus would be one sequential object, so the strings are first dealt into small problems:

1. Each string of ``length`` bytes is owned by its k-gram with the smallest fingerprint (the leftmost of equals), which
   depends on the string alone: equal strings have equal owners at equal offsets. Neighbouring strings with one owner
   make a segment, about one for every 75 bytes. Owners travel as packed fingerprints, not the text.
2. Segments that are equal as a whole (by a fingerprint of 128 bits, as a content address) are one string with a weight:
   all its copies are repeats. A task settles the copies that it holds itself and sends one of them on, so a passage in
   very many documents is met once for each group of texts and not for each document. An owner with one segment has no
   other repeat.
3. Owners with several different segments remain: each different segment is fetched once, and a suffix array is built
   over the blocks of its bytes, aligned at the owner, by linear grouping (``suffix_array``). A string of ``length`` bytes
   holds a fixed number of whole blocks. Neighbours in suffix order whose common prefix has that many blocks are a group;
   strings are equal if their blocks are in one group and the bytes before and behind these blocks are the same. Blocks
   and bytes are compared as such, fingerprints only deal the work.

An owner with more than ``chunk`` different segments is split into chunks of that size; what stays single in its chunk is
compared between the chunks by a fingerprint of 128 bits of the string (one count per string, partially aggregated), so
neither a hot passage nor a large group lands in one task, and nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SLICE_BYTES, Rolling, U, materialise, mix, partitions, rows_of, slices, small_batches
from .suffix_array import suffix_array

GRAM = 50
BLOCK = 32
#: Segments of one owner that are sorted together (about 3 MB of text); more are split.
CHUNK = 8192
#: Segments whose suffixes are sorted together.
BATCH = 4096
#: Bytes of text whose segments are sent on together, and bytes of text for a bucket of them.
TEXT_BYTES, BUCKET_BYTES = 8 << 20, 64 << 20
_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *((x, pa.binary()) for x in ("gram", "whole", "other", "key", "start", "small"))])
_FOUND = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("gram", pa.int64()), ("chunk", pa.int32()), ("split", pa.bool_()), ("at", pa.int32()), ("weight", pa.int32())])
_SEGMENTS = pa.schema([("gram", pa.int64()), ("chunk", pa.int32()), ("split", pa.bool_()), ("key", pa.int64()), ("start", pa.int64()), ("at", pa.int32()), ("weight", pa.int32()), ("data", pa.binary())])
_SORTED = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("print", pa.int64()), ("other", pa.int64()), ("weight", pa.int32())])


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of half-open spans."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.r_[True, start[1:] > reach[:-1]]
    return start[first], reach[np.r_[np.flatnonzero(first)[1:] - 1, len(start) - 1]]


def owners(data: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, Rolling]:
    """(owner of the string at each start, k-gram fingerprints, rolling sums)."""
    rolling = Rolling(data)
    grams = rolling.grams(k)
    low, width, span = (grams >> U(24) << U(24)) | np.arange(len(grams), dtype=U), length - k + 1, 1
    while span * 2 <= width:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    if width > span:
        low = np.minimum(low[: span - width], low[width - span :])
    return (low & U((1 << 24) - 1)).astype(np.int64), grams, rolling


def _pieces(batches, length: int) -> Iterator[tuple]:
    """((key, first byte), bytes): long texts in pieces that overlap by length - 1 bytes, so each string is in one."""
    for key, text in rows_of(batches, "key", "text"):
        for at in range(0, max(0, len(text or b"") - length + 1), SLICE_BYTES):
            yield (key, at), text[at : at + SLICE_BYTES + length - 1]


def _owned(group: list[tuple], length: int) -> tuple[np.ndarray, ...]:
    """(owner's k-gram, whole segment twice, key, start, small) of the segments of some pieces; small: strings - 1, owner's
    offset, 1. Strings do not cross pieces."""
    data = np.frombuffer(b"".join(t for _, t in group), np.uint8)
    bounds = np.r_[0, np.cumsum([len(t) for _, t in group])]
    own, grams, rolling = owners(data, length, GRAM)
    piece = np.repeat(np.arange(len(group)), np.diff(bounds))[: len(own)]
    whole = np.arange(len(own)) + length <= bounds[piece + 1]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(new & whole)
    ends = np.flatnonzero(np.r_[(new | ~whole)[1:], True] & whole)
    p, piece = own[first], piece[first]
    prints = mix(rolling.spans(first, ends + length) + (p - first).astype(U))
    others = mix(Rolling(data, 1).spans(first, ends + length) + (p - first).astype(U))
    keys = np.array([k for (k, _), _ in group], np.int64)[piece]
    starts = first - bounds[piece] + np.array([b for (_, b), _ in group], np.int64)[piece]
    return grams[p], prints, others, keys, starts, np.stack([ends - first, p - first, np.ones(len(p), np.int64)], 1).astype(np.uint8)


def _anchored(length: int, buckets: int):
    """The segments of each task, packed by the k-gram of their owner; equal ones are settled where they meet."""

    def packed(parts):
        grams, prints, others, keys, starts, small = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((others, prints))
        new = np.r_[True, (prints[order[1:]] != prints[order[:-1]]) | (others[order[1:]] != others[order[:-1]])] if len(order) else np.zeros(0, bool)
        at, inverse = order[new], np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        again, rows = np.bincount(inverse)[inverse] > 1, []
        small[again, 2] = 2
        if again.any():  # one of them goes on
            key, start, end = keys[again], starts[again], starts[again] + small[again, 0] + length
            order = np.lexsort((start, key))
            key, start, end = key[order], start[order], end[order]
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                a, b = merged(start[x:y], end[x:y])
                rows.append((int(mix(key[x : x + 1].view(U))[0] % U(buckets)), 1, None, None, None, np.full(len(a), key[x]).tobytes(), a.tobytes(), b.tobytes()))
        target = (mix(grams[at]) >> U(32)) * U(buckets) >> U(32)  # mixed anew: owners are minima and so small
        order = np.argsort(target, kind="stable")
        cuts = np.searchsorted(target[order], np.arange(buckets + 1, dtype=U))
        for b in np.flatnonzero(np.diff(cuts)):
            x = at[order[cuts[b] : cuts[b + 1]]]
            rows.append((int(b), 0, grams[x].tobytes(), prints[x].tobytes(), others[x].tobytes(), keys[x].tobytes(), starts[x].tobytes(), small[x].tobytes()))
        return _batch(_PACKED, *zip(*rows, strict=True))

    def run(batches):
        parts, held = [], 0
        for group in slices(_pieces(batches, length)):
            parts.append(_owned(group, length))
            held += sum(len(t) for _, t in group)
            if held > TEXT_BYTES:
                yield packed(parts)
                parts, held = [], 0
        if parts:
            yield packed(parts)

    return run


def _spans(key, start, end) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    out = [(key[a], *merged(start[a:b], end[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] if len(key) else []
    for i in range(0, len(out), 20000):
        part = out[i : i + 20000]
        k = np.concatenate([np.full(len(a), key) for key, a, _ in part])
        none, zero = np.zeros(len(k), np.int64), np.zeros(len(k), np.int32)
        yield _batch(_FOUND, zero + 1, k, np.concatenate([a for _, a, _ in part]), np.concatenate([b for _, _, b in part]), none, zero, zero > 0, zero, zero)


def _matched(length: int, chunk: int):
    def run(batches):
        parts, spans = [], []
        for batch in batches:
            for kind, gram, whole, other, key, start, small in zip(*(batch.column(i).to_pylist() for i in range(1, 8)), strict=True):
                if kind:
                    spans.append([np.frombuffer(x, np.int64) for x in (key, start, small)])
                else:
                    parts.append((np.frombuffer(gram, U), np.frombuffer(whole, U), np.frombuffer(other, U), np.frombuffer(key, np.int64), np.frombuffer(start, np.int64), np.frombuffer(small, np.uint8).reshape(-1, 3)))
        if spans:
            yield from _spans(*(np.concatenate(x) for x in zip(*spans, strict=True)))
        if not parts:
            return
        gram, whole, other, key, start, small = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((start, key, other, whole, gram))
        gram, whole, other, key, start, small = gram[order], whole[order], other[order], key[order], start[order], small[order].astype(np.int64)
        new_gram = np.r_[True, gram[1:] != gram[:-1]]
        new = new_gram | np.r_[True, (whole[1:] != whole[:-1]) | (other[1:] != other[:-1])]
        first = np.flatnonzero(new)
        weight = np.add.reduceat(small[:, 2], first)
        full = (weight[np.cumsum(new) - 1] > 1) & (small[:, 2] == 1)
        yield from _spans(key[full], start[full], start[full] + small[full, 0] + length)
        of = np.cumsum(new_gram)[first] - 1
        different = np.bincount(of)
        single = np.bincount(of, weights=weight == 1)
        open_ = (different[of] > 1) & (single[of] > 0)
        first, weight, of = first[open_], np.minimum(weight[open_], 2), of[open_]
        if len(first):
            rank = np.arange(len(of)) - np.searchsorted(of, of)
            yield _batch(_FOUND, np.full(len(of), 2, np.int32), key[first], start[first], start[first] + small[first, 0], gram[first].view(np.int64), (rank // chunk).astype(np.int32), different[of] > chunk, small[first, 1].astype(np.int32), weight.astype(np.int32))

    return run


def _fetched(length: int):
    """Rows (key, text, segs): the bytes of each wanted segment."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, text, segs in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows += [(x["gram"], x["chunk"], x["split"], key, x["start"], x["at"], x["weight"], text[x["start"] : x["end"] + length]) for x in segs]
            for i in range(0, len(rows), 8192):
                yield _batch(_SEGMENTS, *zip(*rows[i : i + 8192], strict=True))

    return run


def repeats(at: np.ndarray, weight: np.ndarray, data: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """The strings of ``length`` bytes of each segment: (segment, place in it, total weight of its equals).

    Strings whose blocks repeat nowhere in suffix order have the weight of their segment without a look at their bytes.
    """
    sizes = np.array([len(x) for x in data])
    begin = np.r_[0, np.cumsum(sizes)]
    text = np.frombuffer(b"".join(data), np.uint8)
    lead = at % BLOCK
    blocks = np.maximum(0, (sizes - lead) // BLOCK)
    seg = np.repeat(np.arange(len(data)), blocks)
    nth = np.arange(len(seg)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    where = begin[seg] + lead[seg] + nth * BLOCK
    whole = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, BLOCK)[where]).view(f"S{BLOCK}").ravel()
    ranks = np.unique(whole, return_inverse=True)[1] + 2
    # one line of symbols: the blocks of each segment, then a separator
    line = np.ones(len(seg) + len(data), np.int64)
    slot = np.arange(len(seg)) + seg
    line[slot] = ranks
    core = (length - BLOCK + 1) // BLOCK
    order = np.array(suffix_array(line.tolist()), np.int64)
    inside = np.full(len(line), -1)
    inside[slot[nth + core <= blocks[seg]]] = np.flatnonzero(nth + core <= blocks[seg])
    order = order[inside[order] >= 0]
    differ = np.zeros(max(0, len(order) - 1), bool)  # neighbours whose common prefix is shorter than the core
    for d in range(core):
        differ |= line[order[1:] + d] != line[order[:-1] + d]
    block = inside[order]
    group = np.zeros(len(seg), np.int64)
    if len(order):
        group[block] = np.r_[0, np.cumsum(differ)]
    held = np.bincount(group[block], weights=weight[seg[block]]) if len(block) else np.zeros(0)
    shared = np.zeros(len(seg), bool)
    shared[block] = held[group[block]] > 1
    # every string, by the first whole block that it holds
    count = sizes - length + 1
    of = np.repeat(np.arange(len(data)), count)
    i = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    first = (np.cumsum(blocks) - blocks)[of] + np.maximum(0, -((lead[of] - i) // BLOCK))
    total = weight[of].copy()
    c = np.flatnonzero(shared[first])
    if len(c):
        # the bytes before and behind the blocks decide among the strings of one group
        left = where[first[c]] - begin[of[c]] - i[c]
        rest = np.empty((len(c), 5 + length - core * BLOCK), np.uint8)
        rest[:, :4] = group[first[c]].astype("<u4")[:, None].view(np.uint8)
        rest[:, 4] = left
        places = np.arange(length - core * BLOCK)
        for x in range(0, len(c), 50_000):
            some = c[x : x + 50_000]
            place = (begin[of[some]] + i[some])[:, None] + places
            place += (places >= left[x : x + 50_000, None]) * (core * BLOCK)
            rest[x : x + 50_000, 5:] = text[place]
        _, inverse = np.unique(rest.view(f"S{rest.shape[1]}").ravel(), return_inverse=True)
        total[c] = np.bincount(inverse, weights=weight[of[c]]).astype(np.int64)[inverse]
    return of, i, total


def _sorted(length: int):
    def settle(rows):
        _, _, split, key, start, at, weight, data = (list(x) for x in zip(*rows, strict=True))
        key, start, at, weight, split = (np.array(x) for x in (key, start, at, weight, split))
        of, i, total = repeats(at, weight, data, length)
        hit = (total > 1) & (weight[of] == 1)
        k, a = key[of[hit]], start[of[hit]] + i[hit]
        new = np.r_[True, (k[1:] != k[:-1]) | (a[1:] != a[:-1] + 1) | (np.diff(of[hit]) != 0)] if len(k) else np.zeros(0, bool)
        lo, hi = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:] - 1, len(k) - 1] if len(k) else np.zeros(0, np.int64)
        zero = np.zeros(len(lo), np.int64)
        yield _batch(_SORTED, k[lo], a[lo], a[hi] + length, zero, zero, zero.astype(np.int32))
        far = np.flatnonzero(split[of])
        if len(far):  # of a split owner: counted between the chunks
            text, begin = np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(x) for x in data])]
            at = begin[of[far]] + i[far]
            prints, others = (Rolling(text, kind).spans(at, at + length) for kind in (0, 1))
            single = np.flatnonzero(total[far] == 1)
            multi = np.flatnonzero(total[far] > 1)
            multi = multi[np.unique(prints[multi], return_index=True)[1]]
            x = np.r_[single, multi]
            known = np.r_[np.ones(len(single), bool), np.zeros(len(multi), bool)]
            a = start[of[far[x]]] + i[far[x]]
            yield _batch(_SORTED, pa.array(key[of[far[x]]], mask=~known), a, a + length, prints[x].view(np.int64), others[x].view(np.int64), np.where(known, 1, 2).astype(np.int32))

    def run(batches):
        rows, last = [], None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if len(rows) >= BATCH and row[:2] != last:
                    yield from settle(rows)
                    rows = []
                rows.append(row)
                last = row[:2]
        if rows:
            yield from settle(rows)

    return run


def _kept(decode: bool):
    """Rows (key, text, spans, carry): the bytes that stay."""

    def run(batches):
        kept_type = pa.string() if decode else pa.binary()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for text, span in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2), strict=True):
                    kept = text = text or b""
                    a = ()
                    if span.is_valid:
                        a, b = merged(span.values.field(0).to_numpy(), span.values.field(1).to_numpy())
                        edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(text)]
                        kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                    rows.append((kept.decode("utf-8", "ignore") if decode else kept, len(text), len(text) - len(kept), len(a)))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (kept_type, pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, part.column(3)], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "_carry"])

    return run


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, chunk: int = CHUNK, carry: Sequence[str] = (), decode: bool = False) -> DataFrame:
    """(key, kept binary, n_bytes, n_removed, n_spans) for each row of ``docs``.

    Texts are UTF-8 bytes; a null text is empty and stays empty. Texts under ``length`` bytes keep everything. Strings
    are judged on the input: all copies of a repeated string go, the first too. Repeated rows are repeats of each other
    and all come out. Rows may share a key or have none: they are written once with a number of their own, which names
    them from there on. The columns in ``carry`` follow; others are not read. With ``decode``, kept is a string: a
    character that was cut in two goes whole. No rows, no result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *carry).alias("_carry"))
    texts = materialise(texts.withColumn("key", F.monotonically_increasing_id()))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(partitions(spark), -(-int(size) // BUCKET_BYTES))
    packed = texts.select("key", "text").mapInArrow(_anchored(length, buckets), _ddl(_PACKED))
    found = materialise(packed.repartitionById(buckets, "bucket").mapInArrow(_matched(length, chunk), _ddl(_FOUND)))
    wanted = found.filter("kind = 2").groupBy("key").agg(F.collect_list(F.struct("gram", "chunk", "split", "start", "end", "at", "weight")).alias("segs"))
    segments = texts.join(wanted, "key").select("key", "text", "segs").mapInArrow(_fetched(length), _ddl(_SEGMENTS))
    sorted_ = materialise(segments.repartition(buckets, "gram", "chunk").sortWithinPartitions("gram", "chunk").mapInArrow(_sorted(length), _ddl(_SORTED)))
    spans = found.filter("kind = 1").select("key", "start", "end").unionByName(sorted_.filter("weight = 0").select("key", "start", "end"))
    across = sorted_.filter("weight > 0")
    twice = across.groupBy("print", "other").agg(F.sum("weight").alias("of")).filter("of > 1").select("print", "other")
    spans = spans.unionByName(across.filter("weight = 1").join(twice, ["print", "other"]).select("key", "start", "end"))
    removed = spans.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    schema = f"doc_id long, kept {'string' if decode else 'binary'}, n_bytes long, n_removed long, n_spans long, _carry {texts.schema['_carry'].dataType.simpleString()}"
    kept = texts.join(removed, "key", "left").select("doc_id", "text", "spans", "_carry").mapInArrow(_kept(decode), schema)
    return kept.select(F.col("doc_id").alias(key), "kept", "n_bytes", "n_removed", "n_spans", *(F.col("_carry")[c].alias(c) for c in carry))
