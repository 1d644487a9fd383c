"""Benchmark decontamination: the q-gram lemma on overlapping diagonal bands, then banded alignment.

Texts and items are normalised alike (letters lower case, other ASCII characters as one space). An item is searched by
windows of each of SIZES bytes, one every STEP bytes, so an excerpt of 63 bytes holds a whole window wherever it is cut.
A place in a text that is within e edits of a window of m bytes shares at least m + 1 - q (e + 1) of its q-grams with
it, all on diagonals that differ by e at most; bands of 2 (e + 1) diagonals that overlap by half hold each such set of
diagonals whole. The q-grams are those of the items: bands of an item with fewer hits than a window needs are dropped
first, then windows with fewer hits in a band; the rest is aligned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SLICE_BYTES, Rolling, U, ranges, rows_of, slices, small_batches

Q = 12
#: The longest window.
WINDOW = 96
#: Long windows allow more edits in one place, short ones lie between places with many.
SIZES = (WINDOW, 56)
STEP = 8
#: One edit for so many bytes of a window.
PER_EDIT = 16
#: Bytes of benchmark text that one broadcast index may hold; a larger benchmark is searched in several passes.
INDEX_BYTES = 16 << 20

_FOLD = np.full(256, 32, np.uint8)
for _c in range(128, 256):
    _FOLD[_c] = _c
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _FOLD[_c] = _c
for _c in range(65, 91):
    _FOLD[_c] = _c + 32


def normalised(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(normalised bytes, the place of each in ``data``). UTF-8 capitals of Latin-1 (after byte C3) fold as well."""
    out = _FOLD[data]
    capital = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    out[capital] += 0x20
    keep = out != 32
    keep[1:] |= out[:-1] != 32
    at = np.flatnonzero(keep)
    return out[at], at


def edits_allowed(m: int, per_edit: int = PER_EDIT) -> int:
    """At most one edit for ``per_edit`` bytes, and so few that a match shares a q-gram; -1 under q bytes."""
    return min(m // per_edit, (m + 1) // Q - 1) if m >= Q else -1


class Index:
    """The q-grams of all items in order, with the items and places that hold them, and the windows of the items."""

    def __init__(self, items: list[tuple[int, bytes]], per_edit: int):
        texts = [normalised(np.frombuffer(b" " + text + b" ", np.uint8))[0][:-1] if text else np.zeros(0, np.uint8) for _, text in items]
        sizes = np.array([len(x) for x in texts], np.int64)
        self.first = np.cumsum(np.r_[0, sizes])[:-1]
        self.text = np.concatenate([*texts, np.zeros(WINDOW, np.uint8)])
        self.size = sizes
        #: Items under q bytes have no q-gram: they match texts that are nothing else.
        self.short: dict[bytes, list[int]] = {}
        for (item, _), x in zip(items, texts, strict=True):
            if 0 < len(x) < Q:
                self.short.setdefault(x.tobytes().strip(), []).append(item)
        #: For each of SIZES: bytes, edits, shared q-grams, windows and first window of each item; an item that is shorter is one window.
        self.scales, total, kept = [], 0, []
        for most, shorter in zip(SIZES, [True] + [False] * (len(SIZES) - 1), strict=True):
            length = np.minimum(sizes, most)
            edits = np.array([edits_allowed(int(m), per_edit) for m in length], np.int64)
            count = np.where((edits >= 0) & (shorter | (sizes > most)), -(-(sizes - length) // STEP) + 1, 0)
            base = total + np.cumsum(np.r_[0, count])[:-1]
            owner = np.repeat(np.arange(len(sizes)), count)
            start = np.minimum((np.arange(count.sum()) + total - base[owner]) * STEP, (sizes - length)[owner])  # the last ends with its item
            kept.append((owner.astype(np.int32), (self.first[owner] + start).astype(np.int32), length[owner].astype(np.int16), edits[owner].astype(np.int16)))
            self.scales.append((length, edits, length + 1 - Q * (edits + 1), count, base))
            total += int(count.sum())
        self.owner, self.start, self.length, self.edits = (np.concatenate(x) for x in zip(*kept, strict=True))
        self.item = np.array([x for x, _ in items], np.int64)[self.owner]
        grams = [Rolling(x).grams(Q) if len(x) >= Q else np.zeros(0, U) for x in texts]
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams]).astype(np.int32)
        place = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams]) if grams else np.zeros(0, np.int32)
        gram = np.concatenate(grams) if grams else np.zeros(0, U)
        order = np.argsort(gram, kind="stable")
        self.gram, first = np.unique(gram[order], return_index=True)
        self.bounds = np.r_[first, len(gram)]
        self.holder, self.place = owner[order], place[order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.gram >> U(44)).astype(np.int64)] = True

    @property
    def bytes(self) -> np.ndarray:
        """The bytes of every window, and what follows it up to the longest length."""
        return self._bytes(np.arange(len(self.start)))

    def _bytes(self, window: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.text, WINDOW)[self.start[window]]

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``data``, number of the item, place in the item) of each shared q-gram."""
        none = np.zeros(0, np.int64)
        if len(data) < Q or not len(self.gram):
            return none, none, none
        grams = Rolling(data).grams(Q)
        at = np.flatnonzero(self.filter[(grams >> U(44)).astype(np.int64)])
        where = np.minimum(np.searchsorted(self.gram, grams[at]), len(self.gram) - 1)
        same = self.gram[where] == grams[at]
        at, where = at[same], where[same]
        entry, count = ranges(self.bounds[where], self.bounds[where + 1] - self.bounds[where])
        return np.repeat(at, count), self.holder[entry].astype(np.int64), self.place[entry].astype(np.int64)

    def matches(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(window, start, end, edits) of regions of ``data`` within the edits of a window; starts are approximate."""
        at, item, place = self.hits(data)
        found = [self._near(data, at, item, place, scale) for scale in self.scales]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _near(self, data: np.ndarray, at: np.ndarray, item: np.ndarray, place: np.ndarray, scale: tuple) -> tuple[np.ndarray, ...]:
        length, edits, need, count, base = scale
        mine = count[item] > 0
        at, item, place = at[mine], item[mine], place[mine]
        width = edits[item] + 1
        shift = self.size[item] + WINDOW  # an item may begin before the text does
        band = (at - place + shift) // width
        span = U(1) << U(32)
        item, place, band = np.r_[item, item], np.r_[place, place], np.r_[band, band - 1]
        _, group, hits = np.unique(item.astype(U) * span + band.astype(U), return_inverse=True, return_counts=True)
        many = hits[group] >= need[item]
        item, place, band = item[many], place[many], band[many]
        # the windows that hold the q-gram
        size, last = length[item], self.size[item] - length[item]
        low = -(-np.maximum(0, place + Q - size) // STEP)
        high = np.where(place >= last, count[item] - 1, place // STEP)
        window, of = ranges(base[item] + low, high - low + 1)
        keys, hits = np.unique(window.astype(U) * span + np.repeat(band, of).astype(U), return_counts=True)
        w = (keys // span).astype(np.int64)
        owner = self.owner[w]
        few = hits < need[owner]
        keys, w, owner = keys[~few], w[~few], owner[~few]
        # the band has the diagonals of the window from here on
        low = (keys % span).astype(np.int64) * (edits[owner] + 1) - self.size[owner] - WINDOW + self.start[w] - self.first[owner]
        cost, end = np.full(len(w), WINDOW), np.zeros(len(w), np.int64)
        for m, e in sorted(set(zip(self.length[w].tolist(), self.edits[w].tolist(), strict=True))):
            mine = np.flatnonzero((self.length[w] == m) & (self.edits[w] == e))
            for part in np.array_split(mine, -(-len(mine) // 4096)):
                cost[part], end[part] = aligned(self._bytes(w[part])[:, :m], data, low[part] - e, 4 * e + 2)
        good = cost <= self.edits[w]
        w, end, cost = w[good], end[good], cost[good]
        return w, np.maximum(0, end - self.length[w]), end, cost


def aligned(pattern: np.ndarray, data: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between each pattern and a piece of ``data`` on the diagonals low .. low + width, and its end."""
    n, m = pattern.shape
    diagonals = np.arange(width + 1)
    cost = np.zeros((n, width + 1), np.int64)
    start = low[:, None] + diagonals
    cost[(start < 0) | (start > len(data))] = 2 * WINDOW
    for i in range(m):
        j = start + i
        inside = (j >= 0) & (j < len(data))
        letter = np.where(inside, data[np.clip(j, 0, len(data) - 1)], 0)
        new = np.where(inside, cost + (letter != pattern[:, i : i + 1]), 2 * WINDOW)  # match or replace
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)  # the pattern's byte is missing in the text
        new = np.minimum.accumulate(new - diagonals, axis=1) + diagonals  # the text has bytes more
        cost = np.where((j + 1 >= 0) & (j + 1 <= len(data)), new, 2 * WINDOW)
    best = cost.argmin(1)
    return cost[np.arange(n), best], low + best + m


def _found(index: Index, rows) -> Iterator[list[tuple]]:
    """[(row, key, item, first byte, end byte, edits)] of the regions in ``rows`` (key, text), group by group."""
    for group in slices(_pieces(rows)):
        data = np.frombuffer(b"\n".join(t for _, t in group) + b"\n", np.uint8)
        bounds = np.cumsum([0, *(len(t) + 1 for _, t in group)])
        folded, place = normalised(data)
        # texts are apart by more edits than any window allows
        piece = np.searchsorted(bounds, place, side="right") - 1
        cuts = np.searchsorted(piece, np.arange(len(group) + 1))
        out = []
        for o in np.flatnonzero((np.diff(cuts) > 0) & (np.diff(cuts) <= Q)).tolist() if index.short else ():
            (row, key, base), text = group[o]
            if base == 0:
                out += [(row, key, item, 0, len(text), 0) for item in index.short.get(folded[cuts[o] : cuts[o + 1]].tobytes().strip(), ())]
        spread = np.full(len(folded) + WINDOW * len(group), 1, np.uint8)
        slot = np.arange(len(folded)) + piece * WINDOW
        spread[slot] = folded
        w, start, end, cost = index.matches(spread)
        if len(w):
            owner = np.searchsorted(slot[np.minimum(cuts[:-1], len(slot) - 1)], np.maximum(end - 1, 0), side="right") - 1
            near = lambda x: place[np.clip(np.searchsorted(slot, x), 0, len(slot) - 1)]  # noqa: E731, B023
            for o, item, a, b, c in zip(owner.tolist(), index.item[w].tolist(), near(start).tolist(), near(np.maximum(end - 1, 0)).tolist(), cost.tolist(), strict=True):
                (row, key, base), text = group[o]
                out.append((row, key, item, base + max(0, a - int(bounds[o])), base + min(len(text), b + 1 - int(bounds[o])), c))
        if out:
            yield out


def _searched(index, schema: pa.Schema):
    def run(batches):
        for found in _found(index.value, rows_of(batches, "doc_id", "text")):
            rows: dict[tuple, list] = {}
            for row, key, item, *region in found:
                rows.setdefault((row, key, item), []).append(region)
            out = [(key, item, min(a for a, _, _ in x), max(b for _, b, _ in x), len(x), min(c for _, _, c in x)) for (_, key, item), x in rows.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _clean(index, text: str):
    """The rows of each batch in which nothing is found."""

    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            body = batch.column(batch.schema.get_field_index(text)).cast(pa.string())
            numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), body], names=["row", "text"])
            for found in _found(index.value, rows_of([numbered], "row", "text")):
                keep[[x[1] for x in found]] = False
            yield batch.filter(pa.array(keep))

    return run


def _pieces(rows) -> Iterator[tuple]:
    """((row, key, first byte), bytes); long texts in overlapping pieces."""
    for row, (key, text) in enumerate(rows):
        for at in range(0, max(1, len(text or b"") - 4 * WINDOW), SLICE_BYTES):
            yield (row, key, at), (text or b"")[at : at + SLICE_BYTES + 4 * WINDOW]


def _indexes(benchmark: DataFrame, item: str, item_text: str, per_edit: int) -> list:
    """Broadcast indexes of about INDEX_BYTES of the benchmark each; the smallest holds no item."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    passes = max(1, -(-int(total) // INDEX_BYTES))
    parts = (items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i) if passes > 1 else items for i in range(passes))
    return [spark.sparkContext.broadcast(Index([(x.item_id, x.text.encode()) for x in part.collect()], per_edit)) for part in parts]


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", per_edit: int = PER_EDIT) -> DataFrame:
    """(key, item_id, first_byte, end_byte, windows, edits): the regions of each document that match an item.

    Rows are only for documents that match; a document row gives one row for each item it matches (more for a text over
    128 KiB that holds it in several pieces). Null and empty texts and items match nothing. An item under 12 normalised
    bytes has no q-gram; it matches the texts that are that item and nothing else. Repeated rows come out repeatedly.
    Other columns are not read. An empty benchmark or table gives no rows. A benchmark of more than INDEX_BYTES takes a
    scan of ``docs`` for each INDEX_BYTES.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([(x, pa.int64()) for x in ("doc_id", "item_id", "first_byte", "end_byte", "windows", "edits")])
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = None
    for index in _indexes(benchmark, item, item_text, per_edit):
        one = texts.mapInArrow(_searched(index, schema), "doc_id long, item_id long, first_byte long, end_byte long, windows long, edits long")
        found = one if found is None else found.unionByName(one)
    return found.withColumnRenamed("doc_id", key)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", per_edit: int = PER_EDIT) -> DataFrame:
    """The rows of ``docs`` that match no benchmark item, with all their columns.

    Each row is judged by its own text, whatever its key; rows without text stay. The texts are scanned once: the parts
    of a benchmark of more than INDEX_BYTES filter the rows one after the other in the same tasks, and nothing moves.
    """
    small_batches(docs.sparkSession)
    left = docs
    for index in _indexes(benchmark, item, item_text, per_edit):
        left = left.mapInArrow(_clean(index, text), docs.schema)
    return left
