"""N-gram Jaccard join: prefix-tree similarity join over word-shingle sets.

Every set is put in one global order, rarest shingle first, and stored in a trie. A probe walks the trie once and
shares the overlap counted so far between all sets below a node; a subtree is left as soon as the shingles that remain
on either side cannot lift the overlap to what the threshold needs.

How the work is spread:

1. One pass over the texts makes the shingle sets. Sets are named by a fingerprint, so equal sets are one set from
   here on. Shingles travel as packed arrays, dealt by the value of the shingle into as many buckets as the texts need.
2. Per shingle: the number of different sets that hold it. A shingle of one set alone can link nothing and is dropped.
   A hot shingle (of LOCAL sets in one group of texts, or of more than LISTED sets) is only marked: it is the last in the
   order, its holders go on to their sets without being gathered, so neither a task nor a list grows with it.
3. Per set: its repeated shingles by (frequency, value). A set whose unique shingles fill its whole prefix
   (n - ceil(t n) + 1 rarest shingles) has no partner and is done.
4. Candidates are sets that share a shingle of both prefixes. First a leader of each shingle probes the tries of the
   sets that hold it; the links found make components. Where a shingle is still in different components, the sets that
   hang together over such shingles are a cluster. The sets of a cluster of at most CLUSTER sets probe its tries. In a
   larger cluster they probe the tries of the shingle's own holders of a similar size, and a pair is met only at the
   first shingle that both prefixes have; but not if these are more pairs than those of the cluster, as in a large group
   of near copies, which share most of their shingles. So no link between components is missed, a group whose sets are
   linked anyway is not expanded into all its pairs, and a cluster that has no end is not compared with itself.
5. A walk of a trie takes many probes at once: each of its shingles has a row of bytes, one for each probe, and the
   overlaps of all probes grow by adding up rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import GROUP_BYTES, U, components, materialise, partitions, rows_of, salted_join, slices, small_batches
from .shingles import shingle_sets, signatures

#: Sets that one trie holds, sets that probe it in one task, and sets of a cluster that is compared as a whole at any rate.
TRIE_SETS, SLOT_SETS, CLUSTER = 512, 2048, 8192
#: Probes that walk a trie at once, bytes of their rows, shingles of a trie from which on each probe walks alone, and
#: shingles that are added up between two looks at the bounds; a byte holds no more than 255.
WALKERS, WALK_BYTES, WALK_TOKENS, STEP = 512, 32 << 20, 1 << 22, 255
#: Bytes of text for a bucket of shingles and for a group of texts whose shingles travel together.
BUCKET_BYTES, TEXT_BYTES = 64 << 20, 4 << 20
#: Sets of a group of texts, and sets of a bucket's list, from which a shingle is hot.
LOCAL, LISTED = 64, 1 << 14
#: The frequency that stands for all hot shingles.
HOT = (1 << 31) - 1
#: Shingles that a bucket takes in before it looks for hot ones.
TAKEN = 1 << 20
_PACKED = "bucket int, kind int, ids binary, sizes binary, owner binary, tokens binary, extra binary"
_SETS = "kind int, sig long, n long, freq array<int>, tokens array<long>, docs array<long>"


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return ((tokens >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def _packed(kind, ids, sizes, owner, tokens, extra, target, buckets) -> Iterator[tuple]:
    """Rows (bucket, kind, ...): the entries of each target bucket; an entry names its set by a place in ``ids``."""
    order = np.argsort(target.astype(np.uint16) if buckets <= 1 << 16 else target, kind="stable")  # short keys take one pass
    bounds = np.r_[0, np.cumsum(np.bincount(target, minlength=buckets))]
    seen = np.zeros(len(ids), bool)
    places = np.zeros(len(ids), np.int64)
    for b in np.flatnonzero(np.diff(bounds)):
        at = order[bounds[b] : bounds[b + 1]]
        used = owner[at]
        if len(at) > len(ids) >> 5:  # many: a flag for each set, not a sort
            seen[:] = False
            seen[used] = True
            used = np.flatnonzero(seen)
        else:
            used = np.unique(used)
        places[used] = np.arange(len(used))
        place = places[owner[at]]
        yield int(b), kind, ids[used].tobytes(), sizes[used].tobytes(), place.astype(np.uint32).tobytes() if len(used) > 65535 else place.astype(np.uint16).tobytes(), tokens[at].tobytes(), b"" if extra is None else extra[at].tobytes()


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, bytes | np.ndarray))
        if size > most or len(held) >= 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


_PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *((x, pa.binary()) for x in ("ids", "sizes", "owner", "tokens", "extra"))])
_SETS_ARROW = pa.schema([("kind", pa.int32()), ("sig", pa.int64()), ("n", pa.int64()), ("freq", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])


def _columns(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)


def _shingled(key: str, text: str, size: int, buckets: int):
    """Packed rows: 0 shingles with their sets and 3 marks of hot ones, for the bucket of the shingle; 2 hot shingles for
    the bucket of the set; 1 documents with their sets, for any bucket."""

    def run(batches):
        def rows():
            place = TaskContext.get().partitionId()
            for group in slices(((k, t or b"") for k, t in rows_of(batches, key, text)), TEXT_BYTES):
                parts = [shingle_sets([t for _, t in part], size) for part in slices(((None, t) for _, t in group), GROUP_BYTES)]
                sets, sigs = [s for part in parts for s in part], np.concatenate([signatures(part) for part in parts])
                ns = np.array([len(s) for s in sets], np.int64)
                docs = np.array([-1 if k is None else k for k, _ in group], np.int64)
                valid = np.array([k is not None for k, _ in group])
                place = (place + 1) % buckets
                yield from _packed(1, sigs, ns, np.arange(len(group)), docs, valid.astype(np.uint32), np.full(len(group), place), buckets)
                _, first = np.unique(sigs, return_index=True)
                first = first[ns[first] > 0]
                if not len(first):
                    continue
                tokens = np.concatenate([sets[i] for i in first])
                owner = np.repeat(np.arange(len(first)), ns[first])
                ids, sizes = sigs[first], ns[first]
                if len(first) >= LOCAL:
                    value, count = np.unique(tokens, return_counts=True)
                    hot = value[count >= LOCAL]
                    if len(hot):
                        is_hot = _among(tokens, hot)
                        yield from _packed(2, ids, sizes, owner[is_hot], tokens[is_hot], np.full(int(is_hot.sum()), HOT, np.uint32), _bucket(ids.view(U), buckets)[owner[is_hot]], buckets)
                        yield from _packed(3, ids[:1], sizes[:1], np.zeros(len(hot), np.int64), hot, None, _bucket(hot, buckets), buckets)
                        tokens, owner = tokens[~is_hot], owner[~is_hot]
                yield from _packed(0, ids, sizes, owner, tokens, None, _bucket(tokens, buckets), buckets)

        return _batches(rows(), _PACKED_ARROW)

    return run


def _read(row) -> tuple:
    ids, sizes = np.frombuffer(row[2], np.int64), np.frombuffer(row[3], np.int64)
    owner = np.frombuffer(row[4], np.uint32 if len(ids) > 65535 else np.uint16)
    return ids, sizes, owner, np.frombuffer(row[5], U)


def _among(values: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Whether each value is one of the sorted ``chosen``."""
    if not len(chosen):
        return np.zeros(len(values), bool)
    return chosen[np.minimum(np.searchsorted(chosen, values), len(chosen) - 1)] == values


class Holders:
    """The sets that hold each shingle of a bucket, as they come in; shingles with too many are let go as hot."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.size = self.seen = 0
        self.hot = np.zeros(0, U)

    def add(self, tokens: np.ndarray, sigs: np.ndarray, ns: np.ndarray) -> None:
        self.parts.append((tokens, sigs, ns))
        self.size += len(tokens)

    def sorted(self, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different (shingle, set) pairs in order; at the end without the shingles of one entry."""
        tokens, sigs, ns = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts.clear()
        if last:
            order = np.argsort(tokens)
            t = tokens[order]
            keep = np.zeros(len(t) + 1, bool)
            keep[1:-1] = t[1:] == t[:-1]
            order = order[keep[1:] | keep[:-1] | _among(t, self.hot)]
            del t
            tokens, sigs, ns = tokens[order], sigs[order], ns[order]
        order = np.lexsort((sigs, tokens))
        tokens, sigs, ns = tokens[order], sigs[order], ns[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (sigs[1:] != sigs[:-1])
        return tokens[new], sigs[new], ns[new]

    def released(self, last: bool = False) -> tuple[np.ndarray, ...] | None:
        """(tokens, sigs, ns, freq) that go on: those of hot shingles, at the end all of two sets or more."""
        if not self.parts:
            return None
        tokens, sigs, ns = self.sorted(last)
        first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, np.int64)
        freq = np.diff(np.r_[first, len(tokens)])
        self.hot = np.union1d(self.hot, tokens[first[freq > LISTED]])
        freq = np.where(_among(tokens[first], self.hot), HOT, freq)
        freq = np.repeat(freq, np.diff(np.r_[first, len(tokens)]))
        go = freq > 1 if last else freq == HOT
        if not last:
            self.parts.append((tokens[~go], sigs[~go], ns[~go]))
            self.size = self.seen = len(tokens) - int(go.sum())
        return tokens[go], sigs[go], ns[go], freq[go]


def _counted(buckets: int):
    """Per shingle, the sets that hold it; keeps the shingles of two sets or more, with their frequency."""

    def run(batches):
        def sent(found):
            tokens, sigs, ns, freq = found
            if len(tokens):
                ids, first, owner = np.unique(sigs, return_index=True, return_inverse=True)
                yield from _packed(0, ids, ns[first].astype(np.int64), owner, tokens, freq.astype(np.uint32), _bucket(sigs.view(U), buckets), buckets)

        def rows():
            held, at = Holders(), None
            for row in _columns(batches):
                if row[0] != at:
                    if found := held.released(last=True):
                        yield from sent(found)
                    held, at = Holders(), row[0]
                if row[1] in (1, 2):
                    yield row
                    continue
                ids, sizes, owner, tokens = _read(row)
                if row[1] == 3:
                    held.hot = np.union1d(held.hot, tokens)
                else:
                    held.add(tokens, ids[owner], sizes[owner].astype(np.int32))
                    if held.size > 2 * held.seen + TAKEN:
                        yield from sent(held.released())
            if found := held.released(last=True):
                yield from sent(found)

        return _batches(rows(), _PACKED_ARROW)

    return run


def needed_prefix(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return n - (n * num + den - 1) // den + 1


def _ordered(num: int, den: int):
    """Per set: its repeated shingles, rarest first, if they reach into its prefix. Documents pass with their set."""

    def run(batches):
        def rows():
            parts, at = [], None
            for row in _columns(batches):
                if row[0] != at:
                    yield from settled(parts)
                    parts, at = [], row[0]
                ids, sizes, owner, tokens = _read(row)
                extra = np.frombuffer(row[6], np.uint32)
                if row[1] == 1:  # the documents of each set
                    held: dict[int, list] = {}
                    for i, doc, valid in zip(owner.tolist(), tokens.view(np.int64).tolist(), extra.tolist(), strict=True):
                        held.setdefault(i, []).append(doc if valid else None)
                    yield from ((1, int(ids[i]), int(sizes[i]), None, None, docs) for i, docs in held.items())
                else:
                    parts.append((ids[owner], sizes[owner], tokens, extra))
            yield from settled(parts)

        def settled(parts):
            if not parts:
                return
            sigs, ns, tokens, freq = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((tokens, freq, sigs))
            sigs, ns, tokens, freq = sigs[order], ns[order], tokens[order], freq[order]
            new = np.r_[True, (sigs[1:] != sigs[:-1]) | (tokens[1:] != tokens[:-1])]  # a hot one may come from several groups
            sigs, ns, tokens, freq = sigs[new], ns[new], tokens[new], freq[new]
            first = np.flatnonzero(np.r_[True, sigs[1:] != sigs[:-1]])
            bounds = np.r_[first, len(sigs)]
            n, repeated = ns[first], np.diff(bounds)
            for i in np.flatnonzero(n - repeated < needed_prefix(n, num, den)):
                a, b = bounds[i], bounds[i + 1]
                yield 0, int(sigs[a]), int(n[i]), freq[a:b].astype(np.int32), tokens[a:b].view(np.int64), None

        return _batches(rows(), _SETS_ARROW)

    return run


class Joined:
    """The components that the links of one trie have joined so far; with ``keep`` false it stays empty."""

    def __init__(self, keep: bool = False):
        self.held: dict[int, int] | None = {} if keep else None

    def root(self, comp: int) -> int:
        while self.held and comp in self.held:
            comp = self.held[comp]
        return comp

    def link(self, comp: int, root: int) -> None:
        self.held[self.root(comp)] = root


class Trie:
    """Sets in the global order, as a depth-first list of leaves with the depth shared with the leaf before."""

    def __init__(self, sets: list[tuple[int, int, np.ndarray, np.ndarray, int]]):
        keys = []
        for _, _, freq, tokens, _ in sets:
            key = np.empty(len(tokens), [("f", ">u4"), ("t", ">u8")])
            key["f"], key["t"] = freq, tokens.view(U)
            keys.append(key.tobytes())
        order = sorted(range(len(sets)), key=keys.__getitem__)
        self.ids = [sets[i][0] for i in order]
        self.n = [sets[i][1] for i in order]
        self.comp = [sets[i][4] for i in order]
        self.freq = [sets[i][2] for i in order]
        self.tokens = [sets[i][3].view(U) for i in order]
        self.shared = [0]
        for a, b in zip(self.tokens, self.tokens[1:], strict=False):
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.shared.append(int(differ[0]) if len(differ) else m)
        self.shared.append(0)
        self.size = sum(len(x) for x in self.tokens)
        self.names: np.ndarray | None = None

    def walk(self, probes: list[tuple[int, int, np.ndarray, np.ndarray, int]], num: int, den: int, joined: Joined, first: int | None = None) -> Iterator[tuple[int, int]]:
        """Links (probe, set) as ``probe`` finds them, but of all ``probes`` (sig, n, freq, tokens, comp) in one walk."""
        if self.names is None:
            self.names, codes = np.unique(np.concatenate(self.tokens), return_inverse=True)
            self.codes = np.split(codes, np.cumsum([len(x) for x in self.tokens])[:-1])
        width = -(-len(probes) // 8) * 8  # eight bytes are added at once
        held = np.zeros((len(self.names), width), np.uint8)
        earlier = None if first is None else np.zeros_like(held)
        n, left, comp = (np.zeros(width, np.int64) for _ in range(3))
        for p, (_, m, _, tokens, c) in enumerate(probes):
            values = tokens.view(U)
            place = np.searchsorted(self.names, values)
            place[place == len(self.names)] = 0
            there = self.names[place] == values
            held[place[there], p] = 1
            if first is not None:
                there[int(np.flatnonzero(values == U(first))[0]) :] = False
                earlier[place[there], p] = 1
            n[p], left[p], comp[p] = m, len(values), joined.root(c)
        rows, before = held.view(np.uint64), None if first is None else earlier.view(np.uint64)
        path = [(0, np.zeros(width, np.int64), np.zeros(width, bool))]
        for i, codes in enumerate(self.codes):
            while path[-1][0] > self.shared[i]:
                path.pop()
            at, overlap, met = path[-1]
            m, branch = self.n[i], self.shared[i + 1]
            need = -(-num * (n + m) // (num + den))
            live = (m * den >= n * num) & (n * den >= m * num) & (comp != joined.root(self.comp[i]))
            live &= ~met & (overlap + np.minimum(len(codes) - at, left - overlap) >= need)
            while at < len(codes) and live.any():
                end = min(at + STEP, branch if at < branch else len(codes))
                overlap = overlap + np.add.reduce(rows[codes[at:end]], axis=0).view(np.uint8)
                if first is not None:
                    met = met | (np.bitwise_or.reduce(before[codes[at:end]], axis=0).view(np.uint8) > 0)
                at = end
                if at == branch:
                    path.append((at, overlap, met))
                live &= ~met & (overlap + np.minimum(len(codes) - at, left - overlap) >= need)
            for p in np.flatnonzero(live).tolist():
                if joined.root(self.comp[i]) != (mine := joined.root(probes[p][4])):
                    joined.link(self.comp[i], mine)
                    yield probes[p][0], self.ids[i]

    def probe(self, n: int, freq: np.ndarray, tokens: np.ndarray, comp: int, num: int, den: int, joined: Joined | None = None, first: int | None = None) -> list[int]:
        """The sets of other components whose Jaccard similarity with the probe is at least num / den.

        With ``first``, a shingle that all have, only those with which the probe shares no shingle before it in the order.

        With ``joined`` a component that a link already reaches counts as the probe's own, and each link found adds to it.
        """
        joined = joined or Joined()
        mine = joined.root(comp)
        values = np.sort(tokens.view(U))
        earlier = np.zeros(0, U)
        if first is not None:
            earlier = np.sort(tokens.view(U)[: int(np.flatnonzero(tokens.view(U) == U(first))[0])])
        need = lambda m: -(-num * (n + m) // (num + den))
        least = need(max(min(self.n), -(-n * num // den)))
        found, path, dead = [], [(0, 0)], 0
        for i, leaf in enumerate(self.tokens):
            depth = self.shared[i]
            if dead and depth >= dead:
                continue
            dead = 0
            while path[-1][0] > depth:
                path.pop()
            at, overlap = path[-1]
            if joined.root(self.comp[i]) == mine or self.n[i] * den < n * num or n * den < self.n[i] * num or overlap + min(len(leaf) - at, len(values) - overlap) < need(self.n[i]):
                continue
            branch = self.shared[i + 1]
            for end in (branch, len(leaf)):
                if end <= at:
                    continue
                if len(earlier):
                    there = np.flatnonzero(earlier[np.minimum(np.searchsorted(earlier, leaf[at:end]), len(earlier) - 1)] == leaf[at:end])
                    if len(there):  # met at that shingle
                        dead = at + int(there[0]) + 1
                        break
                where = np.searchsorted(values, leaf[at:end])
                where[where == len(values)] = 0
                overlap += int(np.count_nonzero(values[where] == leaf[at:end]))
                at = end
                if at == branch:
                    path.append((at, overlap))
                    # what the probe has left at or behind this node in the global order
                    if overlap + len(freq) - int(np.searchsorted(freq, self.freq[i][at - 1])) < least:
                        dead = at
                        break
            if not dead and overlap >= need(self.n[i]):
                found.append(self.ids[i])
                if joined.held is not None:
                    joined.link(self.comp[i], mine)
        return found


def _probed(num: int, den: int, by_shingle: bool = False):
    """Rows (group, chunk, slot, role, sig, comp, n, freq, tokens) in this order: role 1 probes the trie of role 0.

    The links of one trie are a forest over its components: a link between parts that are joined already is not emitted.
    With ``by_shingle`` the group is a shingle at which its pairs are to be met.
    """

    def found(trie, probes, joined, first):
        if len(probes) < 4 or trie.size > WALK_TOKENS:
            yield from ((sig, x) for sig, *one, comp in probes for x in trie.probe(*one, comp, num, den, joined, first))
        elif probes:
            yield from trie.walk(probes, num, den, joined, first)

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def rows():
            at, trie, members, joined, probes, first = None, None, [], None, [], None
            for batch in batches:
                group, chunk, slot, role, sig, comp, n = (batch.column(i).to_pylist() for i in range(7))
                freqs, tokens = batch.column(7), batch.column(8)
                for i in range(batch.num_rows):
                    if (group[i], chunk[i], slot[i]) != at:
                        yield from found(trie, probes, joined, first)
                        at, trie, members, joined, probes = (group[i], chunk[i], slot[i]), None, [], Joined(True), []
                        first = group[i] % (1 << 64) if by_shingle else None
                    one = (sig[i], n[i], freqs[i].values.to_numpy(), tokens[i].values.to_numpy(), comp[i])
                    if role[i] == 0:
                        members.append(one)
                    elif members:
                        trie = trie or Trie(members)
                        probes.append(one)
                        if len(probes) >= WALKERS or len(probes) * trie.size >= WALK_BYTES:
                            yield from found(trie, probes, joined, first)
                            probes = []
            yield from found(trie, probes, joined, first)

        return _batches(rows(), schema)

    return run


def _links(members: DataFrame, probes: DataFrame, sets: DataFrame, num: int, den: int, by_shingle: bool = False) -> DataFrame:
    """Links between probes and members (group, chunk, slot, sig, comp) of the same group, chunk and slot."""
    rows = members.withColumn("role", F.lit(0)).unionByName(probes.withColumn("role", F.lit(1))).join(sets, "sig")
    rows = rows.select("group", "chunk", "slot", "role", "sig", "comp", "n", "freq", "tokens")
    return rows.repartition(partitions(sets.sparkSession), "group", "chunk", "slot").sortWithinPartitions("group", "chunk", "slot", "role", "n").mapInArrow(_probed(num, den, by_shingle), "a long, b long")


def _leaders(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links among the candidate ``pairs`` (a, ca, b, cb): a probes tries of its b, about TRIE_SETS in each."""
    pairs = materialise(pairs)
    spread = materialise(pairs.groupBy("a").agg(F.count("*").alias("_deg")))
    chunk = F.expr(f"pmod(xxhash64(b), cast(ceil(_deg / {TRIE_SETS}) as int))").cast("int").alias("chunk")
    dealt = salted_join(pairs, spread, ["a"], "b").select("a", "ca", "b", "cb", chunk, F.lit(0).alias("slot"))
    members = dealt.select(F.col("a").alias("group"), "chunk", "slot", F.col("b").alias("sig"), F.col("cb").alias("comp"))
    probes = dealt.select(F.col("a").alias("group"), "chunk", "slot", F.col("a").alias("sig"), F.col("ca").alias("comp")).distinct()
    return _links(members, probes, sets, num, den)


def _whole(held: DataFrame, by: list[str]) -> DataFrame:
    """For each group ``by`` of (sig, comp): its number of sets m, that of its largest component and its name main."""
    sizes = held.groupBy(*by, "comp").agg(F.count("*").alias("k"))
    whole = sizes.groupBy(*by).agg(F.sum("k").alias("m"), F.max(F.struct("k", "comp")).alias("top")).filter("m > top.k")
    return whole.select(*by, "m", F.col("top.k").alias("k"), F.col("top.comp").alias("main"))


def _clusters(held: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """All links between different components of a cluster, for the sets (cluster, sig, comp) of clusters.

    The sets of a cluster lie in chunks of about TRIE_SETS, each a trie. Sets outside the largest component probe all
    chunks of their cluster; probes come in slots of about SLOT_SETS, which bound a task and pass through it.
    """
    whole = _whole(held, ["cluster"]).select("cluster", F.expr(f"cast(ceil(m / {TRIE_SETS}) as int)").alias("chunks"), F.expr(f"cast(ceil((m - k) / {SLOT_SETS}) as int)").alias("slots"), "main")
    held = salted_join(held, materialise(whole), ["cluster"], "sig").select(F.col("cluster").alias("group"), "sig", "comp", "main", "chunks", "slots")
    own = F.pmod(F.xxhash64("sig"), F.col("chunks")).cast("int")
    members = held.select("group", own.alias("chunk"), F.explode(F.expr("sequence(0, slots - 1)")).alias("slot"), "sig", "comp")
    place = F.pmod(F.xxhash64("sig", F.lit(1)), F.col("slots")).cast("int")
    probes = held.filter("comp <> main").select("group", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), place.alias("slot"), "sig", "comp")
    return _links(members, probes, sets, num, den)


def _postings(held: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """All links between different components of the holders (token, sig, comp, n) of a shingle, met at their first one.

    Holders lie in bands of size, which differ by the factor that a link allows at most, and in chunks of about TRIE_SETS;
    those outside the shingle's largest component probe their own band and the ones beside it.
    """
    banded = held.withColumn("band", F.expr(f"cast(floor(ln(n) / (1.000001D * ln({den} / {num}))) as int)"))
    banded = materialise(salted_join(banded, materialise(_whole(held, ["token"]).select("token", "main")), ["token"], "sig"))
    # how many tries a band has, and how many slots the probes of a band come in
    counts = banded.groupBy("token", "band").agg(F.count("*").alias("m"), F.count(F.when(F.col("comp") != F.col("main"), 1)).alias("p"))
    near = counts.select("token", "p", F.explode(F.expr("sequence(band - 1, band + 1)")).alias("band")).groupBy("token", "band").agg(F.sum("p").alias("p"))
    plan = counts.drop("p").join(near, ["token", "band"]).filter("p > 0").select("token", "band", F.expr(f"cast(ceil(m / {TRIE_SETS}) as int)").alias("chunks"), F.expr(f"cast(ceil(p / {SLOT_SETS}) as int)").alias("slots"))
    plan = materialise(plan)
    own = F.pmod(F.xxhash64("sig"), F.col("chunks")).cast("int")
    inner = F.expr("band * 1000000 + chunk")
    members = salted_join(banded, plan, ["token", "band"], "sig").withColumn("chunk", own).select(F.col("token").alias("group"), inner.alias("chunk"), F.explode(F.expr("sequence(0, slots - 1)")).alias("slot"), "sig", "comp")
    wide = banded.filter("comp <> main").withColumn("band", F.explode(F.expr("sequence(band - 1, band + 1)")))
    place = F.pmod(F.xxhash64("sig", F.lit(1)), F.col("slots")).cast("int")
    probes = salted_join(wide, plan, ["token", "band"], "sig").select("*", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk")).select(F.col("token").alias("group"), inner.alias("chunk"), place.alias("slot"), "sig", "comp")
    return _links(members, probes, sets, num, den, by_shingle=True)


def _listed(held: DataFrame) -> DataFrame:
    """The clusters of (cluster, token, sig, comp) whose sets meet fewer sets in the lists of the shingles than in the cluster."""
    pairs = F.expr("cast(m as double) * (m - k)")
    lists = _whole(held.select("cluster", "token", "sig", "comp"), ["cluster", "token"]).groupBy("cluster").agg(F.sum(pairs).alias("met"))
    whole = _whole(held.select("cluster", "sig", "comp").distinct(), ["cluster"]).select("cluster", pairs.alias("all"))
    return whole.join(lists, "cluster").filter("met < all").select("cluster", F.lit(True).alias("listed"))


def _open_links(still: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """All links between the components that share a prefix shingle: ``still`` has (token, sig, n, comp, lo), where lo is
    the least component at the shingle."""
    # such components are in one cluster: along one edge of each first, then what that left apart; a component that is the
    # least of all its shingles has an edge to itself, so that the second step meets it
    first = components(still.groupBy(F.col("comp").alias("a")).agg(F.min("lo").alias("b"))).select(F.col("node").alias("comp"), F.col("component").alias("near"))
    apart = still.select("comp", "lo").distinct().join(first, "comp").join(first.select(F.col("comp").alias("lo"), F.col("near").alias("other")), "lo").filter("near <> other").select("near", "other").distinct()
    joined = components(apart, "near", "other").select(F.col("node").alias("near"), F.col("component").alias("cluster"))
    clusters = materialise(first.join(joined, "near", "left").select("comp", F.coalesce("cluster", "near").alias("cluster")))
    open_ = materialise(salted_join(still.select("sig", "comp").distinct(), clusters, ["comp"], "sig").select("cluster", "sig", "comp"))
    large = materialise(open_.groupBy("cluster").count().filter(F.col("count") > CLUSTER).select("cluster", F.lit(True).alias("large")))
    if large.isEmpty():
        return _clusters(open_, sets, num, den)
    held = materialise(still.select("token", "sig", "n", "comp").join(salted_join(open_, large, ["cluster"], "sig").select("sig", "cluster"), "sig"))
    sized = materialise(salted_join(open_, materialise(_listed(held)), ["cluster"], "sig", "left"))
    near, far = sized.filter("listed is null").drop("listed"), sized.filter("listed").select("sig")
    links = _clusters(near, sets, num, den)
    return links if far.isEmpty() else links.unionByName(_postings(held.drop("cluster").join(far, "sig", "left_semi"), sets, num, den))


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, num: int = 3, den: int = 4, rounds: int = 2) -> DataFrame:
    """(key, n_shingles, component_id) for each row of ``docs``.

    component_id is the smallest key reachable over links, i.e. pairs with Jaccard similarity of at least num / den.
    Null, empty or blank texts have n_shingles 0 and link with nothing; texts under ``size`` words are one shingle.
    Rows with a null key take part (their component is named by other keys, or null). Repeated rows come out repeatedly.
    Other columns of ``docs`` are not read, so their names cannot clash. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    size_of_all = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), -(-int(size_of_all) // BUCKET_BYTES))
    packed = texts.mapInArrow(_shingled("doc_id", "text", size, buckets), _PACKED)
    by_bucket = lambda df: df.repartitionById(buckets, "bucket")
    counted = by_bucket(packed).mapInArrow(_counted(buckets), _PACKED)
    found = materialise(by_bucket(counted).mapInArrow(_ordered(num, den), _SETS))
    rows = found.filter("kind = 1").select("sig", "n", "docs")
    sets = found.filter("kind = 0").select("sig", "n", "freq", "tokens")
    # the part of the prefix that the unique shingles leave
    reach = F.expr(f"cast(n - ceil(n * {num} / {den}) + 1 - (n - size(tokens)) as int)")
    prefix = materialise(sets.select("sig", "n", F.explode(F.slice("tokens", F.lit(1), reach)).alias("token")))
    labels = None
    for turn in range(rounds):
        held = prefix.join(labels, "sig") if turn else prefix.withColumn("comp", F.col("sig"))
        rank = F.struct(F.xxhash64("sig", F.lit(turn)), F.col("sig"), F.col("n"), F.col("comp"))
        leader = held.groupBy("token").agg(F.min(rank).alias("lead"), (F.min("comp") < F.max("comp")).alias("open")).filter("open").select("token", F.col("lead.sig").alias("a"), F.col("lead.n").alias("na"), F.col("lead.comp").alias("ca"))
        near = salted_join(held, materialise(leader), ["token"], "sig", salts=4).filter(f"ca <> comp and {den} * least(n, na) >= {num} * greatest(n, na)")
        # a set goes to the leader with which it shares most
        shared = near.groupBy("sig", "a").agg(F.count("*").alias("k"), F.first("comp").alias("cb"), F.first("ca").alias("ca"))
        pairs = shared.groupBy("sig").agg(F.max(F.struct("k", "a", "ca", "cb")).alias("p")).select("p.a", "p.ca", F.col("sig").alias("b"), "p.cb")
        labels = _labels(sets, labels, _leaders(pairs, sets, num, den))
    held = prefix.join(labels, "sig")
    mixed = held.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token", "lo")
    still = materialise(salted_join(held, materialise(mixed), ["token"], "sig", salts=4).select("token", "sig", "n", "comp", "lo"))
    if not still.isEmpty():
        labels = _labels(sets, labels, _open_links(still, sets, num, den))
    smallest = rows.filter("n > 0").groupBy("sig").agg(F.min(F.array_min("docs")).alias("doc"))
    named = smallest.join(labels, "sig", "left").select("sig", "doc", F.coalesce("comp", "sig").alias("comp"))
    named = materialise(named)
    name = named.groupBy("comp").agg(F.min("doc").alias("component_id"))
    by_set = salted_join(named, materialise(name), ["comp"], "sig").select("sig", "component_id")
    # rows hold the documents of a set in one group of texts, so a set with many copies is no hot key
    out = rows.join(by_set, "sig", "left").select("n", "component_id", F.explode("docs").alias("doc"))
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"))


def _labels(sets: DataFrame, labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(sig, comp) of all sets when ``links`` (a, b) are added to the components of ``labels``; without, to single sets."""
    labels = sets.select("sig", F.col("sig").alias("comp")) if labels is None else labels
    of = lambda end: labels.select(F.col("sig").alias(end), F.col("comp").alias(f"c_{end}"))
    between = materialise(links.join(of("a"), "a").join(of("b"), "b").filter("c_a <> c_b").select("c_a", "c_b").distinct())
    joined = components(between, "c_a", "c_b").withColumnRenamed("node", "comp")
    return materialise(salted_join(labels, joined, ["comp"], "sig", "left").select("sig", F.coalesce("component", "comp").alias("comp")))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.a = d.doc_id GROUP BY d.doc_id"""
