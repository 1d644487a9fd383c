"""Quality classifier: interpolated modified Kneser-Ney n-gram model of trusted text, a model for each language.

The units are the bytes of UTF-8, so an n-gram of up to six bytes and a place in a group of documents are one exact
integer: the context of an n-gram is the integer without the last byte, the shorter n-gram it backs off to is the integer
without the first. Order 5 sees most of a word and its left neighbour's end; each byte more multiplies the n-grams by
about three and changes the ranking of documents little.

1. Counts, continuation counts, context totals, discounts and interpolated probabilities are groupings and joins of
   sharded tables keyed by (language, n-gram).
2. The different n-grams of all documents, with their counts, meet these tables. What an n-gram needs of any order from
   three on holds its third and second last byte, so one shuffle by these two bytes serves all orders; the two lowest
   orders have at most 2 ** 16 + 2 ** 8 entries of each kind for a language and are broadcast.
3. The documents meet the log probabilities of their n-grams: groups of documents send each n-gram once, with the
   documents that hold it, to the n-gram's shard; sums of each shard come back to the group. The most frequent n-grams of
   all documents, at most HOT of them, are the hot keys of that join: they are broadcast and added up where the documents
   are, so no shard is hot and most of the pairs never move.

A document is kept if its perplexity is at most the QUANTILE of those of the trusted documents of its language that were
held out of the counts, one in HELD_OUT by the hash of the key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import GROUP_BYTES, U, materialise, mix, partitions, ranges, small_batches

ORDER = 5
#: The most trusted keys that are broadcast (8 bytes each); more are joined by a shuffle.
TRUSTED_KEYS = 2_000_000
#: The most n-grams whose log probabilities are broadcast (16 bytes each).
HOT = 1 << 18
QUANTILE = 0.99
#: One trusted document of so many sets the threshold and trains nothing.
HELD_OUT = 5
#: Bytes of text whose n-grams travel together, and the most documents of such a group.
EVENT_BYTES, EVENT_DOCS = 6 << 20, 1 << 16
#: The byte before a text and the one behind it.
START, END = 2, 3
#: Bytes that a unit may be.
VOCABULARY = 256


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of all texts in order, the place of the first of each text); one for each byte and one for the end."""
    data = np.frombuffer(b"".join(bytes([START]) * (order - 1) + t + bytes([END]) for t in texts), np.uint8).astype(np.int64)
    packed = np.zeros(len(data) - order + 1, np.int64)
    for j in range(order):
        packed = packed << 8 | data[j : j + len(packed)]
    lengths = np.array([len(t) + 1 for t in texts])
    first = np.cumsum(lengths) - lengths
    at = np.arange(lengths.sum()) + np.repeat(np.arange(len(texts)) * (order - 1), lengths)
    return packed[at], first


def _by_language(batches, most: int = GROUP_BYTES):
    """(language, keys, texts) of about ``most`` bytes of rows (key, language, text)."""
    held, size = {}, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for key, lang, text in zip(*(part.column(i).to_pylist() for i in range(2)), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                held.setdefault(lang, ([], []))[0].append(key)
                held[lang][1].append(text or b"")
                size += len(text or b"")
            if size > most:
                yield from ((lang, *x) for lang, x in held.items())
                held, size = {}, 0
    yield from ((lang, *x) for lang, x in held.items())


def _counted(order: int, most: int = 1 << 20):
    """Rows (lang, gram, c): each task adds up what it reads and sends it on when it has ``most`` n-grams."""

    def run(batches):
        held: dict[str, list] = {}
        schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("c", pa.int64())])

        def added(lang):
            g, c = (np.concatenate(x) for x in zip(*held[lang], strict=True))
            g, inverse = np.unique(g, return_inverse=True)
            held[lang] = [(g, np.bincount(inverse, weights=c).astype(np.int64))]
            return held[lang][0]

        def sent(lang):
            g, c = added(lang)
            for at in range(0, len(g), 50_000):
                n = len(g[at : at + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(g[at : at + n]), pa.array(c[at : at + n])], schema=schema)

        for lang, _, texts in _by_language(batches):
            held.setdefault(lang, []).append(np.unique(grams(texts, order)[0], return_counts=True))
            if sum(len(g) for g, _ in held[lang]) > most and len(added(lang)[0]) > most // 2:
                yield from sent(lang)
                held.pop(lang)
        for lang in held:
            yield from sent(lang)

    return run


def train(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, n, kind, gram, value): probabilities (kind 0) and back-off weights of contexts (kind 1), for n = 1 .. order.

    ``texts`` has (key, lang, text). The highest order has plain counts, the lower ones the number of different bytes
    before the n-gram. Discounts are those of counts 1, 2 and from 3, from the counts of counts of each language.
    """
    counted = texts.mapInArrow(_counted(order), "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    levels = {order: counted}
    levels[order] = materialise(levels[order])
    for n in range(order - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * n) - 1).cast("long"))
        levels[n] = levels[n + 1].groupBy("lang", shorter.alias("gram")).agg(F.count("*").alias("c"))
    model, lower = None, None
    for n in range(1, order + 1):
        level = levels[n].withColumn("context", F.shiftright("gram", 8))
        number = [F.sum(F.when(F.col("c") == i, 1).otherwise(0)).alias(f"n{i}") for i in (1, 2, 3, 4)]
        # a row for each language; with no n-grams of a count the discount is that of plain absolute discounting
        y = "if(n1 + 2 * n2 > 0, n1 / (n1 + 2 * n2), 0.5D)"
        discounts = level.groupBy("lang").agg(*number).selectExpr("lang", *(f"greatest(0.05D, least({i}D - 0.05D, if(n{i} > 0, {i} - {i + 1} * {y} * n{i + 1} / n{i}, 0.5D * {i}))) AS d{i}" for i in (1, 2, 3)))
        level = level.join(F.broadcast(discounts), "lang").withColumn("d", F.expr("case when c = 1 then d1 when c = 2 then d2 else d3 end"))
        contexts = level.groupBy("lang", "context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma"))
        level = level.join(contexts, ["lang", "context"])
        own = (F.col("c") - F.col("d")) / F.col("total")
        if n == 1:
            p = own + F.col("gamma") / VOCABULARY
            now = level.select("lang", "gram", p.alias("p"))
        else:
            less = lower.select("lang", F.col("gram").alias("short"), F.col("p").alias("q"))
            short = F.col("gram").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1).cast("long"))
            now = level.withColumn("short", short).join(less, ["lang", "short"]).select("lang", "gram", (own + F.col("gamma") * F.col("q")).alias("p"))
        now = materialise(now)
        both = now.select("lang", F.lit(n).alias("n"), F.lit(0).alias("kind"), "gram", F.col("p").alias("value")).unionByName(contexts.select("lang", F.lit(n).alias("n"), F.lit(1).alias("kind"), F.col("context").alias("gram"), F.col("gamma").alias("value")))
        model, lower = both if model is None else model.unionByName(both), now
    return materialise(model)


class Tables:
    """A part of the model of one language as sorted arrays."""

    def __init__(self, order: int):
        self.order = order
        self.parts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def put(self, n: np.ndarray, kind: np.ndarray, gram: np.ndarray, value: np.ndarray) -> None:
        for level, k in set(zip(n.tolist(), kind.tolist(), strict=True)):
            mine = np.flatnonzero((n == level) & (kind == k))
            mine = mine[np.argsort(gram[mine])]
            self.parts[level, k] = gram[mine], value[mine]

    def found(self, n: int, kind: int, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if (n, kind) not in self.parts:
            return np.zeros(len(gram), bool), np.zeros(len(gram))
        return looked_up(*self.parts[n, kind], gram)

    def log_p(self, gram: np.ndarray) -> np.ndarray:
        """The log of the interpolated probability of the last byte after the others."""
        p = np.zeros(len(gram))
        weight, open_ = np.ones(len(gram)), np.arange(len(gram))
        for n in range(self.order, 0, -1):
            short = gram[open_] & ((1 << 8 * n) - 1)
            seen, value = self.found(n, 0, short)
            p[open_[seen]] = weight[open_[seen]] * value[seen]
            open_, short = open_[~seen], short[~seen]
            known, gamma = self.found(n, 1, short >> 8)
            weight[open_[known]] *= gamma[known]
        p[open_] = weight[open_] / VOCABULARY
        return np.log(p)


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each is among the sorted keys, its value)."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, values[at]


def _shard(lang: str, gram: np.ndarray, shards: int) -> np.ndarray:
    seed = U(int.from_bytes(lang.encode()[:8].ljust(8)))
    return (mix(gram.view(U) ^ mix(np.array([seed]))) % U(shards)).astype(np.int32)


_SCORED = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("c", pa.int64()), ("log_p", pa.float64()), ("shard", pa.int32())])


def scored_grams(texts: DataFrame, model: DataFrame, shards: int, order: int = ORDER) -> DataFrame:
    """(lang, gram, c, log_p, shard) of the different n-grams of all ``texts`` whose language has a model."""
    low = [(x.lang, x.n, x.kind, x.gram, x.value) for x in model.filter("n <= 2").collect()]  # bounded for a language
    languages: dict[str, list] = {}
    for lang, *entry in low:
        languages.setdefault(lang, []).append(entry)
    small = {lang: tuple(np.array(x) for x in zip(*rows, strict=True)) for lang, rows in languages.items()}
    small = texts.sparkSession.sparkContext.broadcast(small)

    def run(batches):
        at, tables, held = None, None, []
        known = small.value

        def resolved():
            gram, c = (np.concatenate(x) for x in zip(*held, strict=True))
            gram, inverse = np.unique(gram, return_inverse=True)
            c = np.bincount(inverse, weights=c).astype(np.int64)
            log_p, shard = tables.log_p(gram), _shard(at[0], gram, shards)
            for x in range(0, len(gram), 50_000):
                part = slice(x, x + 50_000)
                n = len(gram[part])
                yield pa.RecordBatch.from_arrays([pa.array([at[0]] * n, pa.string()), *(pa.array(y[part]) for y in (gram, c, log_p, shard))], schema=_SCORED)

        for batch in batches:
            lang = batch.column(0).dictionary_encode()
            code, names = lang.indices.to_numpy(zero_copy_only=False), lang.dictionary.to_pylist()
            pair, role, n, kind, gram, value = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 7))
            cuts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (pair[1:] != pair[:-1]) | (role[1:] != role[:-1]), True])
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if (names[code[x]], int(pair[x])) != at:
                    if held:
                        yield from resolved()
                    at, held, model_rows = (names[code[x]], int(pair[x])), [], []
                    tables = None
                if role[x] == 0:
                    model_rows.append((n[x:y], kind[x:y], gram[x:y], value[x:y]))
                elif at[0] in known:
                    if tables is None:
                        tables = Tables(order)
                        tables.put(*known[at[0]])
                        if model_rows:
                            tables.put(*(np.concatenate(z) for z in zip(*model_rows, strict=True)))
                    held.append((gram[x:y].copy(), value[x:y].copy()))
        if held:
            yield from resolved()

    middle = lambda gram: F.shiftright(gram, 8).bitwiseAND(F.lit(65535).cast("long")).cast("int")
    rows = model.filter("n > 2").select("lang", F.when(F.col("kind") == 0, middle("gram")).otherwise(F.col("gram").bitwiseAND(F.lit(65535).cast("long")).cast("int")).alias("pair"), F.lit(0).alias("role"), "n", "kind", "gram", "value")
    counted = texts.mapInArrow(_counted(order), "lang string, gram long, c long")
    wanted = counted.select("lang", middle("gram").alias("pair"), F.lit(1).alias("role"), F.lit(0).alias("n"), F.lit(0).alias("kind"), "gram", F.col("c").cast("double").alias("value"))
    dealt = rows.unionByName(wanted).repartition(shards, "lang", "pair").sortWithinPartitions("lang", "pair", "role")
    return materialise(dealt.mapInArrow(run, "lang string, gram long, c long, log_p double, shard int"))


def hot_grams(scored: DataFrame, most: int = HOT) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], float]:
    """The most frequent n-grams of each language with their log probabilities, at most ``most`` in all, and the least
    level (of a logarithmic scale of counts) that they have."""
    level = F.floor(4 * F.log2("c")).cast("int")
    cut, total = float("inf"), 0
    for x in sorted(scored.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):  # some 200 rows
        total += x.n
        if total > most:
            break
        cut = x.level
    rows = scored.filter(level >= cut).select("lang", "gram", "log_p").toArrow() if cut < float("inf") else None
    hot: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for lang in set(rows.column("lang").to_pylist()) if rows else ():
        mine = rows.filter(pa.compute.equal(rows.column("lang"), lang))
        gram, value = mine.column("gram").to_numpy(), mine.column("log_p").to_numpy()
        hot[lang] = gram[np.argsort(gram)], value[np.argsort(gram)]
    return hot, cut


_EVENTS = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("gram", pa.int64()), ("log_p", pa.float64()), ("grp", pa.int64()), ("lang", pa.string()), *((x, pa.binary()) for x in ("grams", "holders", "docs", "counts"))])
_DDL = "shard int, kind int, gram long, log_p double, grp long, lang string, grams binary, holders binary, docs binary, counts binary"


def _row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, _EVENTS.types, strict=True)], schema=_EVENTS)


def _events(hot, languages: set[str], shards: int, order: int):
    """For each group of documents one row of kind 2 (keys, units and the sums of hot n-grams) and, for each shard, one of
    kind 1: its n-grams, the number of documents that hold each, these documents and their counts."""

    def run(batches):
        task, number, tables = TaskContext.get().partitionId(), 0, hot.value
        for lang, all_keys, all_texts in _by_language(batches, EVENT_BYTES):
            for at in range(0, len(all_keys), EVENT_DOCS):
                keys, texts = all_keys[at : at + EVENT_DOCS], all_texts[at : at + EVENT_DOCS]
                group, number = (task << 32) + number, number + 1
                units = np.array([len(t) + 1 for t in texts], np.int64)
                sums, has = np.zeros(len(texts)), lang in languages
                known = np.array([k is not None for k in keys])
                ids = np.array([0 if k is None else k for k in keys], np.int64)
                if has:
                    packed = grams(texts, order)[0].view(U) << U(16)
                    packed |= np.repeat(np.arange(len(texts), dtype=U), units)
                    pairs, counts = np.unique(packed, return_counts=True)
                    del packed
                    gram, doc = (pairs >> U(16)).view(np.int64), (pairs & U(65535)).astype(np.uint16)
                    del pairs
                    first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
                    holders, gram = np.diff(np.r_[first, len(gram)]), gram[first]
                    near, value = looked_up(*tables.get(lang, (np.zeros(0, np.int64), np.zeros(0))), gram)
                    mine = np.repeat(near, holders)
                    sums = np.bincount(doc[mine], weights=counts[mine] * np.repeat(value[near], holders[near]), minlength=len(texts))
                    far = np.flatnonzero(~near)
                    shard = _shard(lang, gram[far], shards)
                    far = far[np.argsort(shard, kind="stable")]
                    bounds = np.cumsum(np.r_[0, np.bincount(shard, minlength=shards)])
                    for s in np.flatnonzero(np.diff(bounds)).tolist():
                        one = far[bounds[s] : bounds[s + 1]]
                        where, _ = ranges(first[one], holders[one])
                        few = counts[where]
                        few = few.astype(np.uint8 if few.max() < 256 else np.int64)
                        yield _row(s, 1, None, None, group, lang, np.diff(gram[one], prepend=0).tobytes(), holders[one].astype(np.uint32).tobytes(), doc[where].tobytes(), few.tobytes())
                yield _row(group % shards, 2, None, 1.0 if has else None, group, lang, ids.tobytes(), units.tobytes(), known.tobytes(), sums.tobytes())

    return run


def _summed(batches):
    """Rows of one shard, the n-grams' log probabilities (kind 0) first: the sums of the documents of each group."""
    at, parts, table = None, {}, {}
    for batch in batches:
        shard, kind = (batch.column(i).to_numpy() for i in (0, 1))
        cuts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1]), True])
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if shard[x] != at:
                at, parts, table = shard[x], {}, {}
            piece = batch.slice(x, y - x)
            if kind[x] == 0:
                lang = piece.column(5).dictionary_encode()
                code, gram, value = lang.indices.to_numpy(), piece.column(2).to_numpy(), piece.column(3).to_numpy()
                for i, name in enumerate(lang.dictionary.to_pylist()):
                    parts.setdefault(name, []).append((gram[code == i], value[code == i]))
            elif kind[x] == 2:
                yield piece
            else:
                for row in piece.to_pylist():
                    if row["lang"] not in table:
                        gram, value = (np.concatenate(z) for z in zip(*parts[row["lang"]], strict=True))
                        order = np.argsort(gram)
                        table[row["lang"]] = gram[order], value[order]
                    gram = np.cumsum(np.frombuffer(row["grams"], np.int64))
                    holders, docs = np.frombuffer(row["holders"], np.uint32), np.frombuffer(row["docs"], np.uint16)
                    counts = np.frombuffer(row["counts"], np.uint8 if len(row["counts"]) == len(docs) else np.int64)
                    seen, value = looked_up(*table[row["lang"]], gram)
                    if not seen.all():
                        raise ValueError("an n-gram of a document is in no count table")
                    doc, where = np.unique(docs, return_inverse=True)
                    sums = np.bincount(where, weights=counts * np.repeat(value, holders))
                    yield _row(row["shard"], 1, None, None, row["grp"], None, None, None, doc.tobytes(), sums.tobytes())


def _finished(batches):
    """Rows of one group, the sums of its shards (kind 1) first: (key, lang, units, log_p) of its documents."""
    at, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["grp"] != at:
                at, held = row["grp"], []
            if row["kind"] == 1:
                held.append((np.frombuffer(row["docs"], np.uint16), np.frombuffer(row["counts"])))
                continue
            ids, units, known, total = (np.frombuffer(row[x], t) for x, t in (("grams", np.int64), ("holders", np.int64), ("docs", bool), ("counts", np.float64)))
            total = total.copy()
            for doc, sums in held:
                total[doc] += sums
            log_p = pa.array(total) if row["log_p"] else pa.nulls(len(ids), pa.float64())  # marks a language with a model
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array([row["lang"]] * len(ids), pa.string()), pa.array(units), log_p], names=["key", "lang", "units", "log_p"])


def log_likelihoods(texts: DataFrame, model: DataFrame, order: int = ORDER, hot: int = HOT) -> DataFrame:
    """(key, lang, units, log_p) for each row of ``texts`` (key, lang, text); log_p is null without a model of the language."""
    if order > 6:
        raise ValueError("the order is at most 6")
    spark = texts.sparkSession
    shards = partitions(spark)
    scored = scored_grams(texts, model, shards, order)
    languages = {x.lang for x in model.select("lang").distinct().collect()}
    tables, cut = hot_grams(scored, hot)
    level = F.floor(4 * F.log2("c"))
    cold = scored.filter(level < cut) if cut < float("inf") else scored
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("grams", "binary"), ("holders", "binary"), ("docs", "binary"), ("counts", "binary"))]
    cold = cold.select("shard", F.lit(0).alias("kind"), "gram", "log_p", F.lit(None).cast("long").alias("grp"), "lang", *nothing)
    events = texts.mapInArrow(_events(spark.sparkContext.broadcast(tables), languages, shards, order), _DDL)
    sums = events.unionByName(cold).repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_summed, _DDL)
    by_group = sums.repartition(shards, "grp").sortWithinPartitions("grp", "kind", "shard")
    return by_group.mapInArrow(_finished, "key long, lang string, units long, log_p double")


def perplexity_filter(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER, quantile: float = QUANTILE, hot: int = HOT) -> DataFrame:
    """(key, lang, perplexity, threshold, kept) for each row of ``docs``; ``trusted`` has the keys of trusted rows.

    The perplexity is per byte, the end of the text counted as one. A null language is the language "und". Languages
    without trusted text have no perplexity and no threshold, and those without a held-out trusted text have no
    threshold; their documents are kept. A null or empty text is its end alone. Repeated rows come out repeatedly, rows
    with a null key are never trusted; other columns are not read. Long texts are read whole.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keys = trusted.select(F.col(key).cast("long").alias("key")).filter("key is not null").distinct()
    few = keys.count() <= TRUSTED_KEYS
    held_out = F.pmod(F.xxhash64("key"), F.lit(HELD_OUT)) == 0
    only = lambda df, k: df.join(F.broadcast(k) if few else k.hint("merge"), "key", "left_semi")
    model = train(only(texts, keys.filter(~held_out)), order)
    scored = materialise(log_likelihoods(texts, model, order, hot).withColumn("perplexity", F.exp(-F.col("log_p") / F.col("units"))))
    limits = only(scored, keys.filter(held_out)).groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("threshold"))
    return scored.join(F.broadcast(limits), "lang", "left").select(F.col("key").alias(key), F.col("lang").alias(lang), "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))
