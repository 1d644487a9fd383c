import math
import random
from collections import Counter, defaultdict

import pytest

from graphloom.llm import kneser_ney
from graphloom.llm.kneser_ney import HELD_OUT, perplexity_filter

ORDER = 5


def model(texts):
    """The probability of an n-gram's last byte, from the definitions."""
    counts = {ORDER: Counter()}
    for text in texts:
        b = b"\2" * (ORDER - 1) + text + b"\3"
        counts[ORDER].update(b[i : i + ORDER] for i in range(len(b) - ORDER + 1))
    for n in range(ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount, total = {}, {}
    for n, level in counts.items():
        of = Counter(level.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] + of[2] else 0.5
        discount[n] = [0.0] + [max(0.05, min(i - 0.05, i - (i + 1) * y * of[i + 1] / of[i] if of[i] else 0.5 * i)) for i in (1, 2, 3)]
        total[n] = defaultdict(lambda: [0, 0.0])
        for g, c in level.items():
            total[n][g[:-1]][0] += c
            total[n][g[:-1]][1] += discount[n][min(c, 3)]

    def p(g):
        n = len(g)
        if not n:
            return 1 / 256
        if g[:-1] not in total[n]:
            return p(g[1:])
        c, (whole, spare) = counts[n].get(g, 0), total[n][g[:-1]]
        return max(0, c - discount[n][min(c, 3)]) / whole + spare / whole * p(g[1:])

    return p


def perplexity(p, text):
    b = b"\2" * (ORDER - 1) + text + b"\3"
    return math.exp(-sum(math.log(p(b[i : i + ORDER])) for i in range(len(text) + 1)) / (len(text) + 1))


def rows():
    rng = random.Random(4)
    word = lambda lang: rng.choice({"en": ["the", "of", "and", "stone", "water"], "de": ["der", "und", "größe", "wasser"]}[lang])
    out = [(i, " ".join(word(lang) for _ in range(rng.randrange(5, 60))), lang) for i, lang in enumerate(["en", "de"] * 30)]
    return [*out, (100, "#### $$$ @@@ 0101 " * 5, "en"), (101, None, "en"), (102, "", None), (103, "no trusted text", "fr"), (None, "the of", "en"), (104, "the stone", "en"), (104, "the stone", "en")]


@pytest.mark.parametrize(("hot", "size"), [(1 << 18, 6 << 20), (0, 300), (100, 300)])
def test_against_definitions(spark, documents, monkeypatch, hot, size):
    from pyspark.sql import functions as F

    monkeypatch.setattr(kneser_ney, "EVENT_BYTES", size)
    data = [*rows(), (105, "the stone of water and " * 700, "en"), (106, "a" * 66_000, "de")]
    trusted = spark.createDataFrame([(i, "e") for i in range(60)] + [(None, "e"), (3, "e")], "doc_id long, text string")
    got = perplexity_filter(documents(data), trusted, hot=hot).collect()
    assert len(got) == len(data)
    held_out = {x[0] for x in spark.range(60).filter(F.pmod(F.xxhash64("id"), F.lit(HELD_OUT)) == 0).collect()}
    models = {lang: model([t.encode() for i, t, k in data if k == lang and i is not None and i < 60 and i not in held_out]) for lang in ("en", "de")}
    texts = {i: (t or "").encode() for i, t, _ in data}
    limit = {lang: max(perplexity(models[lang], texts[i]) for i in held_out if data[i][2] == lang) for lang in models}
    for x in got:
        if x.lang in models:
            assert x.perplexity == pytest.approx(perplexity(models[x.lang], texts[x.doc_id]), rel=1e-9)
            assert x.threshold == pytest.approx(limit[x.lang], rel=1e-9)
            assert x.kept == (x.perplexity <= x.threshold)
        else:
            assert x.perplexity is None and x.threshold is None and x.kept
    by = {x.doc_id: x for x in got}
    assert not by[100].kept and not by[106].kept and sum(by[i].kept for i in range(60)) > 30


def test_empty(spark, documents):
    df, none = documents(rows()), spark.createDataFrame([], "doc_id long")
    assert perplexity_filter(df.limit(0), none).collect() == []
    assert all(x.kept and x.perplexity is None for x in perplexity_filter(df, none).collect())
