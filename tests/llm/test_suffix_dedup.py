import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from graphloom.llm.suffix_array import by_symbol, suffix_array
from graphloom.llm.suffix_dedup import repeats, suffix_dedup


def brute(rows, length=200):
    count, texts = Counter(), [(d, (t or "").encode()) for d, t in rows]
    for _, b in texts:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for doc, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc, bytes(x for x, g in zip(b, gone, strict=True) if not g), len(b), sum(gone), runs))
    return sorted(out, key=str)


@given(st.lists(st.integers(1, 4), max_size=60))
@settings(max_examples=200, deadline=None)
def test_suffix_array(x):
    assert suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


@pytest.mark.parametrize("chunk", [2, 1024])
def test_against_counted_strings(spark, documents, chunk):
    rng = random.Random(chunk)
    word = lambda: "".join(rng.choice("abcdeéß ") for _ in range(rng.randrange(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, near = text(60), text(120)
    rows = [(i, text(30) + (passage if i % 3 else "") + text(20)) for i in range(24)]
    for i in range(24, 40):
        at = rng.randrange(len(near))
        rows.append((i, near[:at] + word() + near[at:]))
    double = text(70)
    rows += [(50, double + " x " + double), (51, "a" * 700), (52, "ab" * 450), (53, None), (54, ""), (55, "a" * 199), (56, passage), (57, passage), (58, text(3000)), (59, "b" + "a" * 250)]
    rows += [(60, passage[:150])]
    got = sorted(map(tuple, suffix_dedup(documents(rows), chunk=chunk).collect()), key=str)
    assert [(d, bytes(k), *rest) for d, k, *rest in got] == brute(rows)


def test_repeated_rows_and_carried_columns(spark, documents):
    rows = [(1, "é" * 150), (1, "é" * 150), (None, "unique text " * 3), (2, "unique text " * 3)]
    got = sorted(((x.doc_id, x.kept, x.n_removed, x.lang) for x in suffix_dedup(documents(rows), carry=["lang"], decode=True).collect()), key=str)
    assert got == sorted([(1, "", 300, "en"), (1, "", 300, "en"), (None, "unique text " * 3, 0, "en"), (2, "unique text " * 3, 0, "en")], key=str)


def test_symbols_are_sorted_by_radix():
    x = np.array([5, 70000, 0, 5, 1 << 40, 70000, 65536], np.int64)
    assert by_symbol(x).tolist() == np.argsort(x, kind="stable").tolist()


@pytest.mark.parametrize("seed", range(6))
def test_repeats_by_suffix_order_and_bytes(seed):
    """Segments of one owner: the strings that they share are found at their true places, zero bytes among them."""
    rng, length, owner = random.Random(seed), 200, bytes(range(50))
    draw = lambda n: bytes(rng.choice(b"ab\0") if seed % 2 else rng.randrange(256) for _ in range(n))
    befores, afters = [draw(150) for _ in range(3)], [draw(200) for _ in range(3)]
    data, at = [], []
    for _ in range(30):
        a = rng.randrange(0, 151)
        before, after = bytearray(rng.choice(befores)[150 - a :]), bytearray(rng.choice(afters)[: rng.randrange(150 - min(a, 150), 200)])
        for part in (before, after):
            if part and rng.random() < 0.5:
                part[rng.randrange(len(part))] ^= 1
        text = bytes(before) + owner + bytes(after)
        if len(text) >= length:
            data.append(text)
            at.append(a)
    weight = np.array([1 + (rng.random() < 0.2) for _ in data])
    counts = Counter()
    for x, w in zip(data, weight.tolist(), strict=True):
        for i in range(len(x) - length + 1):
            counts[x[i : i + length]] += w
    of, i, total = repeats(np.array(at), weight, data, length)
    assert len(of) == sum(len(x) - length + 1 for x in data)
    for o, j, t in zip(of.tolist(), i.tolist(), total.tolist(), strict=True):
        string = data[o][j : j + length]
        inside = [(x.find(string), a) for x, a in zip(data, at, strict=True) if string in x]
        if all(p - a == j - at[o] for p, a in inside):  # met at the owner, as in the operator
            assert t == counts[string]


def test_very_long_texts(spark, documents):
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(700))
    fill = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    rows = [(1, fill(131_000) + passage + fill(140_000)), (2, fill(300) + passage), (3, fill(261_900) + passage + fill(100)), (4, fill(400_000))]
    got = sorted(map(tuple, suffix_dedup(documents(rows)).collect()), key=str)
    assert [(d, bytes(k), *rest) for d, k, *rest in got] == brute(rows)


def test_empty_table(spark, documents):
    assert suffix_dedup(documents([(1, "x")]).limit(0)).collect() == []
