import random

import numpy as np
import pytest

from graphloom.llm import decontaminate as D

PARTS = "the of and tion ing er re on th in ea é ß".split()


def phrase(rng, n):
    return "".join(rng.choice(PARTS) + rng.choice(["", " ", " ", ", "]) for _ in range(n))


def least_edits(pattern, text):
    """Least edits between the pattern and any piece of the text."""
    last, places = np.zeros(len(text) + 1, int), np.arange(len(text) + 1)
    letters = np.frombuffer(text, np.uint8)
    for i, c in enumerate(pattern):
        now = np.r_[i + 1, np.minimum(last[:-1] + (letters != c), last[1:] + 1)]
        last = np.minimum.accumulate(now - places) + places
    return last.min()


def spoiled(rng, text, edits):
    text = bytearray(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(text)), rng.random()
        if kind < 0.4:
            text[at : at + 1] = rng.choice([b"x", b"y"])
        elif kind < 0.7:
            del text[at]
        else:
            text[at:at] = b"z"
    return bytes(text)


@pytest.mark.parametrize("seed", [1, 2])
def test_index_finds_what_full_alignment_finds(seed):
    rng = random.Random(seed)
    items = [(i, phrase(rng, rng.randrange(6, 110)).encode()) for i in range(30)]
    index, positive = D.Index(items, 16), 0
    for trial in range(40):
        item = D.normalised(np.frombuffer(rng.choice(items)[1], np.uint8))[0].tobytes()
        text = spoiled(rng, item, rng.randrange(0, max(2, len(item) // 12)))
        text = phrase(rng, 25).encode() * (trial % 3 > 0) + text + phrase(rng, 25).encode() * (trial % 2)
        data = D.normalised(np.frombuffer(text, np.uint8))[0]
        want = {j for j in range(len(index.item)) if least_edits(index.bytes[j, : index.length[j]].tobytes(), data.tobytes()) <= index.edits[j]}
        assert set(index.matches(data)[0].tolist()) == want
        positive += len(want)
    assert positive > 15


def tables(spark, documents):
    rng = random.Random(9)
    items = [(i, phrase(rng, 60)) for i in range(12)] + [(50, None), (51, ""), (52, "tiny")]
    rows = [(i, phrase(rng, 80) + (" " + items[i][1] + " " if i < 12 and i % 2 else "") + phrase(rng, 40)) for i in range(40)]
    rows += [(100, items[0][1].upper().replace(" ", " \n ")), (101, None), (102, ""), (103, "tiny"), (None, items[2][1]), (104, items[4][1]), (104, items[4][1]), (105, phrase(rng, 400_000) + items[6][1] + phrase(rng, 10))]
    want = {(i, i) for i in range(1, 12, 2)} | {(100, 0), (None, 2), (104, 4), (105, 6), (103, 52)}
    return documents(rows), spark.createDataFrame([(*x, "e") for x in items], "item_id long, text string, doc_id string"), want


@pytest.mark.parametrize("index_bytes", [16 << 20, 4000])
def test_matches(spark, documents, monkeypatch, index_bytes):
    monkeypatch.setattr(D, "INDEX_BYTES", index_bytes)
    docs, items, want = tables(spark, documents)
    got = D.benchmark_matches(docs, items).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want
    assert sum(x.doc_id == 104 for x in got) == 2
    spans = {x.doc_id: (x.first_byte, x.end_byte) for x in got}
    texts = {x.doc_id: x.text.encode() for x in docs.collect() if x.doc_id in (1, 105)}
    named = {x.item_id: x.text.encode() for x in items.collect() if x.text}
    for doc, item in ((1, 1), (105, 6)):
        assert abs(spans[doc][0] - texts[doc].index(named[item])) < 12 and abs(spans[doc][1] - texts[doc].index(named[item]) - len(named[item])) < 12


def test_decontaminate_drops_rows(spark, documents):
    docs, items, want = tables(spark, documents)
    left = D.decontaminate(docs, items)
    assert left.columns[0] == "doc_id" and set(left.columns) == set(docs.columns)
    assert {x.doc_id for x in left.select("doc_id").collect()} == {x.doc_id for x in docs.collect()} - {d for d, _ in want}


@pytest.mark.parametrize("index_bytes", [16 << 20, 4000])
def test_rows_are_judged_by_their_own_text(spark, documents, monkeypatch, index_bytes):
    monkeypatch.setattr(D, "INDEX_BYTES", index_bytes)
    _, items, _ = tables(spark, documents)
    passage = next(x.text for x in items.collect() if x.item_id == 3)
    rows = [(None, passage), (None, "nothing of it"), (7, passage), (7, "clean"), (7, None), (8, "a tiny thing"), (8, " Tiny! ")]
    left = D.decontaminate(documents(rows), items)
    assert sorted(((x.doc_id, x.text) for x in left.collect()), key=str) == sorted([(None, "nothing of it"), (7, "clean"), (7, None), (8, "a tiny thing")], key=str)


def test_empty(spark, documents):
    docs, items, _ = tables(spark, documents)
    assert D.benchmark_matches(docs.limit(0), items).collect() == []
    assert D.benchmark_matches(docs, items.limit(0)).collect() == []


def folded(text):
    return D.normalised(np.frombuffer(text, np.uint8))[0]


@pytest.mark.parametrize("size", [64, 72, 100])
def test_excerpts_at_every_offset(size):
    rng = random.Random(4)
    item = folded(phrase(rng, 110).encode()).tobytes()
    index, (before, after) = D.Index([(3, item)], 16), (phrase(rng, 30).encode(), phrase(rng, 30).encode())
    for at in range(len(item) - size + 1):
        data = folded(before + b" q " + item[at : at + size] + b" q " + after)
        want = {j for j in range(len(index.item)) if least_edits(index.bytes[j, : index.length[j]].tobytes(), data.tobytes()) <= index.edits[j]} if at % 16 == 0 else None
        got = set(index.matches(data)[0].tolist())
        assert got and (want is None or got == want)


def test_copy_with_replaced_words():
    rng = random.Random(8)
    item = folded(phrase(rng, 110).encode()).tobytes()
    copy = b"".join(item[at : at + 62] + b"0123456789" for at in range(0, len(item) - 72, 72))
    assert len(D.Index([(3, item)], 16).matches(folded(b"start " + copy + b" end"))[0])
