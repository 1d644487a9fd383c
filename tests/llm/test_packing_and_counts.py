import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphloom.llm.packing import Bins, WordTokenizer, pack
from graphloom.llm.sharding import jump_hash, shard_rows, with_shard
from graphloom.llm.token_counts import scan, token_counts, token_files, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
ROWS = [(i, f"Some Text number {i} with é, ß and <|endoftext|> in it.\n" * (i % 37)) for i in range(120)]
ROWS += [(500, None), (501, ""), (502, "one two  three\t\x1c!　?\xa0x " * 30000), (None, "no key"), (3, ROWS[3][1]), (3, ROWS[3][1])]


def expected_ids(text, literal=False):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = literal
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("literal", [False, True])
def test_word_tokenizer_equals_tokenizer(literal):
    texts = [(t or "")[:100_000] for _, t in ROWS] + ["it's  we'll\r\nDON'T 123 ½ ﬁ Å  á a. b.. ?c d?", "a <|endoftext|> b <|startoftext|>c x<|endoftext|>y <|ENDOFTEXT|>", "Straße, ΑΒΓ: ǅ; ª. a\x00b"]
    assert [x.tolist() for x in WordTokenizer(PATH, literal).ids(texts)] == [expected_ids(t, literal) for t in texts]


def test_special_tokens():
    assert expected_ids("a <|endoftext|> b <|startoftext|>c") == [320, 49407, 321, 49406, 322]


def check_sequences(pieces, capacity):
    """(sequence, offset, length) of pieces: gapless and full but for small rooms, or a power of two."""
    sequences = defaultdict(list)
    for sequence, offset, length in pieces:
        sequences[sequence].append((offset, length))
    assert sorted(sequences) == list(range(len(sequences)))
    for held in sequences.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at and n > 0
            at += n
        assert at <= capacity and (at > capacity - 16 or at & (at - 1) == 0)


def test_pack(spark, documents):
    pieces = pack(documents(ROWS), PATH).collect()
    docs = defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
    for doc, text in ROWS:
        ids = np.array([*expected_ids(text), 2], "<u4")
        copies = 3 if doc == 3 else 1
        assert sum(p.length for p in docs[doc]) == copies * len(ids) and all(p.doc_tokens == len(ids) for p in docs[doc])
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in docs[doc])
        covered = np.zeros(len(ids), int)
        for p in docs[doc]:
            covered[p.start : p.start + p.length] += 1
        assert (covered == copies).all()
    check_sequences([(p.sequence_id, p.offset, p.length) for p in pieces], 4096)
    assert pack(documents(ROWS[:1]).limit(0), PATH).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_bins(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([64, 100, 4096]))
    sizes = np.maximum(1, (rng.random(int(rng.integers(1, 300))) ** 3 * capacity * 2.5)).astype(int)
    bins = Bins(capacity)
    for i, n in enumerate(sizes.tolist()):
        bins.add(i, np.full(n, i, np.uint32))
    bins.finish()
    check_sequences([(x[5], x[6], x[2]) for x in bins.rows], capacity)
    total = np.zeros(len(sizes), int)
    for x in bins.rows:
        assert x[3] == zlib.crc32(np.full(x[2], x[0], "<u4").tobytes())
        total[x[0]] += x[2]
    assert (total == sizes).all()


def test_a_bin_of_a_class_takes_k_documents():
    bins = Bins(4096)
    for i in range(12):
        bins.add(i, np.zeros(1000, np.uint32))  # k = 4
    assert [x[2] for x in bins.rows if x[5] == 0] == [1000, 1000, 1000, 1000, 96] and bins.rows[4][0] == 4


def test_capacity_must_be_positive(spark, documents):
    with pytest.raises(ValueError, match="positive"):
        pack(documents(ROWS), PATH, capacity=0)


@pytest.mark.parametrize("block", [7, 1 << 18])
def test_token_counts(spark, documents, block):
    rows = ROWS if block > 7 else [r for r in ROWS if len(r[1] or "") < 2000]
    got = sorted(((x.doc_id, x.n_tokens) for x in token_counts(documents(rows), PATH, 49407, width=16 if block == 7 else 32, block=block).collect()), key=str)
    assert got == sorted(((d, len(expected_ids(t, True)) + 1) for d, t in rows), key=str)
    assert token_counts(documents(rows).limit(0), PATH, 49407).collect() == []


@pytest.mark.parametrize("width", [16, 32, 64])
def test_scan_of_flat_files(spark, tmp_path, width):
    rng = np.random.default_rng(1)
    for name, tail in (("a.bin", True), ("b.bin", False), ("c.bin", True)):
        ids = np.where(rng.random(5000) < (0.01 if name != "c.bin" else 0), 9, rng.integers(10, 99, 5000)).astype(f"<u{width // 8}")
        ids[-1] = 11 if tail else 9
        (tmp_path / name).write_bytes(ids.tobytes() + b"x" * (name == "a.bin"))  # a torn id at the end
        found = sorted((x.ordinal, x.start, x.n_tokens) for x in scan(token_files(spark, str(tmp_path / name)), 9, width, 100).collect())
        ends = [*(np.flatnonzero(ids == 9) + 1).tolist(), *([5000] if tail else [])]
        starts = [0, *ends[:-1]]
        assert found == [(i, s, e - s) for i, (s, e) in enumerate(zip(starts, ends, strict=True))]
    (tmp_path / "d.bin").write_bytes(b"")
    assert scan(token_files(spark, str(tmp_path / "d.bin")), 9).collect() == []


def test_written_files_are_flat(spark, documents, tmp_path):
    files, order = write_tokens(documents(ROWS[:50]), PATH, 49407, f"file:{tmp_path}/t")
    data = {x.file: np.fromfile(x.file.removeprefix("file:"), "<u4") for x in files.collect()}
    assert all(4 * len(data[x.file]) == x.bytes for x in files.collect())
    texts = {f: np.split(d, np.flatnonzero(d == 49407) + 1)[:-1] for f, d in data.items()}
    wanted = dict(ROWS[:50])
    assert all(texts[x.file][x.ordinal].tolist() == [*expected_ids(wanted[x.doc_id], True), 49407] for x in order.collect())


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(2).integers(0, 2**63, 3000).astype(np.uint64)
    for n in (1, 2, 40, 41, 1000):
        assert jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]
    with pytest.raises(ValueError, match="positive"):
        jump_hash(keys, 0)


def test_shards(spark, documents):
    got = shard_rows(documents(ROWS)).collect()
    by = defaultdict(list)
    for x in got:
        by[x.shard].append(x.slot)
        assert x.law == "key" and x.grown_shard in (x.shard, 40)
    assert len(got) == len(ROWS) and all(sorted(v) == list(range(len(v))) for v in by.values())
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in ROWS)
    assert sorted((x.size, x.text_crc32) for x in got) == want
    assert len({x.shard for x in got if x.doc_id == 3}) == 1
    assert shard_rows(documents(ROWS).limit(0)).collect() == []
    assert with_shard(documents(ROWS), ["source", "doc_id"], 8, "s").filter("s between 0 and 7").count() == len(ROWS)
