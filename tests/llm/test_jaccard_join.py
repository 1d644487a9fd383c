import random
import re
from collections import defaultdict

import numpy as np
import pytest

from graphloom.llm.jaccard_join import Trie, jaccard_join
from graphloom.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute(rows):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOW))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if sets[i] and doc is not None:
            least[find(i)].append(doc)
    return sorted((doc, len(sets[i]), (min(least[find(i)], default=None) if sets[i] else doc)) for i, (doc, _) in enumerate(rows) if doc is not None)


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


def rows_with_families(seed=5):
    rng = random.Random(seed)
    rows, doc = [], 0
    for size in (1, 2, 3, 5, 8, 40):
        base = [f"v{rng.randrange(400)}" for _ in range(rng.randrange(60, 200))]
        for _ in range(size):
            rows.append((doc, " ".join(edited(base, rng.randrange(0, 5), rng))))
            doc += 1
    shared = " ".join(f"p{i}" for i in range(40))  # a passage that many share
    for _ in range(30):
        rows.append((doc, shared + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))))
        doc += 1
    rows += [(900, rows[3][1]), (901, rows[3][1].upper()), (902, None), (903, ""), (904, " \t\n"), (905, "Just three words"), (906, "just THREE words"), (907, "a b c d e"), (908, "x" * 5000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [5, 6])
def test_against_all_pairs(spark, documents, seed):
    rows = rows_with_families(seed)
    got = [tuple(x) for x in jaccard_join(documents(rows)).collect()]
    assert sorted(got) == brute(rows)


def rows_of_one_cluster(seed):
    """Families apart from each other by more than a link, but chained by shared halves; a shingle that all hold."""
    rng = random.Random(seed)
    rows, common = [], "the one line that all have in here"
    parts = [[f"c{i}x{j}" for j in range(30)] for i in range(9)]
    for i in range(80):
        a = rng.randrange(8)
        words = [*parts[a], *parts[a + 1], *common.split()]
        rows.append((i, " ".join(edited(words, rng.randrange(0, 9), rng))))
    return [*rows, *((200 + i, common) for i in range(20)), *((300 + i, rows[0][1]) for i in range(20))]


@pytest.mark.parametrize(("seed", "cluster"), [(1, 8192), (2, 0), (3, 0), (4, 10)])
def test_tries_clusters_and_hot_shingles(spark, documents, monkeypatch, seed, cluster):
    from graphloom.llm import common, jaccard_join as J

    for name, value in {"TRIE_SETS": 4, "CLUSTER": cluster, "LOCAL": 6, "LISTED": 7, "TAKEN": 50, "TEXT_BYTES": 3000, "GROUP_BYTES": 1000, "BUCKET_BYTES": 4000}.items():
        monkeypatch.setattr(J, name, value)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 100_000 if seed == 1 else 0)
    rows = rows_of_one_cluster(seed) if seed % 2 else rows_with_families(seed) + [(1000 + d, t) for d, t in rows_of_one_cluster(seed)]
    got = [tuple(x) for x in jaccard_join(documents(rows), rounds=1).collect()]
    assert sorted(got) == brute(rows)


def test_repeated_rows_null_keys_and_ties(spark, documents):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, "q")]
    got = sorted(map(tuple, jaccard_join(documents(rows)).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 0, None), (2, 1, 2)], key=str)


def test_empty_table(spark, documents):
    assert jaccard_join(documents([(1, "x")]).limit(0)).collect() == []


def test_trie_finds_what_pairs_find():
    rng = random.Random(3)
    sets = []
    for i in range(60):
        base = set(range(10 * (i % 7), 10 * (i % 7) + 40)) - set(rng.sample(range(100), rng.randrange(0, 30)))
        tokens = np.array(sorted(base), np.int64)
        sets.append((i, len(tokens) + rng.randrange(0, 5), np.ones(len(tokens), np.int32) + (tokens // 30).astype(np.int32), tokens, i))
    trie = Trie(sets)
    for i, n, freq, tokens, comp in sets:
        want = sorted(j for j, m, _, other, _ in sets if j != i and 7 * len(set(tokens.tolist()) & set(other.tolist())) >= 3 * (n + m))
        assert sorted(trie.probe(n, freq, tokens, comp, 3, 4)) == want


@pytest.mark.parametrize("step", [255, 7])
def test_many_probes_find_in_one_walk_what_they_find_alone(monkeypatch, step):
    from graphloom.llm import jaccard_join as J

    monkeypatch.setattr(J, "STEP", step)
    rng, sets, probes = random.Random(4), [], []
    for i in range(150):
        base = set(range(300 * (i % 3), 300 * (i % 3) + 300)) - set(rng.sample(range(900), rng.randrange(0, 200))) | {1000}
        tokens = np.array(sorted(base), np.int64)
        one = (i, len(tokens) + rng.randrange(0, 9), (tokens // 100 + 2).astype(np.int32), tokens, i // 2)
        (sets if i % 5 else probes).append(one)
    ends = {i: comp for i, *_, comp in sets + probes}
    for first in (None, 1000, 302):
        trie, mine = Trie([x for x in sets if first is None or first in x[3]]), [x for x in probes if first is None or first in x[3]]
        alone = {(x[0], y) for x in mine for y in trie.probe(*x[1:], 3, 4, None, first)}
        got = list(trie.walk(mine, 3, 4, J.Joined(True), first))
        assert set(got) <= alone and (first == 1000 or alone)
        forest, whole = J.Joined(True), J.Joined(True)
        for links, joined in ((got, forest), (sorted(alone), whole)):
            for x, y in links:
                if joined.root(ends[x]) != joined.root(ends[y]):
                    joined.link(ends[x], joined.root(ends[y]))
        assert len(got) == len(forest.held) == len(whole.held)


@pytest.mark.parametrize("chained", [False, True])
def test_large_group_of_near_copies_meets_each_pair_once(spark, documents, monkeypatch, chained):
    """The shingles of a text that many copies share would make each pair come up at many of them."""
    from graphloom.llm import common, jaccard_join as J

    rng, lists, postings = random.Random(9), [], J._postings
    for name, value in {"TRIE_SETS": 16, "SLOT_SETS": 32, "WALKERS": 8, "CLUSTER": 10}.items():
        monkeypatch.setattr(J, name, value, raising=False)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(J, "_postings", lambda held, *a: lists.append(held.count()) or postings(held, *a))
    if chained:  # each shares shingles with two neighbours only
        rows = [(i, " ".join(f"c{i + k}x{j}" for k in (0, 1) for j in range(20))) for i in range(60)] + [(100, " ".join(f"c{i}x{j}" for i in range(61) for j in range(20)))]
    else:
        base = [f"b{i}" for i in range(150)]
        rows = [(i, " ".join(edited(base, rng.randrange(4, 16), rng))) for i in range(120)]
    got = [tuple(x) for x in jaccard_join(documents(rows), rounds=1).collect()]
    assert sorted(got) == brute(rows)
    assert bool(lists) == chained


def test_shingles_of_long_and_short_texts():
    long = b" ".join(b"w%d" % (i % 5000) for i in range(200_000))
    assert [len(x) for x in shingle_sets([long, b"a b c d", b"", None, b"A b", b"a B"])] == [5000, 1, 0, 0, 1, 1]
    a, b, c, d = shingle_sets([b"A b", b"a B", b"a b c", b"c b a"])
    assert a[0] == b[0] and len({int(a[0]), int(c[0]), int(d[0])}) == 3


def test_component_that_is_least_of_all_its_shingles(spark, documents):
    """c links with l but shares more rare shingles with m; two long texts make all but those frequent."""
    words = lambda *x: [f"{'x'.join(map(str, x))}x{j}" for j in range(x[-1])]
    rows, want, long = [], [], ([], [])
    for seed in range(400):
        p, q, r = words(seed, "p", 90), words(seed, "q", 18), words(seed, "r", 90)
        one = [(10 * seed, " ".join(q + p)), (10 * seed + 1, " ".join(p + words(seed, "l", 10))), (10 * seed + 2, " ".join(q + r))]
        rows += one
        want += brute(one)
        for side, x in enumerate(long):
            x += p + [f"gap{side}x{seed}"] + r + words(seed, "junk", side, 120)
    for doc, x in zip((9000, 9001), long, strict=True):
        rows.append((doc, " ".join([str(doc), *x])))
        want += brute(rows[-1:])
    got = [tuple(x) for x in jaccard_join(documents(rows)).collect()]
    assert sorted(got) == sorted(want)


def test_holders_let_hot_shingles_go(monkeypatch):
    from graphloom.llm import jaccard_join as J

    monkeypatch.setattr(J, "LISTED", 5)
    rng, held, want, out = np.random.default_rng(3), J.Holders(), defaultdict(set), []
    held.hot = np.array([29], np.uint64)  # marked from outside
    for _ in range(12):
        tokens, sigs = (rng.integers(0, 30, 40) ** 2 % 31).astype(np.uint64), rng.integers(0, 60, 40)
        for t, s in zip(tokens.tolist(), sigs.tolist(), strict=True):
            want[t].add(s)
        held.add(tokens, sigs, sigs + 1)
        out.append(held.released())
    out.append(held.released(last=True))
    got = defaultdict(set)
    for tokens, sigs, ns, freq in out:
        assert (ns == sigs + 1).all()
        for t, s, f in zip(tokens.tolist(), sigs.tolist(), freq.tolist(), strict=True):
            got[t].add(s)
            assert f == (J.HOT if len(want[t]) > 5 or t == 29 else len(want[t]))
    assert got == {t: s for t, s in want.items() if len(s) > 1 or t == 29}
