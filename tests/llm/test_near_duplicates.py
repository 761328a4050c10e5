import collections
import itertools
import os
import random

import numpy as np
import pytest

from pointframe.llm import neardup
from pointframe.llm.common import WordHashes, shingle_set

SF = "/root/testdata/sf0.01"


def shingles(text, k):
    w = text.encode().lower().split() if text else []
    return {tuple(w[i : i + min(k, len(w))]) for i in range(len(w) - min(k, len(w)) + 1)} if w else set()


def brute(rows, k, percent):
    """component by doc_id, over all pairs."""
    sets = {d: shingles(t, k) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in sets}


def family(rng, n, edits, size=80):
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, monkeypatch, k, percent):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 7)  # many blocks
    monkeypatch.setattr(neardup, "HUB_ROWS", 9)  # hubs and nodes are dealt to several tasks
    monkeypatch.setattr(neardup, "NODE_ROWS", 11)
    rng = random.Random(k)
    texts = [t for n, e in ((40, 6), (25, 3), (30, 9), (5, 0)) for t in family(rng, n, e)]
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(1, 40))) for _ in range(60)]
    texts += texts[:5] + ["", "   ", "one", "One", "one two"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k, percent).collect()}
    want = brute(rows, k, percent)
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert all(r.kept == (d == r.component_id) for d, r in got.items())
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), k, percent)
    assert {r.doc_id for r in kept.collect()} == {d for d, (_, c) in want.items() if c == d}


def test_one_hub_of_many_copies(spark):
    base = " ".join(f"w{i}" for i in range(60))
    docs = spark.range(50_000, numPartitions=8).selectExpr("id as doc_id", f"concat('{base} e', id) as text")
    got = neardup.near_duplicates(docs, 3, 85).groupBy("component_id").count().collect()
    assert [tuple(r) for r in got] == [(0, 50_000)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_recall_on_documents(spark, k, percent):
    """Linked pairs of the whole table found, of all by brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {r.doc_id: shingles(r.text, k) for r in docs.collect()}
    owners, inter = collections.defaultdict(list), collections.Counter()
    for d in sorted(sets):
        for x in sets[d]:
            inter.update((e, d) for e in owners[x])
            owners[x].append(d)
    links = [p for p, n in inter.items() if 100 * n >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, k, percent).collect()}
    joined = sum(found[a] == found[b] for a, b in links)
    assert links and joined >= 0.9 * len(links)
    assert sum(c != d for d, c in found.items()) <= len({b for _, b in links})


def test_odd_rows(odd_docs, no_docs):
    rows = neardup.near_duplicates(odd_docs, 3, 85).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[None].kept and by[None].component_id is None
    assert by[0].n_shingles == by[1].n_shingles == by[2].n_shingles == 0 and by[0].kept and by[1].kept
    assert by[7].component_id == by[8].component_id == by[6].component_id == 6
    assert by[4].component_id == by[5].component_id == 4 and by[3].component_id == 3
    assert [r.kept for r in rows if r.doc_id == 6] == [True] * 3
    assert neardup.near_duplicates(no_docs).count() == 0 and neardup.keep_one(no_docs).count() == 0
    assert neardup.keep_one(odd_docs, 3, 85).columns == odd_docs.columns


def test_rows_that_share_or_lack_an_id(spark):
    rng = random.Random(9)
    a, b, c, d = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(60)) for x in "abcd")
    near_b = b.rsplit(" ", 1)[0] + " other"
    rows = [(1, a), (1, a), (None, a), (5, b), (5, c), (7, near_b), (8, c), (None, d), (None, d), (9, ""), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [r.text for r in neardup.keep_one(docs).collect()]
    assert kept.count(a) == kept.count(c) == kept.count(d) == 1 and kept.count(b) + kept.count(near_b) == 1 and kept.count("") == 2
    found = [(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()]
    assert len(found) == len(rows) and {x for x in found if x[0] in (5, 7, 8)} == {(5, 5, True), (7, 5, False), (8, 5, False)}


def test_long_chain_is_one_component(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(200)], "u long, v long")
    got = neardup.components(chain).collect()
    assert {r.node for r in got} == set(range(1, 201)) and {r.component for r in got} == {0}
    assert neardup.components(chain.limit(0)).count() == 0


def test_intersections_are_exact():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60_000, rng.integers(0, 9000)).astype(np.uint64)) for _ in range(9)]
    got = neardup.intersections(sets[:4], sets[4:])
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]).all()
    assert neardup.intersections([np.empty(0, np.uint64)], [sets[1]]).tolist() == [[0]]


def test_odd_sketch_keeps_links():
    mult = neardup._multipliers(160)
    rng = random.Random(1)
    h = WordHashes()
    limit = neardup.most_flips(85, 160)
    far = 0
    for _ in range(60):
        a, b = (shingle_set(t, 3, h) for t in family(rng, 2, 4, 100))
        sim = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = (np.frombuffer(neardup.odd_sketch(neardup.minhash(s, mult)), np.uint64) for s in (a, b))
        flips = int(np.bitwise_count(x ^ y).sum())
        assert sim < 0.85 or flips <= limit
        z = np.frombuffer(neardup.odd_sketch(neardup.minhash(shingle_set(" ".join(f"z{rng.random()}" for _ in range(90)), 3, h), mult)), np.uint64)
        far += int(np.bitwise_count(x ^ z).sum()) > limit
    assert far == 60
