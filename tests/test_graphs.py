from collections import deque

import numpy as np
import pytest

from pointframe.operators import graphs
from pointframe.operators.neighbors import knn


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def bag(rng, vertices, n):
    return [(int(a), int(b)) for a, b in rng.integers(0, vertices, (n, 2))]


def test_edge_bag(spark):
    pairs = bag(np.random.default_rng(3), 12, 60)
    e, v = edges(spark, pairs), spark.range(12)
    assert graphs.counts(v, e).first() == (12, 60)
    out = {u: [d for s, d in pairs if s == u] for u in {s for s, _ in pairs}}
    assert {r.src: (r.edges, r.dst_sum) for r in graphs.out_degree(e).collect()} == {u: (len(d), sum(d)) for u, d in out.items()}
    some = next(u for u, d in out.items() if len(d) > len(set(d)))
    twice = next(d for d in out[some] if out[some].count(d) > 1)
    left = graphs.remove_edges(e, edges(spark, [(some, twice)])).where(f"src = {some} and dst = {twice}").count()
    assert left == out[some].count(twice) - 1
    assert graphs.add_edges(e, edges(spark, pairs[:1])).count() == 61
    assert graphs.out_edges_of(e, some).count() == len(out[some])
    assert graphs.add_vertices(v, spark.range(10, 15)).count() == 15


def test_undirected_knn_graph(cloud_of):
    pts = np.random.default_rng(4).uniform(0, 1, (30, 3)).tolist()
    e = graphs.undirected_knn_graph(knn(cloud_of(pts), 2))
    assert e.count() == 120 and e.where("src = dst").count() == 0


def levels_of(pairs, root):
    level, queue = {root: 0}, deque([root])
    while queue:
        u = queue.popleft()
        for a, b in pairs:
            if a == u and b not in level:
                level[b] = level[u] + 1
                queue.append(b)
    return level


@pytest.mark.parametrize("blocks", [None, 1, 4, 11])
def test_breadth_first_by_blocks(spark, blocks):
    """Levels and least parents are those of a queue, whatever the blocks."""
    rng = np.random.default_rng(11)
    pairs = bag(rng, 60, 90) + [(i, i + 1) for i in range(60, 90)] + [(5, 60), (5, 5)]
    homes = None if blocks is None else spark.createDataFrame([(i, int(b)) for i, b in enumerate(rng.integers(0, blocks, 85))], "id long, block long")  # some without a block
    level = levels_of(pairs, 5)
    want = {v: (n, min(a for a, b in pairs if b == v and level.get(a) == n - 1)) for v, n in level.items() if n}
    assert {r.child: (r.level, r.parent) for r in graphs.breadth_first_search(edges(spark, pairs), 5, homes).collect()} == want
    assert graphs.breadth_first_search(edges(spark, pairs), 777, homes).count() == 0


def test_rounds_are_blocks_not_levels(spark, monkeypatch):
    """A path of five hundred vertices in four blocks is walked in four rounds."""
    stored = []
    keep = graphs.store
    monkeypatch.setattr(graphs, "store", lambda df, tag: (stored.append(tag), keep(df, tag))[1])
    homes = spark.range(500).selectExpr("id", "id div 125 as block")
    got = graphs.breadth_first_search(edges(spark, [(i, i + 1) for i in range(499)]), 0, homes)
    assert {r.child: r.level for r in got.collect()} == {i: i for i in range(1, 500)} and stored.count("relaxed") == 4


def test_depth_first_matches_recursion(spark):
    pairs = bag(np.random.default_rng(12), 25, 60)
    want, seen = [], {3}

    def walk(u):
        for v in sorted({b for a, b in pairs if a == u}):
            if v not in seen:
                seen.add(v)
                want.append((u, v))
                walk(v)

    walk(3)
    assert [(r.parent, r.child) for r in graphs.depth_first_search(edges(spark, pairs), 3).orderBy("ord").collect()] == want
    with pytest.raises(ValueError):
        graphs.depth_first_search(edges(spark, pairs), 3, max_edges=3)


def test_rooted_tree(spark):
    """Random trees, a star and a second component against a queue."""
    rng = np.random.default_rng(13)
    tree = [(int(rng.integers(0, i)), i) for i in range(1, 80)] + [(7, 100 + i) for i in range(30)]
    other = [(500, 501), (501, 502)]
    df = spark.createDataFrame([(b, a) if i % 2 else (a, b) for i, (a, b) in enumerate(tree + other)], "a long, b long")
    both = tree + [(b, a) for a, b in tree]
    for root in (0, 41, 105):
        level = levels_of(both, root)
        got = {r.child: (r.level, r.parent) for r in graphs.rooted_tree(df, root).collect()}
        assert {v: n for v, (n, _) in got.items()} == {v: n for v, n in level.items() if n}
        assert all((p, v) in both and level[p] == n - 1 for v, (n, p) in got.items())
    assert graphs.rooted_tree(df, 999).count() == 0 and graphs.rooted_tree(df.limit(0), 0).count() == 0


def test_a_long_path_is_rooted_in_few_rounds(spark, monkeypatch):
    stored = []
    keep = graphs.store
    monkeypatch.setattr(graphs, "store", lambda df, tag: (stored.append(tag), keep(df, tag))[1])
    n = 100_000
    got = graphs.rooted_tree(spark.range(n - 1).selectExpr("id as a", "id + 1 as b"), 0).selectExpr("count(*) n", "sum(level) s", "count_if(parent + 1 = child and level = child) ok").first()
    assert tuple(got) == (n - 1, n * (n - 1) // 2, n - 1) and stored.count("tour") < 25


def test_spanning_forest_against_kruskal(spark):
    rng = np.random.default_rng(7)
    rows = [(int(a), int(b), float(rng.integers(1, 6))) for a, b in rng.integers(0, 40, (90, 2))]
    parent = list(range(40))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    total = n = 0
    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in rows):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            total, n = total + w, n + 1
    got = graphs.minimum_spanning_forest(spark.createDataFrame(rows, "src long, dst long, w double")).collect()
    assert (sum(r.w for r in got), len(got)) == (total, n)
