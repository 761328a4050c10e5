"""Sharding, centroid clusters and token alignment against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from pointframe.llm import alignment, centroids, queries, sharding
from pointframe.llm.queries import PIECES, tokenizer_path


def text_of(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(n))


# --- shards


@pytest.fixture(scope="module")
def many_docs(spark):
    """A third of the rows are one text, one document is long, and some repeat."""
    rng = random.Random(5)
    rows = [(i, text_of(rng, rng.randint(1, 120)), f"s{i % 3}") for i in range(900)]
    rows += [(1000 + i, rows[0][1], None) for i in range(600)] + [(2000, "long " * 2000, "s1"), rows[5], rows[5], (None, None, None)]
    rows += [(3000 + i, rows[7 + i // 4][1], "s9") for i in range(80)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


def check_law(rows, shards, slack=1 / 64):
    sizes = dict.fromkeys(range(shards), 0)
    slots: dict[int, list[int]] = {}
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    mean, widest = sum(sizes.values()) / shards, max(r["size"] for r in rows)
    # Each level may miss by half a document or the slack; the last ones are not spread over many shards.
    assert max(abs(x - mean) for x in sizes.values()) <= 2 * (widest / 2 + slack * mean), sizes


@pytest.mark.parametrize("shards", [1, 2, 7, 16])
def test_shards_have_equal_bytes(many_docs, shards):
    given, got = many_docs.collect(), sharding.shard_documents(many_docs, shards).collect()
    key = lambda i: (i is None, i or 0)
    want = [(r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in given]
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=lambda x: (key(x[0]), x)) == sorted(want, key=lambda x: (key(x[0]), x))
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    check_law(got, shards)


def test_equal_texts_part_only_at_cuts(many_docs):
    """A group within the slack is in one shard; only one that a cut must divide is in several."""
    got = sharding.shard_documents(many_docs, 8).collect()
    groups: dict[int, list] = {}
    for r in got:
        groups.setdefault(r["text_crc32"], []).append(r)
    slack = sum(r["size"] for r in got) / 8 / 64
    small = [g for g in groups.values() if sum(r["size"] for r in g) <= slack]
    assert len(small) > 500 and all(len({r["shard"] for r in g}) == 1 for g in small)
    assert sum(len({r["shard"] for r in g}) > 1 for g in groups.values()) <= 7


def test_shards_follow_given_dimensions(spark):
    from pyspark.sql import functions as F

    docs = spark.range(1024).select(F.col("id").alias("doc_id"), F.lit("same length").alias("text"), (F.col("id") % 32).alias("x"), F.floor(F.col("id") / 32).alias("y"))
    got = sharding.shard_documents(docs, 16, {"x": F.col("x"), "y": F.col("y")}).collect()
    for s in range(16):  # sixteen squares of 8 by 8
        mine = [r for r in got if r["shard"] == s]
        assert len(mine) == 64
        assert all(max(r[c] for r in mine) - min(r[c] for r in mine) == 7 for c in ("dim_x", "dim_y"))


def test_shards_of_odd_and_no_documents(odd_docs, no_docs):
    got = sharding.shard_documents(odd_docs, 40).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["shard"] < 40 for r in got)
    assert sharding.shard_documents(no_docs, 40).count() == 0
    null = sharding.shard_documents(odd_docs.limit(1), 3).first()
    assert (null["size"], null["text_crc32"], null["slot"]) == (16, 0, 0)


# --- clusters


def plain_lloyd(rows, k, rounds, width=64):
    kept = [(i, [int(np.floor(64 * float(v))) for v in e]) for i, e in rows if e is not None and len(e) == width and all(v is not None and np.isfinite(v) for v in e)]
    name = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    cents = [list(v) for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    home = lambda v: min(range(len(cents)), key=lambda c: (far(v, cents[c]), c))
    for _ in range(rounds):
        mine = [home(v) for _, v in kept]
        for c in range(len(cents)):
            some = [v for (_, v), h in zip(kept, mine, strict=True) if h == c]
            if some:
                cents[c] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    out = [(i, home(v)) for i, v in kept]
    dist = [far(v, cents[h]) for (_, v), (_, h) in zip(kept, out, strict=True)]
    per = {c: sum(d for d, (_, h) in zip(dist, out, strict=True) if h == c) for c in range(len(cents))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return [(i, h, d, per[h], sum(dist), sha[h]) for (i, h), d in zip(out, dist, strict=True)]


def rows_of(df):
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("kind", ["clusters", "noise", "ties", "large"])
def test_lloyd_is_the_plain_one(spark, kind):
    rng = np.random.default_rng(2)
    if kind == "clusters":
        x = rng.normal(0, 3, (9, 64))[rng.integers(0, 9, 300)] + rng.normal(0, 0.05, (300, 64))
    elif kind == "ties":  # few different vectors, many equally far from two centroids
        x = rng.integers(-1, 2, (200, 64)) * (np.arange(64) < 2)
    else:
        x = rng.normal(0, 0.2 if kind == "noise" else 2e5, (200, 64))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert rows_of(centroids.lloyd(df, k=7, rounds=3, block=64)) == sorted(plain_lloyd(rows, 7, 3), key=str)


def test_lloyd_of_odd_rows(spark):
    good = [0.5] * 64
    rows = [(1, good), (1, good), (2, None), (3, [1.0] * 63), (4, [*good[1:], None]), (5, [*good[1:], float("nan")]), (6, [*good[1:], float("inf")]), (7, [*good[1:], -0.3]), (None, [0.1] * 64), (8, [])]
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, points string")
    assert rows_of(centroids.lloyd(df, k=16, rounds=2)) == sorted(plain_lloyd(rows, 16, 2), key=str)
    assert centroids.lloyd(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, good), (2, [1e300] * 64)], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in centroids.lloyd(huge).collect()] == [1]  # its distances would not fit a long


@pytest.mark.parametrize("spread", [0.01, 1.0, 30.0])
def test_cover_tree_covers_and_separates(spread):
    rng = np.random.default_rng(int(spread * 100))
    x = np.floor(64 * (rng.normal(0, 1, (12, 8))[rng.integers(0, 12, 400)] + rng.normal(0, spread, (400, 8))))
    t = centroids.cover_tree(x)
    y = x[t.order]
    assert sorted(t.order) == list(range(400))
    for n in range(len(t.low)):
        inside = y[t.low[n] : t.high[n]]
        assert np.sqrt(((inside - inside[0]) ** 2).sum(1)).max() <= t.radius[n] + 1e-9
        if t.children[n]:
            kids = np.arange(t.child[n], t.child[n] + t.children[n])
            assert t.low[kids[0]] == t.low[n] and t.high[kids[-1]] == t.high[n] and (t.low[kids[1:]] == t.high[kids[:-1]]).all()
            assert t.radius[kids].max() <= t.radius[n] / 2 + 1e-9
            heads = y[t.low[kids]]
            apart = np.sqrt(((heads[:, None] - heads[None]) ** 2).sum(-1)) + np.eye(len(kids)) * 1e9
            assert apart.min() > t.radius[n] / 2 - 1e-9


def test_two_trees_prune(spark):
    """Where vectors lie in clusters, most pairs of points and centroids are never met."""
    rng = np.random.default_rng(8)
    heads = rng.normal(0, 5, (64, 16))
    x = np.floor(64 * (heads[rng.integers(0, 64, 2048)] + rng.normal(0, 0.02, (2048, 16))))
    cents = np.floor(64 * heads)
    t = centroids.cover_tree(x)
    home, work = centroids.nearest(x[t.order], t, cents, centroids.cover_tree(cents, leaf=1))
    assert (home == ((x[t.order][:, None] - cents[None]) ** 2).sum(-1).argmin(1)).all()
    assert work < 2048 * 64 / 8


# --- alignment


def plain_alignment(texts):
    """Tokens, groups and links of each text by walking both sides."""
    both = alignment.Pair(tokenizer_path(), tokenizer_path(PIECES))
    out, links = [], []
    for t in texts:
        raw = (" " + t).encode() if t else b""
        a = both.a.tokenizer.encode(" " + t, add_special_tokens=False).ids if t else []
        b = both.b.model.encode(t) if t else []
        if not t or b"".join(both.a_bytes[i] for i in a) != raw or b"".join(both.b_bytes[i] for i in b) != raw:
            out.append((0, 0, 0, 0, "")), links.append([])
            continue
        groups, mine, i, j, x, y = [], [], 0, 0, 0, 0
        left, right = [], []
        while i < len(a) or j < len(b):
            if x <= y and i < len(a):
                left.append(a[i])
                x += len(both.a_bytes[a[i]])
                i += 1
            else:
                right.append(b[j])
                y += len(both.b_bytes[b[j]])
                j += 1
            if x == y:
                groups.append((left, right))
                mine.append((left[-1], right[-1]))
                left, right = [], []
        form = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((len(a), len(b), len(groups), len(mine), hashlib.sha256(form.encode()).hexdigest()))
        links.append(mine)
    return out, links


def test_alignment_is_the_plain_one(spark, odd_docs):
    rng = random.Random(9)
    odd = ["<|endoftext|> and <s> </s> <unk> <0x0A>", "  two  blanks \n\n lines\t", "a▁b", "naïve café 日本語 🙂🙂 ​", "x" * 300, "\x00nul", "don't 1234567 $$$ ...", "ﬁ ligature", "é ½ ①"]
    texts = [r["text"] for r in odd_docs.collect()] + odd + [text_of(rng, 40) for _ in range(40)] + [text_of(random.Random(1), 30)] * 5
    docs = spark.createDataFrame([(i, t, 3, "k") for i, t in enumerate(texts)], "doc_id long, text string, row int, keys string").repartition(3)
    want, links = plain_alignment(texts)
    counts: dict[tuple, int] = {}
    for mine in links:
        for p in mine:
            counts[p] = counts.get(p, 0) + 1
    top: dict[int, int] = {}
    for (_, q), n in counts.items():
        top[q] = max(top.get(q, 0), n)
    got = {r["doc_id"]: r for r in alignment.align_tokens(docs, tokenizer_path(), tokenizer_path(PIECES)).collect()}
    assert len(got) == len(texts)
    for i, (w, mine) in enumerate(zip(want, links, strict=True)):
        r = got[i]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) == w, texts[i]
        assert r["count_sum"] == sum(counts[p] for p in mine)
        assert r["n_best"] == sum(counts[p] == top[p[1]] for p in mine)


def test_intervals_and_products_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        a, b = (np.unique(np.r_[rng.integers(1, n + 1, int(rng.integers(0, 20))), n]) for _ in range(2))
        ends, i, j, shared = alignment.intervals(a, b)
        starts = lambda e: np.r_[0, e[:-1]]
        overlap = {(p, q) for p in range(len(a)) for q in range(len(b)) if min(a[p], b[q]) > max(starts(a)[p], starts(b)[q])}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == overlap and len(ends) == len(overlap)
        closed = ends[shared]
        assert closed.tolist() == sorted(set(a) & set(b))
        ga, gb = np.searchsorted(closed, a), np.searchsorted(closed, b)
        assert (ga == alignment.groups_of(i, shared)).all() and (gb == alignment.groups_of(j, shared)).all()
        x, y = alignment.product(ga, gb, len(closed))
        assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == [(p, q) for p in range(len(a)) for q in range(len(b)) if ga[p] == gb[q]]


def test_remembered_words_are_the_models_own():
    rng = random.Random(4)
    some = alignment.Pieces(tokenizer_path(PIECES), limit=50)
    assert some.by_word
    letters = ["a", "é", "日", "\n", "\t", ".", "'", "9", "\u00a0", "\u200b", "🙂", "ß", "▁", "the", "ing", "<s>"]
    for _ in range(60):
        texts = ["".join(rng.choice(letters) + rng.choice(["", " ", "", "  "] if rng.random() < 0.2 else ["", " "]) for _ in range(rng.randint(1, 30))) for _ in range(8)]
        ids, sizes = some.encode(texts)
        want = [some.model.encode(t) for t in texts]
        assert ids.tolist() == [x for w in want for x in w] and sizes.tolist() == [len(w) for w in want]


def test_alignment_by_overlaps_and_groups(spark):
    docs = spark.createDataFrame([(1, "unbelievable antidisestablishmentarianism"), (None, None)], "doc_id long, text string")
    ends, over, groups = (alignment.align_tokens(docs, tokenizer_path(), tokenizer_path(PIECES), kind).where("doc_id = 1").first() for kind in ("ends", "overlaps", "groups"))
    assert ends["n_links"] == ends["n_groups"] < over["n_links"] == over["n_overlaps"] <= groups["n_links"]
    with pytest.raises(ValueError, match="links"):
        alignment.align_tokens(docs, tokenizer_path(), tokenizer_path(PIECES), "all")


def test_alignment_of_no_documents(no_docs):
    assert alignment.align_tokens(no_docs, tokenizer_path(), tokenizer_path(PIECES)).count() == 0


def test_new_queries_are_registered():
    assert {"op11_shard_documents", "op12_centroid_clusters", "op13_align_tokens"} <= set(queries.queries())


def test_other_tokenizer_files_are_encoded_whole():
    """Lower-casing or word ends rule out remembered words; the ids are still the library's."""
    from tokenizers import Tokenizer

    from pointframe.llm.tokens import Encoder

    texts = ["Some Words, and  MORE of them.", None, "", "naïve 日本 don't"]
    for name, by_words in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        own, plain = Encoder(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))
        plain.encode_special_tokens = True
        ids, sizes = own.encode(texts)
        want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert own.by_words == by_words and ids.tolist() == [x for w in want for x in w] and sizes.tolist() == [len(w) for w in want]
