import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pointframe.llm import fingerprints, langid, licenses, packing, quality, simple8b, tokens
from pointframe.llm.queries import table, tokenizer_path

SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


# --- language ID


@data
def test_languages_held_out(spark):
    docs = table(spark, SF, "documents")
    rows = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_code_lengths_by_a_plain_walk():
    rng = random.Random(2)
    grams = collections.Counter()
    for lang, alphabet in (("a", "abcd "), ("b", "bcde ")):
        text = b"\0" * 2 + "".join(rng.choice(alphabet) for _ in range(600)).encode()
        for i in range(2, len(text)):
            for d in range(3):
                ctx = sum(text[i - 1 - j] << (8 * j) for j in range(d))
                grams[d, ctx, lang, text[i]] += 1
    by = collections.defaultdict(lambda: collections.defaultdict(dict))
    for (d, ctx, lang, s), n in grams.items():
        by[lang][d, ctx][s] = n
    m = langid.Model(["a", "b"], [langid.Tree.load(langid.tree(by[k], 2).dump()) for k in "ab"], 2)

    def count(lang, ctx):
        c = {s: n for (g, x, k, s), n in grams.items() if k == lang and g == len(ctx) and x == sum(v << (8 * j) for j, v in enumerate(reversed(ctx)))}
        return c

    every = len({s for (d, _, _, s) in grams if d == 0} | {0})

    def prob(lang, ctx, s, out=frozenset()):
        here = {k: v for k, v in count(lang, ctx).items() if k not in out}
        total, kinds = sum(here.values()), len(here)
        if s in here:
            return here[s] / (total + kinds)
        esc = kinds / (total + kinds) if total else 1.0
        seen = out | set(count(lang, ctx))
        if ctx:
            return esc * prob(lang, ctx[1:], s, frozenset(seen))
        return esc / (256 - len(seen))

    text = b"abcde deadbee z"
    padded = b"\0\0" + text
    want = [sum(-np.log2(prob(k, tuple(padded[i - 2 : i]), padded[i])) for i in range(2, len(padded))) for k in "ab"]
    assert every > 0 and np.allclose(m.code_lengths([text])[0], want, rtol=1e-5)
    assert np.allclose(m.code_lengths([text, b"", text])[2], want, rtol=1e-5)
    # probabilities of all 256 bytes add up to one
    assert np.allclose(sum(2.0 ** -m.code_lengths([b"ab" + bytes([x])])[0] for x in range(256)), 2.0 ** -m.code_lengths([b"ab"])[0], rtol=1e-4)


def test_rare_language_among_many(spark):
    """Three hundred languages, one of them with four documents: each keeps its own contexts."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def made(lang, n):
        own = random.Random(f"words of {lang}")
        words = ["".join(own.choice(letters) for _ in range(own.randint(3, 8))) for _ in range(30)]
        return [" ".join(rng.choice(words) for _ in range(80)) for _ in range(n)]

    rows = [(f"l{k:03}", t) for k in range(300) for t in made(f"l{k:03}", 12)] + [("rare", t) for t in made("rare", 9)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").repartition(8)
    trees = langid.fit(docs)
    assert trees.count() == 301 and trees.agg({"size": "sum"}).first()[0] < langid.MODEL_BYTES == 200 << 20
    got = langid.identify(docs, trees).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.98 * len(got)
    assert all(r.lang_pred == "rare" for r in got if r.lang == "rare") and any(r.lang == "rare" for r in got)


def test_interleaved_rows():
    rng = random.Random(8)
    rows = [([], [])]
    for _ in range(900):
        at = sorted(rng.sample(range(256), rng.choice((0, 1, 1, 2, 5, 30, 256) if len(rows) < 200 else (1, 2, 3))))
        rows.append((at, [rng.randint(1, 99) for _ in at]))
    t = langid.interleaved(rows, np.int32)
    node, byte = (x.ravel() for x in np.meshgrid(np.arange(len(rows)), np.arange(256), indexing="ij"))
    slot, known = t.find(node, byte.astype(np.uint8))
    want = [dict(zip(*r)) for r in rows]
    assert [v if k else None for v, k in zip(t.value[slot].tolist(), known.tolist())] == [w.get(b) for w in want for b in range(256)]
    assert len(t.owner) < 1.3 * sum(len(a) for a, _ in rows) + 512


@data
def test_languages_by_groups(spark, odd_docs):
    """Trees over the bound go by groups, in one pass each, and give the same."""
    docs = table(spark, SF, "documents")
    trees = langid.fit(docs)
    most = trees.agg({"size": "max"}).first()[0] + 1
    assert len(langid.groups(trees, most)) >= 3 and len(langid.groups(trees, 1)) == trees.count()
    for frame in (docs, odd_docs):
        one, many = (sorted(((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in langid.identify(frame, trees, m).collect()), key=repr) for m in (langid.MODEL_BYTES, most))
        assert one == many
        assert sorted(map(repr, langid.keep_identified(frame, trees).collect())) == sorted(map(repr, langid.keep_identified(frame, trees, most=most).collect()))


def test_language_odd_rows(odd_docs, no_docs):
    model = langid.fit(odd_docs)
    rows = langid.identify(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert {0, 1, 2, 13} <= und and 6 not in und
    assert langid.identify(no_docs, langid.fit(no_docs)).count() == 0
    assert {r.lang_pred for r in langid.identify(odd_docs, langid.fit(no_docs)).collect()} == {"und"}
    kept = langid.keep_identified(odd_docs, model)
    assert kept.columns == odd_docs.columns and 0 not in {r.doc_id for r in kept.collect()}


# --- token files and packing


@pytest.mark.parametrize("high", [1, 2, 50257, 2**31, 2**63])
@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
def test_simple8b_round_trip(n, high):
    v = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64)
    v[: n // 3] = 0
    words, offsets = simple8b.encode(v)
    assert (simple8b.decode(words, offsets, n) == v).all()
    assert len(words) <= 2 * n and (n < 1000 or high > 2 or len(words) < n / 20)


def test_simple8b_escapes():
    v = np.array([0] * 400 + [2**63 + 7] * 5 + [15 << 60] * 3 + [1] * 300, np.uint64)
    words, offsets = simple8b.encode(v)
    assert (simple8b.decode(words, offsets, len(v)) == v).all()


ODD = ["a  b", "a   b", " a", "a ", "a\n b", "a \nb", "\n\n a b", "x<|endoftext|> c", "", None, "a\u00a0b", "don't 's it's", "\t a", "x \n\n y", "é ü 🙂 b", "a\n\nb c", "abc123,;# d.e", " ", "  ", "ſſ ²³ x٣"]


def test_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    e = tokens.Encoder(tokenizer_path(), limit=10)
    for _ in range(2):
        ids, n = e.encode(pa.array(ODD))
        at = 0
        for text, k in zip(ODD, n, strict=True):
            assert ids[at : at + k].tolist() == t.encode(text or "", add_special_tokens=False).ids, text
            at += k
    assert e.encode([])[0].size == 0 and e.encode(["", None])[1].tolist() == [0, 0]


def test_letters_are_remembered_whatever_follows():
    e = tokens.Encoder(tokenizer_path(), plain=False)
    texts = ["x foo foo, foo. foo\nBar foo...\n\nBaz don't don't, 12, ### \u2026, \u00c9t\u00e9! '\ns a'\n's", "foo! foo", "\nfoo,\n", None]
    ids, lengths = e.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [w for w in e.words if w.startswith("foo")] == ["foo"]


def test_packing_sends_few_bytes_at_a_time(spark, monkeypatch):
    def sizes(docs, *_):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32() if i == 1 else pa.int64()) for i, x in enumerate((b.num_rows, 0, b.nbytes, 1, 0))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

        return docs.select("text").mapInArrow(run, packing.PIECES)

    monkeypatch.setattr(packing, "pieces", sizes)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(0, 2000, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 800) AS text")
    rows = packing.pack_documents(docs, "").collect()
    assert sum(r.doc_id for r in rows) == 2000 and max(r.start for r in rows) < 3 << 20
    assert spark.conf.get(key) == before


def test_queries_encode_as_the_library_does(spark):
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(tokenizer_path()), tokens.encoder(tokenizer_path())
    for texts in (ODD, ["<|endoftext|>", "a b<|endoftext|>", "x <|endoftext|>y z", "plain text"]):
        ids, n = e.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    row = simple8b.encode_documents(spark.createDataFrame([(1, "x<|endoftext|> c")], "doc_id long, text string"), tokenizer_path(), 2).first()
    assert row.ids_crc32 == zlib.crc32(np.array([87, 50256, 269, 2], "<u4").tobytes())


def test_token_files(spark, odd_docs, no_docs, tmp_path):
    folder = f"file://{tmp_path}/shards"
    rows = simple8b.encode_documents(odd_docs, tokenizer_path(), 2, folder).orderBy("start").collect()
    ids = [r.ids for r in simple8b.read_ids(spark, folder).collect()]
    assert len(rows) == odd_docs.count() == len(ids)
    e = tokens.encoder(tokenizer_path())
    by = {r.doc_id: r.text for r in odd_docs.collect()}
    keys = [r.doc_id for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    at = 0
    for r in rows:
        mine = np.append(e.encode([by[r.doc_id]])[0], 2).astype("<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(mine), zlib.crc32(mine.tobytes()))
        at += len(mine)
    assert sorted(map(len, ids)) == sorted(r.n_tokens for r in rows)
    assert simple8b.encode_documents(no_docs, tokenizer_path()).count() == 0


def test_packing(odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, tokenizer_path(), 256, 0, open_bins=4).collect()
    e = tokens.encoder(tokenizer_path())
    want = collections.Counter()
    for r in odd_docs.collect():
        ids = np.append(e.encode([r.text])[0], 0).astype("<u4")
        for k, (i, n) in enumerate(packing.cut(len(ids), 256)):
            want[r.doc_id, k, i, n, zlib.crc32(ids[i : i + n].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    check_sequences(rows, 256)
    assert packing.pack_documents(no_docs, tokenizer_path()).count() == 0


def check_sequences(rows, size):
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    return len(seqs)


def test_packer_is_best_fit_with_bounded_space():
    rng = random.Random(5)
    p, open_, made = packing.Packer(100, 3), {}, 0
    for _ in range(3000):
        n = rng.randint(1, 100)
        b, offset = p.place(n)
        fits = {k: f for k, f in open_.items() if f >= n}
        if fits:
            assert open_[b] == min(fits.values()) and offset == 100 - open_[b]
            open_[b] -= n
        else:
            assert b == made and offset == 0
            if len(open_) >= 3:
                least = min(open_.values())
                gone = [k for k, f in open_.items() if f == least]
                assert len(gone) >= 1
                open_.pop(gone[-1] if len(gone) == 1 else next(k for k in gone if k not in {x for f in p.free for x in f}))
            made += 1
            open_[b] = 100 - n
        if not open_[b]:
            del open_[b]
        assert {x for f in p.free for x in f} == set(open_) and len(open_) <= 3


@data
def test_packing_is_tight(spark):
    rows = packing.pack_documents(table(spark, SF, "documents"), tokenizer_path()).collect()
    assert check_sequences(rows, 2048) <= 1.02 * -(-sum(r.length for r in rows) // 2048) + 1


# --- quality rules


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = list(zip(w, w[1:], w[2:], strict=False))
    n = collections.Counter(grams)
    cover = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


def test_quality_statistics(odd_docs, no_docs, labels, monkeypatch):
    rows = quality.quality_rules(odd_docs, labels).collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    assert len(rows) == odd_docs.count()
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == plain(texts[r.doc_id]), r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.quality_rules(no_docs, labels.limit(0)).count() == 0
    assert quality.keep_good(odd_docs, labels).columns == odd_docs.columns
    monkeypatch.setattr(quality.Words, "limit", 20)
    monkeypatch.setattr(quality.Words, "most", 30)
    numbers = quality.Words()
    for t in texts.values():
        assert quality.statistics_of(t, numbers)[4] == plain(t)[4]


@data
def test_quality_verdicts(spark):
    labels = table(spark, SF, "labels")
    rows = quality.quality_rules(table(spark, SF, "documents"), labels).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_quality_learns_from_all_labels(spark, monkeypatch):
    rng = random.Random(6)
    rows = []
    for i in range(12_000):
        good = rng.random() < 0.9
        w = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(60)]
        for at in rng.sample(range(60), max(0, int(rng.gauss(4 if good else 14, 3)))):
            w[at] += "#"
        rows.append((i, " ".join(w), int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4)
    labels = docs.select("doc_id", "quality")
    judged = {r.doc_id: r for r in quality.quality_rules(docs.drop("quality"), labels).collect()}
    passed = [(judged[i].anomaly, q) for i, _, q in rows if not judged[i].base_failed]
    g, b = sorted(a for a, q in passed if q), sorted(a for a, q in passed if not q)
    start = g[math.ceil(0.998 * len(g)) - 1]
    limit = (start + next(a for a in b if a > start)) / 2
    assert len(passed) > 11_000 and 0 < sum(a > limit for a in b) < len(b)
    assert all(r.kept == (not r.base_failed and r.anomaly <= limit) for r in judged.values())
    kept = {i for i, r in judged.items() if r.kept}
    for most in (quality.BROADCAST_ROWS, 10):
        monkeypatch.setattr(quality, "BROADCAST_ROWS", most)
        monkeypatch.setattr("pointframe.llm.common.BROADCAST_ROWS", most)
        assert {r.doc_id for r in quality.keep_good(docs, labels).select("doc_id").collect()} == kept


def test_quality_trees_count_every_row(spark):
    rng, n, size, deep = np.random.default_rng(7), 20_000, 16, 6
    stats = {c: rng.integers(0, 40, n) for c in quality.NAMES} | {"n_words": rng.integers(50, 400, n), "word_chars": rng.integers(400, 900, n), "n_lines": rng.integers(1, 60, n)}
    x = quality.features(stats)
    assert x.shape[1] == quality.N_FEATURES
    rows = spark.createDataFrame(list(zip(*(stats[c].tolist() for c in quality.NAMES), strict=True)), quality.STATS)
    for tail in (0, 0.01):
        order, skip = np.sort(x, axis=0), int(tail * n)
        low, high = quality.box(rows, tail)
        assert (low <= order[skip]).all() and (low >= order[skip] * (1 - 1 / 256)).all()
        assert (high >= order[n - 1 - skip]).all() and (high <= order[n - 1 - skip] * (1 + 1 / 256) + 1e-300).all()
    drawn = quality.draw(low, high, deep, trees=5)
    forest = quality.grown(drawn, quality.counted(rows, drawn), size)
    assert forest.norm == pytest.approx(sum(2 / i for i in range(1, size)) - 2 * (size - 1) / size)
    for t in range(5):
        left = [(0, 0, np.arange(n))]
        while left:
            node, depth, here = left.pop()
            held = len(here) * size / n
            if held <= 1 or depth == deep:
                m, part = int(held), held % 1
                c = [sum(2 / i for i in range(1, k)) - 2 * (k - 1) / k if k > 1 else 0 for k in (m, m + 1)]
                assert forest.feature[t, node] == -1 and forest.path[t, node] == pytest.approx(depth + (c[0] * (1 - part) + c[1] * part if held > 1 else 0))
                assert (forest.leaves(t, x[here]) == node).all()
            else:
                less = x[here, forest.feature[t, node]] < forest.cut[t, node]
                left += [(2 * node + 1, depth + 1, here[less]), (2 * node + 2, depth + 1, here[~less])]


def test_nth_largest_with_ties(spark):
    values = [0.0, 0.25, 0.25, 0.25, 0.25 + 2**-54, 0.5, 0.5, 1.0, *(0.7 + k * 1e-9 for k in range(50))]
    df = spark.createDataFrame([(v,) for v in values], "score double")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 30, 51, 52, 53, 54, 55, 57, 58):
        assert quality.nth_largest(df, k) == ordered[k - 1]


# --- licences


def licence_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hits = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def licence_labels(texts, min_score=0.75):
    """Labels and score of each text, from every alignment of every template."""
    cut = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    known = [(label, key.split(), text.split()) for label, key, text in licenses.templates()]
    idf = {w: math.log((len(cut) + 1) / (sum(w in set(c) for c in cut) + 1)) + 1 for *_, text in known for w in text}
    for words in cut:
        labels, best = set(), 0.0
        for label, key, text in known:
            at = next(i for i in range(len(text)) if text[i : i + len(key)] == key)
            for off in range(-len(text), len(words)):
                same = [0 <= off + i < len(words) and words[off + i] == w for i, w in enumerate(text)]
                score = sum(idf[w] for w, x in zip(text, same, strict=True) if x) / sum(idf[w] for w in text)
                if score >= min_score - 1e-9 and all(same[at : at + len(key)]):
                    labels.add(label)
                    best = max(best, score)
        yield ",".join(sorted(labels)), min(1.0, best)


def test_licences(spark, odd_docs, no_docs):
    texts = [r.text for r in odd_docs.collect() if len(r.text or "") < 50_000]
    texts += ["MIT-License, and the Apache\nLicense! mit license", "general PUBLIC license general public", "licenseé mit licence", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "x " * 40 + "Licensed under CC BY-NC 4.0.", "license " * 500, "0 1 mit license 2"]
    texts += ["m\u0131t l\u0130cense M\u0130T \u212aey MIT L\u0130CENSE", "you may redistribute: THE ORIGIN OF THIS SOFTWARE MUST NOT BE MISREPRESENTED; you must not claim that you wrote the original program. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. " * 3, "mit license " * 40]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, words string")
    rows = licenses.scan(df.repartition(3)).collect()
    assert len(rows) == len(texts)
    want = list(licence_labels(texts))
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == licence_base(texts[r.doc_id])
        assert r.labels == want[r.doc_id][0] and math.isclose(r.score, want[r.doc_id][1], abs_tol=1e-8), texts[r.doc_id]
    by = {r.doc_id - len(texts): r for r in rows}
    assert by[-7].labels == "mit" and by[-7].n_base == 0 and by[-6].labels == "cc-by-nc" and by[-5].labels == "" and by[-2].labels == "zlib" and by[-1].n_base == 40
    assert licenses.scan(no_docs).count() == 0
    assert licenses.scan(odd_docs).count() == odd_docs.count()


# --- fingerprints


def true_likeness(a, b):
    sets = []
    for t in (a, b):
        w = t.encode().lower().split()
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


@data
@pytest.mark.parametrize("buckets", [1, 5])
def test_fingerprints(spark, buckets):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs, buckets=buckets).collect()}
    order = sorted(texts, reverse=True)
    assert len(got) == len(order)
    errors = []
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        t, cut = texts[a], len(texts[a]) // 3
        edited = t[: len(t) - cut] + texts[b][:cut]
        assert (got[a].n_chars, got[a].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        errors += [got[a].near_edited - true_likeness(t, edited), got[a].near_next - true_likeness(t, texts[b])]
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.06
    same = collections.defaultdict(set)
    for d, t in texts.items():
        same[t].add(got[d].fingerprint)
    assert all(len(v) == 1 for v in same.values())


def test_fingerprint_odd_rows(odd_docs, no_docs):
    for buckets in (1, 4):
        rows = fingerprints.fingerprint_edits(odd_docs, buckets=buckets).collect()
        assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r.doc_id for r in odd_docs.collect())
        by = {r.doc_id: r for r in rows}
        assert by[0].fingerprint == by[1].fingerprint == "" and by[0].n_chars == 0
        assert by[6].fingerprint == by[7].fingerprint and by[7].near_next in (0.0, 1.0)
    assert fingerprints.fingerprint_edits(no_docs).count() == 0


@pytest.mark.parametrize("crowd", [(5,), (None,), (9, 0), (None, 0, 1), (3, None, 9)])
def test_fingerprints_of_crowded_ids_do_not_depend_on_the_buckets(spark, crowd):
    rows = [(i % 10, f"plain text number {i} of a few words {i * i} here") for i in range(0, 30, 1 + (0 in crowd))]
    rows += [(i, f"crowded {n % 40} has words of its own {n % 40} and more {i}") for i in crowd for n in range(60)]
    rows += [(crowd[0], "the same row again and again in one id")] * 70 + [(crowd[-1], None)] * 50
    if None not in crowd:
        rows.append((None, "one row without an id"))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, at int").repartition(3)
    one, many = (collections.Counter(fingerprints.fingerprint_edits(docs, buckets=b).collect()) for b in (1, 12))
    assert sum(one.values()) == len(rows) and one == many
    bounds, _, repeats = fingerprints._bounds(docs, 12)
    assert set(bounds.hashes) >= set(crowd) and any(r[0] == crowd[0] for r in repeats)


def test_densification_is_unbiased():
    rng = np.random.default_rng(0)
    for size in (3, 40, 2000):
        errors = []
        for _ in range(60):
            both, own = rng.integers(0, 2**64, size, dtype=np.uint64), [rng.integers(0, 2**64, size // 2 + 1, dtype=np.uint64) for _ in range(2)]
            a, b = (np.unique(np.concatenate([both, o])) for o in own)
            errors.append(fingerprints.likeness(fingerprints.digits(a), fingerprints.digits(b)) - size / (size + 2 * (size // 2 + 1)))
        assert abs(np.mean(errors)) < 0.07
