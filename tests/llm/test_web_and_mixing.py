import collections
import math
import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pointframe.llm import htmltext, mixing, neardup, quality, urlrep
from pointframe.llm.common import store
from pointframe.llm.queries import URL_RULES, op9_url_filter, oracle_sql, table, tokenizer_path

SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href=x>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="wrap"><article class="post post-12"><header><h1>Head &amp; shoulders</h1></header><p>First  paragraph&nbsp;with <b>bold<p>Second&#39;s <a href="y">link</a> text
goes on</p><ul><li>one<li>two</ul><aside>related</aside><form><input><button>Send</button></form><table><tr><td>cell a<td>cell b</table>
<!-- hidden <p>comment</p> --><p>x &lt; y &am</p><div class="ad-box">Buy</div><section id="comments"><p>Nice post! Very very very long reader comment here.</p></section></article>
<div class="sidebar"><p>Side text that is long enough to matter a little.</p></div></div><footer>&copy; me</footer></body></html>"""


def path(*labels):
    """Digest of a path."""
    out = ""
    for label in labels:
        out = htmltext.step(out, label)
    return out


def test_page_text():
    want = "Head & shoulders\n\nFirst paragraph with bold\n\nSecond's link text goes on\n\none\n\ntwo\n\ncell a\n\ncell b\n\nx < y &am"
    assert htmltext.main_text(PAGE, None) == want
    assert htmltext.main_text(PAGE, path("html", "body", "div", "article.post.post-")) == want
    assert htmltext.main_text(PAGE, path("no", "such")) == want


def test_text_around_the_best_container():
    long, short = "Long text of the body. " * 30, "A lead or a smaller section."
    nested = f"<html><body><nav>menu</nav><article><h1>Title</h1><p>{short}</p><div class=entry><p>{long}</p></div></article><footer>end</footer></body></html>"
    headed = f"<html><body><main><article><header><h1>Title</h1></header><p>{short}</p><div class=entry><p>{long}</p></div></article></main></body></html>"
    plain = f"<html><body><div id=wrap><h1>Title</h1><ul><li><a href=/>Home of links</a></ul><p>{short}</p><div class=entry><p>{long}</p></div></div></body></html>"
    loose = f"<h1>Title</h1><div class=lead><p>{short}</p></div><div class=entry><p>{long}</p></div>"
    for source in (nested, headed, plain, loose):
        assert htmltext.main_text(source, None) == f"Title\n\n{short}\n\n{long.strip()}", source
    for around in ("article", "main", "div"):
        source = f"<html><body><{around}><section class=a><p>{long}</p></section><section class=b><p>{short}</p></section></{around}></body></html>"
        assert htmltext.main_text(source, None) == f"{long.strip()}\n\n{short}"
    two = f"<html><body><article class=a><p>{long}</p></article><article class=b><p>{short}</p></article></body></html>"
    assert htmltext.main_text(two, None) == f"{long.strip()}\n\n{short}"


def test_articles_keep_titles_lists_and_formulas():
    source = """<html><body><div class="header">site</div><article><div class="entry-header"><h1>Title</h1></div><div class="articleHeader">Sub</div>
    <div class="post-content"><p>Text with <math><mi>x</mi><mo>=</mo><mn>2</mn></math> inside.</p><ul class="social-facts"><li>fact one</li><li>fact two</li></ul>
    <div class="notice-of-motion"><p>Motion.</p></div><div class="ad-box">Buy</div><div class="share-buttons">Share</div><div class="site-notice">Old page</div><div id="postComments"><p>Reader!</p></div>
    <div class="wrap"><div class="sidebar-widget">Side</div><section class="results"><table class="data"><tr><td>cell</td></tr></table></section></div></div></article>
    <div class="promo-text">Promo</div></body></html>"""
    assert htmltext.main_text(source, None) == "Title\n\nSub\n\nText with x=2 inside.\n\nfact one\n\nfact two\n\nMotion.\n\ncell"


def test_paths_differ_at_any_depth():
    page = htmltext.Page("<div class=abcdefghij>" * 3000 + "<p>deep</p><section>x</section>")
    assert len(set(page.path)) == len(page.path) == 3003 and max(map(len, page.path)) == 24


def test_host_path_with_little_text():
    long = "Long text of the body. " * 30
    source = f"<html><body><article class=teaser><p>Tiny.</p></article><div class=entry><p>{long}</p></div></body></html>"
    assert htmltext.main_text(source, path("html", "body", "article.teaser")) == f"Tiny.\n\n{long.strip()}"


def post(text, extra=""):
    return f"<html><body><div class=layout><article class=post-17><h1>Post</h1><p>{text}</p></article>{extra}</div></body></html>"


def test_the_vote_leaves_teasers_out(spark):
    """A host's posts outvote what else is an article on its pages; without the vote the teasers are taken for text."""
    long, short = "A sentence of the post that goes on. " * 12, "A short post of two sentences. Nothing more."
    teasers = "".join(f"<article class=teaser><h2>Other {i}</h2><p>{'Read the other one. ' * 3}</p></article>" for i in range(2))
    rows = [(i, f"http://h.net/{i}", post(long, teasers if i % 2 else "")) for i in range(5)] + [(9, "http://h.net/9", post(short, teasers))]
    rows += [(10, "http://h.net/index", f"<html><body><div class=layout>{teasers}</div></body></html>")]  # lacks the path
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == f"Post\n\n{short}" and got[1] == f"Post\n\n{long.strip()}"
    assert "Other 1" in htmltext.main_text(rows[5][2], None) and "Other 1" in htmltext.main_text(rows[1][2], None)
    assert got[10].startswith("Other 0") and "Other 1" in got[10]


def test_an_article_never_gains_what_lies_around_it(spark):
    text = "Words of the page itself, and more of them. " * 8
    plain = [(i, f"http://b.net/{i}", f"<html><body><h1>T</h1><p>{text}</p></body></html>") for i in range(4)]
    page = f"<html><body><div class=teaser><p>Teaser before it.</p></div><article><h1>T</h1><p>{text}</p></article><div class=after><p>More from this site.</p></div></body></html>"
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame([*plain, (7, "http://b.net/7", page)], "page_id long, url string, html string")).collect()}
    assert set(got.values()) == {f"T\n\n{text.strip()}"}


def test_words_in_classes_lose_to_text():
    text = "Words of the page itself, and more of them. " * 6
    kept = ["<p class=share-price>Shares rose by two per cent.</p>", '<p class="footer-note">A note on the method.</p>', '<div class="alert-level-report"><p>The level is at three.</p></div>']
    gone = ['<div class="cookie-notice"><p>We use cookies.</p></div>', '<p class="ad-slot">Buy now.</p>', '<div class="related-stories"><a href=/1>One</a> <a href=/2>Two</a></div>', '<div class="left sidebar">Side.</div>', "<aside>Beside.</aside>"]
    want = "\n\n".join([text.strip(), "Shares rose by two per cent.", "A note on the method.", "The level is at three."])
    assert htmltext.main_text(f"<html><body><div><p>{text}</p>{''.join(kept)}</div>{''.join(gone)}</body></html>", None) == want
    kept = ['<blockquote class="comment">He said so.</blockquote>', "<aside>A pulled quote of five words.</aside>", '<div class="menu"><p>First soup, then fish, then fruit.</p></div>']
    gone = ['<div class="comments"><p>First!</p></div>', '<div class="share"><a href=/f>F</a> <a href=/t>T</a></div>', '<aside><a href=/x>See also</a></aside>', '<div class="advert">Buy now.</div>', "<nav>Up</nav>"]
    want = "\n\n".join([text.strip(), "He said so.", "A pulled quote of five words.", "First soup, then fish, then fruit."])
    assert htmltext.main_text(f"<html><body><article><p>{text}</p>{''.join(kept)}{''.join(gone)}</article></body></html>", None) == want


@pytest.mark.parametrize("html", ["", "<", "<p", "a<b", "<script>never ends", "<!-- open", "<p class='x>text</p>", "</p></div>x", "<div " * 50, "&", "<a b=\"c>d\">e</a>", "<p>" * 3000 + "x"])
def test_broken_markup(html):
    assert isinstance(htmltext.main_text(html, None), str)


def test_plain_text_and_no_article():
    assert htmltext.main_text("just words & more", None) == "just words & more"
    assert htmltext.main_text("<nav>menu</nav>", None) == ""
    assert htmltext.main_text(None, "x") == ""


def test_host_consensus(spark):
    odd = "<body><div class='main'><p>short</p></div><div class='promo2x'><p>{}</p></div></body>"
    rows = [(i, f"http://h.org/{i}", "<body><div class='main'><p>{}</p></div><div class='list'><p>ab</p></div></body>".format("long text " * 30)) for i in range(6)]
    rows += [(6, "http://H.org/6", odd.format("very long but other text " * 40)), (7, None, None), (8, "x", ""), (9, "http://other.net/", "<p>alone</p>"), (6, "http://H.org/6", odd.format("z"))]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "page_id long, url string, html string, host int, path string")
    got = htmltext.extract(df).collect()
    assert len(got) == 11
    by = {r.page_id: r for r in got}
    assert by[6].text == "short" and by[9].text == "alone" and by[7].text == "" and by[8].n_chars == 0
    assert htmltext.extract(df.limit(0)).count() == 0


@data
def test_pages_against_their_articles(spark):
    import html

    pages = table(spark, SF, "pages")
    got = {r.page_id: r.text for r in htmltext.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert got[r.page_id] == "\n\n".join(p for p in parts if p)


# --- URL filters


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_for(host, path):
    fits = [(len(t), t, v) for v, t in URL_RULES if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


def rates(outcomes):
    """bad_low, and whether it is worse than the whole, by host, from (host, bad) pairs and hosts without outcomes (bad None): the shrinkage in plain Python."""

    def place(h):
        w = re.sub(r":\d*$", "", h).split(".")
        deep = len(w) >= 3 and len(w[-1]) == 2 and w[-2] in urlrep.SECOND_LEVEL
        return (".".join(w[-3:]), ".".join(w[-2:])) if deep else (".".join(w[-2:]), w[-1])

    count = collections.defaultdict(lambda: [0, 0])
    for h, bad in outcomes:
        count[h]
        if bad is not None:
            count[h][0] += 1
            count[h][1] += bad

    def strength(groups):
        groups = [(n, b, m) for n, b, m in groups if n]
        spread = sum(n * (b / n - m) ** 2 / (m * (1 - m)) if m * (1 - m) > 0 else 0 for n, b, m in groups)
        total, g = sum(n for n, _, _ in groups), len(groups)
        below = total - sum(n * n for n, _, _ in groups) / total - (g - 1) if total else 0
        rho = max(0.005, min(0.9, (spread - (g - 1)) / below if below else 0.9))
        return 1 / rho - 1

    total, bad = (sum(c[i] for c in count.values()) for i in (0, 1))
    mean0 = (bad + 0.5) / (total + 1)
    dom, suf = (collections.defaultdict(lambda: [0, 0]) for _ in range(2))
    for h, (n, b) in count.items():
        for t, k in ((dom, place(h)), (suf, place(h)[1])):
            t[k][0] += n
            t[k][1] += b
    s = strength([(n, b, mean0) for n, b in suf.values()])
    mean1 = {k: (b + s * mean0) / (n + s) for k, (n, b) in suf.items()}
    s = strength([(n, b, mean1[k[1]]) for k, (n, b) in dom.items()])
    mean2 = {k: (b + s * mean1[k[1]]) / (n + s) for k, (n, b) in dom.items()}
    s = strength([(n, b, mean2[place(h)]) for h, (n, b) in count.items()])
    low = {}
    for h, (n, b) in count.items():
        a, c = b + s * mean2[place(h)], n - b + s * (1 - mean2[place(h)])
        m = a / (a + c)
        low[h] = max(0.0, m - 1.645 * math.sqrt(m * (1 - m) / (a + c + 1))), m > mean0
    return low


URLS = ["http://a.example.com/fr/x", "https://EXAMPLE.org/es/1", "http://x.example.org/en/12?q", "http://org/", "http://b.co.uk:80/p#f", "nothing", None, "://h", "http://bad.net", "http://bad.net/x", "http://ok.net/a//b", "x://a?b://c/d", "http://example.com/de/", "http://É.example.com/de"]


@pytest.mark.parametrize("limit", [0.3, 0.05])
def test_urls_against_plain_python(spark, limit):
    rows = [(i, u, "h", None) for i, u in enumerate(URLS * 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, bad int")
    seen = [(i, i % 14 in (8, 9) or i % 5 == 0) for i in range(0, 42, 1) if i % 14 not in (3, 7)] + [(4, None), (99, True), (None, True)]
    outcomes = spark.createDataFrame(seen, "page_id long, bad boolean")
    got = urlrep.judge_urls(pages, outcomes, URL_RULES, limit=limit).collect()
    assert len(got) == len(rows)
    known = collections.defaultdict(list)
    for i, bad in seen:
        known[i].append(bad)
    low = rates([(parts(u)[0], b) for i, u, *_ in rows for b in known.get(i, [None])])
    for r in got:
        host, path = parts(rows[r.page_id][1])
        rule, verdict = rule_for(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert math.isclose(r.bad_low, low[host][0], abs_tol=2e-9)
        assert r.verdict == (verdict or ("block" if low[host][1] and low[host][0] >= limit else "allow"))
    assert urlrep.judge_urls(pages.limit(0), outcomes, URL_RULES).count() == 0
    assert urlrep.judge_urls(pages, outcomes.limit(0), URL_RULES).count() == len(rows)


def test_limit_holds_back_good_outcomes(spark):
    """The limit is the lowest step that keeps good pages lost within bounds, in plain Python."""
    rng = random.Random(4)
    rows = [(f"h{i}", n := rng.randint(0, 40), rng.randint(0, n), rng.randint(0, 99) / 100, rng.random() < 0.5) for i in range(200)]
    frame = spark.createDataFrame([(h, n, b, low, 1.0 if w else 0.0) for h, n, b, low, w in rows], "host string, n long, bad long, bad_low double, bad_rate double").selectExpr("*", "0.5D as whole")
    for loss in (0.0, 0.01, 0.05, 0.5):
        room = loss * sum(n - b for _, n, b, _, _ in rows)
        fits = [k for k in range(0, 10001, 100) if sum(n - b for _, n, b, low, w in rows if w and math.floor(low * 10000) >= k) <= room]
        got = urlrep.limit_for(frame, loss)
        held = lambda limit: sum(n - b for _, n, b, low, w in rows if w and math.floor(low * 10000) >= round(limit * 10000))
        assert held(got) == held(min(fits) / 10000)
    assert urlrep.limit_for(frame.withColumn("bad", frame.bad * 0), 0.05) > 1


def test_bad_hosts_are_blocked_more(spark):
    """Outcomes of one half of the pages decide; the other half is judged."""
    rng = random.Random(8)
    rate = {f"w{i}.{'spam' if i % 5 == 0 else 'fine'}{i % 10}.net": 0.8 if i % 5 == 0 else 0.05 for i in range(60)}
    rows = [(i, f"http://{(h := rng.choice(sorted(rate)))}/{i}", rng.random() < rate[h]) for i in range(3000)]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, bad) for i, _, bad in rows if i % 2], "page_id long, bad boolean")
    verdict = {r.page_id: r.verdict for r in urlrep.judge_urls(pages, outcomes, URL_RULES).collect()}
    share = {b: [verdict[i] == "block" for i, _, bad in rows if not i % 2 and bad == b] for b in (True, False)}
    assert sum(share[True]) / len(share[True]) > 0.5 and sum(share[False]) / len(share[False]) < 0.08


@data
@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.1")])
def test_url_query(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rows = op9_url_filter(spark, sf).collect()
    want = con.sql(oracle_sql()["op9_url_filter"])
    assert sorted((tuple(r[c] for c in want.columns) for r in rows), key=repr) == sorted(want.fetchall(), key=repr)
    urls = {r.page_id: r.url for r in table(spark, sf, "pages").collect()}
    assert len(rows) == len(urls)
    assert all((r.host, r.path) == parts(urls[r.page_id]) and r.rule == rule_for(r.host, r.path)[0] for r in rows)
    if len(rows) > 1000:
        assert {r.verdict for r in rows if r.rule is None} == {"allow", "block"}


# --- mixing


def plain_targets(size):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(size.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= 2 * size[s]}
        if not full:
            out.update({s: left * weight[s] / total for s in open_})
            break
        out.update({s: 2.0 * size[s] for s in full})
        left -= sum(2 * size[s] for s in full)
        open_ -= full
    return out


def check_mix(rows, docs, tolerance):
    size, taken = collections.Counter(), collections.Counter()
    for r in docs:
        size[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = plain_targets(size)
    assert len(rows) == len(docs)
    for r in rows:
        assert r.source_size == size[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= tolerance(s), (s, taken[s], want[s])


@data
def test_mix(spark):
    docs = table(spark, SF, "documents")
    rows = mixing.mix(docs).collect()
    all_ = docs.collect()
    check_mix(rows, all_, lambda s: 400)
    again = mixing.mix(docs.repartition(9)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_mix_many_blocks(spark):
    rows = [(i, " ".join(["w"] * (1 + i * i % 97)), f"s{(i % 7) // 3}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check_mix(mixing.mix(docs).collect(), docs.collect(), lambda s: 40)
    copies = collections.Counter(r.doc_id for r in mixing.mixed_rows(docs).collect())
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix(docs).collect() if r.size}
    assert copies == collections.Counter({d: n for d, n in taken.items() if n})


def test_mix_many_sources(spark, monkeypatch):
    """Sources as many as hosts, of very different sizes: levels by rounds, and the same mix where sources are joined
    without a broadcast."""
    rng = random.Random(12)
    rows = [(i, "w " * rng.randint(0, 9), rng.choice([None, *"ab"]) if i % 3 == 0 else f"h{int(rng.paretovariate(0.6)) % 500}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    one = mixing.mix(docs).collect()
    check_mix(one, docs.collect(), lambda s: 9)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted((r.doc_id, r.taken, r.target) for r in mixing.mix(docs).collect()) == sorted((r.doc_id, r.taken, r.target) for r in one)


def test_mix_targets_when_all_are_full(spark):
    sizes = spark.createDataFrame([("a", 4), ("b", 6), (None, 0)], "source string, size long")
    got = {r.source: (r.n, r.source_size, r.target) for r in mixing.source_targets(sizes, share=3.0, most=2.0).collect()}
    assert got == {"a": (1, 4, 8.0), "b": (1, 6, 12.0), None: (1, 0, 0.0)}
    assert mixing.source_targets(sizes.limit(0)).count() == 0


def plain_pivotal(rng, docs):
    """Copies of (size, expected copies) by pairwise rounding of words, one after the other; the last one at random."""
    out = [math.floor(p) for _, p in docs]
    carry = None
    for i, (size, p) in enumerate(docs):
        p -= out[i]
        if carry is None:
            carry = (i, size, p)
            continue
        j, other, q = carry
        up, down = min((1 - q) * other, p * size), min(q * other, (1 - p) * size)
        move = up if rng.random() * (up + down) < down else -down
        q, p = q + move / other, p - move / size
        ends = [(k, v) for k, v in ((j, q), (i, p)) if min(v, 1 - v) < 1e-9]
        for k, v in ends:
            out[k] += round(v)
        rest = [(k, s, v) for k, s, v in ((j, other, q), (i, size, p)) if k not in dict(ends)]
        carry = rest[0] if rest else None
    if carry:
        out[carry[0]] += rng.random() < carry[2]
    return out


def test_mix_expected_copies(spark):
    """Over many sources of the same documents, small and large ones are copied as often as a plain pivotal run does."""
    sizes, sources = [3 + 7 * j % 50 for j in range(80)], 240
    rows = [(s * 1000 + j, "w " * n, f"s{s:03}") for s in range(sources) for j, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    rng, got, want = random.Random(4), collections.defaultdict(list), collections.defaultdict(list)
    for r in mixing.mix(docs).collect():
        got[r.target, r.size // 10].append(r.taken / r.size - r.target / r.source_size)
    for target in {t for t, _ in got}:
        ratio = target / sum(sizes)
        for _ in range(sources // 3):
            for n, c in zip(sizes, plain_pivotal(rng, [(n, ratio) for n in sizes]), strict=True):
                want[target, n // 10].append(c - ratio)
    for key, off in got.items():
        assert abs(np.mean(want[key])) < 0.05 and abs(np.mean(off)) < 0.05, (key, np.mean(off), np.mean(want[key]), len(off))


@pytest.mark.parametrize("doc_id", ["7L", "cast(null as long)"])
def test_mix_one_document_repeated(spark, doc_id):
    """A hundred thousand rows of one document are dealt to many blocks and numbered without gaps."""
    docs = spark.range(100_000, numPartitions=5).selectExpr(f"{doc_id} as doc_id", "'a b c' as text", "'s' as source").unionByName(spark.createDataFrame([(i, "w " * (i % 50 + 1), "t") for i in range(2000)], "doc_id long, text string, source string"))
    started = time.perf_counter()
    taken = collections.Counter()
    for r in mixing.mix(docs).groupBy("source", "target", "taken", "size").count().collect():
        taken[r.source, r.target] += r.taken * r["count"]
        assert r.taken <= 2 * r.size
    assert all(abs(n - target) < 60 for (_, target), n in taken.items()) and len(taken) == 2
    assert time.perf_counter() - started < 90
    sizes = docs.selectExpr("doc_id", "source", "3L as size").withColumn("row", F.monotonically_increasing_id())
    seen = mixing.with_occurrence(sizes).where("source = 's'").selectExpr("count(distinct nth) n", "max(nth) m").first()
    assert (seen.n, seen.m) == (100_000, 99_999)


def test_mix_odd_rows(odd_docs, no_docs):
    check_mix(mixing.mix(odd_docs).collect(), odd_docs.collect(), lambda s: 40_000)
    assert mixing.mix(no_docs).count() == 0
    assert mixing.mixed_rows(odd_docs).columns == odd_docs.columns and mixing.mixed_rows(no_docs).count() == 0


CLASHES = ("_id", "_key", "_lost", "_row", "_copy", "_copies", "_salt", "_salts", "row", "copies", "nth", "size")


@pytest.fixture(scope="module")
def clashing(spark):
    """Rows that share ids, with columns named like helpers, whose values must come back."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(30)) for _ in range(12)]
    rows = [(i % 9 if i % 7 else None, texts[i % 12], ("a", None, "b")[i % 3], *([-7 - i] * len(CLASHES))) for i in range(36)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} long" for c in CLASHES))


def test_helper_names_do_not_clash(clashing):
    given = {tuple(r) for r in clashing.collect()}
    mixed = mixing.mixed_rows(clashing)
    assert mixed.columns == clashing.columns and {tuple(r) for r in mixed.collect()} <= given
    kept = neardup.keep_one(clashing)
    rows = [tuple(r) for r in kept.collect()]
    assert kept.columns == clashing.columns and set(rows) <= given and len(rows) == len({r[1] for r in rows}) == 12
    assert neardup.near_duplicates(clashing).count() == 36 and len(mixing.mix(clashing).collect()) == 36


# --- pipeline


def plain_pipeline(docs, decided):
    """(doc_id, text, source) rows kept at each stage. The two learned verdicts are given by text; the rest is plain Python."""
    out = [docs]
    for verdict in decided:
        out.append([r for r in out[-1] if verdict(r[1])])
    sets = []
    for _, text, _ in out[-1]:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, r in enumerate(out[-1]):
        groups[find(i)].append(r)
    return out, list(groups.values())


@pytest.fixture(scope="module")
def small_corpus(spark, tmp_path_factory):
    """Four languages of the given tables, with copies, near copies, rows without id, text or source, and repeated rows."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()][:120]
    words_ = docs[3][1].split() + docs[5][1].split() * 3
    near = " ".join(words_[:150])
    docs += [(9001, near, "en", "s", 1), (9002, near + " tail", "en", "s", 1), (9003, near.upper(), "en", None, 1), (9004, None, None, None, None), (9005, "", "en", "s", 0), (None, near, None, "s", None), (None, None, None, None, None)]
    docs += [docs[7], docs[7], docs[8]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    table(spark, SF, "labels").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_pipeline_against_plain_python(spark, small_corpus):
    """Every stage's rows, and the packed pieces."""
    docs = table(spark, small_corpus, "documents")
    given = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    passed = {r.text for r in corpus_pipeline.STAGES[0][1](spark, docs, small_corpus).collect()}
    judged = quality.quality_rules(docs, table(spark, small_corpus, "labels")).select("doc_id", "kept").collect()
    assert {r.doc_id for r in judged if r.kept and r.doc_id} == {d for d, t, _ in given if d and t in passed}  # the pipeline's verdicts are the operator's
    good = [r for r in given if r[1] in passed]
    assert all(len((t or "").split()) >= 50 for _, t, _ in good)
    stage_rows, now = [], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, small_corpus)
        assert now.columns == docs.columns
        now = store(now, "test-stage")
        stage_rows.append([(r.doc_id, r.text, r.source) for r in now.collect()])
    spoken = {t for _, t, _ in stage_rows[1]}
    kept, groups = plain_pipeline(given, [lambda t: t in passed, lambda t: t in spoken])
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2] or "")
    assert sorted(stage_rows[0], key=key) == sorted(kept[1], key=key) and sorted(stage_rows[1], key=key) == sorted(kept[2], key=key)
    assert len(stage_rows[2]) == len(groups) < len(stage_rows[1])
    assert all(sum(r in stage_rows[2] for r in set(g)) == 1 for g in groups)
    size = collections.Counter()
    for _, t, s in stage_rows[2]:
        size[s] += len(t.split())
    want = plain_targets(size)
    taken = collections.Counter()
    for _, t, s in stage_rows[3]:
        taken[s] += len(t.split())
    longest = max(len(t.split()) for _, t, _ in stage_rows[2])
    assert all(abs(taken[s] - want[s]) <= longest for s in want) and set(stage_rows[3]) <= set(stage_rows[2])
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    pieces = corpus_pipeline.run(spark, small_corpus).collect()
    lengths = collections.Counter()
    for d, t, _ in stage_rows[3]:
        lengths[d, len(tok.encode(t, add_special_tokens=False).ids) + 1] += 1
    whole = collections.Counter()
    for r in pieces:
        whole[r.doc_id] += r.length
    per = collections.Counter()
    for (d, n), times in lengths.items():
        per[d] += n * times
    assert whole == per
    bins = collections.defaultdict(list)
    for r in pieces:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 2048


def test_pipeline_deletes_its_stages(spark, small_corpus):
    import glob

    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{shared}/pointframe/**/pipeline-*", recursive=True))
    assert corpus_pipeline.run(spark, small_corpus).count()
    assert set(glob.glob(f"{shared}/pointframe/**/pipeline-*", recursive=True)) == before


def test_pipeline_of_an_empty_table(spark, tmp_path):
    table(spark, SF, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, SF, "labels").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@data
def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
