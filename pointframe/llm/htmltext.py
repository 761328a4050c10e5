"""Main text of web pages by consensus paths of their host.

Each page scores its containers: the text of a block goes to the element around
it and, halved, to the one above, less what lies in links. From the best container
it climbs to the outermost article or main around it, or else to the body, so that
titles, leads and smaller sections beside the best container stay. That element's
generalised path (tags with their classes, digits removed) is a vote weighted by
the container's characters. A path is carried as a digest of its parent's digest
and its own step, of one size at any depth. Votes are summed per host in Spark, and
every page of the host is extracted again from the elements on the winning path
alone: what else looks like an article there (teasers, comments) is left out. The page's
own choice serves where it lacks that path, where the path holds under ``LEAST`` of
the text of its own choice, and where an article of its own lies within a winning body, so that a page with
an article never gains what lies around it. A page without any container gives its
whole body.

Inside the chosen elements everything is kept except elements that are not
article text (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments), found by tag, role, or class and id, and, where there is no article or
main, blocks of links outside the best container. All words of a class or id must
be such or say nothing ("ad-box"): then the element goes. Where only some are
("share-price", "footer-note"), and within an article for quotes, only
its blocks of links go, and for names of menus those under four words too. The name of a header within an article is
none, for it may hold the title.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointframe.llm.common import salted_join, store

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")

# Fixed values of HTML: kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp noscript template svg annotation object select canvas audio video".split())
MAIN = ("article", "main")
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("nav aside footer form button input label menu dialog head search".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Words of a class or id that mark an element as not part of the article.
BOILERPLATE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget related recommended share sharing social comment comments disqus respond reply replies footer header masthead copyright pagination pager toolbar skip".split())
#: Those of them that name lists of links: within an article such an element goes only as far as it is links.
LINKY = frozenset("nav navbar navigation menu breadcrumb breadcrumbs related recommended share sharing social pagination pager toolbar skip".split())
#: Words that say nothing about what an element holds.
NEUTRAL = frozenset("area bar block body box button buttons cell column container content entry first fixed global group holder inline inner item items label large last left link links list local main mobile desktop module outer page panel post posts primary right row secondary section site slot small sticky sub tab tabs text title top bottom unit user wrap wrapper".split())
#: Quoted or drawn text: within an article a class alone does not remove it.
QUOTED = frozenset("blockquote pre figure q".split())
#: Share of the text of a page's own choice that the winning path must hold.
LEAST = 0.25
#: Words that do not count inside an article.
TITLES = frozenset("header masthead banner".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
_WORDS = re.compile(r"[a-z]+")


def step(above: str, label: str) -> str:
    """Digest of the path that goes on from ``above`` with one element."""
    return hashlib.blake2b(f"{above}>{label}".encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


class Page:
    """Blocks of text with the elements around them, from one pass over the markup."""

    def __init__(self, source: str):
        self.path: list[str] = [""]  # digest of the generalised path by element
        self.above: list[int] = [0]
        self.tag: list[str] = [""]
        self.blocks: list[tuple[int, str, int, bool]] = []  # element, text, characters in links, dropped
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int, int, bool, bool]] = [("", 0, 0, False, False)]  # tag, element, dropped, in link, in article
        parts: list[str] = []
        links = 0

        def flush() -> None:
            nonlocal links
            if parts:
                if text := " ".join("".join(parts).split()):
                    level = stack[-1][2]
                    drop = level == 3 or level > 0 and len(text) <= 2 * links or level == 2 and text.count(" ") < 3
                    self.blocks.append((stack[-1][1], text, links, drop))
                parts.clear()
                links = 0

        def add(raw: str) -> None:
            nonlocal links
            if raw:
                text = html.unescape(raw) if "&" in raw else raw
                parts.append(text)
                if stack[-1][3]:
                    links += len(text)

        def close(names: tuple[str, ...], within: frozenset[str]) -> None:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in names:
                    if any(t[0] in BLOCK for t in stack[k:]):
                        flush()
                    del stack[k:]
                    return
                if stack[k][0] in within:
                    return

        at, end = 0, len(source)
        while at < end:
            m = _TOKEN.search(source, at)
            if not m:
                add(source[at:])
                break
            add(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, closing, attrs = name.lower(), m[1] or m[4], m[3] or m[6] or ""
            if closing:
                if name == "br":
                    parts.append(" ")
                else:
                    close((name,), frozenset() if name in BLOCK else BLOCK)
                continue
            if name in RAW:
                if not attrs.rstrip().endswith("/"):
                    stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
                    tail = source.find(">", stop.end()) if stop else -1
                    at = tail + 1 if tail >= 0 else end
                continue
            if name in BLOCK:
                close(("p",), BLOCK - {"p"})
                if name in CLOSES:
                    close(CLOSES[name], frozenset(("ul", "ol", "dl", "table", "select")))
                flush()
            elif name == "br":
                parts.append(" ")
            if name in VOID:
                continue
            top = stack[-1]
            known = {a.lower(): b or c or d for a, b, c, d in _ATTR.findall(attrs)} if attrs else {}
            dropped = max(top[2], self._boilerplate(name, known, top[4]))
            element = top[1]
            if name in BLOCK:
                element = len(self.path)
                label = name + "".join(f".{w}" for w in sorted(re.sub(r"\d+", "", known["class"]).split())) if known.get("class") else name
                self.path.append(step(self.path[top[1]], label))
                self.above.append(top[1])
                self.tag.append(name)
            stack.append((name, element, dropped, top[3] or name == "a", top[4] or name in MAIN))
        flush()

    @staticmethod
    def _boilerplate(name: str, attrs: dict[str, str], inside: bool) -> int:
        """What is no article text of an element: 3 all, 2 links and blocks under four words, 1 links; ``inside``: within an
        article."""
        if name in DROPPED and not (inside and name == "aside") or name == "header" and not inside:
            return 3
        level = 2 if name == "aside" else 0
        if name in ("html", "body", *MAIN) or not attrs:
            return level
        if attrs.get("role", "").lower() in ROLES or attrs.get("aria-hidden") == "true" or "hidden" in attrs:
            return 3
        marks = f"{attrs.get('class', '')} {attrs.get('id', '')}"
        if len(marks) < 2:
            return level
        for x in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", marks).lower().split():
            said = {w for w in _WORDS.findall(x) if len(w) > 1} - NEUTRAL
            bad = said & (BOILERPLATE - TITLES if inside else BOILERPLATE)
            if bad and bad == said:
                level = max(level, 1 if inside and name in QUOTED else 2 if inside and said <= LINKY else 3)
            elif bad and not inside:
                level = max(level, 1)
        return level

    def container(self) -> tuple[str, int] | None:
        """Path and score of the best container."""
        score: dict[int, int] = {}
        for element, text, links, dropped in self.blocks:
            if dropped:
                continue
            worth = 2 * max(0, len(text) - 2 * links)
            box = element
            while self.tag[box] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "ul", "ol"):
                box = self.above[box]
            score[box] = score.get(box, 0) + worth
            if up := self.above[box]:
                score[up] = score.get(up, 0) + worth // 2
        for box in score:
            if self.tag[box] in MAIN:
                score[box] = score[box] * 3 // 2
        by_path: dict[str, int] = {}
        for box, n in score.items():
            if box and n > 0:
                by_path[self.path[box]] = by_path.get(self.path[box], 0) + n
        return min(by_path.items(), key=lambda x: (-x[1], x[0])) if by_path else None

    def best(self) -> tuple[str, int] | None:
        """Path of the element that holds the whole main text, and the score of the best container."""
        if not (won := self.container()):
            return None
        box, around = self.path.index(won[0]), []
        while box:
            around.append(box)
            box = self.above[box]
        tops = [e for e in around if self.tag[e] in MAIN] or [e for e in around if self.tag[e] == "body"] or [0]
        return self.path[tops[-1]], won[1]

    def _under(self, roots: set[int]) -> list[bool]:
        under = [e in roots for e in range(len(self.path))]
        for e in range(1, len(under)):
            under[e] = under[e] or under[self.above[e]]
        return under

    def text(self, path: str | None = None, beside: bool = False) -> str:
        """Blocks under the elements with this path (None: all), in page order; ``beside``: if they are articles, under the
        page's other articles too."""
        kept = [b for b in self.blocks if not b[3]]
        if path is not None:
            roots = {e for e, p in enumerate(self.path) if p == path}
            if beside and any(self.tag[e] in MAIN for e in roots):
                roots |= {e for e, t in enumerate(self.tag) if t in MAIN}
            loose = self._under({e for e in roots if self.tag[e] in ("", "html", "body")})
            won = self.container()
            sure = self._under({e for e, p in enumerate(self.path) if won and p == won[0] or self.tag[e] in MAIN})
            under = self._under(roots)
            kept = [b for b in kept if under[b[0]] and not (loose[b[0]] and not sure[b[0]] and len(b[1]) <= 2 * b[2])]
        return "\n\n".join(b[1] for b in kept)

    def narrower(self, path: str, own: str) -> bool:
        """Whether this page's own choice is an article and the path leads to something else around articles."""
        roots = {e for e, p in enumerate(self.path) if p == path}
        tops = {e for e, p in enumerate(self.path) if p == own and self.tag[e] in MAIN}
        under = self._under(roots)
        return not any(self.tag[e] in MAIN for e in roots) and any(under[e] for e in tops)


def host_of(url: str = "url"):
    """Lower-cased host of a url column; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sums: dict[tuple[str, str], int] = {}
        for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
            if source and (won := Page(source).best()):
                sums[host, won[0]] = sums.get((host, won[0]), 0) + won[1]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], names=["host", "path", "votes"])


def main_text(source: str | None, path: str | None) -> str:
    """Text of one page: from its host's path, or from its own choice where that path does not serve."""
    if not source:
        return ""
    page = Page(source)
    own = page.best()
    voted = page.text(path) if path is not None and path in page.path else ""
    if not own:
        return voted or page.text()
    if own[0] == path:
        return voted
    mine = page.text(own[0], beside=True)
    if not voted or len(voted) < LEAST * len(mine) or page.narrower(path, own[0]):
        return mine
    return voted


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(h, p) for h, p in zip(b.column("html").to_pylist(), b.column("path").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), b.column("path")], names=["page_id", "url", "text", "n_chars", "path"])


def host_paths(pages: DataFrame) -> DataFrame:
    """host and the digest of its winning path (most votes, then the first in order)."""
    rows = pages.select(host_of().alias("host"), "html")
    votes = rows.mapInArrow(_votes, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return votes.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("n"), "path"))["path"].alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and path (its host's) of every page.

    Null html or html without text gives an empty text, a null url belongs to the
    host without a name, repeated rows are extracted one by one, other columns are
    ignored, and an empty table gives no rows. Winning paths are broadcast while
    hosts are few and short; beyond that pages meet them on host and a salt, so that
    one host's pages spread over many tasks.
    """
    paths = store(host_paths(pages), "paths")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of().alias("host"), "html")
    seen = paths.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("host") + 24), F.lit(0)).alias("b")).first()
    joined = salted_join(rows, paths, ["host"], seen["n"], seen["b"], "left")
    return joined.select("page_id", "url", "html", "path").mapInArrow(_extract, "page_id long, url string, text string, n_chars long, path string")
