"""Language identification by prediction by partial matching (PPM).

Every language has its own tree of byte contexts (up to ``order`` preceding bytes)
with symbol counts, grown from a bounded sample of its labelled documents. Counts
are frozen and turned, with escape probabilities of method C and exclusion of the
symbols already seen in longer contexts, into exact code lengths. A document's code
length under a language is the sum over its bytes: the longest known context is
found by walking the language's tree backwards from each byte, and the byte's own
count by walking back towards the root until a context has seen it, for all
positions at once.

Trees are sparse (links and counts of the bytes that occurred, rows interleaved in
flat tables), grown by one task a language, and their sizes are known before any is
broadcast: languages go by groups of at most ``MODEL_BYTES``, one pass over the
texts for each group.

Null text, or text without a letter: ``und`` with score 0. Ties go to the
language that sorts first. Without a labelled document every text is ``und``.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from pointframe.llm.common import forget, release, store, trim, unused

ORDER = 4

#: Bytes of trees that are broadcast at a time.
MODEL_BYTES = 200 << 20

#: No byte costs more bits than this.
_MOST_BITS = -np.log2(1e-12)

_LETTER = regex.compile(r"\p{L}")


@dataclass
class Sparse:
    """Rows of a nodes x 256 table, of which few cells are filled: the rows lie interleaved in one flat table, each from
    its own base on, and a slot names the row that owns it."""

    base: np.ndarray  # node -> slot of its byte 0
    owner: np.ndarray  # slot -> node, or -1
    value: np.ndarray

    def find(self, node: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of cells, and whether these cells are filled."""
        slot = self.base[node] + byte
        return slot, self.owner[slot] == node


def interleaved(rows: list[tuple[list[int], list[float]]], kind: type) -> Sparse:
    """Rows of (bytes, values), full ones first, each at the first base where its slots are free; rows of one length go on
    from the base that the last one found, single cells fill what is left."""
    base = np.zeros(len(rows), np.int32)
    used = np.zeros(1 << 12, bool)
    since: dict[int, int] = {}
    owner, value = np.full(len(used), -1, np.int32), np.zeros(len(used), kind)
    ahead = np.arange(256)
    for v in sorted(range(len(rows)), key=lambda v: -len(rows[v][0])):
        at = np.array(rows[v][0], np.int64)
        if not len(at):
            continue
        b = since.get(len(at), 0)
        while True:
            if b + 768 > len(used):
                used = np.concatenate([used, np.zeros(len(used), bool)])
                owner = np.concatenate([owner, np.full(len(owner), -1, np.int32)])
                value = np.concatenate([value, np.zeros(len(value), kind)])
            free = ~used[(b + ahead)[:, None] + at].any(1)
            if free.any():
                b += int(free.argmax())
                break
            b += 256
        since[len(at)] = b
        base[v], used[b + at], owner[b + at], value[b + at] = b, True, v, rows[v][1]
    end = int(base.max(initial=0)) + 256
    return Sparse(base, owner[:end].copy(), value[:end].copy())


@dataclass
class Tree:
    """Frozen statistics of one language; node 0 is the dead end, node 1 the root.

    All costs are in bits. A byte that a context has seen costs ``own`` less the
    logarithm of its count. Else it costs ``escape``, and is looked up in the shorter
    context without the bytes that the longer one has seen: there it costs ``under``
    (of the longer one) less the logarithm, or ``fall`` and the next shorter one's.
    ``beyond`` is the cost of a byte that the root has not seen.
    """

    links: Sparse  # node and preceding byte -> node of the longer context
    counts: Sparse  # node and byte -> logarithm of the count
    parent: np.ndarray
    own: np.ndarray
    escape: np.ndarray
    under: np.ndarray
    fall: np.ndarray
    beyond: float

    def arrays(self) -> list[np.ndarray]:
        pair = [x for t in (self.links, self.counts) for x in (t.base, t.owner, t.value)]
        return [*pair, self.parent, self.own, self.escape, self.under, self.fall, np.array([self.beyond])]

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, *self.arrays())
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> Tree:
        with np.load(io.BytesIO(raw)) as f:
            a = [f[f"arr_{n}"] for n in range(12)]
        return Tree(Sparse(*a[:3]), Sparse(*a[3:6]), *a[6:11], float(a[11][0]))

    def contexts(self, before: list[np.ndarray]) -> np.ndarray:
        """Node of the longest known context of each position; ``before`` has the bytes one, two, ... back."""
        best = np.ones(len(before[0]), np.int32) if before else np.empty(0, np.int32)
        at, node = np.arange(len(best)), best
        for byte in before:
            slot, known = self.links.find(node, byte[at])
            at, node = at[known], self.links.value[slot[known]]
            best[at] = node
        return best

    def bits(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Code length of each byte in its context."""
        slot, seen = self.counts.find(node, byte)
        cost = self.own[node].astype(np.float64) - self.counts.value[slot]
        at = np.flatnonzero(~seen)
        u = node[at]
        cost[at] = self.escape[u]
        while len(at):
            end = u == 1
            cost[at[end]] += self.beyond
            at, u = at[~end], u[~end]
            w = self.parent[u]
            slot, seen = self.counts.find(w, byte[at])
            cost[at] += np.where(seen, self.under[u] - self.counts.value[slot], self.fall[u])
            at, u = at[~seen], w[~seen]
        return np.minimum(cost, _MOST_BITS)


@dataclass
class Model:
    """Languages, in order, with their trees."""

    langs: list[str]
    trees: list[Tree]
    order: int

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Exact code length in bits of every text under every language."""
        out = np.zeros((len(texts), len(self.langs)))
        ends = np.cumsum([len(t) + self.order for t in texts])
        pad = b"\x00" * self.order
        buf = np.frombuffer(pad + b"".join(t + pad for t in texts), np.uint8)
        step = 1 << 18
        total = len(buf) - self.order
        starts = ends - np.array([len(t) + self.order for t in texts])
        stops = ends - self.order
        for lo in range(0, total, step):
            hi = min(total, lo + step)
            first, last = np.searchsorted(stops, lo, "right"), np.searchsorted(starts, hi, "left")
            a = np.clip(starts[first:last], lo, hi) - lo
            b = np.clip(stops[first:last], lo, hi) - lo
            here = buf[lo + self.order : hi + self.order]
            before = [buf[lo + self.order - d : hi + self.order - d] for d in range(1, self.order + 1)]
            run = np.zeros(hi - lo + 1)
            for k, tree in enumerate(self.trees):
                np.cumsum(tree.bits(tree.contexts(before), here), out=run[1:])
                out[first:last, k] += run[b] - run[a]
        return out

    def judge(self, texts: list[str | None], so_far: list[tuple[str, float, float]] | None = None) -> list[tuple[str, float, float]]:
        """Best language of every text, its code length, and the sum over languages of two to the power of minus their
        excess, scaled to at most 64 bytes. ``so_far`` is what other languages, before these in order, gave."""
        out = [("und", 0.0, 0.0)] * len(texts) if so_far is None else list(so_far)
        known = [i for i, t in enumerate(texts) if t and self.langs and _LETTER.search(t)]
        raw = [normal(texts[i]) for i in known]
        at = 0
        while at < len(raw):  # bounded buffers, whatever the lengths
            end, size = at, 0
            while end < len(raw) and (end == at or size + len(raw[end]) < 4 << 20):
                size += len(raw[end])
                end += 1
            for k, row in enumerate(self.code_lengths(raw[at:end])):
                i = known[at + k]
                scale = min(1.0, 64 / max(1, len(raw[at + k])))
                best = int(np.argmin(row))
                lang, low, mass = out[i]
                if not mass or row[best] < low:
                    mass = mass * float(np.exp2((row[best] - low) * scale)) if mass else 0.0
                    lang, low = self.langs[best], float(row[best])
                out[i] = (lang, low, mass + float(np.exp2((low - row) * scale).sum()))
            at = end
        return out


def normal(text: str) -> bytes:
    """What is modelled: the lower-cased text's UTF-8 bytes."""
    return text.lower().encode("utf-8", "surrogatepass")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the documents that are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % 3 == 1, F.lit(False))


def _contexts(order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, list[bytes]] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(normal(text))
        for lang, texts in by_lang.items():
            pad = b"\x00" * order
            buf = np.frombuffer(pad + b"".join(t + pad for t in texts), np.uint8).astype(np.int64)
            real = np.ones(len(buf), bool)
            at = 0
            real[:order] = False
            for t in texts:
                at += order + len(t)
                real[at : at + order] = False
            pos = np.flatnonzero(real)
            key = np.zeros(len(pos), np.int64)
            for d in range(order + 1):
                if d:
                    key = key | (buf[pos - d] << (8 * (d - 1)))
                full, n = np.unique((key << 8) | buf[pos], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n)), pa.array([d] * len(n), pa.int32()), pa.array(full >> 8), pa.array((full & 255).astype(np.int32)), pa.array(n.astype(np.int64))],
                    names=["lang", "depth", "ctx", "sym", "n"],
                )

    return count


def fit(docs: DataFrame, order: int = ORDER, docs_per_lang: int = 150, min_count: int = 12, seed: int = 17) -> DataFrame:
    """lang, order, size and tree of every language: learned from text and lang of the documents that are not held out.

    Bound of the training sample: about ``docs_per_lang`` whole documents of each
    language, chosen by a hash of doc_id; repeated rows count once. A context becomes
    a node of a language's tree when that language's sample shows it ``min_count``
    times, however rare the language is. Null texts, langs and doc_ids do not teach.
    A tree is made from its language's nodes by one task; ``size`` is its bytes.
    """
    train = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = store(train.groupBy("lang").agg(F.count("*").alias("n")), "lang-sizes")
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    taught = train.where(F.col("text").isNotNull())
    shares = {r["lang"]: docs_per_lang / r["n"] for r in sizes.collect()}  # one row a language
    if not shares:
        return docs.sparkSession.createDataFrame([], "lang string, order int, size long, tree binary")
    share = F.create_map(*[F.lit(x) for k in sorted(shares) for x in (k, float(shares[k]))])
    sample = taught.where(draw < share[F.col("lang")]).dropDuplicates(["doc_id", "lang", "text"]).repartition("lang")  # each context of a language is counted once
    counts = sample.select("lang", "text").mapInArrow(_contexts(order), "lang string, depth int, ctx long, sym int, n long")
    grams = counts.groupBy("lang", "depth", "ctx", "sym").agg(F.sum("n").alias("n")).groupBy("lang", "depth", "ctx").agg(F.sum("n").alias("total"), F.collect_list("sym").alias("sym"), F.collect_list("n").alias("n"))
    nodes = grams.where((F.col("total") >= min_count) | (F.col("depth") == 0)).select("lang", "depth", "ctx", "sym", "n")  # at most the sample's bytes / min_count rows

    def grown(rows: pa.Table) -> pa.Table:
        cells = zip(*(rows.column(c).to_pylist() for c in ("depth", "ctx", "sym", "n")), strict=True)
        t = tree({(d, c): dict(zip(s, n, strict=True)) for d, c, s, n in cells}, order)
        return pa.table({"lang": rows.column("lang").slice(0, 1), "order": pa.array([order], pa.int32()), "size": [sum(a.nbytes for a in t.arrays())], "tree": pa.array([t.dump()], pa.binary())})

    return store(nodes.groupBy("lang").applyInArrow(grown, "lang string, order int, size long, tree binary"), "lang-trees")


def tree(grams: dict[tuple[int, int], dict[int, int]], order: int) -> Tree:
    """One language's tree from the counts of bytes by (depth, context); a context's last byte is its lowest."""
    nodes: dict[tuple[int, int], int] = {}
    shorter = lambda depth, ctx: (depth - 1, ctx & ((1 << (8 * (depth - 1))) - 1))
    for depth, ctx in sorted(grams):
        if depth == 0 or (depth <= order and shorter(depth, ctx) in nodes):
            nodes[depth, ctx] = len(nodes) + 1
    rows = {v: grams[key] for key, v in nodes.items()}
    parent = np.zeros(len(nodes) + 1, np.int32)
    links: list[tuple[list[int], list[float]]] = [([], []) for _ in parent]
    own, escape, under, fall = (np.zeros(len(parent), np.float32) for _ in range(4))

    def costs(size: int, kinds: int) -> tuple[float, float]:
        """Of a byte before its count, and of an escape (method C); nothing left: the escape is free."""
        return float(np.log2(max(1, size + kinds))), float(np.log2((size + kinds) / kinds)) if kinds else 0.0

    for (depth, ctx), v in nodes.items():
        seen = rows[v]
        own[v], escape[v] = costs(sum(seen.values()), len(seen))
        if depth:
            p = parent[v] = nodes[shorter(depth, ctx)]
            links[p][0].append(ctx >> (8 * (depth - 1)))
            links[p][1].append(v)
            left = [n for s, n in rows[p].items() if s not in seen]
            under[v], fall[v] = costs(sum(left), len(left))
    counts = [(sorted(rows[v]), [float(np.log2(rows[v][s])) for s in sorted(rows[v])]) if v else ([], []) for v in range(len(parent))]
    return Tree(interleaved(links, np.int32), interleaved(counts, np.float32), parent, own, escape, under, fall, float(np.log2(max(1, 256 - len(rows.get(1, ()))))))


def groups(trees: DataFrame, most: int = MODEL_BYTES) -> list[list[str]]:
    """Languages, in order, by groups whose trees have at most ``most`` bytes; a larger tree is a group of its own."""
    out: list[list[str]] = []
    size = 0
    for lang, n in sorted((r["lang"], r["size"]) for r in trees.select("lang", "size").collect()):  # one row a language
        if not out or size + n > most:
            out.append([])
            size = 0
        out[-1].append(lang)
        size += n
    return out


def model(trees: DataFrame, langs: list[str]) -> Model:
    """The trees of some languages."""
    rows = sorted(trees.where(F.col("lang").isin(langs)).select("lang", "order", "tree").collect(), key=lambda r: r["lang"]) if langs else []
    return Model([r["lang"] for r in rows], [Tree.load(r["tree"]) for r in rows], rows[0]["order"] if rows else ORDER)


def judged(docs: DataFrame, trees: DataFrame, keep: list[str], names: tuple[str, str], most: int = MODEL_BYTES) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, and its language and score under ``names``.

    The trees of one group of languages are broadcast at a time. Beyond one group, rows
    are stored with what the groups before gave, which is deleted after the next one.
    """
    spark = docs.sparkSession
    notes = unused(docs, "_lang", "_bits", "_mass")
    noted = [StructField(notes[0], StringType()), StructField(notes[1], DoubleType()), StructField(notes[2], DoubleType())]
    fields = list(docs.schema.fields)
    at = docs.columns.index("text")
    passes = groups(trees, most) or [[]]
    now = docs
    for turn, langs in enumerate(passes):
        shared = spark.sparkContext.broadcast(model(trees, langs))
        last = turn == len(passes) - 1
        stay = [n for n, f in enumerate(fields) if not last or f.name in keep]

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn, stay=stay) -> Iterator[pa.RecordBatch]:
            trim()
            for b in (w.slice(lo, 1024) for w in batches for lo in range(0, w.num_rows, 1024)):
                past = list(zip(*(b.column(len(fields) + n).to_pylist() for n in range(3)), strict=True)) if turn else None
                found = shared.value.judge(b.column(at).to_pylist(), past)
                lang, bits, mass = ([r[n] for r in found] for n in range(3))
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in stay), pa.array(lang, pa.string()), pa.array(bits, pa.float64()), pa.array(mass, pa.float64())], names=[*(fields[n].name for n in stay), *notes])
                release()

        done = now.mapInArrow(run, StructType([*(fields[n] for n in stay), *noted]))
        if not last:
            done = store(done, "judged")
            shared.unpersist()
            if turn:
                forget(now)
        now = done
    score = F.when(F.col(notes[2]) > 0, 1 / F.col(notes[2])).otherwise(0.0)
    return now.select(*keep, F.col(notes[0]).alias(names[0]), score.alias(names[1]))


def identify(docs: DataFrame, trees: DataFrame, most: int = MODEL_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``; other columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return judged(rows, trees, ["doc_id", "held_out"], ("lang_pred", "score"), most)


def keep_identified(docs: DataFrame, trees: DataFrame, min_score: float = 0.5, most: int = MODEL_BYTES) -> DataFrame:
    """The rows of ``docs`` in a known language; ``und`` and undecided ones (score under ``min_score``) go.

    Rows are judged one by one, repeated ones and those without a doc_id too; all
    columns stay as they are, and an empty table gives no rows.
    """
    lang, score = unused(docs, "_known", "_score")
    found = judged(docs, trees, docs.columns, (lang, score), most)
    return found.where((F.col(lang) != "und") & (F.col(score) >= min_score)).select(*docs.columns)
