"""Tokens of two tokenizers over the same bytes, linked by elementary intervals.

Both tokenizations of a text are lists of byte ranges that cover it. The union of the
two lists of ends cuts the text into elementary intervals, each within one token of
either side (its owners, found by binary search): each interval is one overlap. An
interval whose end both sides share closes a group; the pair of its owners ends
together. The product of a group's two sides is expanded where links are asked by
group. A batch of texts is one array: documents end where both sides end.

Counts of id pairs are summed over the whole corpus and joined back to each
document's distinct pairs. There are at most as many as the vocabularies' product;
they are broadcast up to a counted limit and joined with salts beyond it.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointframe.llm.common import arrow_bytes, release, salted_join, store, trim
from pointframe.llm.tokens import Encoder, byte_letters

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, keys array<long>, times array<int>"

_PAIRS: dict[tuple[str, str], Pair] = {}


def _expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, ``count`` of them."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)


class Pieces:
    """Ids of a sentencepiece model, with remembered words.

    Where no piece holds a space mark after another letter, nothing is merged across
    a space, so the words of a text with single spaces between them are encoded one by one
    and remembered, as the tokens of a mark and a word. Other texts go through the model whole.
    """

    def __init__(self, path: str, limit: int = 200_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.by_word = not any("\u2581" in n.lstrip("\u2581") for n in self.names)
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.limit = limit

    def _known(self, words: list[str]) -> list[bytes]:
        new = [w for w in words if w not in self.words]
        fresh = []
        for w in new:
            if (held := self.old.get(w)) is not None:
                self.words[w] = held
            else:
                fresh.append(w)
        for w, ids in zip(fresh, self.model.encode(fresh, num_threads=1), strict=True):
            self.words[w] = array("i", ids).tobytes()
        return list(map(self.words.__getitem__, words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text; no text is empty."""
        if len(self.words) > self.limit:  # what was not used since the generation before is forgotten
            self.old, self.words = self.words, {}
        whole = [not self.by_word or t[0] == " " or t[-1] == " " or "  " in t or "\u2581" in t for t in texts]
        plain = [t for t, w in zip(texts, whole, strict=True) if not w]
        parts, sizes = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        at_plain = np.flatnonzero(~np.array(whole, bool))
        ids = np.zeros(0, np.int32)
        if plain:
            cut = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
            coded = cut.flatten().dictionary_encode()
            known = self._known(coded.dictionary.to_pylist())
            size = np.fromiter(map(len, known), np.int64, len(known)) // 4
            which = coded.indices.to_numpy()
            table, first = np.frombuffer(b"".join(known), np.int32), np.cumsum(size) - size
            ids = table[_expand(first[which], size[which])]
            ends = np.r_[0, np.cumsum(size[which])][cut.offsets.to_numpy()]
            sizes[at_plain] = np.diff(ends)
        odd = [t for t, w in zip(texts, whole, strict=True) if w]
        if not odd:
            return ids, sizes
        alone = [np.array(x, np.int32) for x in self.model.encode(odd, num_threads=1)]
        at_odd = np.flatnonzero(np.array(whole, bool))
        sizes[at_odd] = [len(x) for x in alone]
        out = np.empty(int(sizes.sum()), np.int32)
        mine = np.repeat(np.array(whole, bool), sizes)
        out[~mine], out[mine] = ids, np.concatenate(alone)
        return out, sizes


class Pair:
    """A byte-level tokenizers file (A) and a sentencepiece model (B), with the bytes of their ids."""

    def __init__(self, a_path: str, b_path: str):
        self.a = Encoder(a_path, plain=True)
        self.b = Pieces(b_path)
        back = {c: bytes([b]) for b, c in byte_letters().items()}
        vocab = self.a.tokenizer.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for name, i in vocab.items():
            self.a_bytes[i] = b"".join(back[c] if c in back else c.encode() for c in name)
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.b.model.is_byte(i) else n.replace("\u2581", " ").encode() for i, n in enumerate(self.b.names)]
        self.a_size, self.b_size = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.a_bytes, self.b_bytes))
        # An id with the mark that follows it: next of its side, then the end of its side in the group.
        self.written = [f"{i}{mark}" for marks, n in ((",|", len(self.a_bytes)), (",;", len(self.b_bytes))) for mark in marks for i in range(n)]


def pair(a_path: str, b_path: str) -> Pair:
    """This process's pair of tokenizers."""
    if (a_path, b_path) not in _PAIRS:
        _PAIRS[a_path, b_path] = Pair(a_path, b_path)
    return _PAIRS[a_path, b_path]


def intervals(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the elementary intervals of two coverings (the union of their ends; as both are sorted, a stable sort only
    merges them), their owners on both sides, and whether both end there."""
    ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
    ends = ends[np.r_[True, ends[1:] != ends[:-1]]]
    a, b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    return ends, a, b, (a_ends[a] == ends) & (b_ends[b] == ends)


def groups_of(owner: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Group of each token of a side: the shared ends before its last interval."""
    return (np.cumsum(shared) - shared)[np.r_[owner[1:] != owner[:-1], True]]


def product(a_groups: np.ndarray, b_groups: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places that lie in one of ``n`` groups; both lists of groups are sorted."""
    na, nb = np.bincount(a_groups, minlength=n), np.bincount(b_groups, minlength=n)
    a = np.repeat(np.arange(len(a_groups)), nb[a_groups])
    first = np.cumsum(nb) - nb
    return a, _expand(np.repeat(first, na), np.repeat(nb, na))


def _aligned(pair_: Pair, b: pa.RecordBatch, links: str) -> pa.RecordBatch:
    texts = b.column("text").to_pylist()
    spaced = pa.array([" " + t if t else None for t in texts], pa.string())
    a_ids, a_n = pair_.a.encode(spaced)
    full = [i for i, t in enumerate(texts) if t]
    b_ids, b_n = pair_.b.encode([texts[i] for i in full]) if full else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    # Texts whose bytes both sides give back.
    a_bytes, b_bytes = (list(map(t.__getitem__, ids.tolist())) for t, ids in ((pair_.a_bytes, a_ids), (pair_.b_bytes, b_ids)))
    at, at_b = np.r_[0, np.cumsum(a_n)], np.r_[0, np.cumsum(b_n)]
    good, good_b, sizes = [], [], []
    for k, i in enumerate(full):
        want = f" {texts[i]}".encode("utf-8", "surrogatepass")
        if b"".join(a_bytes[at[i] : at[i + 1]]) == want and b"".join(b_bytes[at_b[k] : at_b[k + 1]]) == want:
            good.append(i), good_b.append(k), sizes.append(len(want))
    n = len(texts)
    n_a, n_b, n_groups, n_links, n_overlaps = (np.zeros(n, np.int64) for _ in range(5))
    digest = [""] * n
    counts = np.zeros(n, np.int64)
    keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if good:
        A, B = a_ids[_expand(at[good], a_n[good])].astype(np.int64), b_ids[_expand(at_b[good_b], b_n[good_b])].astype(np.int64)
        n_a[good], n_b[good] = a_n[good], b_n[good_b]
        ends, own_a, own_b, shared = intervals(np.cumsum(pair_.a_size[A]), np.cumsum(pair_.b_size[B]))
        stops = np.searchsorted(ends, np.cumsum(sizes), "right")  # a document ends where both sides do
        n_overlaps[good] = np.diff(np.r_[0, stops])
        n_groups[good] = np.diff(np.r_[0, np.cumsum(shared)[stops - 1]])
        a_group, b_group = groups_of(own_a, shared), groups_of(own_b, shared)
        if links == "ends":
            la, lb = own_a[shared], own_b[shared]
        elif links == "overlaps":
            la, lb = own_a, own_b
        else:
            la, lb = product(a_group, b_group, int(shared.sum()))
        where = np.repeat(np.arange(len(good)), n_a[good])[la]
        n_links[good] = np.bincount(where, minlength=len(good))
        room = len(pair_.a_bytes) * len(pair_.b_bytes)
        keyed = np.sort(where * room + A[la] * len(pair_.b_bytes) + B[lb])
        first = np.flatnonzero(np.r_[True, keyed[1:] != keyed[:-1]])
        keyed, times = keyed[first], np.diff(np.r_[first, len(keyed)])
        counts[good] = np.bincount(keyed // room, minlength=len(good))
        keys = keyed % room
        # A group's ids of A, then those of B, each with the mark after it.
        last_a, last_b = (np.r_[g[1:] != g[:-1], True] for g in (a_group, b_group))
        va, vb = len(pair_.a_bytes), len(pair_.b_bytes)
        names = np.concatenate([A + last_a * va, B + last_b * vb + 2 * va])
        rank = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        names = names[rank].tolist()
        stop = np.cumsum(n_a[good] + n_b[good]).tolist()
        start = 0
        for i, end in zip(good, stop, strict=True):
            digest[i] = hashlib.sha256("".join(map(pair_.written.__getitem__, names[start:end]))[:-1].encode()).hexdigest()
            start = end
    offsets = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in ((keys, pa.int64()), (times, pa.int32()))]
    longs = [pa.array(v, pa.int64()) for v in (n_a, n_b, n_groups, n_links, n_overlaps)]
    return pa.RecordBatch.from_arrays([b.column("doc_id"), *longs, pa.array(digest, pa.string()), *lists], names=[f.split()[0] for f in ALIGNED.split(", ")])


def align_texts(docs: DataFrame, a_path: str, b_path: str, links: str = "ends") -> DataFrame:
    """A row a row of ``docs`` (doc_id, text) with its numbers of tokens, groups, links and overlaps, the digest of its
    groups, and its distinct id pairs (``keys``: A's id times B's vocabulary plus B's id) with how often each is linked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        both = pair(a_path, b_path)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                yield _aligned(both, b.slice(lo, 512), links)
            release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ALIGNED)


def align_tokens(docs: DataFrame, a_path: str, b_path: str, links: str = "ends") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps of every row.

    A encodes a space and the text, B the text; special tokens in a text are plain
    text. A null or empty text, or one whose bytes either side does not give back,
    has no tokens: zeros and an empty digest. ``links`` are pairs of tokens that end
    together (``ends``), overlap (``overlaps``) or share a group (``groups``). A
    pair's count is its links in all rows; ``count_sum`` adds it over a row's links,
    ``n_best`` counts the links whose pair has the highest count of its B id, ties
    included. Repeated rows count as often as they occur, null ids are kept, other
    columns are ignored, and an empty table gives no rows.
    """
    if links not in ("ends", "overlaps", "groups"):
        raise ValueError(f"links must be ends, overlaps or groups, not {links}")
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    with arrow_bytes(docs.sparkSession):
        made = store(align_texts(docs, a_path, b_path, links).withColumn("row", F.monotonically_increasing_id()), "aligned")
    held = made.select("row", F.explode(F.arrays_zip("keys", "times")).alias("p")).select("row", F.col("p.keys").alias("key"), F.col("p.times").alias("times"))
    counts = store(held.groupBy("key").agg(F.sum("times").alias("count")), "pair-counts")
    top = counts.groupBy(F.pmod("key", F.lit(width)).alias("b")).agg(F.max("count").alias("most"))  # at most one row an id of B
    known = counts.withColumn("b", F.pmod("key", F.lit(width))).join(F.broadcast(top), "b").select("key", "count", (F.col("count") == F.col("most")).alias("best"))
    met = salted_join(held, known, ["key"], counts.count())
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("long").alias(n)
    return made.drop("keys", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", "n_overlaps")
