"""Quality rules with an isolation forest on their statistics.

Every document gets rule statistics from its whole text. Documents that fail a
base rule are rejected. For the others the statistics become ratios that do not
depend on length, and an isolation forest gives each an anomaly score from its
mean path length over random splits. Every labelled row counts: the trees are
drawn first, in the box of the good rows, and all good rows are then counted in
their nodes; the threshold comes from the scores of all good and bad rows. It is
the lowest score that rejects at most ``max_loss`` of the good ones, moved to the
widest gap above it that costs no further bad row. Without good and bad labelled
rows nothing but the base rules rejects.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointframe.llm.common import BROADCAST_ROWS, release, small, store, trim

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_marks long, n_lines long"
NAMES = [x.split()[0] for x in STATS.split(", ")]
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Words(dict):
    """Numbers for words, so that a window of three packs into one exact key; forgotten between texts beyond ``limit``."""

    limit = 1 << 18
    most = 1 << 21

    def __missing__(self, word: str) -> int:
        n = len(self)
        self[word] = n
        return n


def repeated(words: list[bytes], numbers: Words) -> int:
    """Words inside three-word windows that occur twice or more, first occurrences included."""
    if len(words) < 4:
        return 0
    if len(numbers) + len(words) > numbers.limit:
        numbers.clear()
    if len(words) > numbers.most:  # a text of more words than numbers: rank its own
        _, w = np.unique(np.array(words, object), return_inverse=True)
    else:
        w = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    order = np.lexsort((w[2:], w[1:-1], w[:-2])) if w.max() >= 1 << 21 else np.argsort(w[:-2] << 42 | w[1:-1] << 21 | w[2:], kind="stable")
    a, b, c = w[:-2][order], w[1:-1][order], w[2:][order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (c[1:] == c[:-1])
    if not same.any():
        return 0
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(words), bool)
    at = order[twice]
    for k in range(3):
        cover[at + k] = True
    return int(cover.sum())


def statistics_of(text: str | None, numbers: Words) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_marks, n_lines of one text (null: none)."""
    if not text:
        return (0,) * 8
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: set[bytes] = set()
    dup = lines = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    upper = len(raw) - len(raw.translate(None, _UPPER.encode()))
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated(words, numbers), upper, text.count("!") + text.count("?"), lines)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trim()
    numbers = Words()
    for b in (w.slice(lo, 1024) for w in batches for lo in range(0, w.num_rows, 1024)):
        rows = [statistics_of(t, numbers) for t in b.column("text").to_pylist()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols)], names=NAMES)


def rule_statistics(docs: DataFrame) -> DataFrame:
    """Rule statistics of every whole text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_statistics, STATS)


def base_failed(n_words, n_repeat_words):
    """The base rule: too short, or mostly repeated windows."""
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


#: Columns of ``features``.
N_FEATURES = 6


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios free of length."""
    chars, words, lines = np.maximum(1, stats["word_chars"]), np.maximum(1, stats["n_words"]), np.maximum(1, stats["n_lines"])
    return np.stack([stats["n_symbols"] / words, stats["n_repeat_words"] / words, stats["n_dup_lines"] / lines, stats["n_upper"] / chars, stats["n_marks"] / words, chars / words], axis=1).astype(float)


@dataclass
class Forest:
    """Binary trees as arrays, nodes numbered as in a heap: split feature (-1: leaf), cut, and path length at leaves."""

    feature: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    norm: float = 1.0
    threshold: float = np.inf

    def leaves(self, t: int, x: np.ndarray) -> np.ndarray:
        """Where rows end in one tree."""
        f, c = self.feature[t], self.cut[t]
        rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        while True:
            k = f[node]
            if (k < 0).all():
                return node
            node = np.where(k < 0, node, 2 * node + 1 + (x[rows, np.maximum(k, 0)] >= c[node]))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score, 0 to 1."""
        total = np.zeros(len(x))
        for t in range(len(self.feature)):
            total += self.path[t][self.leaves(t, x)]
        return 2.0 ** (-total / max(1, len(self.feature)) / self.norm)


def draw(low: np.ndarray, high: np.ndarray, deep: int, trees: int = 128, seed: int = 11) -> Forest:
    """Complete trees of random cuts in a box. Cuts reach past the box, so that what lies outside parts early."""
    rng = np.random.default_rng(seed)
    pad = np.maximum(high - low, 1e-3) * 0.5 + 1e-6
    lo, hi = np.tile(low - pad, (trees, 1, 1)), np.tile(high + pad, (trees, 1, 1))
    feature, cut = [], []
    for _ in range(deep):
        k = rng.integers(len(low), size=(*lo.shape[:2], 1))
        a, b = np.take_along_axis(lo, k, 2), np.take_along_axis(hi, k, 2)
        c = a + rng.random(a.shape) * (b - a)
        below, above = hi.copy(), lo.copy()
        np.put_along_axis(below, k, c, 2)
        np.put_along_axis(above, k, c, 2)
        lo, hi = np.stack([lo, above], 2).reshape(trees, -1, len(low)), np.stack([below, hi], 2).reshape(trees, -1, len(low))
        feature.append(k[:, :, 0])
        cut.append(c[:, :, 0])
    ends = np.zeros((trees, 1 << deep))
    grid = np.concatenate([*cut, ends], axis=1)
    return Forest(np.concatenate([*feature, ends - 1], axis=1).astype(np.int8), grid, np.zeros_like(grid))


def grown(drawn: Forest, landed: np.ndarray, size: int) -> Forest:
    """Leaves and path lengths from the number of rows in each deepest node (trees by nodes): of ``size`` rows that fall
    as all of them do, a leaf expects one at most, or lies deepest."""
    levels = [landed * (size / landed[0].sum())]
    while levels[-1].shape[1] > 1:
        levels.append(levels[-1].reshape(len(landed), -1, 2).sum(2))
    held = np.concatenate(levels[::-1], axis=1)
    depth = np.concatenate([np.full(h.shape[1], d) for d, h in enumerate(levels[::-1])])
    m = np.arange(1, size + 1)
    average = 2 * (np.cumsum(1 / m) - 1 / m) - 2 * (m - 1) / m  # mean path among m rows
    return Forest(np.where(held <= 1, -1, drawn.feature).astype(np.int8), drawn.cut, depth + np.interp(held, m, average), max(1e-9, average[-1]))


def _features(b: pa.RecordBatch) -> np.ndarray:
    return features({c: b.column(c).to_numpy() for c in NAMES[1:]})


def box(good: DataFrame, tail: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``tail`` and 1 - ``tail`` quantiles of each feature over all rows, rounded outwards to 1 part in 256; a few
    extreme rows do not widen the box."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, x in enumerate(_features(b).T):  # none is negative: leading bits order as values do
                v, n = np.unique(np.ascontiguousarray(x).view(np.int64) >> 44, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k)), pa.array(v), pa.array(n)], names=["k", "v", "n"])

    bins = good.mapInArrow(run, "k long, v long, n long").groupBy("k", "v").agg(F.sum("n").alias("n")).toPandas().sort_values(["k", "v"])
    ends = []
    for _, g in bins.groupby("k"):
        v, upto = g.v.to_numpy(), g.n.cumsum().to_numpy()
        skip = int(tail * upto[-1])
        ends.append((v[np.searchsorted(upto, skip, "right")], v[np.searchsorted(upto, upto[-1] - skip, "left")] + 1))
    low, high = (np.array(ends, np.int64).T << 44).copy().view(np.float64)
    return low, high


def counted(good: DataFrame, drawn: Forest) -> np.ndarray:
    """Rows in each deepest node of complete trees: trees by nodes."""
    shared = good.sparkSession.sparkContext.broadcast(drawn)
    trees, wide = len(drawn.feature), (drawn.feature.shape[1] + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, total = shared.value, np.zeros((trees, wide), np.int64)
        for b in batches:
            x = _features(b)
            for t in range(trees):
                total[t] += np.bincount(f.leaves(t, x) - (wide - 1), minlength=wide)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "n"])

    cells = good.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    landed = np.zeros(trees * wide, np.int64)
    landed[cells["at"].to_numpy()] = cells["n"].to_numpy()
    return landed.reshape(trees, wide)


def nth_largest(values: DataFrame, n: int) -> float:
    """The ``n``-th largest of the column ``score``, ties counted, by counts in ever narrower ranges."""
    low, high = values.agg(F.min("score"), F.max("score")).first()
    while low < high:
        part = F.floor((F.col("score") - F.lit(low)) / F.lit(high - low) * 1024)
        bins = values.where(F.col("score").between(low, high)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
        for r in sorted(bins.collect(), key=lambda r: -r.part):
            if n <= r.n:
                low, high = r.low, r.high
                break
            n -= r.n
    return low


def calibrate(scores: DataFrame, n_good: int, max_loss: float) -> float:
    """Score above which documents are rejected, from the scores of all good and bad rows."""
    start = nth_largest(scores.where("quality = 1"), n_good + 1 - max(1, int(np.ceil((1 - max_loss) * n_good))))
    over = scores.where((F.col("quality") == 0) & (F.col("score") > F.lit(start))).agg(F.min("score")).first()[0]
    return np.inf if over is None else (start + over) / 2


def best_labels(labels: DataFrame) -> DataFrame:
    """doc_id and quality of every labelled document, stored.

    ``labels`` has doc_id and quality (1 good, 0 bad); nulls are ignored, and of
    several labels of a document the best counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    return store(known.groupBy("doc_id").agg(F.max("quality").alias("quality")), "labels")


def fit(labelled: DataFrame, max_loss: float = 0.002, size: int = 256, task_rows: int = 1 << 14) -> Forest | None:
    """Forest and threshold from the statistics and quality of all labelled rows that pass the base rules; equal rows of
    one document count once. The trees stand for ``size`` rows each, by what all rows count in them."""
    passed = store(labelled.where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).where("quality in (0, 1)").dropDuplicates(NAMES), "labelled")
    found = {r.quality: r.n for r in passed.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    n = found.get(1, 0)
    if n < 8:
        return None
    rows = passed.repartition(-(-sum(found.values()) // task_rows))
    good = rows.where("quality = 1")
    size = min(size, n)
    drawn = draw(*box(good, max_loss / 2 / N_FEATURES), deep=int(np.ceil(np.log2(size))) + 2)
    forest = grown(drawn, counted(good, drawn), size)
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("quality").cast(pa.int32()), pa.array(shared.value.score(_features(b)))], names=["quality", "score"])

    if found.get(0):
        forest.threshold = calibrate(store(rows.mapInArrow(run, "quality int, score double"), "scores"), n, max_loss)
    return forest


def judge(stats: DataFrame, forest: Forest | None) -> DataFrame:
    """Statistics with base_failed, anomaly and kept. A null doc_id is judged like any other."""
    spark = stats.sparkSession
    shared = spark.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            s = {c: b.column(c).to_numpy() for c in NAMES[1:]}
            failed = base_failed(s["n_words"], s["n_repeat_words"])
            score = f.score(features(s)) if f and b.num_rows else np.zeros(b.num_rows)
            kept = ~failed & (score <= (f.threshold if f else np.inf))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(failed), pa.array(score), pa.array(kept)], names=[*b.schema.names, "base_failed", "anomaly", "kept"])

    return stats.mapInArrow(run, STATS + ", base_failed boolean, anomaly double, kept boolean")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics and verdict of every row of ``docs``.

    A null text has no words and fails the base rules; rows with a null doc_id and
    repeated rows are judged one by one; an empty table gives no rows.
    """
    stats = store(rule_statistics(docs), "statistics")
    known = best_labels(labels)
    return judge(stats, fit(stats.join(small(known, known.count()), "doc_id")))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; only labelled rows are read twice, or all where
    there are too many labels to broadcast, rather than moving the texts to them.

    Texts are judged where they are, without a join: null texts go, repeated rows
    stay or go together, and an empty table gives no rows.
    """
    known = best_labels(labels)
    n = known.count()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if n <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    forest = fit(rule_statistics(texts).join(small(known, n), "doc_id"))
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        numbers, f = Words(), shared.value
        for b in (w.slice(lo, 1024) for w in batches for lo in range(0, w.num_rows, 1024)):
            rows = np.array([statistics_of(t, numbers) for t in b.column(at).to_pylist()], np.int64).reshape(-1, 8)
            s = dict(zip(NAMES[1:], rows.T, strict=True))
            kept = ~base_failed(s["n_words"], s["n_repeat_words"])
            if f and len(rows):
                kept &= f.score(features(s)) <= f.threshold
            yield b.filter(pa.array(kept))
            release()

    return docs.mapInArrow(run, docs.schema)
