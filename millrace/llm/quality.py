"""Quality rules: an isolation forest over statistics of the rules.

Every document gets counts (words, symbols, repeated lines, repeated word windows and a few more).
Two of them are hard rules. What passes these is judged by an isolation forest: random splits
isolate a document with unusual statistics after few steps, so a short mean path is the sign of
an anomaly. Labelled rows tell from which path on a document counts as one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the hard rules: least words, words of a window, percent of words in repeated windows.
LEAST_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
# Mean characters of a word from which on words count as equally long.
LONG_WORD = 64
SYMBOLS = b"#*$%&|<>"
# Labelled rows that forest and threshold are learned from, at most.
SAMPLE = 20_000
# Trees, rows of a tree, share of the clean rows held back that may lie beyond the threshold, what
# one of them weighs against a bad row, seed.
TREES, ROWS, MISTAKES, CLEAN_WEIGHT, SEED = 200, 256, 0.005, 10, 17

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Further statistics, of the forest alone.
EXTRA = ("n_lines", "n_distinct", "n_capitals", "n_marks")

_SPACE = b" \t\n\v\f\r"
_LATER_BYTES = bytes(range(0x80, 0xC0))  # of a code point in UTF-8
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_MARKS = b"!?"


def repeated_words(words: np.ndarray, window: int = WINDOW) -> int:
    """How many words stand in a window of ``window`` words that the text holds twice or more.

    ``words`` are numbers, equal for equal words. Windows are compared exactly: runs of one, two,
    four words … get numbers from those of their two halves, and only where both halves occur
    more than once does a longer run.
    """
    if len(words) <= window:
        return 0
    numbers, length = words.astype(np.int64), 1
    repeated = np.bincount(numbers)[numbers] > 1
    while length < window:
        step = min(length, window - length)
        places = np.flatnonzero(repeated[:-step] & repeated[step:])
        if not len(places):
            return 0
        halves = numbers[places] * (int(numbers.max()) + 1) + numbers[places + step]
        _, inverse, times = np.unique(halves, return_inverse=True, return_counts=True)
        numbers, repeated = np.zeros_like(numbers), np.zeros_like(repeated)
        numbers[places], repeated[places] = inverse, times[inverse] > 1
        length += step
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(repeated)
    edges[starts] += 1
    edges[starts + window] -= 1
    return int((np.cumsum(edges) > 0).sum())


def _count(text: bytes, wanted: bytes) -> int:
    return len(text) - len(text.translate(None, wanted))


def statistics(text: bytes | None) -> tuple[int, ...]:
    """``COUNTS`` and ``EXTRA`` of one UTF-8 text; null counts like an empty one.

    Words are runs of bytes other than space and \\t to \\r. Lines end at \\n; a line without a
    word is none, and a line equal to an earlier one is repeated.
    """
    text = text or b""
    words = text.split()  # of bytes: exactly the six separators
    known: dict[bytes, int] = {}
    numbers = np.fromiter((known.setdefault(word, len(known)) for word in words), np.int64, len(words))
    lines = Counter(line for line in text.split(b"\n") if line and not line.isspace())
    n_lines = lines.total()
    return (
        len(words),
        len(text.translate(None, _SPACE + _LATER_BYTES)),
        _count(text, SYMBOLS),
        n_lines - len(lines),
        repeated_words(numbers),
        n_lines,
        len(known),
        _count(text, _CAPITALS),
        _count(text, _MARKS),
    )


def base_failed(counts: np.ndarray) -> np.ndarray:
    """The hard rules on rows of ``statistics``."""
    words, repeats = counts[:, 0], counts[:, 4]
    return (words < LEAST_WORDS) | (100 * repeats > REPEAT_PERCENT * words)


def features(counts: np.ndarray) -> np.ndarray:
    """What the forest splits by: shares from 0 to 1, so that the length of a text is no anomaly."""
    words, chars, symbols, dup_lines, repeats, lines, distinct, capitals, marks = counts.astype(np.float64).T
    some_words, some_lines, some_chars = np.maximum(words, 1), np.maximum(lines, 1), np.maximum(chars, 1)
    return np.column_stack([
        np.minimum(np.log(np.maximum(chars / some_words, 1)) / np.log(LONG_WORD), 1),
        symbols / (symbols + some_words),
        dup_lines / some_lines,
        repeats / some_words,
        # Distinct words grow with a power of the words, so their logarithms have a steady ratio.
        np.log(np.maximum(distinct, 1)) / np.log(np.maximum(words, 2)),
        capitals / some_chars,
        marks / (marks + some_words),
    ])


@dataclass
class Forest:
    """Trees as arrays over nodes: inner nodes have a feature, a cut and two children, leaves
    the path length that ends there."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    roots: np.ndarray
    usual: float
    threshold: float = np.inf

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1, for every row: near 1 for short mean paths, below 0.5 for long ones."""
        if not len(self.roots):
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root)
            while True:
                inner = np.flatnonzero(self.feature[at] >= 0)
                if not len(inner):
                    break
                node = at[inner]
                below = rows[inner, self.feature[node]] < self.cut[node]
                at[inner] = np.where(below, self.left[node], self.right[node])
            total += self.length[at]
        return 2.0 ** (-total / len(self.roots) / self.usual)

    def anomalous(self, rows: np.ndarray) -> np.ndarray:
        return self.scores(rows) > self.threshold


def _mean_path(rows: int) -> float:
    """Mean path of an unsuccessful search in a binary search tree of so many rows."""
    if rows < 2:
        return 0.0
    return 2.0 * (np.log(rows - 1) + np.euler_gamma) - 2.0 * (rows - 1) / rows if rows > 2 else 1.0


def grow(rows: np.ndarray, trees: int = TREES, sample: int = ROWS, seed: int = SEED) -> Forest:
    """A forest over ``rows`` of features.

    Random cuts fall anywhere between 0 and 1 inside the box of their node, not only between its
    rows: so a place where no row is gets cut off soon, also if it differs in a feature in which
    all rows are equal. A tree ends at a node with one row or none, or two levels below the mean depth.
    """
    random = np.random.default_rng(seed)
    size = min(sample, len(rows))
    deepest = int(np.ceil(np.log2(max(size, 2)))) + 2
    nodes: list[list[float]] = []  # feature, cut, left, right, length
    roots = []
    for _ in range(trees if size else 0):
        roots.append(len(nodes))
        nodes.append([-1, 0.0, -1, -1, 0.0])
        waiting = [(roots[-1], rows[random.choice(len(rows), size, replace=False)], np.zeros(rows.shape[1]), np.ones(rows.shape[1]), 0)]
        while waiting:
            node, part, least, most, depth = waiting.pop()
            if len(part) <= 1 or depth >= deepest:
                nodes[node][4] = depth + _mean_path(len(part))
                continue
            axis = int(random.integers(rows.shape[1]))
            cut = random.uniform(least[axis], most[axis])
            below = part[:, axis] < cut
            nodes[node][:4] = [axis, cut, len(nodes), len(nodes) + 1]
            upper, lower = least.copy(), most.copy()
            upper[axis] = lower[axis] = cut
            waiting.append((len(nodes), part[below], least, lower, depth + 1))
            waiting.append((len(nodes) + 1, part[~below], upper, most, depth + 1))
            nodes.extend([[-1, 0.0, -1, -1, 0.0], [-1, 0.0, -1, -1, 0.0]])
    table = np.array(nodes, np.float64).reshape(-1, 5)
    feature, left, right = (table[:, i].astype(np.int64) for i in (0, 2, 3))
    return Forest(feature, table[:, 1], left, right, table[:, 4], np.array(roots, np.int64), _mean_path(size) or 1.0)


def calibrated(counts: np.ndarray, clean: np.ndarray, mistakes: float = MISTAKES, seed: int = SEED) -> Forest:
    """A forest and its threshold from labelled rows of ``statistics``.

    Rows that the hard rules remove say nothing about the forest. One half of the clean ones
    among the others grows the trees. The other half and all bad ones set the threshold: the one
    with the least loss, a clean row lost weighing ``CLEAN_WEIGHT`` times a bad row kept, among those beyond
    which at most the share ``mistakes`` of the clean rows lies. Without clean rows nothing can
    be calibrated: no row is an anomaly.
    """
    passed = ~base_failed(counts)
    rows, clean = features(counts[passed]), clean[passed]
    half = np.random.default_rng(seed).permutation(len(rows)) % 2 == 0
    forest = grow(rows[half & clean], seed=seed)
    good, bad = np.sort(forest.scores(rows[~half & clean])), np.sort(forest.scores(rows[~clean]))
    if len(good):
        places = np.unique(np.concatenate([good, bad]))
        places = np.append((places[:-1] + places[1:]) / 2, places[-1])
        lost = 1 - np.searchsorted(good, places, side="right") / len(good)
        kept = np.searchsorted(bad, places, side="right") / max(1, len(bad))
        loss = np.where(lost <= mistakes, CLEAN_WEIGHT * lost + kept, np.inf)
        forest.threshold = float(places[len(places) - 1 - np.argmin(loss[::-1])])
    return forest


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """A calibrated forest from at most ``sample`` labelled rows of ``docs`` (doc_id, text);
    ``labels`` has doc_id and quality, 1 for clean.

    Which rows: those with the smallest hash of doc_id. Labels without doc_id or quality, and
    documents whose labels contradict each other, take no part; nor do labels of no document.
    """
    usable = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .where("quality = other")
    )
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "quality")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _with_counts(batch.select(["doc_id", "quality"]), _batch_counts(batch.column("text")))

    kept = rows.mapInArrow(run, f"doc_id long, quality int, {_COUNT_TYPES}").collect()
    table = np.array(sorted(tuple(row) for row in kept), np.int64).reshape(-1, 2 + len(COUNTS) + len(EXTRA))
    return calibrated(table[:, 2:], table[:, 1] == 1)


_COUNT_TYPES = ", ".join(f"{name} long" for name in (*COUNTS, *EXTRA))


def _batch_counts(texts: pa.Array) -> np.ndarray:
    """``statistics`` of a column, one text in Python at a time."""
    rows = [statistics(text.as_py()) for text in texts.cast(pa.binary())]
    return np.array(rows, np.int64).reshape(-1, len(COUNTS) + len(EXTRA))


def _with_counts(batch: pa.RecordBatch, counts: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(column) for column in counts.T]
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *COUNTS, *EXTRA])


def judged(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, the five counts, n_words first, base_failed, score and kept of every row of ``docs``
    (doc_id, text).

    kept is false where a hard rule fails, else where the forest finds an anomaly. Each row is
    judged by its own text: repeated rows and rows without doc_id come out as they came in, a
    null text counts as an empty one. One pass over the texts, nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _batch_counts(batch.column("text"))
            failed, scores = base_failed(counts), shared.value.scores(features(counts))
            kept = ~failed & ~(scores > shared.value.threshold)
            arrays = [batch.column("doc_id"), *[pa.array(column) for column in counts.T[: len(COUNTS)]]]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(failed), pa.array(scores), pa.array(kept)],
                ["doc_id", *COUNTS, "base_failed", "score", "kept"],
            )

    types = ", ".join(f"{name} long" for name in COUNTS)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ids.mapInArrow(run, f"doc_id long, {types}, base_failed boolean, score double, kept boolean")


def accepted(docs: DataFrame, forest: Forest) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _batch_counts(batch.column(batch.schema.get_field_index("text")))
            kept = ~base_failed(counts) & ~shared.value.anomalous(features(counts))
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
