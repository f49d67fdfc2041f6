"""Hard-negative mining by a secondary-sort shuffle.

Anchors meet all rows block by block. What can be a positive or a negative of an anchor becomes a
packed key (anchor, descending score, kind, id), and the keys are sorted by one shuffle. A
streaming iterator then reads every anchor's rows from the best score down: a positive opens a
window of scores, a negative goes to all windows that are open and not yet full. It holds the open
windows of one anchor and nothing else.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import drop_staged, staged
from millrace.operators.joins import splittable_join

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
# A negative scores from this percentage of its positive up to the same score.
LEAST_PERCENT = 80
# Rows of a block, anchors that meet it at once, and products held at a time.
BLOCK, ANCHORS, PRODUCTS = 16_384, 32_768, 4_000_000

_KEY = struct.Struct(">QQBQ")  # anchor, score turned over, 0 for positives, id
_LOW, _HIGH = -(2**63), 2**63 - 1
_MIX = 0x9E3779B97F4A7C15  # an odd number, for a hash of anchors


def labelled_vectors(table: DataFrame, label: Column | str = "label", scale: int = SCALE) -> DataFrame:
    """vec_id, label, vector (array<double> of integers floor(scale * x)) of every usable row of
    ``table`` (vec_id, embedding, and what ``label`` needs).

    Rows without id or label, and vectors that are null, empty or hold null or non-finite
    components, take no part. Several rows of one vec_id are one: that with the smallest label,
    then vector.
    """
    values = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    finite = F.forall(
        "embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))
    )
    label = F.col(label) if isinstance(label, str) else label
    usable = table.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0").where(finite)
    rows = usable.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), values.alias("vector"))
    row = F.min(F.struct("label", "vector")).alias("row")
    return rows.where("label IS NOT NULL").groupBy("vec_id").agg(row).select("vec_id", "row.label", "row.vector")


def integer_products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact; raises where one leaves 64 bits."""
    most = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * anchors.shape[1]
    if most < 2**53:
        return (anchors @ rows.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in anchors], object) @ np.array([[int(x) for x in row] for row in rows], object).T
    if any(not _LOW <= score <= _HIGH for score in exact.ravel().tolist()):
        raise OverflowError("an inner product leaves 64 bits")
    return exact.astype(np.int64)


def best_places(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` highest ``scores`` in each row that ``allowed`` admits.

    Ties go to the smaller column, so columns must be in the order of their ids.
    """
    columns = scores.shape[1]
    k = min(k, columns)
    if not k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Below the k-th score nothing is wanted; of those equal to it the first ones are.
    masked = np.where(allowed, scores, _LOW)
    floor = np.partition(masked, columns - k, axis=1)[:, columns - k][:, None]
    above = allowed & (scores > floor)
    level = allowed & (scores == floor)
    level &= np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | level)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of vectors of one width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _first_of_each(lines: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the first ``k`` of their line; ``lines`` is sorted."""
    return np.arange(len(lines)) - np.searchsorted(lines, lines, side="left") < k


def _meetings(anchors: DataFrame, rows: DataFrame, keys: list[str], meet, schema: dict[str, pa.DataType]) -> DataFrame:
    """``meet`` of every part of ``anchors`` with every block of ``rows`` that has the same ``keys``,
    written to the shared folder.

    Parts and blocks are cut by a hash within the keys, to sizes that do not grow with the data:
    an anchor is copied for every ``BLOCK`` rows and a row for every ``ANCHORS`` anchors it meets, so that
    products outnumber copied vectors by thousands. The counts by key are written, as Spark then
    knows how small they are.
    """
    parts = staged(anchors.groupBy(*keys).agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("parts")), "negative-parts")
    blocks = staged(rows.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "negative-blocks")
    counts = parts.join(blocks, keys)

    def dealt(side: DataFrame, prefix: str, own: str, n: str, other: str, m: str) -> DataFrame:
        cell = F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int").alias(own)
        placed = splittable_join(side, counts, keys).select(
            *side.columns, cell, F.explode(F.sequence(F.lit(0), F.col(m) - 1)).alias(other)
        )
        return placed.toDF(*[f"{prefix}{name}" for name in placed.columns])

    asking = dealt(anchors, "", "part", "parts", "block", "blocks")
    held = dealt(rows, "held_", "block", "blocks", "part", "parts")

    def run(asking: pa.Table, held: pa.Table) -> pa.Table:
        found = {name: [] for name in schema}
        if asking.num_rows and held.num_rows:
            found = meet(asking, held.rename_columns([name.removeprefix("held_") for name in held.column_names]).sort_by("vec_id"))
        return pa.table({name: pa.array(found[name], kind) for name, kind in schema.items()})

    cell = [*keys, "part", "block"]
    groups = asking.groupBy(*cell).cogroup(held.groupBy(*[f"held_{name}" for name in cell]))
    types = ", ".join(f"{name} {'binary' if kind == pa.binary() else 'long'}" for name, kind in schema.items())
    met = staged(groups.applyInArrow(run, types), "negative-met")
    drop_staged(parts, blocks)
    return met


def _portions(anchors: int, rows: int) -> Iterator[slice]:
    step = max(1, PRODUCTS // max(1, rows))
    return (slice(begin, begin + step) for begin in range(0, anchors, step))


def positive_scores(anchors: DataFrame, rows: DataFrame, k: int = POSITIVES) -> DataFrame:
    """vec_id, positives: the ``k`` highest scores of every anchor with other rows of its label,
    for anchors that have any. A block hands on the ``k`` best of each anchor in it."""

    def meet(asking: pa.Table, held: pa.Table) -> dict[str, np.ndarray]:
        ids, vectors = held["vec_id"].to_numpy(), _matrix(held["vector"])
        own, wanted = asking["vec_id"].to_numpy(), _matrix(asking["vector"])
        found = []
        for part in _portions(len(own), len(ids)):
            scores = integer_products(wanted[part], vectors)
            line, place = best_places(scores, ids[None, :] != own[part][:, None], k)
            found.append((own[part][line], ids[place], scores[line, place]))
        return dict(zip(("vec_id", "positive_id", "score"), map(np.concatenate, zip(*found))))

    schema = dict.fromkeys(("vec_id", "positive_id", "score"), pa.int64())
    near = _meetings(anchors, rows, ["width", "label"], meet, schema)
    order = Window.partitionBy("vec_id").orderBy(F.desc("score"), "positive_id")
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    kept = staged(best.groupBy("vec_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("positives")), "negative-positives")
    drop_staged(near)
    return kept


def packed_keys(
    anchors: DataFrame, rows: DataFrame, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT
) -> DataFrame:
    """key: the packed pairs that can be in the result. ``anchors`` have their ``positives``.

    From a block go, for every anchor, the rows of its label that score as high as its last
    positive (of equal scores the first ones of a block), and for every positive the best
    ``negatives`` rows of other labels in its window: what a block leaves out, these stand before.
    """

    def meet(asking: pa.Table, held: pa.Table) -> dict[str, list[bytes]]:
        ids, labels, vectors = held["vec_id"].to_numpy(), held["label"].to_numpy(), _matrix(held["vector"])
        own, own_labels, wanted = asking["vec_id"].to_numpy(), asking["label"].to_numpy(), _matrix(asking["vector"])
        levels = asking["positives"].to_pylist()
        most = max(map(len, levels))
        # A missing positive, like one below zero, has an empty window.
        high = np.array([row + [-1] * (most - len(row)) for row in levels], np.int64)
        low = high // 100 * least_percent - -(high % 100) * least_percent // 100
        last = np.array([row[-1] for row in levels], np.int64)
        keys: list[bytes] = []
        for part in _portions(len(own), len(ids)):
            scores = integer_products(wanted[part], vectors)
            same = labels[None, :] == own_labels[part][:, None]
            positive = same & (scores >= last[part][:, None]) & (ids[None, :] != own[part][:, None])
            floor = np.where(high[part] >= 0, low[part], _HIGH).min(axis=1)
            negative = ~same & (scores >= floor[:, None]) & (scores <= high[part].max(axis=1)[:, None])
            for kind, candidates in enumerate((positive, negative)):
                line, place = np.nonzero(candidates)
                score = scores[line, place]
                order = np.lexsort((place, -score, line))
                line, place, score = line[order], place[order], score[order]
                if kind == 0:
                    chosen = _first_of_each(line, most)
                else:
                    chosen = np.zeros(len(line), bool)
                    for rank in range(most):
                        top, bottom = high[part][line, rank], low[part][line, rank]
                        inside = np.flatnonzero((top >= 0) & (score <= top) & (score >= bottom))
                        chosen[inside[_first_of_each(line[inside], negatives)]] = True
                keys += _packed(own[part][line[chosen]], score[chosen], kind, ids[place[chosen]])
        return {"key": keys}

    return _meetings(anchors, rows, ["width"], meet, {"key": pa.binary()})


def _packed(anchors: np.ndarray, scores: np.ndarray, kind: int, ids: np.ndarray) -> list[bytes]:
    """Keys whose order as bytes is that of anchor, descending score, kind, id."""
    pairs = zip(anchors.tolist(), scores.tolist(), ids.tolist())
    return [_KEY.pack(anchor - _LOW, _HIGH - score, kind, vec_id - _LOW) for anchor, score, vec_id in pairs]


def opened_windows(
    keys: Iterator[bytes], positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT
) -> Iterator[tuple[int, int, int, int, int, int]]:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from sorted keys.

    At any time the state is one anchor's open windows, ``positives`` at most.
    """
    current, opened, windows = None, 0, []
    for key in keys:
        anchor, score, kind, vec_id = _KEY.unpack(key)
        if anchor != current:
            current, opened, windows = anchor, 0, []
        score, vec_id = _HIGH - score, vec_id + _LOW
        if kind == 0:
            if opened < positives:
                opened += 1
                windows.append([vec_id, score, 0])
            continue
        for window in windows:
            positive_id, high, given = window
            if least_percent * high <= 100 * score <= 100 * high:
                window[2] = given + 1
                yield anchor + _LOW, positive_id, given + 1, vec_id, high, score
        windows = [w for w in windows if w[2] < negatives and least_percent * w[1] <= 100 * score]


def hard_negatives(
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Both tables are those of ``labelled_vectors``. An anchor's positives are the ``positives``
    rows of its label with the highest inner product, itself left out; their negatives the first
    ``negatives`` rows of other labels that score between ``least_percent`` of the positive and its score.
    Ties go to the smaller id. Only vectors of the anchor's width have a product with it. Anchors
    without a positive, and positives without a negative in their window, have no rows; a positive
    below zero has none, as a share of it lies above it.
    """
    spark = vectors.sparkSession
    width = F.size("vector").alias("width")
    rows = staged(vectors.select("vec_id", "label", "vector", width), "negative-rows")
    asked = staged(anchors.select("vec_id", "label", "vector", width), "negative-anchors")
    known = positive_scores(asked, rows, positives)
    keys = packed_keys(asked.join(known, "vec_id"), rows, negatives, least_percent)
    drop_staged(rows, asked, known)
    # All keys of an anchor go to one task: 5 positives and 25 negatives from each block at most.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = keys.rdd.map(lambda row: (bytes(row.key), None))
    dealt = pairs.repartitionAndSortWithinPartitions(tasks, lambda key: int.from_bytes(key[:8]) * _MIX >> 20)
    found = dealt.mapPartitions(lambda part: opened_windows((key for key, _ in part), positives, negatives, least_percent))
    return spark.createDataFrame(
        found, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    )
