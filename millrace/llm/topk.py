"""Exact top-k search by inner product: norm-bucketed retrieval.

Vectors are grouped by length. A first pass verifies the longest vectors, which gives every
query a score its k-th best cannot fall below. Then each query meets the buckets whose longest
vector could still reach that score. In a bucket the score and the lengths give a local cosine
threshold: high thresholds prune by coordinates (a vector within the angle of the query has each
coordinate in a known interval), low ones by length alone. What is left is verified by exact
integer products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import staged

SCALE = 256
# Vectors of the first pass, and vectors and queries of a block.
LONGEST, BLOCK = 2_048, 4_096
# Buckets to each doubling of the length; the local cosine threshold from which coordinates
# prune, and the coordinates looked at.
BUCKETS, COSINE, FOCUS = 4, 0.5, 3
# Relative slack for the rounding of lengths and cosines: bounds only ever err to the safe side.
_SLACK = 1e-9


def integer_vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, vector (array<double> of integers floor(scale * x)), norm of every usable row of
    ``table`` (vec_id, embedding); exact repeats of a row count once.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do rows
    without vec_id.
    """
    values = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    finite = F.forall(
        "embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))
    )
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    return (
        table.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
        .where(finite)
        .select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("vector"))
        .distinct()
        .withColumn("norm", F.sqrt(square))
    )


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows; raises where one leaves 64 bits."""
    if not queries.size or not vectors.size:
        return np.zeros((len(queries), len(vectors)), np.int64)
    bound = np.abs(queries).max() * np.abs(vectors).max() * queries.shape[1]
    if bound < 2**53:
        return (queries @ vectors.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in queries], object) @ np.array([[int(x) for x in row] for row in vectors], object).T
    if any(not -(2**63) <= score < 2**63 for score in exact.ravel().tolist()):
        raise OverflowError("an inner product leaves 64 bits")
    return exact.astype(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


class Block:
    """Vectors of one length bucket, longest first, with what pruning needs."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> None:
        order = np.lexsort((ids, -norms))
        self.ids, self.vectors, self.norms = ids[order], vectors[order], norms[order]
        self.units = np.ascontiguousarray((self.vectors / np.maximum(self.norms, 1e-300)[:, None]).T)

    def candidates(self, query: np.ndarray, norm: float, least: float) -> np.ndarray:
        """Places of the vectors whose product with ``query`` may be ``least`` or more."""
        if least <= 0 or norm == 0:  # no length bounds a product from below zero
            return np.arange(len(self.ids))
        shortest = least / norm * (1 - _SLACK)
        long_enough = int(np.searchsorted(-self.norms, -shortest, side="right"))
        if not long_enough:
            return np.arange(0)
        cosine = min(1.0, least / (norm * self.norms[0]))
        if cosine < COSINE:
            return np.arange(long_enough)
        unit, angle = query / norm, np.arccos(cosine)
        left = np.arange(long_enough)
        for axis in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
            own = np.arccos(np.clip(unit[axis], -1, 1))
            low, high = np.cos(min(np.pi, own + angle)) - 1e-7, np.cos(max(0.0, own - angle)) + 1e-7
            values = self.units[axis, left]
            left = left[(values >= low) & (values <= high)]
        return left

    def best(self, query_id: int, query: np.ndarray, norm: float, least: float, k: int) -> list[tuple[int, int]]:
        """The k best (score, vec_id) of at least ``least``, ties to the smaller id."""
        places = self.candidates(query, norm, least)
        places = places[self.ids[places] != query_id]
        scores = products(query[None, :], self.vectors[places])[0]
        keep = scores >= least
        scores, ids = scores[keep], self.ids[places[keep]]
        order = np.lexsort((ids, -scores))[:k]
        return list(zip(scores[order].tolist(), ids[order].tolist()))


def _floors(queries: DataFrame, longest: DataFrame, k: int) -> DataFrame:
    """``queries`` with least: a score that the k-th best of a query reaches, from ``LONGEST`` vectors."""
    rows = longest.collect()
    shared = queries.sparkSession.sparkContext.broadcast([(row.vec_id, row.vector) for row in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_width: dict[int, list] = {}
        for vec_id, vector in shared.value:
            by_width.setdefault(len(vector), []).append((vec_id, vector))
        known = {w: (np.array([v[0] for v in part]), np.array([v[1] for v in part], np.float64)) for w, part in by_width.items()}
        for batch in batches:
            least = []
            for vec_id, vector in zip(batch.column("vec_id").to_pylist(), batch.column("vector").to_pylist()):
                floor = None
                if len(vector) in known:
                    ids, vectors = known[len(vector)]
                    scores = products(np.array([vector], np.float64), vectors)[0][ids != vec_id]
                    floor = int(np.partition(scores, -k)[-k]) if len(scores) >= k else None
                least.append(floor)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], [*batch.schema.names, "least"])

    return queries.mapInArrow(run, "vec_id long, vector array<double>, norm double, least long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of every query with
    the vectors of other ids, ties to the smaller vec_id.

    Both tables are those of ``integer_vectors``. Only vectors of the query's width have a
    product with it. A query has fewer rows if there are fewer vectors, none if there is no other.
    Rows of one vec_id with different vectors are answered each, and ranked together.

    Buckets hold vectors whose lengths differ by a fixed factor; a large bucket is cut into
    blocks by hash, so that no group grows with the data, and so are the queries.
    """
    vectors = staged(vectors, "topk-vectors")
    queries = staged(_floors(queries, vectors.orderBy(F.desc("norm"), "vec_id").limit(LONGEST), k), "topk-queries")
    width = F.size("vector").alias("width")
    bucket = F.when(F.col("norm") > 0, F.floor(F.log2("norm") * BUCKETS)).otherwise(-1_000_000).cast("int").alias("bucket")
    sized = vectors.select("vec_id", "vector", "norm", width, bucket)
    buckets = sized.groupBy("width", "bucket").agg(
        F.max("norm").alias("most"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")
    )
    # Written, so that its size is known: a few rows, which Spark then sends to the vectors.
    buckets = staged(buckets, "topk-buckets")
    parts = max(1, -(-queries.count() // BLOCK))
    asked = queries.select("vec_id", "vector", "norm", "least", width)
    # A query goes to the buckets that can reach its floor: one row per block of these.
    reach = F.col("least").isNull() | (F.col("least") <= 0) | (F.col("norm") * F.col("most") * (1 + _SLACK) >= F.col("least"))
    sent = (
        asked.join(buckets, "width").where(reach)
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("part", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(parts)).cast("int"))
        .select("width", "bucket", "block", "part", "vec_id", "vector", "norm", "least")
    )
    met = sized.join(buckets, ["width", "bucket"]).select(
        "width", "bucket", F.pmod(F.xxhash64("vec_id", "vector"), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "vec_id", "vector", "norm",
    )

    def meet(asking: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asking.num_rows and held.num_rows:
            block = Block(held["held_vec_id"].to_numpy(), _matrix(held["held_vector"]), held["held_norm"].to_numpy())
            rows = zip(asking["vec_id"].to_pylist(), _matrix(asking["vector"]), asking["norm"].to_pylist(), asking["least"].to_pylist())
            for query_id, query, norm, least in rows:
                found = block.best(query_id, query, norm, float("-inf") if least is None else least, k)
                out += [(query_id, vec_id, score) for score, vec_id in found]
        columns = list(zip(*out)) or [[], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns)})

    keys = ["width", "bucket", "block", "part"]
    met = met.toDF(*[f"held_{name}" for name in met.columns])
    groups = sent.groupBy(*keys).cogroup(met.groupBy(*[f"held_{name}" for name in keys]))
    near = groups.applyInArrow(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
