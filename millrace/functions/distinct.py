"""Exact, approximate and sketch-based distinct counts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The relative errors of the report, and the default one.
ERRORS = (0.005, 0.02, 0.05, 0.1)
DEFAULT_ERROR = 0.05


def sketch_size(error: float) -> int:
    """log2 of the number of sketch buckets whose standard error is at most ``error``.

    The standard error of a HyperLogLog sketch is about 1.04 / sqrt(buckets). The sketch
    functions accept 4 to 21; a smaller error than 21 give is refused.
    """
    size = math.ceil(math.log2((1.04 / error) ** 2))
    if size > 21:
        raise ValueError(f"no sketch has an error as small as {error}")
    return max(4, size)


def sketch_init_agg(column: Column | str, error: float = DEFAULT_ERROR) -> Column:
    """Aggregate a column into one sketch (BINARY) of at most a few hundred KiB."""
    return F.hll_sketch_agg(column, F.lit(sketch_size(error)))


def sketch_cardinality(sketch: Column | str) -> Column:
    """Estimated distinct count held in a sketch."""
    return F.hll_sketch_estimate(sketch)


# Tasks that merge sketches before the last one does.
MERGE_TASKS = 256


def merged_sketches(df: DataFrame, column: str, errors: Sequence[float]) -> DataFrame:
    """One row with the number of rows, ``n``, and a sketch of the column for each error: ``s0``,
    ``s1`` …

    Each task makes one sketch of up to 64 KiB. With hundreds of thousands of tasks a single
    one should not merge them all: they are merged in groups of tasks first.
    """
    grouped = df.select(F.col(column).alias("value"), F.pmod(F.spark_partition_id(), F.lit(MERGE_TASKS)).alias("part"))
    names = [f"s{i}" for i in range(len(errors))]
    partial = grouped.groupBy("part").agg(
        F.count("*").alias("n"), *[sketch_init_agg("value", error).alias(name) for name, error in zip(names, errors)]
    )
    return partial.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.hll_union_agg(name).alias(name) for name in names])


def sketches_by(df: DataFrame, by: Sequence[str], column: str, error: float = DEFAULT_ERROR) -> DataFrame:
    """One mergeable sketch of ``column`` for each group, with its number of rows: what is stored by day
    to answer for any period later. Each task hands on one sketch per group it has seen."""
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), sketch_init_agg(column, error).alias("sketch"))


def merged_estimate(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows and estimated distinct values of stored sketches together, by some of their columns or
    over all; only sketches are read. Sketches must be of one size. Nothing to merge: 0."""
    return sketches.groupBy(*by).agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
        F.coalesce(sketch_cardinality(F.hll_union_agg("sketch")), F.lit(0)).alias("estimate"),
    )


def distinct_report(
    df: DataFrame,
    column: str,
    errors: Sequence[float] = ERRORS,
    method: str = "sketch",
    sketched: Sequence[float] = (),
) -> DataFrame:
    """One row: exact count, default estimates, and a map from error to estimate.

    Estimates are built-in aggregates or sketches as ``method`` says, and sketches for the
    errors in ``sketched``: below about 0.01 a built-in aggregate keeps thousands of buffer
    columns, whose code takes longer to compile than the query to run.

    The column is read and its repeats are dropped once, as the exact count needs anyway; it and
    all estimates are made from the different values, which no estimate can tell from all.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    by_sketch = [error for error in errors if method == "sketch" or error in sketched]
    built_in = [error for error in errors if error not in by_sketch]
    counts = merged_sketches(values, column, [DEFAULT_ERROR, *by_sketch])
    estimates = {error: sketch_cardinality(f"s{i}") for i, error in enumerate(by_sketch, 1)}
    approx = values.agg(
        F.struct(
            F.approx_count_distinct(column).alias("default"),
            *[F.approx_count_distinct(column, error).alias(f"e{i}") for i, error in enumerate(built_in)],
        )
    )
    joined = counts.withColumn("approx", approx.scalar())
    estimates |= {error: F.col(f"approx.e{i}") for i, error in enumerate(built_in)}
    by_error = [part for error in errors for part in (F.lit(error).cast("decimal(5,3)"), estimates[error])]
    return joined.select(
        F.col("n").alias("exact"),
        F.col("approx.default").alias("approx_default"),
        F.coalesce(sketch_cardinality("s0"), F.lit(0)).alias("sketch_default"),
        F.create_map(*by_error).alias("by_error"),
    )


def error_check(report: DataFrame, factor: float = 3.0) -> DataFrame:
    """One row per error of a distinct report, and two with the names of the default estimates:
    is there an estimate, and is it within ``factor`` errors?"""
    by_error = report.select("exact", F.explode("by_error").alias("error", "estimate")).withColumn("name", F.col("error").cast("string"))
    bound = F.lit(DEFAULT_ERROR).cast("decimal(5,3)").alias("error")
    defaults = [
        report.select("exact", bound, F.col(name).alias("estimate"), F.lit(name).alias("name"))
        for name in ("approx_default", "sketch_default")
    ]
    rows = by_error.union(defaults[0]).union(defaults[1])
    return rows.select(
        "name",
        "error",
        "exact",
        (F.col("estimate") > 0).alias("estimated"),
        (F.abs(F.col("estimate") - F.col("exact")) <= F.col("exact") * F.col("error").cast("double") * factor).alias(
            "within_bound"
        ),
    )
