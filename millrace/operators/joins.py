"""Joins that can be split at hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def splittable_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    salts: int = 1,
    spread: Column | None = None,
) -> DataFrame:
    """Equi-join of a large side, where one key may hold a large share of the rows, with a
    smaller one.

    Adaptive execution splits a hot key only when both inputs of the join are plain shuffles.
    The output of an aggregate or of another join on the same keys is not: Spark would reuse
    its partitioning, and the hot key stays in one task. Here a further key column, computed
    and therefore new to Spark, makes it shuffle both sides for this join.

    With ``salts`` above 1 the rows of a key are spread over that many tasks from the start,
    by a hash of ``spread`` (a column that differs within a key), and each row of the right
    side is copied to all of them. That helps without adaptive execution, and costs the copies.

    ``how`` is ``inner`` or ``left``: with these every left row stands for itself.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how!r}")
    if salts > 1 and spread is None:
        raise ValueError("salting needs a column to spread by")
    salted = left.withColumn("_salt", _bucket(F.col(keys[0]) if spread is None else spread, salts))
    if salts == 1:
        copied = right.withColumn("_salt", _bucket(F.col(keys[0]), 1))
    else:
        copied = right.withColumn("_salt", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(salts)])))
    return salted.join(copied, [*keys, "_salt"], how).drop("_salt")


def _bucket(column: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets))
