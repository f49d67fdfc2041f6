"""Grouped counts, sums and their compositions.

Counts, sums and averages are combined on the map side first, so a key that holds a large
share of the rows reaches its reducer as one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    """Global count."""
    return df.agg(F.count("*").alias(name))


def top_keys(df: DataFrame, key: str, k: int = 10, name: str = "n") -> DataFrame:
    """The ``k`` most frequent keys, ties broken by the key.

    Sort and limit become one operator that keeps ``k`` rows per task; nothing is sorted whole.
    """
    return df.groupBy(key).agg(F.count("*").alias(name)).orderBy(F.desc(name), F.asc(key)).limit(k)


def sum_by_key(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """Sum of an expression by key."""
    return df.groupBy(key).agg(F.sum(value).alias(name))


def distinct_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without duplicates, over the given columns."""
    return df.select(*columns).distinct()


def distinct_row_count(df: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    """How many different rows there are."""
    return row_count(distinct_rows(df, *columns), name)


def prefix_averages(df: DataFrame, text: Column, length: int, number: Column) -> DataFrame:
    """Average of a number by the first characters of a text."""
    return df.groupBy(F.substring(text, 1, length).alias("prefix")).agg(F.avg(number).alias("average"))


def prefix_average_range(df: DataFrame, text: Column, length: int, number: Column, name: str = "rng") -> DataFrame:
    """Largest minus smallest average over the prefixes."""
    averages = prefix_averages(df, text, length, number)
    return averages.agg((F.max("average") - F.min("average")).alias(name))
