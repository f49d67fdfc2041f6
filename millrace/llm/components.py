"""Connected components of a table of links, by alternating star operations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import drop_staged, staged
from millrace.operators.joins import splittable_join

# Rows that a task takes at least, on average, before a step is dealt out to more tasks.
ROWS = 100_000


def in_few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has about ``rows`` rows at most, in no more tasks (and so files) than they need.

    Where a shuffle has more pieces than that, a task takes several of them; no row moves for it.
    """
    return df.coalesce(max(1, math.ceil(rows / ROWS)))


def _smallest(links: DataFrame) -> DataFrame:
    """node, least: the smallest of every node and its neighbours."""
    return links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("least"))


def _large_star(links: DataFrame, rows: int) -> DataFrame:
    """Every neighbour above a node is linked to the smallest neighbour of that node."""
    both = links.union(links.select("b", "a"))
    least = in_few_tasks(_smallest(both), rows)
    joined = in_few_tasks(splittable_join(both.withColumnRenamed("a", "node"), least, ["node"]), 2 * rows)
    return in_few_tasks(joined.where("b > node").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct(), rows)


def _small_star(links: DataFrame, rows: int) -> DataFrame:
    """Every node and its neighbours below it are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = in_few_tasks(_smallest(down), rows)
    joined = in_few_tasks(splittable_join(down.withColumnRenamed("a", "node"), least, ["node"]), rows)
    stars = (
        joined.select("b", "least").union(joined.select("node", "least"))
        .where("b <> least")
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .distinct()
    )
    return in_few_tasks(stars, rows)


def connected(links: DataFrame) -> DataFrame:
    """node, label of every end of ``links`` (a, b): label is the smallest node it is connected to.

    A round makes the links of every node point further down; the rounds end when the links no
    longer change, which takes a number logarithmic in the longest path. Minima are combined
    before the shuffle, so a node with very many links is no hot key; the joins are left to
    adaptive execution, which splits them. Every round ends as files in the shared folder; the
    driver sees one count and one checksum a round. No round makes more links than it takes, so
    the count says how many tasks and files the next one needs: small tables are not dealt out
    to all pieces of a shuffle, round after round. ``links``, staged as a rule, is counted and then
    read in the first round alone.
    """
    now, before, earlier, rows = links.select("a", "b").where("a <> b"), None, [], links.count()
    while True:
        now = staged(_small_star(_large_star(now, rows), rows), "components")
        drop_staged(*earlier)
        earlier = [now]
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before, rows = state, state[0]
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("label", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)
