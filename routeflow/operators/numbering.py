"""Places, running sums and previous values along an order within each key, without bringing a key into one task.

Rows are range-partitioned by (key, order) and sorted, so that a key with a third of all rows spreads over a third of the
partitions. Within a partition Spark's own row ids count on without gaps; how much a key has in earlier partitions comes
from a table with one row for each key and partition. Everything stays on the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeflow.functions.shared import table


def _placed(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Written once: range bounds come from a sample, and both uses below must see the same ones."""
    rows = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    return table(rows.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")), "placed")


def _with_earlier(placed: DataFrame, by: Sequence[str], amount: Column) -> DataFrame:
    """Adds ``__start``, the first row id of a key in a partition, and ``__earlier``, the key's amount in partitions before."""
    runs = placed.groupBy(*by, "__part").agg(amount.alias("__n"), F.min("__at").alias("__start"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*[F.col(b).alias(f"__by{i}") for i, b in enumerate(by)], F.col("__part").alias("__in"), "__start", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__earlier"))
    same = F.col("__part") == F.col("__in")
    for i, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"__by{i}"))
    return placed.join(runs, same)


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "pos") -> DataFrame:
    """Adds ``name``: each row's place in its key's order, from 1. Null keys are a key; without keys, all rows are one."""
    rows = _with_earlier(_placed(df, by, order), by, F.count("*"))
    return rows.select(*[c for c in df.columns if c != name], (F.col("__at") - F.col("__start") + F.col("__earlier") + 1).cast("long").alias(name))


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over a key's rows up to this one. Nulls add nothing."""
    amount = F.coalesce(F.col(value), F.lit(0))
    here = Window.partitionBy(*by, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    rows = _with_earlier(_placed(df, by, order), by, F.sum(amount))
    return rows.select(*[c for c in df.columns if c != name], (F.sum(amount).over(here) + F.col("__earlier")).alias(name))


def following(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the first ``value`` that isn't null, of this row or those behind it in the key's order."""
    placed = _placed(df, by, order)
    here = Window.partitionBy(*by, "__part").orderBy("__at").rowsBetween(0, Window.unboundedFollowing)
    firsts = placed.where(F.col(value).isNotNull()).groupBy(*by, "__part").agg(F.min_by(value, "__at").alias("__first"))
    runs = placed.select(*by, "__part").distinct()
    same = runs["__part"] == firsts["__part"]
    for b in by:
        same &= runs[b].eqNullSafe(firsts[b])
    runs = runs.join(firsts, same, "left").select(*[runs[b].alias(f"__by{i}") for i, b in enumerate(by)], runs["__part"].alias("__in"), "__first")
    behind = Window.partitionBy(*[f"__by{i}" for i in range(len(by))]).orderBy("__in").rowsBetween(1, Window.unboundedFollowing)
    runs = runs.withColumn("__later", F.first("__first", ignorenulls=True).over(behind)).drop("__first")
    same = F.col("__part") == F.col("__in")
    for i, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"__by{i}"))
    rows = placed.withColumn("__own", F.first(value, ignorenulls=True).over(here)).join(runs, same)
    return rows.select(*[c for c in df.columns if c != name], F.coalesce("__own", "__later").alias(name))
