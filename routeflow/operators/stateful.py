"""TTL deduplication and the weak join: what must see a key's messages one after another.

Which message is accepted, or opens a group, follows from the one before that was or did: :mod:`routeflow.operators.marking` finds
them without bringing a key into one task. Without a TTL or a timeout, plain aggregates do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeflow.functions.messages import as_json_element, merged_array
from routeflow.operators.marking import Marks, marked  # noqa: F401  Marks folds one key's rows, here for streams
from routeflow.operators.numbering import numbered


def first_of_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Deduplication for ever: the first message of each key. A minimum combines before the shuffle, which a rank can't."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("first") if rest else F.count("*").alias("first")
    out = df.groupBy(*keys).agg(first)
    return out.select(*keys, "first.*").select(*df.columns) if rest else out.select(*keys)


def dedup_ttl(df: DataFrame, keys: Sequence[str], us: str, tie: str, ttl_s: int) -> DataFrame:
    """A message is accepted if none of its key was, or the last accepted one is ``ttl_s`` whole seconds old. Duplicates
    refresh nothing; ``ttl_s`` 0 accepts everything. Null keys are a key; messages without a time have no place and go."""
    df = df.where(F.col(us).isNotNull())
    if ttl_s <= 0:
        return df
    return marked(df, keys, [us, tie], F.floor(F.col(us) / 1_000_000).cast("long"), ttl_s, mark="__accepted", group="__grp").where("__accepted").select(*df.columns)


def weak_join_groups(df: DataFrame, key: str, us: str, tie: str, count: int, timeout_us: int | None = None) -> DataFrame:
    """Adds ``grp``: a key's messages are buffered until ``count`` are there or, at the next arrival, ``timeout_us`` has
    passed since the group's first one."""
    if timeout_us is None:
        return numbered(df, [key], [us, tie], "grp").withColumn("grp", F.floor((F.col("grp") - 1) / count).cast("long"))
    clock = F.coalesce(F.col(us), F.lit(-(1 << 62)))  # messages without a time come first, as one moment
    return marked(df, [key], [us, tie], clock, max(1, timeout_us), count, mark="__opens").drop("__opens")


def weak_join(df: DataFrame, key: str, us: str, tie: str, payload: str, count: int, timeout_us: int | None = None, on_end: str = "flush", carry: Sequence[str] = ()) -> DataFrame:
    """One row a group: (key, grp, size, first, complete, payload as a JSON array in arrival order, null where a payload is), then the
    columns in ``carry`` of the group's first message. ``on_end='drop'`` leaves out incomplete last groups."""
    rows = weak_join_groups(df, key, us, tie, count, timeout_us)
    parts = F.sort_array(F.collect_list(F.struct(F.col(us).alias("t"), F.col(tie).alias("i"), as_json_element(F.col(payload)).alias("p"))))  # at most ``count`` elements
    out = rows.groupBy(key, "grp").agg(F.count("*").alias("size"), F.min_by(F.struct(F.col(tie).alias("first"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]), F.struct(us, tie)).alias("f"), parts.alias("parts"))
    out = out.select(key, "grp", "size", "f.first", (F.col("size") >= count).alias("complete"), merged_array(F.transform("parts", lambda x: x["p"])).alias("payload"), *[F.col(f"f.c{i}").alias(c) for i, c in enumerate(carry)])
    if on_end == "drop":
        last = F.max("grp").over(Window.partitionBy(key))
        out = out.withColumn("__last", last).where(F.col("complete") | (F.col("grp") < F.col("__last"))).drop("__last")
    return out
