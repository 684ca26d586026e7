"""An append-only log: offsets from 1 for each topic, reads behind a cursor, subscribers, gaps, retention, garbage collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeflow.functions.messages import NONRETRYABLE, RETRYABLE
from routeflow.operators.numbering import numbered

#: Events kept, seconds until a silent subscriber no longer counts, and an event's greatest age in seconds.
KEEP, SILENT_S, AGE_S = 100_000, 300, 86_400


def append(df: DataFrame, topic: str, *order: str, base: int = 0) -> DataFrame:
    return numbered(df, [topic], order, "offset").withColumn("offset", F.col("offset") + base)


def since(log: DataFrame, topic: str, cursor: int, limit: int) -> DataFrame:
    """Each topic's first ``limit`` events behind the cursor. Offsets have no holes above the base, so a range does it."""
    base = log.groupBy(F.col(topic).alias("__topic")).agg(F.greatest(F.min("offset") - 1, F.lit(cursor)).alias("__base"))
    rows = log.where(F.col("offset") > cursor).join(base, log[topic].eqNullSafe(base["__topic"]))
    return rows.where(F.col("offset") <= F.col("__base") + limit).drop("__topic", "__base")


def since_each(log: DataFrame, topic: str, subscribers: DataFrame, subscriber: str, limit: int) -> DataFrame:
    """The same for each subscriber (topic, subscriber, last_ack), which is added to the rows."""
    base = log.groupBy(F.col(topic).alias("__topic")).agg((F.min("offset") - 1).alias("__base"))
    at = subscribers.select(F.col(topic).alias("__of"), F.col(subscriber).alias("__who"), "last_ack").join(base, F.col("__of").eqNullSafe(F.col("__topic")))
    at = at.select("__of", "__who", F.greatest("__base", "last_ack").alias("__from"))
    rows = log.join(at, log[topic].eqNullSafe(at["__of"]) & (F.col("offset") > F.col("__from")) & (F.col("offset") <= F.col("__from") + limit))
    return rows.select(*log.columns, F.col("__who").alias(subscriber))


def retained(log: DataFrame, topic: str, keep: int = KEEP) -> DataFrame:
    """The newest ``keep`` events of each topic."""
    top = log.groupBy(F.col(topic).alias("__topic")).agg(F.max("offset").alias("__top"))
    return log.join(top, log[topic].eqNullSafe(top["__topic"])).where(F.col("offset") > F.col("__top") - keep).drop("__topic", "__top")


def gaps(log: DataFrame, topic: str, cursors: list[int]) -> DataFrame:
    """(topic, requested, base, gap): whether a reader at the cursor has lost events."""
    base = log.groupBy(topic).agg(F.min("offset").alias("base"))
    return base.withColumn("requested", F.explode(F.array(*[F.lit(c).cast("long") for c in cursors]))).withColumn("gap", F.col("requested") + 1 < F.col("base"))


def registered(subscribers: DataFrame, reads: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, last_ack, seen_s): whoever reads is a subscriber from then on, at 0, and has shown a sign of life."""
    news = reads.select(*keys, F.lit(0).cast("long").alias("last_ack"), "seen_s")
    return subscribers.select(*keys, "last_ack", "seen_s").unionByName(news).groupBy(*keys).agg(F.max("last_ack").alias("last_ack"), F.max("seen_s").alias("seen_s"))


def acknowledged(acks: DataFrame, subscriber: str) -> DataFrame:
    """Each subscriber's highest acknowledged offset and last sign of life."""
    return acks.groupBy(subscriber).agg(F.max("offset").alias("last_ack"), F.max("seen_s").alias("seen_s"))


def acknowledge(subscribers: DataFrame, acks: DataFrame, keys: list[str]) -> DataFrame:
    """The registry after (keys, offset, seen_s): acknowledged offsets never go back, and an ack is a sign of life."""
    return registered(subscribers, acks.select(*keys, F.col("offset").alias("last_ack"), "seen_s").withColumnRenamed("last_ack", "__ack"), keys).alias("s").join(
        acks.groupBy(*keys).agg(F.max("offset").alias("__ack")), keys, "left"
    ).select(*keys, F.greatest("last_ack", F.coalesce("__ack", F.lit(0))).alias("last_ack"), "seen_s")


def committed(outcomes: DataFrame, keys: list[str], batch: str, status: str = "status") -> DataFrame:
    """(keys, batch, offset) of batches without a failure, to be acknowledged; a batch with one is read again whole."""
    bad = F.count_if(F.col(status).isin(RETRYABLE, NONRETRYABLE))
    return outcomes.groupBy(*keys, batch).agg(F.max("offset").alias("offset"), bad.alias("__bad")).where(F.col("__bad") == 0).drop("__bad")


def marked_garbage(log: DataFrame, topic: str, subscribers: DataFrame, now_s: Column, stored_s: str) -> DataFrame:
    """The log with ``removable``: a prefix of offsets up to the least acknowledged one of active subscribers, or too old,
    ending before the first event that must stay. Without active subscribers nothing goes. ``subscribers``: (topic,
    last_ack, seen_s). What a drop callback is told of are the removable rows."""
    low = subscribers.where(now_s - F.col("seen_s") < SILENT_S).groupBy(F.col(topic).alias("__topic")).agg(F.min("last_ack").alias("__low"))
    rows = log.join(low, log[topic].eqNullSafe(low["__topic"]), "left")
    stays = F.col("__low").isNull() | ((F.col("offset") > F.col("__low")) & (now_s - F.col(stored_s) <= AGE_S))
    marked = rows.withColumn("__stays", stays)
    first = marked.where("__stays").groupBy(F.col(topic).alias("__t")).agg(F.min("offset").alias("__first"))
    out = marked.join(first, marked[topic].eqNullSafe(first["__t"]), "left")
    return out.select(*log.columns, (F.col("__first").isNull() | (F.col("offset") < F.col("__first"))).alias("removable"))


def collect_garbage(log: DataFrame, topic: str, subscribers: DataFrame, now_s: Column, stored_s: str) -> DataFrame:
    """The log without its removable prefix; see :func:`marked_garbage`."""
    return marked_garbage(log, topic, subscribers, now_s, stored_s).where(~F.col("removable")).drop("removable")
