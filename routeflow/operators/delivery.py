"""Batches, retries, dead letters, ordered commits, sequences, claims and correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeflow.functions.messages import ACK, NONRETRYABLE, RETRYABLE
from routeflow.operators.marking import marked
from routeflow.operators.numbering import following, numbered, running_sum


def batched(df: DataFrame, size: int, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Adds ``pos`` (from 1) and ``batch`` (from 0) in each partition ``by``, or along one global order."""
    return numbered(df, by, order).withColumn("batch", F.floor((F.col("pos") - 1) / size).cast("long"))


def retry_delays(failures: Column, attempts: int = 5, initial_ms: int = 100, most_ms: int = 5000, multiplier: float = 2.0) -> Column:
    """Milliseconds slept before each further attempt of a message that fails ``failures`` times."""
    tries = F.least(failures, F.lit(attempts - 1))
    start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(initial_ms).cast("bigint").alias("next"))
    step = lambda s, _: F.struct(F.concat(s["out"], F.array(s["next"])).alias("out"), F.least((s["next"] * F.lit(multiplier)).cast("bigint"), F.lit(most_ms).cast("bigint")).alias("next"))
    return F.aggregate(F.when(tries > 0, F.sequence(F.lit(1), tries)).otherwise(F.array().cast("array<int>")), start, step, lambda s: s["out"])


def retried(failures: Column, retryable: Column, attempts: int) -> tuple[Column, Column]:
    """(attempts used, status at the end)."""
    used = F.when(retryable, F.least(failures + 1, F.lit(attempts))).otherwise(F.lit(1))
    status = F.when(failures == 0, ACK).when(~retryable, NONRETRYABLE).when(failures < attempts, ACK).otherwise(RETRYABLE)
    return used, status


def split_dead(outcomes: DataFrame, status: str = "status") -> tuple[DataFrame, DataFrame]:
    """(delivered, dead letters)."""
    bad = F.col(status).isin(RETRYABLE, NONRETRYABLE)
    return outcomes.where(~bad), outcomes.where(bad)


def abort_after_retryable(df: DataFrame, status: str, batch: str, pos: str) -> DataFrame:
    """Sending one by one: a retryable failure ends the batch, and all after it become retryable; non-retryable ones don't."""
    first = F.min(F.when(F.col(status) == RETRYABLE, F.col(pos))).over(Window.partitionBy(batch))
    return df.withColumn("final", F.when(F.col(pos) > first, RETRYABLE).otherwise(F.col(status)))


def contiguous_acks(df: DataFrame, nack: Column, seq: str, by: str) -> DataFrame:
    """Per ``by``: the highest sequence number before the first nack; null if the first one is."""
    marked = df.groupBy(by).agg(F.min(F.when(nack, F.col(seq))).alias("bad"), F.max(seq).alias("top"), F.min(seq).alias("low"))
    cut = F.coalesce(F.col("bad") - 1, F.col("top"))
    return marked.select(by, F.when(cut >= F.col("low"), cut).alias("committed"), F.col("bad").alias("first_nack"))


def partition_commits(df: DataFrame, nack: Column, batch: str, partition: str, offset: str) -> DataFrame:
    """Per batch and partition the next offset, or null where the batch holds a nack."""
    found = df.groupBy(batch, partition).agg(F.max(offset).alias("top"), F.max(nack.cast("int")).alias("bad"))
    any_bad = F.max("bad").over(Window.partitionBy(batch)) > 0
    return found.select(batch, partition, F.when(~any_bad, F.col("top") + 1).alias("next_offset"))


def allocate(df: DataFrame, batch: str, base: int = 0) -> DataFrame:
    """Sequence ranges of batches in order: (batch, size, first, last)."""
    sizes = running_sum(df.groupBy(batch).agg(F.count("*").alias("size")), [], [batch], "size", "last")
    last = F.col("last") + base
    return sizes.select(batch, "size", (last - F.col("size") + 1).alias("first"), last.alias("last"))


def claim(df: DataFrame, locked_until: str, now: Column, order: str, limit: int) -> DataFrame:
    """The first ``limit`` messages, in order, that no unexpired lease holds."""
    return df.where(F.col(locked_until).isNull() | (F.col(locked_until) < now)).orderBy(order).limit(limit)


#: Fixed value: milliseconds for which a claim holds.
LEASE_MS = 60_000


def leased(queue: DataFrame, claimed: DataFrame, key: str, locked_until: str, now: Column, lease: int = LEASE_MS) -> DataFrame:
    """The queue after a claim: claimed messages are locked until the lease ends."""
    taken = claimed.select(key, F.lit(True).alias("__taken"))
    rows = queue.join(taken, key, "left")
    return rows.withColumn(locked_until, F.when(F.col("__taken"), now + lease).otherwise(F.col(locked_until))).select(*queue.columns)


def settled(queue: DataFrame, outcomes: DataFrame, key: str, locked_until: str, status: str = "status") -> DataFrame:
    """The queue after outcomes (key, status) of claimed messages: handled ones are gone, failed ones free again at once."""
    rows = queue.join(outcomes.select(key, F.col(status).alias("__status")), key, "left")
    bad = F.col("__status").isin(RETRYABLE, NONRETRYABLE)
    return rows.where(F.col("__status").isNull() | bad).withColumn(locked_until, F.when(bad, None).otherwise(F.col(locked_until))).select(*queue.columns)


def commit_order(batches: DataFrame, ready: str, seq: str = "seq") -> DataFrame:
    """Adds ``committed``: commits run in the order of ``seq``, so that a batch waits for all before it, however early it is ready."""
    parts = numbered(batches, [], [seq], "__pos").withColumn("__part", F.floor(F.col("__pos") / 100_000))
    here = Window.partitionBy("__part").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    tops = parts.groupBy("__part").agg(F.max(ready).alias("__top"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for 100,000 batches
    tops = tops.select("__part", F.max("__top").over(before).alias("__before"))
    rows = parts.join(tops, "__part")
    return rows.select(*batches.columns, F.greatest(F.max(ready).over(here), "__before").alias("committed"))


def insert_new(incoming: DataFrame, existing: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """Rows whose key isn't there yet, once; a duplicate key is a success that writes nothing. Of equal keys the first in ``order`` is
    written, or the one that a hash of the row puts first. Rows without a key are all written."""
    fresh = incoming.join(existing.select(key), key, "left_anti").select(*incoming.columns)
    rest = [c for c in incoming.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*order, F.xxhash64(*rest))) if rest else F.lit(None)
    # rows without a key are groups of their own, dealt by their hash
    own = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    out = fresh.withColumn("__own", own).groupBy(key, "__own").agg(first.alias("__first"))
    return out.select(key, *([F.col("__first")[c].alias(c) for c in rest])).select(*incoming.columns)


def requeue(batch: DataFrame, nack: Column, queue: DataFrame, order: str) -> DataFrame:
    """Rejected messages go to the tail as one batch: read by (``turn``, ``place``), they come after the queue, in their order."""
    return queue.withColumns({"turn": F.lit(0), "place": F.col(order)}).unionByName(batch.where(nack).withColumns({"turn": F.lit(1), "place": F.col(order)}))


def _first_answers(requests: DataFrame, answers: DataFrame, key: str, asked: str, answered: str) -> DataFrame:
    """(__key, __at, q, n): each request as a struct with the first answer of its key from its time on, all in the order of the key."""
    theirs = [c for c in answers.columns if c != key]
    kind = answers.select(F.struct(*theirs).alias("a")).schema["a"].dataType
    asks = requests.select(F.col(key).alias("__key"), F.col(asked).alias("__when"), F.lit(0).alias("__side"), F.struct(*requests.columns).alias("q"), F.lit(None).cast(kind).alias("a"))
    gives = answers.select(F.col(key).alias("__key"), F.col(answered).alias("__when"), F.lit(1).alias("__side"), F.lit(None).cast(asks.schema["q"].dataType).alias("q"), F.struct(*theirs).alias("a"))
    # no answer belongs to a null key; an answer at a request's very time counts; equal answers tie by their hash
    known = asks.where(F.col("__key").isNotNull()).unionAll(gives.where(F.col("__key").isNotNull())).withColumn("__tie", F.xxhash64("a"))
    found = following(known.withColumnRenamed("__when", "__time"), ["__key"], ["__time", "__side", "__tie"], "a", "n")
    found = found.where(F.col("__side") == 0).select("__key", F.col("__time").alias("__when"), "q", "n")
    return found.unionAll(asks.where(F.col("__key").isNull()).select("__key", "__when", "q", F.lit(None).cast(kind).alias("n")))


def replies(requests: DataFrame, answers: DataFrame, key: str, asked: str, answered: str, timeout: int) -> DataFrame:
    """Each request with its first answer of the same correlation within ``timeout``: the request's columns, the answer's
    but for the key (null where none came), and ``timed_out``. One ordered pass instead of a range join; an answer may serve several."""
    theirs = [c for c in answers.columns if c != key]
    fine = F.coalesce(F.col(f"n.{answered}") <= F.col("__when") + timeout, F.lit(False))
    return _first_answers(requests, answers, key, asked, answered).select("q.*", *[F.when(fine, F.col(f"n.{c}")).alias(c) for c in theirs], (~fine).alias("timed_out"))


#: Outcomes of a request.
ANSWERED, TIMED_OUT, DUPLICATE = "answered", "timed_out", "duplicate"


def exchanged(requests: DataFrame, answers: DataFrame, key: str, asked: str, answered: str, timeout: int, tie: str) -> DataFrame:
    """Requests and answers one to one: of a correlation one request waits at a time, until its first answer or for ``timeout``. A
    request that comes while another waits is a duplicate and waits for nothing; an answer serves the request that waits, or none.
    The request's columns, the answer's but for the key, and ``outcome``. Requests of one time come in the order of ``tie``, all of
    them before answers of that time; times are integers. Requests without a correlation time out."""
    theirs = [c for c in answers.columns if c != key]
    found = _first_answers(requests, answers, key, asked, answered)
    end = F.least(F.coalesce(F.col(f"n.{answered}"), F.col("__when") + timeout), F.col("__when") + timeout)
    rows = found.withColumns({"__tie": F.col(f"q.{tie}"), "__until": end.cast("long") + 1})
    waits = marked(rows.where(F.col("__key").isNotNull()), ["__key"], ["__when", "__tie"], F.col("__when").cast("long"), timeout + 1, mark="__waits", group="__turn", reach=F.col("__until"))
    alone = rows.where(F.col("__key").isNull()).withColumns({"__waits": F.lit(True), "__turn": F.lit(0).cast("long")})
    fine = F.col("__waits") & F.coalesce(F.col(f"n.{answered}") <= F.col("__when") + timeout, F.lit(False))
    outcome = F.when(fine, ANSWERED).when(F.col("__waits"), TIMED_OUT).otherwise(DUPLICATE)
    return waits.unionByName(alone).select("q.*", *[F.when(fine, F.col(f"n.{c}")).alias(c) for c in theirs], outcome.alias("outcome"))


def faulty(id_: Column, per_mille: int) -> Column:
    """A fault that strikes the same messages in every run."""
    return F.pmod(id_, F.lit(1000)) < per_mille
