"""Named topics in a shared folder: a queue that is drained from its head, or a log that subscribers read behind a cursor.

A topic is one or the other. A publisher that names no mode follows the topic: it appends to the log where there is one.

Messages stand in *segments*, folders of Parquet files that never change. A batch is written once, in the order of its
arrival; then the topic's manifest, swapped in one step, gives it a range of offsets after all others. So publishers may
write at the same time and never share an offset, and nobody sees half of a batch. Offsets have no holes: within a segment
they are counted from the manifest, which knows how many messages each of its partitions holds.

Taking from a queue and dropping from a log move the topic's base, in the manifest too. Segments below it go whole; of the
first one that stays, readers skip what is below. Rejected messages come back as a segment of their own at the tail, by
the same swap that takes them from the head. Where two consumers have read the same messages, the first to commit has
them, and the other one's commit is an error.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeflow.functions.messages import MESSAGE
from routeflow.functions.shared import table
from routeflow.operators.event_log import AGE_S, SILENT_S
from routeflow.sources.manifest import Manifest, State, delete

_COLUMNS = [f.name for f in MESSAGE.fields]
#: A segment's columns: a message, its partition, and its place there in the lower bits of ``at``.
_PART, _AT, _PLACE = "__part", "__at", (1 << 33) - 1
#: Partitions of segments whose offsets are broadcast to a read at most, some 60 bytes each; beyond, they are joined.
_BROADCAST = 100_000
#: Names of commits and segments that a topic remembers, to know one that is made again.
REMEMBERED = 1000


class Taken(RuntimeError):
    """What was read has been taken by another consumer."""


class Gap(ValueError):
    """What was asked for has been dropped."""


def manifest(root: str, topic: str) -> Manifest:
    return Manifest(f"{root}/{topic}/manifest")


def mode_of(root: str, topic: str) -> str | None:
    return manifest(root, topic).state().get("mode")


def _agreed(state: State, topic: str, mode: str | None) -> str:
    known = state.get("mode")
    if known and mode and known != mode:
        raise ValueError(f"topic {topic} is a {known}, not a {mode}")
    return known or mode or "queue"


def segment_path(root: str, topic: str, segment: str) -> str:
    return f"{root}/{topic}/segments/segment={segment}"


def check_mode(root: str, topic: str, mode: str | None) -> None:
    _agreed(manifest(root, topic).state(), topic, mode)


def stage(messages: DataFrame, root: str, topic: str, order: Sequence[str] = ("message_id",)) -> State:
    """Writes a batch as a segment that no reader sees until it is attached. Null orders come first."""
    spark, name = messages.sparkSession, uuid.uuid4().hex
    path = segment_path(root, topic, name)
    rows = messages.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select(*_COLUMNS, F.spark_partition_id().alias(_PART), F.monotonically_increasing_id().alias(_AT)).write.parquet(path)
    counts = spark.read.parquet(path).groupBy(_PART).count().collect()  # a row for each task that wrote
    return {"id": name, "parts": sorted([r[_PART], r["count"]] for r in counts)}


def _attached(state: State, segment: State, now_ms: int) -> State:
    n = sum(count for _, count in segment["parts"])
    if not n or segment["id"] in state["attached"]:
        return state
    state["attached"] = [*state["attached"], segment["id"]][-REMEMBERED:]
    state["segments"].append(segment | {"first": state["next"], "rows": n, "stored_ms": max(now_ms, state["segments"][-1]["stored_ms"] if state["segments"] else 0)})
    state["next"] += n
    return state


def _begun(state: State, topic: str, mode: str | None) -> State:
    return {"mode": _agreed(state, topic, mode), "base": 1, "next": 1, "segments": [], "attached": [], "taken": [], "subscribers": {}} | state


def attach(root: str, topic: str, segment: State, mode: str | None = None) -> State:
    """Puts a staged segment at the topic's tail; once only, however often it is called."""
    now = int(time.time() * 1000)
    return manifest(root, topic).update(lambda s: _attached(_begun(s, topic, mode), segment, now))


def publish(messages: DataFrame, root: str, topic: str, mode: str | None = None, order: str | Sequence[str] = "message_id") -> State:
    """Appends a batch in the order of ``order``."""
    check_mode(root, topic, mode)
    return attach(root, topic, stage(messages, root, topic, [order] if isinstance(order, str) else order), mode)


def _between(spark: SparkSession, root: str, topic: str, state: State, low: int, high: int | None = None) -> DataFrame:
    """Messages with offsets from ``low`` to ``high``, with ``offset`` and ``stored_at``; only segments that hold some are read."""
    low, high = max(low, state.get("base", 1)), min(high or 1 << 62, state.get("next", 1) - 1)
    segments = [s for s in state.get("segments", ()) if s["first"] <= high and s["first"] + s["rows"] > low]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in MESSAGE.fields)
    if not segments:
        return spark.createDataFrame([], f"{schema}, offset long, stored_at timestamp")
    starts = []
    for s in segments:
        first = s["first"]
        for part, n in s["parts"]:
            if first <= high and first + n > low:
                starts.append((s["id"], part, first, s["stored_ms"]))
            first += n
    places = spark.createDataFrame(starts, "of string, in_part int, first long, stored_ms long")
    places = F.broadcast(places) if len(starts) <= _BROADCAST else places
    files = spark.read.schema(f"{schema}, {_PART} int, {_AT} long, segment string").option("basePath", f"{root}/{topic}/segments").parquet(*[segment_path(root, topic, s["id"]) for s in segments])
    rows = files.join(places, (F.col("segment") == F.col("of")) & (F.col(_PART) == F.col("in_part")))
    rows = rows.select(*_COLUMNS, (F.col("first") + F.col(_AT).bitwiseAND(F.lit(_PLACE))).alias("offset"), F.timestamp_millis("stored_ms").alias("stored_at"))
    return rows.where(F.col("offset").between(low, high))


def queued(spark: SparkSession, root: str, topic: str, limit: int | None = None) -> DataFrame:
    """What the queue holds, or its first ``limit`` messages; a topic that nobody has published to is empty."""
    state = manifest(root, topic).state()
    _agreed(state, topic, "queue")
    base = state.get("base", 1)
    return _between(spark, root, topic, state, base, None if limit is None else base + limit - 1)


def _without_prefix(state: State, base: int) -> State:
    state["base"] = base
    state["segments"] = [s for s in state["segments"] if s["first"] + s["rows"] > base]
    return state


def _delete_segments(root: str, topic: str, before: State, after: State) -> None:
    stays = {s["id"] for s in after["segments"]}
    for s in before["segments"]:
        if s["id"] not in stays:
            delete(segment_path(root, topic, s["id"]))


def window(root: str, topic: str, limit: int | None = None) -> tuple[int, int]:
    """(first, last) offset of a queue's next messages; last < first where there are none."""
    state = manifest(root, topic).state()
    first, end = state.get("base", 1), state.get("next", 1) - 1
    return first, end if limit is None else min(end, first + limit - 1)


def taken(root: str, topic: str, first: int, last: int, commit: str, rejected: State | None = None) -> None:
    """Takes offsets ``first`` to ``last`` from a queue's head, and puts a staged segment of rejected messages at its tail. A commit of
    the same name is made once; if someone else has taken them, it is an error."""
    now, before = int(time.time() * 1000), {}

    def change(state: State) -> State | None:
        before.update(_begun(state, topic, "queue"))
        state = _begun(state, topic, "queue")
        if commit in state["taken"]:
            return None
        if state["base"] != first:
            raise Taken(f"{topic}: {first} to {last} were read, but {state['base']} is the first left")
        state = _without_prefix(state, last + 1)
        state["taken"] = [*state["taken"], commit][-REMEMBERED:]
        return state if rejected is None else _attached(state, rejected, now)

    after = manifest(root, topic).update(change)
    _delete_segments(root, topic, before, after)


def drained(spark: SparkSession, root: str, topic: str, limit: int | None = None) -> tuple[DataFrame, Callable[..., None]]:
    """What the queue holds now (or its first ``limit`` messages), and a function that takes just that out of it. Its argument,
    messages that were rejected, go to the queue's tail as one batch, in their order. What is published meanwhile stays."""
    first, last = window(root, topic, limit)
    rows = queued(spark, root, topic, max(0, last - first + 1))

    def done(rejected: DataFrame | None = None) -> None:
        if last >= first:
            back = None if rejected is None else stage(rejected, root, topic, ["offset"] if "offset" in rejected.columns else ["message_id"])
            taken(root, topic, first, last, uuid.uuid4().hex, back)

    return rows, done


def read_log(spark: SparkSession, root: str, topic: str, cursor: int = 0, limit: int | None = None) -> DataFrame:
    """Events behind the cursor; a late subscriber starts at 0 and sees all that is left. A cursor before the log's base is an error."""
    state = manifest(root, topic).state()
    _agreed(state, topic, "log")
    base = state.get("base", 1)
    if cursor and cursor + 1 < base:
        raise Gap(f"gap in {topic}: {cursor + 1} was asked for, {base} is the first left")
    low = max(cursor + 1, base)
    return _between(spark, root, topic, state, low, None if limit is None else low + limit - 1)


def register(root: str, topic: str, subscriber: str, now_s: float | None = None) -> int:
    """A sign of life; who is new starts at 0. Returns the last offset that the subscriber has acknowledged."""
    now = time.time() if now_s is None else now_s

    def change(state: State) -> State:
        state = _begun(state, topic, "log")
        known = state["subscribers"].get(subscriber, {"ack": 0})
        state["subscribers"][subscriber] = {"ack": known["ack"], "seen": now}
        return state

    return manifest(root, topic).update(change)["subscribers"][subscriber]["ack"]


def acknowledge(root: str, topic: str, subscriber: str, offset: int, now_s: float | None = None) -> None:
    """Acknowledged offsets never go back; an unknown subscriber's are ignored."""
    now = time.time() if now_s is None else now_s

    def change(state: State) -> State | None:
        known = state.get("subscribers", {}).get(subscriber)
        if known is None:
            return None
        state["subscribers"][subscriber] = {"ack": max(known["ack"], offset), "seen": now}
        return state

    manifest(root, topic).update(change)


def subscribed(spark: SparkSession, root: str, topic: str, subscriber: str, limit: int | None = None) -> tuple[DataFrame, int, Callable[[], None]]:
    """What a subscriber hasn't acknowledged yet, the last offset of that, and a function that acknowledges it."""
    ack = register(root, topic, subscriber)
    state = manifest(root, topic).state()
    if ack and ack + 1 < state["base"]:
        raise Gap(f"gap in {topic}: {ack + 1} was asked for, {state['base']} is the first left")
    last = state["next"] - 1 if limit is None else min(state["next"] - 1, max(ack, state["base"] - 1) + limit)
    rows = _between(spark, root, topic, state, ack + 1, last) if last > ack else _between(spark, root, topic, {}, 1)
    return rows, last, lambda: acknowledge(root, topic, subscriber, last)


def droppable(state: State, keep: int | None, now_s: float, age_s: float | None, silent_s: float) -> int:
    """The base after retention. The newest ``keep`` events stay whatever else holds; once there is a subscriber, a prefix goes that all
    active ones have acknowledged, or that is older than ``age_s``."""
    base = state["base"]
    if keep is not None:
        base = max(base, state["next"] - keep)
    if state["subscribers"]:
        acks = [s["ack"] for s in state["subscribers"].values() if now_s - s["seen"] < silent_s]
        base = max([base, *([min(acks) + 1] if acks else [])])
        for s in state["segments"]:
            if s["first"] > base or age_s is None or now_s - s["stored_ms"] / 1000 <= age_s:
                break
            base = max(base, s["first"] + s["rows"])
    return min(base, state["next"])


def collect_garbage(
    spark: SparkSession, root: str, topic: str, keep: int | None = None, age_s: float | None = AGE_S, silent_s: float = SILENT_S,
    archive: str | None = None, on_drop: Callable[[DataFrame], None] | None = None, now_s: float | None = None,
) -> int:
    """Drops the log's prefix that retention lets go, and returns how many events that were. They are copied to the folder
    ``archive`` first; ``on_drop`` is told of them once, when they are gone."""
    now, before = time.time() if now_s is None else now_s, manifest(root, topic).state()
    if not before:
        return 0
    _agreed(before, topic, "log")
    base = droppable(before, keep, now, age_s, silent_s)
    if base <= before["base"]:
        return 0
    gone = None
    if archive or on_drop:
        gone = _between(spark, root, topic, before, before["base"], base - 1)
        kept = f"{archive}/{topic}-{before['base']:020d}-{base - 1:020d}" if archive else None
        if kept:
            gone.write.mode("overwrite").parquet(kept)
            gone = spark.read.schema(gone.schema).parquet(kept)
        else:
            gone = table(gone, f"dropped-{topic}")

    def change(state: State) -> State:
        if state["base"] != before["base"]:
            raise Taken(f"{topic}: another collector was first")
        return _without_prefix(state, base)

    after = manifest(root, topic).update(change)
    if on_drop is not None:
        on_drop(gone)
    _delete_segments(root, topic, before, after)
    return base - before["base"]
