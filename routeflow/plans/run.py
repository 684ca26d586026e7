"""A configured route from its source to its sinks, batch by batch: all sinks have a batch, or none has and its source keeps it.

Sinks that send (HTTP, Kafka, custom ones) go first; what they can't deliver and nothing takes as dead letters ends the batch.
For the others (topics, files, tables) a batch is written where no reader sees it. Then the route's ledger gets what is to be done:
take the messages from their source, and make each of the written parts seen. Each of these steps can be made again without
effect, so whoever opens the ledger after a crash makes them all. Messages that were sent before a batch failed are noted,
and not sent again with the next try.
"""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeflow.functions import messages as M
from routeflow.functions.shared import exists, folder, move_into, remove, table
from routeflow.operators.sending import dead_letters, send_with_retry
from routeflow.plans import build
from routeflow.plans.config import SINKS, SOURCES, Endpoint, Route, children, named, title
from routeflow.sources import readers, streams, topics, writers
from routeflow.sources.manifest import Manifest

#: Sinks that deliver at once; what they got can't be taken back.
SENDING = {"http", "kafka", "custom"}


class Failed(RuntimeError):
    """Messages could not be delivered, and no sink takes dead letters; the source keeps them."""


def _placed(df: DataFrame) -> DataFrame:
    """Messages of a topic with the time at which they came in and their place among all."""
    return df.select("message_id", "payload", "metadata", F.unix_micros("stored_at").alias("arr_us"), F.col("offset").alias(build.PLACE))


def read(spark: SparkSession, e: Endpoint, route: str, root: str | None = None) -> DataFrame:
    """The input's messages with ``arr_us``, and ``arr_at`` where the source has an order. Topics and paths default to the route's name."""
    o = e.options
    if e.kind == "file":
        at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
        df = M.from_lines(spark.read.text(o.get("path", route)).select("value", at.alias(build.PLACE)), keep=[build.PLACE])
    elif e.kind == "parquet":
        df = spark.read.parquet(o["path"])
    elif e.kind == "static":
        df = readers.static(spark, str(o.get("value", "")), int(o.get("count", 1)))
    elif e.kind in ("memory", "null"):
        of = (spark, root or folder(spark), o.get("topic", route) if e.kind == "memory" else f"{route}-null")
        df = _placed(topics.read_log(*of, int(o.get("cursor", 0))) if o.get("subscribe_mode") else topics.queued(*of))
    elif e.kind == "kafka":
        df = readers.from_kafka(spark.read.format("kafka").options(**readers.kafka_options({"topic": route} | dict(o)) | {"startingOffsets": "earliest"}).load())
    elif e.kind == "custom" and o["name"] in SOURCES:
        df = SOURCES[o["name"]](spark, o["config"])
    else:
        raise ValueError(f"no reader for {title(e)}; register one in SOURCES")
    return df if "arr_us" in df.columns else df.withColumn("arr_us", F.unix_micros(F.current_timestamp()))


def received(spark: SparkSession, e: Endpoint, route: str, root: str, limit: int | None = None) -> tuple[DataFrame, dict[str, Any] | None]:
    """A batch of the input, of at most ``limit`` messages from topics or a file that the driver shares with the executors, and what takes
    it from there once it is delivered: lines are cut off the file, unless it is only subscribed to. A
    subscriber's name defaults to the route's; with a ``cursor`` it reads from there and acknowledges nothing. With ``retention``, a map
    of ``keep``, ``age_s``, ``silent_s`` and ``archive`` (or an empty one), each acknowledgement drops what the log needn't keep."""
    o = e.options
    if e.kind == "file" and not o.get("subscribe_mode") and os.path.isfile(path := o.get("path", route)):
        streams.register(spark)
        file = streams.LineFile(path)
        first = file.cut()
        last = file.end_of_lines(first, limit)
        lines = spark.read.format("lines").options(path=path, start=first, end=last).load()
        rows = M.from_lines(lines.select("value", F.col("position").alias(build.PLACE)), keep=[build.PLACE])
        return rows.withColumn("arr_us", F.unix_micros(F.current_timestamp())), {"kind": "lines", "path": path, "first": first, "last": last}
    if e.kind != "memory" or (o.get("subscribe_mode") and "cursor" in o):
        return read(spark, e, route, root), None
    topic = o.get("topic", route)
    if o.get("subscribe_mode"):
        who = o.get("subscriber", route)
        rows, last, _ = topics.subscribed(spark, root, topic, who, limit)
        return _placed(rows), {"kind": "log", "topic": topic, "subscriber": who, "last": last, "retention": o.get("retention")}
    first, last = topics.window(root, topic, limit)
    return _placed(topics.queued(spark, root, topic, max(0, last - first + 1))), {"kind": "queue", "topic": topic, "first": first, "last": last}


class Leaf(NamedTuple):
    endpoint: Endpoint
    retry: dict | None  # of the endpoint itself or the nearest one above
    dead: Endpoint | None


def leaves(e: Endpoint, retry: dict | None = None, dead: Endpoint | None = None) -> dict[str, Leaf]:
    """All sinks that rows of an output with named sinks can reach, by name, those of dead letters among them."""
    retry = next((dict(o) for n, o in e.middlewares if n == "retry"), retry)
    mine = next((o["endpoint"] for n, o in e.middlewares if n == "dlq"), None)
    out = leaves(mine) if mine is not None else {}
    dead = mine or dead
    for child in children(e):
        out |= leaves(child, retry, dead)
    return out | ({e.sink: Leaf(e, retry, dead)} if e.sink else {})


class Ledger:
    """What a route has open, in the folder that the cluster shares."""

    def __init__(self, spark: SparkSession, name: str, root: str):
        self.spark, self.root, self.path = spark, root, f"{root}/_routes/{name}"
        self.manifest = Manifest(f"{self.path}/ledger")

    def settled(self, batch: str) -> bool:
        return batch in self.manifest.state().get("done", ())

    def open(self, batch: str, source: dict | None, parts: list[dict]) -> None:
        def change(state: dict) -> dict:
            if state.get("open"):
                raise topics.Taken("another run of this route is in its commit")
            return state | {"open": {"batch": batch, "source": source, "parts": parts}}

        self.manifest.update(change)

    def finish(self) -> None:
        """Makes all steps of what is open. If the messages were taken by someone else meanwhile, nothing becomes seen."""
        work = self.manifest.state().get("open")
        if not work:
            return
        try:
            self._take(work["source"], work["batch"])
        except topics.Taken:
            for part in work["parts"]:
                remove(self.spark, part["from"])
            self._close(work["batch"], False)
            raise
        for part in work["parts"]:
            if part["kind"] == "topic":
                topics.attach(part["root"], part["topic"], part["segment"], part["mode"])
            else:
                move_into(self.spark, part["from"], part["to"])
        remove(self.spark, f"{self.path}/sent")
        self._close(work["batch"], True)

    def _take(self, source: dict | None, batch: str) -> None:
        if source is None:
            return
        if source["kind"] == "lines":
            streams.LineFile(source["path"]).take(source["first"], source["last"], batch)
        elif source["kind"] == "log":
            topics.acknowledge(self.root, source["topic"], source["subscriber"], source["last"])
            if source.get("retention") is not None:
                with contextlib.suppress(topics.Taken):  # another collector was first
                    topics.collect_garbage(self.spark, self.root, source["topic"], **source["retention"])
        elif source["last"] >= source["first"]:
            topics.taken(self.root, source["topic"], source["first"], source["last"], batch)

    def _close(self, batch: str, done: bool) -> None:
        def change(state: dict) -> dict | None:
            if (state.get("open") or {}).get("batch") != batch:
                return None
            return state | {"open": None, "done": [*state.get("done", []), *([batch] if done else [])][-topics.REMEMBERED:]}

        self.manifest.update(change)

    def unsent(self, rows: DataFrame, sink: str) -> DataFrame:
        """Rows without those that an earlier try has sent."""
        if not exists(self.spark, f"{self.path}/sent"):
            return rows
        sent = self.spark.read.parquet(f"{self.path}/sent").where(F.col("sink") == sink).select("message_id", F.col("at").alias("__at"))
        return rows.withColumn("__at", _at(rows)).join(sent, ["message_id", "__at"], "left_anti").drop("__at")

    def note_sent(self, rows: DataFrame, sink: str) -> None:
        rows.select(F.lit(sink).alias("sink"), "message_id", _at(rows).alias("at")).write.mode("append").parquet(f"{self.path}/sent")


def _at(rows: DataFrame):
    return F.to_json(F.struct(build.PLACE)) if build.PLACE in rows.columns else F.lit("")


def _order(rows: DataFrame) -> list[str]:
    return ["arr_us", build.PLACE] if build.PLACE in rows.columns else ["arr_us", "message_id"]


def _bare(rows: DataFrame) -> DataFrame:
    return rows.select("message_id", "payload", "metadata")


def _staged(rows: DataFrame, e: Endpoint, route: str, root: str) -> dict[str, Any]:
    """A batch written for a topic, file or table, where no reader sees it yet."""
    o = e.options
    if e.kind == "memory":
        topic, mode = o.get("topic", route), "log" if o.get("subscribe_mode") else None
        topics.check_mode(root, topic, mode)
        segment = topics.stage(rows, root, topic, _order(rows))
        return {"kind": "topic", "root": root, "topic": topic, "mode": mode, "segment": segment, "from": topics.segment_path(root, topic, segment["id"])}
    path = o.get("path", route)
    part = f"{path}/_route-{uuid.uuid4().hex}"
    (_bare(rows).write.parquet if e.kind == "parquet" else lambda to: writers.to_lines(_bare(rows), to))(part)
    return {"kind": "files", "from": part, "to": path}


def _sent(rows: DataFrame, leaf: Leaf, route: str) -> DataFrame | None:
    """Delivers messages to a sink that sends. HTTP gives the outcomes, a custom sink what it likes to answer."""
    e, o = leaf.endpoint, leaf.endpoint.options
    if e.kind == "kafka":
        writers.to_kafka_rows(rows).write.format("kafka").options(**writers.kafka_options({"topic": route} | dict(o))).save()
        return None
    if e.kind == "custom":
        if o["name"] not in SINKS:
            raise ValueError(f"no writer for {title(e)}; register one in SINKS")
        return SINKS[o["name"]](_bare(rows), o["config"])
    r = leaf.retry or {"max_attempts": 1}
    return send_with_retry(_bare(rows), lambda d: writers.post(d, o["url"]), int(r.get("max_attempts", 5)), int(r.get("initial_interval_ms", 100)), int(r.get("max_interval_ms", 5000)), float(r.get("multiplier", 2.0)))


def deliver(rows: DataFrame, name: str, r: Route, root: str, batch: str, source: dict[str, Any] | None = None, metrics: build.Metrics | None = None) -> dict[str, DataFrame]:
    """A batch of messages that the input's middleware has seen, through the output to all its sinks. The rows that reach a sink are
    written once, so that a handler runs once for each attempt. Returns the answers of sinks that give any, by sink."""
    spark = rows.sparkSession
    ledger, output = Ledger(spark, name, root), named(r.output)
    once: Callable[[DataFrame], DataFrame] = lambda df: table(df, f"route-{name}")
    columns = ["sink", "message_id", "payload", "metadata", "arr_us", *[c for c in (build.PLACE,) if c in rows.columns]]
    planned = once(build.settled(build.send(rows, output, "arr_us", metrics, once)).select(*columns))
    answers, of = {}, leaves(output)
    reached = {x["sink"] for x in planned.select("sink").distinct().collect()}
    here = {sink: planned.where(F.col("sink") == sink).drop("sink") for sink in of if sink in reached or of[sink].endpoint.kind in ("response", "static")}
    sending = [(s, rows) for s, rows in here.items() if of[s].endpoint.kind in SENDING]
    for sink, rows in sending:  # dead letters for sinks that send come at its end
        leaf, pending = of[sink], ledger.unsent(rows, sink)
        if r.concurrency > 1 and leaf.endpoint.kind == "http":
            pending = pending.coalesce(r.concurrency)  # so many senders at most
        found = _sent(pending, leaf, name)
        if found is not None:
            answers[sink] = found
        if leaf.endpoint.kind != "http":
            ledger.note_sent(pending, sink)
            continue
        lost, retryable = dead_letters(pending, found), found.where(F.col("status") == M.RETRYABLE)
        # what has failed is not noted: should another sink fail, it is tried again with the rest of its batch
        ledger.note_sent(pending.join(lost.select("message_id"), "message_id", "left_anti"), sink)
        if leaf.dead is None:
            if not retryable.isEmpty():
                raise Failed(f"{sink}: {retryable.count()} messages could not be sent, the first because of {retryable.first()['error']}")
            continue
        dead = once(build.settled(build.send(lost.drop("status", "error"), leaf.dead, "arr_us", None, once)).select(*columns))
        for x in dead.select("sink").distinct().collect():
            more = dead.where(F.col("sink") == x["sink"]).drop("sink")
            if of[x["sink"]].endpoint.kind in SENDING:
                sending.append((x["sink"], more))
            else:
                here[x["sink"]] = here[x["sink"]].unionByName(more) if x["sink"] in here else more
    parts = []
    try:
        for sink, mine in here.items():
            e = of[sink].endpoint
            if e.kind == "static":
                answers[sink] = writers.static_reply(_bare(mine), str(e.options.get("value", "")))
            elif e.kind == "response":
                answers[sink] = _bare(mine)
            elif e.kind in ("memory", "file", "parquet"):
                parts.append(_staged(mine, e, name, root))
            elif e.kind not in SENDING:
                raise ValueError(f"no writer for {title(e)}; register one in SINKS")
        ledger.open(batch, source, parts)
    except Exception:
        for part in parts:
            remove(spark, part["from"])
        raise
    ledger.finish()
    return answers


def run(spark: SparkSession, name: str, r: Route, root: str | None = None, metrics: build.Metrics | None = None, limit: int | None = None) -> dict[str, DataFrame]:
    """Runs a route once over what its source holds, or over the next ``limit`` messages of a topic; first it finishes what an
    earlier run has left open. ``metrics`` gets the observations of endpoints with that middleware. Where messages can't be
    delivered this raises, no sink of the kind that doesn't send has any of them, and their source still holds them all."""
    root = root or folder(spark)
    Ledger(spark, name, root).finish()
    build.validate(r)
    rows, source = received(spark, r.input, name, root, limit)
    return deliver(build.consume(rows, r.input, "arr_us", metrics), name, r, root, uuid.uuid4().hex, source, metrics)


def output_of(spark: SparkSession, r: Route, name: str, root: str | None = None) -> dict[str, DataFrame]:
    """What a route's sinks hold, by sink, of those that can be read: a probe for tests."""
    return {sink: read(spark, e, name, root) for sink, (e, _, _) in leaves(named(r.output)).items() if e.kind in ("memory", "file", "parquet")}
