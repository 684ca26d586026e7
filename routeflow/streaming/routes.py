"""Configured routes as streams: a route's input is read as a stream, each micro-batch goes through the output in two phases.

A micro-batch has a name made of its query's id and its number, and the route's ledger knows the names of those that all sinks
have. So a batch that Spark runs again after a crash is not written again. Once Spark has committed a batch, its messages are
taken from the source; until then it holds them, and a route that starts anew with the same checkpoint goes on behind them.

``batch_size`` times ``concurrency`` bounds what a micro-batch of a route that keeps running reads from a topic or line file, where
``batch_size`` is above 1. A run that ends reads all that is there when it starts: Spark asks these sources once in such a run, so
a bound would leave the rest, and a run for each part would cost a start for every few messages.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from routeflow.functions import messages as M
from routeflow.functions.shared import folder
from routeflow.plans import build, run
from routeflow.plans.config import SOURCES, Endpoint, Route, title, validate
from routeflow.sources import readers, streams, topics
from routeflow.streaming import runtime, stateful


@dataclass
class Deployed:
    """A route that was deployed in this session, with counts of its messages and a histogram of its batches' durations."""

    route: Route
    query: StreamingQuery | None  # None while it starts
    source: tuple[str, ...]  # what takes handled messages away: its kind, and what it is addressed by
    messages: int = 0
    batches: int = 0
    durations: Counter[int] = field(default_factory=Counter)  # batches by the power of two of their milliseconds


_deployed: dict[str, Deployed] = {}
_listening: set[int] = set()


def get(name: str) -> Route | None:
    """The route that runs under a name."""
    found = _deployed.get(name)
    return found.route if found is not None and found.query is not None and found.query.isActive else None


def names() -> list[str]:
    return sorted(n for n, d in _deployed.items() if d.query is not None and d.query.isActive)


def metrics(name: str) -> dict[str, float]:
    """``processed``, ``batches`` and, from their histogram, upper bounds of the batch durations' quantiles in seconds."""
    d = _deployed[name]
    return {"processed": d.messages, "batches": d.batches} | {f"duration_{q}": quantile(d.durations, q / 100) for q in (50, 90, 99)}


def quantile(histogram: Mapping[int, int], q: float) -> float:
    """Seconds that at least a share ``q`` of what a histogram by powers of two of milliseconds holds stays below; histograms of
    several routes or drivers are added up key by key before."""
    total, seen = sum(histogram.values()), 0
    for k in sorted(histogram):
        seen += histogram[k]
        if seen >= q * total:
            return 2**k / 1000
    return 0.0


class _Commits(StreamingQueryListener):
    """Takes from the sources what Spark has committed, and keeps count."""

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        d = _deployed.get(p.name or "")
        if d is None or (d.query is not None and str(d.query.id) != str(p.id)):
            return
        d.messages += p.numInputRows
        d.batches += 1
        d.durations[max(0, int(p.durationMs.get("triggerExecution", 0)).bit_length())] += 1
        end = p.sources[0].endOffset if p.sources else None
        if end and end != "null":
            _take(d.source, json.loads(end))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def _take(source: tuple[str, ...], end: Mapping[str, Any]) -> None:
    if source[0] == "queue":
        root, topic = source[1:]
        first, last = topics.window(root, topic)[0], end["offset"] - 1
        if first <= last:
            topics.taken(root, topic, first, last, f"to {end['offset']}")
    elif source[0] == "log":
        topics.acknowledge(*source[1:], end["offset"] - 1)
    elif source[0] == "lines":
        streams.LineFile(source[1]).cut_to(end["position"])


def limit_of(r: Route) -> int | None:
    return r.batch_size * r.concurrency if r.batch_size > 1 else None


def read_stream(spark: SparkSession, e: Endpoint, name: str, root: str, limit: int | None = None, once: bool = False) -> tuple[DataFrame, tuple[str, ...]]:
    """The input as a stream of messages with ``arr_us``, and ``arr_at`` where it has an order; and what handled ones are taken from.
    ``limit`` bounds a micro-batch; with ``once`` not that of a topic or line file, whose runs that end have only one."""
    o, source = e.options, ("",)
    if once and e.kind in ("memory", "file"):
        limit = None
    streams.register(spark)
    if e.kind == "memory":
        topic = o.get("topic", name)
        reader = spark.readStream.format("topic").options(root=root, topic=topic, commit="false", consumer=name)
        source = ("queue", root, topic)
        if o.get("subscribe_mode"):
            source = ("log", root, topic, o.get("subscriber", name))
            reader = reader.option("subscriber", source[3])
        df = (reader.option("limit", limit) if limit else reader).load()
        return df.select("message_id", "payload", "metadata", (F.col("stored_ms") * 1000).alias("arr_us"), F.col("offset").alias(build.PLACE)), source
    now = F.unix_micros(F.current_timestamp())
    if e.kind == "file" and not os.path.isdir(o.get("path", name)):
        path = o.get("path", name)
        reader = spark.readStream.format("lines").options(path=path, consume="false")
        df = (reader.option("limit", limit) if limit else reader).load()
        source = ("",) if o.get("subscribe_mode") else ("lines", path)
        return M.from_lines(df.select("value", F.col("position").alias(build.PLACE)), keep=[build.PLACE]).withColumn("arr_us", now), source
    if e.kind == "file":
        df = readers.stream_lines(spark, o["path"], consume=not o.get("subscribe_mode"))
    elif e.kind == "static":
        rate = spark.readStream.format("rate").option("rowsPerSecond", int(o.get("count", 1))).load()
        df = rate.select(M.hex_id(F.col("value")).alias("message_id"), F.encode(F.lit(str(o.get("value", ""))), "UTF-8").alias("payload"), F.expr("cast(map() as map<string,string>)").alias("metadata"))
    elif e.kind == "kafka":
        df = readers.from_kafka(spark.readStream.format("kafka").options(**readers.kafka_options({"topic": name} | dict(o) | ({"batch_size": limit} if limit else {}))).load())
    elif e.kind == "custom" and o["name"] in SOURCES:
        df = SOURCES[o["name"]](spark, o["config"])
        if not df.isStreaming:
            raise ValueError(f"{title(e)} is no stream")
    else:
        raise ValueError(f"no stream for {title(e)}; register one in SOURCES")
    return df if "arr_us" in df.columns else df.withColumn("arr_us", now), source


def consume(df: DataFrame, e: Endpoint) -> DataFrame:
    """The input's middleware on a stream. One of it may keep state."""
    tie = build.PLACE if build.PLACE in df.columns else "message_id"
    if sum(n in ("deduplication", "weak_join") for n, _ in e.middlewares) > 1:
        raise ValueError("a stream has one of deduplication and weak_join; let a second route do the other")
    for name, o in reversed(e.middlewares):
        if name == "deduplication":
            df = stateful.dedup_ttl(df, "message_id", "arr_us", tie, int(o["ttl_seconds"]))
        elif name == "weak_join":
            df = _joined(df, o, tie)
        else:
            df = build.apply(df, name, o, "arr_us")
    return df


def _joined(df: DataFrame, o: Mapping[str, Any], tie: str) -> DataFrame:
    """As in a batch, but for what isn't full when a batch ends: it waits."""
    by = o["group_by"]
    key = F.coalesce(F.try_element_at("metadata", F.lit(by)), F.lit("default"))
    others = F.to_json(F.map_filter("metadata", lambda k, _: k != by))
    rows = df.select(key.alias("key"), "arr_us", F.col(tie).alias("tie"), "message_id", M.as_json_element(M.payload_text(F.col("payload"))).alias("p"), others.alias("meta"))
    out = stateful.grouped(rows, "key", "arr_us", "tie", ["arr_us", "tie", "message_id", "p", "meta"], int(o["expected_count"]), int(o["timeout_ms"]) * 1000)
    first, last = F.get("held", F.lit(0)), F.element_at("held", -1)
    metadata = F.map_concat(F.from_json(first["meta"], "map<string,string>"), F.create_map(F.lit(by), F.col("key")))
    return out.select(
        F.md5(F.concat_ws("|", "key", first["message_id"], last["message_id"], first["arr_us"])).alias("message_id"),
        F.encode(M.merged_array(F.transform("held", lambda x: x["p"])), "UTF-8").alias("payload"), metadata.alias("metadata"), first["arr_us"].alias("arr_us"), first["tie"].alias(build.PLACE),
    )


def deploy(spark: SparkSession, name: str, r: Route, root: str | None = None, checkpoint: str | None = None, once: bool = False) -> StreamingQuery:
    """Starts a route under a name; one of the same name is stopped first. The checkpoint is the route's own folder, unless another
    is named; a route that goes on from it must read the same source. ``once``: it ends when it has handled what is there."""
    validate(r)
    root = root or folder(spark)
    stop(spark, name)
    run.Ledger(spark, name, root).finish()
    stream, source = read_stream(spark, r.input, name, root, limit_of(r), once)
    rows = consume(stream, r.input)

    def batch(df: DataFrame, number: int) -> None:
        ledger, of = run.Ledger(df.sparkSession, name, root), f"{checkpoint or name}/{df.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}/{number}"
        ledger.finish()
        if not ledger.settled(of):
            run.deliver(df, name, r, root, of)

    if id(spark) not in _listening:
        spark.streams.addListener(_Commits())
        _listening.add(id(spark))
    _deployed[name] = Deployed(r, None, source)
    _deployed[name].query = runtime.deploy(name, rows, batch, checkpoint or f"{root}/_routes/{name}/checkpoint", once)
    return _deployed[name].query


def stop(spark: SparkSession, name: str) -> bool:
    """Stops a route after its current batch's work; False if none of that name runs."""
    found = runtime.stop(spark, name)
    if not found:
        _deployed.pop(name, None)
    return found
