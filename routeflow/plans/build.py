"""A route as one lazy DataFrame: input middleware in order, then the output's tree of endpoints, each with its own middleware
and handler.

The result has ``sink`` (where a row goes), ``status`` and ``attempts``; a writer partitions by ``sink`` in one pass. Trees
whose children have neither middleware nor handler are one projection; only children that have some get a branch.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from routeflow.functions import messages as M
from routeflow.operators import routing, stateful
from routeflow.plans.config import CUSTOM_MIDDLEWARE, Endpoint, Route, children, named, title, validate

#: The column that orders messages of the same time, where a source has one.
PLACE = "arr_at"
Metrics = dict[str, Observation]
#: Writes rows that are used more than once, or gives them back as they are.
Store = Callable[[DataFrame], DataFrame]


def sinks(e: Endpoint, metadata: Column) -> Column:
    """Names of all sinks that a message reaches in a tree whose sinks are named; an empty array drops it."""
    if e.kind == "switch":
        key = F.try_element_at(metadata, F.lit(e.options["metadata_key"]))
        default = e.options["default"]
        out = sinks(default, metadata) if default else F.array().cast("array<string>")
        for value, child in reversed(list(e.options["cases"].items())):
            out = F.when(key == value, sinks(child, metadata)).otherwise(out)
        return out
    if e.kind == "fanout":
        return F.flatten(F.array(*[sinks(t, metadata) for t in e.options["targets"]]))
    if e.kind == "null":
        return F.array().cast("array<string>")
    return F.array(F.lit(e.sink))


def plain(e: Endpoint) -> bool:
    """Whether no endpoint below has middleware or a handler."""
    return all(not c.middlewares and c.handler is None and plain(c) for c in children(e))


def failed(status: str = "status") -> Column:
    return F.col(status).isin(M.RETRYABLE, M.NONRETRYABLE)


def apply(df: DataFrame, name: str, o: Mapping[str, Any], us: str) -> DataFrame:
    """Middleware that means the same on inputs and outputs; any other leaves ``df`` as it is."""
    if name == "delay":
        return df.withColumn(us, F.col(us) + int(o["delay_ms"]) * 1000)
    if name == "random_panic":
        struck = F.pmod(F.xxhash64("message_id"), F.lit(1_000_000)) < int(float(o["probability"]) * 1_000_000)
        return df.where(~F.when(struck, F.raise_error(F.lit("injected fault")).cast("boolean")).otherwise(F.lit(False)))
    if name == "custom":  # not registered when the configuration was read
        name, o = o["name"], o["config"]
        if name not in CUSTOM_MIDDLEWARE:
            raise ValueError(f"no middleware {name}; register one in CUSTOM_MIDDLEWARE")
    return CUSTOM_MIDDLEWARE[name](df, o) if name in CUSTOM_MIDDLEWARE else df


def measured(df: DataFrame, e: Endpoint, side: str, metrics: Metrics | None) -> DataFrame:
    """Counts processed and failed messages of an endpoint with the metrics middleware, once an action runs."""
    if metrics is None or not any(name == "metrics" for name, _ in e.middlewares):
        return df
    name = next(n for k in range(1 << 30) if (n := f"{side} {title(e)}" + f" {k}" * (k > 0)) not in metrics)
    metrics[name] = Observation(name)
    bad = failed() if "status" in df.columns else F.lit(False)
    return df.observe(metrics[name], F.count_if(~bad).alias("processed"), F.count_if(bad).alias("failed"))


def consume(df: DataFrame, e: Endpoint, us: str = "arr_us", metrics: Metrics | None = None) -> DataFrame:
    """The input's middleware; the first entry is the outermost, so the last one sees messages first. Among messages of the same
    time the column ``arr_at`` tells which was first, where there is one."""
    tie = PLACE if PLACE in df.columns else "message_id"
    for name, o in reversed(e.middlewares):
        if name == "deduplication":
            df = stateful.dedup_ttl(df, ["message_id"], us, tie, int(o["ttl_seconds"]))
        elif name == "weak_join":
            df = _joined(df, o, us, tie)
        else:
            df = apply(df, name, o, us)
    return measured(df, e, "input", metrics)


def _joined(df: DataFrame, o: Mapping[str, Any], us: str, tie: str) -> DataFrame:
    """One message for each group of the weak join: the payloads as an array, the first one's metadata with the group's key, and
    the time and place at which the group was opened. What isn't full when the batch ends goes as it is."""
    by, places = o["group_by"], [c for c in (PLACE,) if c in df.columns]
    key = F.coalesce(F.try_element_at("metadata", F.lit(by)), F.lit("default"))
    rows = df.select(key.alias("key"), F.col(us).alias("us"), "message_id", M.payload_text(F.col("payload")).alias("text"), "metadata", *places)
    joined = stateful.weak_join(rows, "key", "us", tie, "text", int(o["expected_count"]), int(o["timeout_ms"]) * 1000, carry=["message_id", "us", "metadata"])
    others = F.map_filter("metadata", lambda k, _: k != by)
    return joined.select(
        F.md5(F.concat_ws("|", "key", "message_id", "grp")).alias("message_id"), F.encode("payload", "UTF-8").alias("payload"),
        F.map_concat(others, F.create_map(F.lit(by), F.col("key"))).alias("metadata"), F.col("us").alias(us), *[F.col("first").alias(c) for c in places],
    )


def _handled(df: DataFrame, e: Endpoint, store: Store) -> DataFrame:
    """Adds ``status`` and ``attempts``. Retry stands around the handler: what it finds retryable goes to it again as it was,
    up to ``max_attempts`` times in all. A handler of two arguments gets the attempt's number."""
    if e.handler is None:
        return df.withColumns({"status": F.lit(M.ACK), "attempts": F.lit(1)})
    retry = next((o for name, o in e.middlewares if name == "retry"), None)
    attempts = max(1, int(retry.get("max_attempts", 5))) if retry is not None else 1
    numbered = len(inspect.signature(e.handler).parameters) > 1
    pending, out = df.withColumns({"__payload": F.col("payload"), "__metadata": F.col("metadata")}), None
    for n in range(1, attempts + 1):
        rows = e.handler(pending, n) if numbered else e.handler(pending)
        status = F.coalesce("status", F.lit(M.ACK)) if "status" in rows.columns else F.lit(M.ACK)
        rows = rows.withColumns({"status": status, "attempts": F.lit(n)})
        rows = store(rows) if n < attempts else rows
        again = F.col("status") == M.RETRYABLE
        part = (rows if n == attempts else rows.where(~again)).select(*df.columns, "status", "attempts")
        out = part if out is None else out.unionByName(part)
        pending = rows.where(again).withColumns({"payload": F.col("__payload"), "metadata": F.col("__metadata")}).select(*pending.columns)
    return out


def _branches(df: DataFrame, e: Endpoint) -> list[tuple[Endpoint, DataFrame]]:
    if e.kind == "fanout":
        return [(child, df) for child in e.options["targets"]]
    key, cases = F.try_element_at("metadata", F.lit(e.options["metadata_key"])), e.options["cases"]
    out = [(child, df.where(key == value)) for value, child in cases.items()]
    if e.options["default"]:
        out.append((e.options["default"], df.where(F.coalesce(~key.isin(*cases), F.lit(True)))))
    return out


def send(df: DataFrame, e: Endpoint, us: str = "arr_us", metrics: Metrics | None = None, store: Store = lambda df: df) -> DataFrame:
    """Messages through an endpoint: its middleware, the last entry outermost, then its handler, then its children. Rows
    without a sink have failed; the dead letters' endpoint, where there is one, is their sink."""
    for name, o in reversed(e.middlewares):
        df = apply(df, name, o, us)
    columns, rows = df.columns, _handled(df, e, store)
    none = F.lit(None).cast("string")
    if plain(e):
        rows = rows.withColumn("sink", F.explode(F.when(failed(), F.array(none)).otherwise(sinks(e, F.col("metadata")))))
    else:
        rows = store(rows) if e.handler is not None else rows
        out = rows.where(failed()).withColumn("sink", none)
        for child, part in _branches(rows.where(~failed()).select(*columns), e):
            out = out.unionByName(send(part, child, us, metrics, store))
        rows = out
    dead = next((o["endpoint"] for name, o in e.middlewares if name == "dlq"), None)
    if dead is not None:
        lost = failed() & F.col("sink").isNull()
        rows = rows.withColumn("sink", F.explode(F.when(lost, sinks(dead, F.col("metadata"))).otherwise(F.array("sink"))))
    return measured(rows, e, "output", metrics)


def plan(df: DataFrame, r: Route, us: str = "arr_us", metrics: Metrics | None = None, store: Store = lambda df: df) -> DataFrame:
    """Messages (with an arrival column) through a route: one row for each message and sink, or dead letter.

    A handler takes the DataFrame, keeps its columns and adds ``status`` (and may change payload and metadata); rows it
    leaves without one are fine. Without dead letters, what can't be retried is dropped, and what can be fails the batch.
    ``metrics`` gets an observation for each endpoint with that middleware. ``store`` gets what a handler made wherever more than
    one part of the plan needs it; without it the plan stays lazy, and the handler is computed for each.
    """
    validate(r)
    return settled(send(consume(df, r.input, us, metrics), named(r.output), us, metrics, store))


def settled(rows: DataFrame) -> DataFrame:
    """Rows that have a sink. What has failed and can't be retried goes; what can be is an error once the rows are computed."""
    left = F.when(F.col("sink").isNotNull(), True).when(F.col("status") == M.NONRETRYABLE, False)
    return rows.where(left.otherwise(F.raise_error(F.lit("retryable messages are left")).cast("boolean")))


def write(planned: DataFrame, folder: str) -> None:
    """All sinks in one pass, a folder each."""
    planned.select("sink", "message_id", "payload", "metadata", "status").write.mode("append").partitionBy("sink").parquet(folder)
