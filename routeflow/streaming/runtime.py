"""Deployed routes: start under a name, replace, stop, list; a supervisor that starts again after a failure."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

Sink = Callable[[DataFrame, int], None]
_publishers: dict[str, Sink] = {}


def register_publisher(name: str, sink: Sink) -> None:
    _publishers[name] = sink


def publisher(name: str) -> Sink | None:
    return _publishers.get(name)


def unregister_publisher(name: str) -> None:
    _publishers.pop(name, None)


def find(spark: SparkSession, name: str) -> StreamingQuery | None:
    return next((q for q in spark.streams.active if q.name == name), None)


def routes(spark: SparkSession) -> list[str]:
    return sorted(q.name for q in spark.streams.active if q.name)


def stop(spark: SparkSession, name: str) -> bool:
    query = find(spark, name)
    if query:
        query.stop()
    return query is not None


def deploy(name: str, stream: DataFrame, sink: Sink, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start a route; one of the same name is stopped first. A batch's number makes a sink's writes repeatable."""
    stop(stream.sparkSession, name)
    writer = stream.writeStream.queryName(name).foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def supervise(start: Callable[[], StreamingQuery], tries: int | None = None, pause_s: float = 5.0) -> None:
    """Runs until the stream ends by itself; after a failure it starts again from the checkpoint."""
    failed = 0
    while True:
        try:
            start().awaitTermination()
            return
        except Exception:
            failed += 1
            if tries is not None and failed >= tries:
                raise
            time.sleep(pause_s)


def split_sink(ok: Sink, dead: Sink, status: str = "status") -> Sink:
    """Writes both halves of a batch from one evaluation of it."""
    from routeflow.operators.delivery import split_dead

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            done, lost = split_dead(batch, status)
            ok(done, number)
            dead(lost, number)
        finally:
            batch.unpersist()

    return run
