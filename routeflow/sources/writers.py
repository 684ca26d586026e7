"""Sinks: line files, tables, nothing, brokers by option maps, and HTTP from the tasks."""

from __future__ import annotations

import urllib.request
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeflow.functions import messages as M
from routeflow.operators.numbering import numbered


def to_lines(messages: DataFrame, path: str) -> None:
    M.to_envelope(messages).write.mode("append").text(path)


def to_nothing(messages: DataFrame) -> None:
    messages.write.format("noop").mode("overwrite").save()


def to_kafka_rows(messages: DataFrame) -> DataFrame:
    """Key: the id's 16 bytes; headers: the id and the metadata."""
    entry = lambda k, v: F.struct(k.alias("key"), F.encode(v, "UTF-8").alias("value"))
    headers = F.concat(F.array(entry(F.lit(M.CARRIED_ID), F.col("message_id"))), F.transform(F.map_entries("metadata"), lambda e: entry(e["key"], e["value"])))
    return messages.select(F.unhex("message_id").alias("key"), F.col("payload").alias("value"), headers.alias("headers"))


def kafka_options(options: dict) -> dict[str, str]:
    return {"kafka.bootstrap.servers": options["url"], "topic": options["topic"], "kafka.acks": "all", "kafka.compression.type": "lz4", "kafka.linger.ms": "100", "kafka.retries": "3"}


def static_reply(messages: DataFrame, text: str) -> DataFrame:
    """Every payload replaced by the text as a JSON string."""
    return messages.withColumn("payload", F.encode(M.as_json_string(F.lit(text)), "UTF-8"))


def to_frames(messages: DataFrame, size: int, order: list[str]) -> DataFrame:
    """Frames of up to ``size`` messages: a JSON array of envelopes as one line; see ``readers.decode_frame``."""
    batched = numbered(messages.select(*M.MESSAGE.names, *[c for c in order if c not in M.MESSAGE.names]), [], order, "__pos")
    whole = M.to_envelope(batched, keep=["__pos"]).withColumn("frame", F.floor((F.col("__pos") - 1) / size).cast("long"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("__pos", M.as_json_element(F.col("value")).alias("e")))), lambda x: x["e"])
    return whole.groupBy("frame").agg(M.merged_array(parts).alias("value"))


def post(messages: DataFrame, url: str, timeout_s: float = 30.0) -> DataFrame:
    """(message_id, status, error): each payload posted by the tasks; anything but a 2xx answer is retryable."""

    def run(batches: Iterable) -> Iterable:
        for pdf in batches:
            found = []
            for message_id, payload, metadata in zip(pdf["message_id"], pdf["payload"], pdf["metadata"], strict=True):
                try:
                    with urllib.request.urlopen(urllib.request.Request(url, bytes(payload), dict(metadata), method="POST"), timeout=timeout_s):
                        found.append((message_id, M.ACK, None))
                except Exception as e:  # every failure to deliver is an outcome of its row
                    found.append((message_id, M.RETRYABLE, str(e)))
            yield pd.DataFrame(found, columns=["message_id", "status", "error"])

    return messages.mapInPandas(run, "message_id string, status string, error string")
