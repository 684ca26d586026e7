"""Sending a batch through a sink that answers for each message: retries, dead letters, replies and counts."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from routeflow.functions.messages import NONRETRYABLE, RETRYABLE
from routeflow.functions.shared import table

#: (messages) -> (message_id, status, error)
Send = Callable[[DataFrame], DataFrame]


def send_with_retry(messages: DataFrame, send: Send, attempts: int = 5, initial_ms: int = 100, most_ms: int = 5000, multiplier: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(message_id, status, error, attempts) of every message. Only what failed as retryable is sent again, after a
    growing pause; what still fails after ``attempts`` stays retryable. Each attempt's outcomes are written before the
    next, so that no message is sent twice because an outcome was computed again."""
    pending, delay, settled = messages, initial_ms, None
    for n in range(1, max(1, attempts) + 1):
        outcomes = table(send(pending).select("message_id", "status", "error", F.lit(n).alias("attempts")), f"outcomes-{n}")
        again = F.col("status") == RETRYABLE
        last = n >= attempts or outcomes.where(again).isEmpty()
        final = outcomes if last else outcomes.where(~again)
        settled = final if settled is None else settled.unionByName(final)
        if last:
            break
        pending = pending.join(outcomes.where(again).select("message_id"), "message_id", "left_semi")
        sleep(delay / 1000)
        delay = min(int(delay * multiplier), most_ms)
    return settled


def dead_letters(messages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Messages whose outcome is a failure, with its status and error. Of messages that share an id, all go where one has failed."""
    bad = outcomes.where(F.col("status").isin(RETRYABLE, NONRETRYABLE)).groupBy("message_id").agg(F.min_by(F.struct("status", "error"), F.struct("status", "error")).alias("f")).select("message_id", "f.*")
    return messages.drop("status", "error").join(bad, "message_id")


def paired_replies(requests: DataFrame, responses: DataFrame, key: str = "message_id") -> DataFrame:
    """Requests with their response; those without one are acknowledged alone. Paired by id, so a partial answer loses none."""
    return requests.join(responses.select(key, F.col("payload").alias("reply")), key, "left")


def observed(df: DataFrame, route: str, ok: Column) -> tuple[DataFrame, Observation]:
    """``df`` unchanged, and an observation that has ``processed`` and ``failed`` once an action has run."""
    seen = Observation(route)
    return df.observe(seen, F.count_if(ok).alias("processed"), F.count_if(~ok).alias("failed")), seen
