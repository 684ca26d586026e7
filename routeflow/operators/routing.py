"""Content-based routing, fan-out, handlers and typed dispatch, all as columns that Catalyst can push down and fold."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeflow.functions.messages import ACK, NONRETRYABLE

#: Cases beyond this many are looked up in a map literal instead of a chain of comparisons.
CHAIN = 50
#: How deep switches and fan-outs may nest.
DEPTH = 16
#: Endpoint types that every policy allows.
CORE = ("file", "static", "memory", "fanout", "switch", "response", "null", "custom")


def route_of(key: Column, cases: Mapping[str, str], default: str | None = None) -> Column:
    """The route a key leads to; null where there is no case and no default. A missing key has no case."""
    if len(cases) > CHAIN:
        table = F.create_map(*[F.lit(x) for kv in cases.items() for x in kv])
        return F.coalesce(F.try_element_at(table, key), F.lit(default))
    out = F.lit(default).cast("string")
    for value, route in reversed(list(cases.items())):
        out = F.when(key == value, route).otherwise(out)
    return out


def switch(df: DataFrame, key: Column, cases: Mapping[str, str], default: str | None = None) -> DataFrame:
    """Adds ``route``; messages without one are acknowledged and dropped."""
    return df.withColumn("route", route_of(key, cases, default)).where(F.col("route").isNotNull())


def fanout(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Every message once for every target, without a join."""
    return df.withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets])))


def handle(df: DataFrame, output: Column, keep: Column | None = None, name: str = "payload") -> DataFrame:
    """A handler from one message to one or none: ``output`` replaces the payload where ``keep`` holds."""
    return (df if keep is None else df.where(keep)).withColumn(name, output)


def dispatch(df: DataFrame, kind: Column, handlers: Mapping[str, tuple[Column, Column]], fallback: Column | None = None) -> DataFrame:
    """Typed dispatch. ``handlers``: kind -> (condition that the payload reads well, result).

    Adds ``status``, ``result`` and ``error``. A payload that doesn't read, or a kind without handler, is non-retryable.
    """
    if fallback is None:
        status, result, error = F.lit(NONRETRYABLE), F.lit(None).cast("string"), F.lit("No handler registered")
    else:
        status, result, error = F.lit(ACK), fallback, F.lit(None).cast("string")
    for name, (reads, value) in handlers.items():
        here = F.coalesce(kind == name, F.lit(False))
        fine = F.coalesce(reads, F.lit(False))
        status = F.when(here, F.when(fine, ACK).otherwise(NONRETRYABLE)).otherwise(status)
        result = F.when(here & fine, value).when(here, F.lit(None)).otherwise(result)
        error = F.when(here & ~fine, "Deserialization failed").when(here, F.lit(None)).otherwise(error)
    return df.select("*", status.alias("status"), result.alias("result"), error.alias("error"))


def check_policy(kinds: Iterable[str], allowed: Iterable[str]) -> None:
    """Raises for endpoint types outside the allow-list; core types always pass."""
    bad = sorted(set(kinds) - set(allowed) - set(CORE))
    if bad:
        raise ValueError(f"endpoint types not allowed: {', '.join(bad)}")
