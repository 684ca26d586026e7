"""Handlers by message kind, added one after another, over a raw handler that gets what no kind matches."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeflow.functions import messages as M
from routeflow.operators import routing

#: (parsed payload, metadata) -> the payload to publish as text, or None to publish nothing
Typed = Callable[[Column, Column], Column | None]
Raw = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class TypeHandlers:
    """A handler for :class:`routeflow.plans.config.Endpoint`. Payloads that lack a field of their schema are non-retryable, and so
    are kinds without handler if there is no fallback."""

    of: Mapping[str, tuple[str, Typed]] = field(default_factory=dict)
    fallback: Raw | None = None

    def add(self, kind: str, schema: str, handler: Typed) -> TypeHandlers:
        return replace(self, of={**self.of, kind: (schema, handler)})

    def __call__(self, df: DataFrame) -> DataFrame:
        kind, text = F.try_element_at("metadata", F.lit(M.KIND)), M.payload_text(F.col("payload"))
        known, quiet = {}, []
        for name, (schema, handler) in self.of.items():
            parsed = F.from_json(text, schema)
            reads = parsed.isNotNull()
            for f in T.StructType.fromDDL(schema).fields:
                reads &= parsed[f.name].isNotNull()
            value = handler(parsed, F.col("metadata"))
            if value is None:
                quiet.append(name)
            known[name] = (reads, F.lit(None).cast("string") if value is None else value)
        mine = F.coalesce(kind.isin(*self.of), F.lit(False))
        rows = df if self.fallback is None else df.where(mine)
        out = routing.dispatch(rows, kind, known).where(~(F.coalesce(kind.isin(*quiet), F.lit(False)) & (F.col("status") == M.ACK)))
        out = out.withColumn("payload", F.when(F.col("status") == M.ACK, F.encode("result", "UTF-8")).otherwise(F.col("payload"))).drop("result")
        if self.fallback is None:
            return out
        rest = self.fallback(df.where(~mine))
        missing = {c: F.lit(v).cast("string") for c, v in (("status", M.ACK), ("error", None)) if c not in rest.columns}
        return out.unionByName(rest.withColumns(missing) if missing else rest)
