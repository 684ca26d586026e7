"""Mixing sources to target weights by systematic sampling.

Every document of a source expects ``target / source size`` copies. Within a source the documents stand in the order
(size, id); the running sum of expected copies plus one offset per source is taken, and a document is emitted once for
each integer that its step crosses. Ordering by size stratifies the sample, so that the words taken stay close to the
target.

The running sum never needs a source in one task: rows are range-partitioned by (source, size, id), each partition
numbers its own rows in one streaming pass, and the count of rows before a partition comes from a table with one row
per (partition, source).

Defined cases: null text has size 0; a null source is a source of its own, last in order; repeated rows count
separately; sources without words get target 0; other columns stay as they are, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeflow.llm.storage import in_arrow, shuffle_partitions, stored

#: The weights of the sources in order, repeating; the mix's share of all words; most copies of a source.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size). The table of sources is small; targets fill up by weight and
    stop at ``most`` times a source's size, the rest going to the others by weight."""
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = by_source.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = s.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("total"),
        F.coalesce(F.sum("cap").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("caps"),
        F.sum("w").over(ratio.rowsBetween(0, Window.unboundedFollowing)).alias("ws"),
    ).withColumn("capped", F.col("cap") * F.col("ws") <= (F.col("total") - F.col("caps")) * F.col("w"))
    s = s.select("*", F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0)).alias("full"), F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything).alias("open"))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("total") - F.col("full")) * F.col("w") / F.col("open"))
    return s.select("source", "source_size", target.alias("target"))


def _number(source_at: int):
    """Appends the partition's number and a row's place in its source within the partition; rows come sorted by source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            source = batch.column(source_at)
            codes = source.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
            place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes)))) + 1
            if source[0].as_py() == last:
                place[: starts[1] if len(starts) > 1 else len(codes)] += seen
            last, seen = source[-1].as_py(), int(place[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(codes), part, np.int32)), pa.array(place.astype(np.int64))], names=[str(i) for i in range(batch.num_columns + 2)])

    return run


def offset_of(source: Column, seed: str = "mix") -> Column:
    """One random offset in [0, 1) for each source, the same in every run: 32 bits of a digest of seed and source."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit("\0null")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, carry: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: Sequence[int] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(id, source, size, source_size, target, copies) for every row, with the columns in ``carry`` prefixed by ``c_``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("hash"), *[F.col(c).alias(f"c_{c}") for c in carry])
    if not carry:
        rows = stored(rows, "mix-sizes")  # range bounds come from a sample: so texts are read once
    order = (F.col("source").asc_nulls_last(), F.col("size"), F.col("id"), F.col("hash"))
    dealt = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(dealt.schema.fields)) + ", part int, place long"
    placed = stored(dealt.transform(in_arrow, _number(1), schema).toDF(*dealt.columns, "part", "place"), "mix-rows")
    parts = placed.groupBy("source", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    facts = _null_safe(parts, source_targets(placed.select("source", "size"), weights, share))
    facts = facts.select(F.col("source").alias("f_source"), F.col("part").alias("f_part"), "base", "source_size", "target", offset_of(F.col("source"), seed).alias("u"))
    out = placed.join(facts, (F.col("part") == F.col("f_part")) & F.col("source").eqNullSafe(F.col("f_source")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = F.col("base") + F.col("place")
    copies = F.floor(rank * each + F.col("u")) - F.floor((rank - 1) * each + F.col("u"))
    return out.select("id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), *[f"c_{c}" for c in carry])


def _null_safe(parts: DataFrame, targets: DataFrame) -> DataFrame:
    t = targets.withColumnRenamed("source", "t_source")
    return parts.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")


def sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as its copies say, with its own columns."""
    own = docs.toDF(*[str(i) for i in range(len(docs.columns))])  # names of our own can't clash
    at = [str(docs.columns.index(c)) for c in (id_col, text_col, source_col)]
    rows = mix(own, own.columns, *at, **options).where(F.col("copies") > 0)
    rows = rows.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))), *[f"c_{c}" for c in own.columns])
    return rows.drop("col").toDF(*docs.columns)
