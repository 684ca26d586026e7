"""Exact top-k search by inner product, with a pivot-distance index.

Components are floored multiples of 1/1024, so that scores are integers. One more coordinate makes all vectors equally
long; then a larger inner product is a smaller distance, and the triangle inequality holds. Pivots come from a bounded
sample. Every vector is keyed by its nearest pivot and the distance to it; sorted by that key, vectors fall into blocks,
each an annulus around a pivot. For a query, the distances to the pivots bound from below its distance to each annulus.

Two passes. A query is an indexed row too, so the first pass searches each query's own annulus where it lies, without any
shuffle, and stores the queries with the k-th best score found there or in the sample: all queries then start with a
radius that shrinks as the index grows. The second pass expands the annuli in the order of their bounds. A query takes part
in an annulus only while the bound is within its radius; where that holds for no query any more, the search stops. Only
scores that reach the query's k-th best so far leave a task.

Blocks are scanned by tasks; every task reads the packed queries from the shared folder batch by batch, so that neither
side is ever whole in one place. Bounds get a margin for rounding; the scores themselves are exact.

Defined cases: vectors that are null, or hold a null, NaN or infinite component, take no part, nor do null ids; a
finite vector so long that scores might leave 64 bits is an error, never a wrong score; shorter ones are filled up with zeros; repeated rows count once, and rows that share a query's id are its own; of rows that share
an id the best counts, for queries as for candidates; ties go to the smaller id; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.dataset
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeflow.llm.storage import fresh_path, in_arrow, open_fs, shuffle_partitions, stored

SCALE, PIVOTS, SAMPLE, BLOCK, QUERIES, GROUP = 1024, 48, 2048, 1024, 256, 16
LEAST = np.iinfo(np.int64).min  # no score
#: Squared length, of floored components, from which on inner products might not fit into 64 bits.
WIDEST = 2.0**62


class Index(NamedTuple):
    dims: int
    longest: int  # the largest squared length
    pivots: np.ndarray  # with the added coordinate
    ids: np.ndarray  # of the sample
    sample: np.ndarray


def _floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = [], []
        for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if vec_id is None or not v.is_valid or v.values.null_count:
                continue
            x = np.floor(SCALE * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
            if np.isfinite(x).all():
                if x @ x >= WIDEST:
                    raise ValueError(f"vector {vec_id} is too long for integer inner products")
                ids.append(vec_id)
                rows.append(x.astype("<i8"))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(r) for r in rows], pa.int32()), pa.array([int(r @ r) for r in rows], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["vec_id", "dims", "norm2", "v"])


def floored(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, dims, norm2, v) with floored components, of the vectors that take part."""
    return vectors.select(F.col(id_col).cast("long"), F.col(vector_col)).transform(in_arrow, _floored, "vec_id long, dims int, norm2 long, v binary")


def _matrix(column: list[bytes], dims: int) -> np.ndarray:
    if all(len(v) == 8 * dims for v in column):
        return np.frombuffer(b"".join(column), "<i8").reshape(-1, dims)
    return np.stack([np.pad(np.frombuffer(v, "<i8"), (0, dims - len(v) // 8)) for v in column]) if column else np.zeros((0, dims), np.int64)


def _scorable(v: np.ndarray, longest: int) -> np.ndarray:
    """Floating point holds all inner products exactly while they are below 2**53."""
    return v.astype(np.float64) if longest < 1 << 52 else v


def _raised(v: np.ndarray, longest: int) -> np.ndarray:
    v = v.astype(np.float64)
    return np.column_stack([v, np.sqrt(np.maximum(longest - (v * v).sum(1), 0.0))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0.0))


def fit(rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> Index | None:
    """Pivots from a sample of ``sample`` vectors in expectation, chosen by a hash of the id."""
    facts = rows.agg(F.count("*").alias("n"), F.max("dims").alias("dims"), F.max("norm2").alias("longest")).first()
    if not facts["n"]:
        return None
    draw = F.pmod(F.xxhash64(F.lit("pivots"), "vec_id"), F.lit(1 << 30))
    got = rows.where(draw < int(min(1.0, sample / facts["n"]) * (1 << 30))).select("vec_id", "v").dropDuplicates(["vec_id"]).orderBy("vec_id").toArrow()
    ids, v = got.column("vec_id").to_numpy(), _matrix(got.column("v").to_pylist(), facts["dims"])
    if not len(ids):
        return Index(facts["dims"], facts["longest"], np.zeros((1, facts["dims"] + 1)), ids, v)
    up, rng = _raised(v, facts["longest"]), np.random.default_rng(7)
    centres = up[rng.choice(len(up), min(pivots, len(up)), replace=False)]
    for _ in range(8):
        of = _distances(up, centres).argmin(1)
        centres = np.stack([up[of == j].mean(0) if (of == j).any() else centres[j] for j in range(len(centres))])
    return Index(facts["dims"], facts["longest"], centres, ids, v)


def _keyed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            if batch.num_rows:
                d = _distances(_raised(_matrix(batch.column(1).to_pylist(), index.dims), index.longest), index.pivots)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near]), *batch.columns], names=["pivot", "distance", "vec_id", "v", "asks"])

    return run


ANNULI = "block long, pivot int, inner double, outer double, ids binary, v binary, asks binary"
_ANNULI = pa.schema([("block", pa.int64()), ("pivot", pa.int32()), ("inner", pa.float64()), ("outer", pa.float64()), ("ids", pa.binary()), ("v", pa.binary()), ("asks", pa.binary())])


def _annuli(size: int, dims: int):
    """Blocks of rows sorted by (pivot, distance, vec_id); exact repeats stand side by side and count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        made, last = 0, None

        def block() -> pa.RecordBatch:
            pivot, distances, ids, vectors, asks = zip(*held, strict=True)
            row = {"block": TaskContext.get().partitionId() << 32 | made, "pivot": pivot[0], "inner": distances[0], "outer": distances[-1], "ids": np.array(ids, "<i8").tobytes(), "v": _matrix(list(vectors), dims).astype("<i8").tobytes(), "asks": np.array(asks, bool).tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=_ANNULI)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (row[2], row[3]) == last:
                    continue
                if held and (len(held) >= size or held[0][0] != row[0]):
                    yield block()
                    made, held = made + 1, []
                held.append(row)
                last = row[2], row[3]
        if held:
            yield block()

    return run


def build(rows: DataFrame, index: Index, asks, block: int = BLOCK) -> DataFrame:
    """The index itself, stored: one row an annulus with its pivot, its inner and outer distance, its ids and vectors, and
    which of them meet the condition ``asks`` on ``vec_id``."""
    spark = rows.sparkSession
    shared, order = spark.sparkContext.broadcast(index), ("pivot", "distance", "vec_id")
    keyed = rows.select("vec_id", "v", F.coalesce(asks, F.lit(False)).alias("asks")).transform(in_arrow, _keyed(shared), "pivot int, distance double, vec_id long, v binary, asks boolean")
    dealt = keyed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    return stored(dealt.transform(in_arrow, _annuli(block, index.dims), ANNULI), "topk-index")


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; ``LEAST`` where there are fewer. ``scores`` hold ``LEAST`` where a pair doesn't count."""
    if scores.shape[1] < k:
        return np.full(len(scores), LEAST)
    return np.partition(scores, scores.shape[1] - k, 1)[:, scores.shape[1] - k]


def _own_annuli(shared, k: int, batch_rows: int):
    """The first pass: the queries of each annulus, with the k-th best score found there or in the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        sample = _scorable(index.sample, index.longest)
        for batch in batches:
            for block in batch.to_pylist():
                ids, v = np.frombuffer(block["ids"], "<i8"), np.frombuffer(block["v"], "<i8").reshape(-1, index.dims)
                asking = np.flatnonzero(np.frombuffer(block["asks"], bool))
                first = np.unique(ids, return_index=True)[1]  # of rows that share an id one counts
                sets = [(index.ids, sample), (ids[first], _scorable(v[first], index.longest))]
                for a in range(0, len(asking), batch_rows):
                    some = asking[a : a + batch_rows]
                    q, floor = _scorable(v[some], index.longest), np.full(len(some), LEAST)
                    for of, others in sets:
                        scores = (q @ others.T).astype(np.int64)
                        scores[ids[some][:, None] == of[None]] = LEAST
                        floor = np.maximum(floor, _kth(scores, k))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array([x.tobytes() for x in v[some]], pa.binary()), pa.array(floor)], names=["vec_id", "v", "floor"])

    return run


def _best(of: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k largest scores of different ids, ties by the smaller id; with the rank of each."""
    order = np.lexsort((-scores, ids, of))
    of, ids, scores = of[order], ids[order], scores[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (ids[1:] != ids[:-1])
    of, ids, scores = of[new], ids[new], scores[new]
    order = np.lexsort((ids, -scores, of))
    of, ids, scores = of[order], ids[order], scores[order]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    top = rank < k
    return of[top], ids[top], scores[top], rank[top]


def _search(shared, queries: str, k: int, batch_rows: int, group: int, scored):
    def scan(blocks: list[dict], index: Index) -> Iterator[pa.RecordBatch]:
        files, path = open_fs(queries)
        ids = [np.frombuffer(b["ids"], "<i8") for b in blocks]
        vectors = [_scorable(np.frombuffer(b["v"], "<i8").reshape(-1, index.dims), index.longest) for b in blocks]
        pivot, inner, outer = (np.array([b[c] for b in blocks]) for c in ("pivot", "inner", "outer"))
        margin = 1e-6 * (1 + np.sqrt(float(index.longest)))
        for part in pyarrow.dataset.dataset(path, filesystem=files, format="parquet").to_batches(columns=["vec_id", "v", "floor"], batch_size=batch_rows):
            if not part.num_rows:
                continue
            q_ids, floor = part.column("vec_id").to_numpy(), part.column("floor").to_numpy().copy()
            raw = _matrix(part.column("v").to_pylist(), index.dims)
            up, q = np.column_stack([raw.astype(np.float64), np.zeros(len(raw))]), _scorable(raw, index.longest)
            to_pivots, own2 = _distances(up, index.pivots), (up * up).sum(1)
            bound = np.maximum(np.maximum(to_pivots[:, pivot] - outer, inner - to_pivots[:, pivot]), 0) - margin
            nearest = bound.min(0)

            def radius(some, own2=own2, floor=floor, index=index):
                known = floor[some] > LEAST
                return np.where(known, np.sqrt(np.maximum(own2[some] + index.longest - 2.0 * np.where(known, floor[some], 0), 0)), np.inf)

            reach = radius(np.arange(len(q)))  # distance of the k-th best so far
            held = tuple(np.empty(0, np.int64) for _ in range(3))
            for b in np.argsort(nearest):
                if nearest[b] > reach.max():
                    break
                near = np.flatnonzero(bound[:, b] <= reach)
                if not len(near):
                    continue
                scores = (q[near] @ vectors[b].T).astype(np.int64)
                if scored is not None:
                    scored.add(scores.size)
                row, at = np.nonzero((scores >= floor[near][:, None]) & (ids[b][None] != q_ids[near][:, None]))
                if len(row):
                    new = near[row], ids[b][at], scores[row, at]
                    of, *found, rank = _best(*(np.concatenate(x) for x in zip(held, new, strict=True)), k)
                    held = of, *found
                    full = rank == k - 1
                    floor[of[full]] = np.maximum(floor[of[full]], found[1][full])
                    reach[of[full]] = radius(of[full])
            if len(held[0]):
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[held[0]]), pa.array(held[1]), pa.array(held[2])], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                if len(held) == group:
                    yield from scan(held, shared.value)
                    held = []
        if held:
            yield from scan(held, shared.value)

    return run


def search(blocks: DataFrame, index: Index, k: int = 10, batch_rows: int = QUERIES, group: int = GROUP, scored=None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of each row that ``build`` marked as a query, among all indexed rows
    but its own. ``scored``, an accumulator, takes the number of pairs whose score is computed in the second pass."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(index)  # pivots and sample, both of bounded size
    path = fresh_path(spark, "topk-queries")
    blocks.transform(in_arrow, _own_annuli(shared, k, batch_rows), "vec_id long, v binary, floor long").write.parquet(path)
    found = blocks.select(*_ANNULI.names[:-1]).transform(in_arrow, _search(shared, path, k, batch_rows, group, scored), "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Search of the rows that ``is_query`` (a condition on ``vec_id``) picks against all rows."""
    rows = stored(floored(vectors, id_col, vector_col), "topk-vectors")
    index = fit(rows)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return search(build(rows, index, is_query), index, k)
