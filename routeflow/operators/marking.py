"""Marks along each key's order: a key's first row, and then each row that lies ``step`` or more behind the last mark on the key's
clock (or as far as the marked row itself says), or has ``most`` rows since it. A key of any length spreads, also one that never
pauses.

Which row is marked next depends on the last mark alone. Rows are range-partitioned by (key, order), sorted and written once.
In a partition that a key enters from before, only rows of its first step can be the first marks there; for each of these
(and for a key's own first row) the partition's task knows the last mark it leads to, and so where, in a later partition, the
chain goes on. These edges from entry to entry make a forest with one edge a row at most; pointer jumping, in as many joins as
the logarithm of the most partitions that one key has, finds the entries on the way from each key's first row. There is at
most one entry a partition. Then each partition marks its rows by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeflow.functions.shared import table
from routeflow.operators.numbering import _placed

_PLACE = (1 << 33) - 1
Arrow = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def reached(values: np.ndarray, low: np.ndarray, high: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each range low..high of ascending values, where the target is reached first (high: nowhere)."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        less = open_ & (values[np.minimum(middle, len(values) - 1)] < target)
        low = np.where(less, middle + 1, low)
        high = np.where(open_ & ~less, middle, high)
    return low


class Marks:
    """Marks rows, run by run. Batches come one after another; a run may go on from one to the next."""

    def __init__(self, step: int, most: int | None = None):
        self.step, self.most, self.session, self.last, self.until, self.since = step, most, None, 0, 0, 0

    def resume(self, session: int, last: int, since: int = 0) -> None:
        """Goes on in a run whose last mark was at ``last``, ``since`` rows ago."""
        self.session, self.last, self.until, self.since = session, last, last + self.step, since

    def of(self, sessions: np.ndarray, values: np.ndarray, reach: np.ndarray | None = None) -> np.ndarray:
        """``reach``: for each row the value from which on the next mark may come, if it is one; else ``step`` more than its own."""
        n, marks = len(sessions), np.zeros(len(sessions), bool)
        if not n:
            return marks
        reach = values + self.step if reach is None else reach
        starts = np.flatnonzero(np.append(True, sessions[1:] != sessions[:-1]))
        ends, at = np.append(starts[1:], n), starts.copy()
        if sessions[0] == self.session:  # goes on
            first = int(np.searchsorted(values[: ends[0]], self.until))
            at[0] = first if self.most is None else min(first, self.most - self.since)
        while True:
            open_ = at < ends
            at, ends = at[open_], ends[open_]
            if not len(at):
                break
            marks[at] = True
            there = reached(values, at, ends, reach[at])
            at = there if self.most is None else np.minimum(there, at + self.most)
        mine = np.flatnonzero(marks[starts[-1] :]) + starts[-1]
        goes_on = sessions[-1] == self.session
        if len(mine):
            self.last, self.until, self.since = int(values[mine[-1]]), int(reach[mine[-1]]), n - int(mine[-1])
        elif goes_on:
            self.since += n - int(starts[-1])
        self.session = sessions[-1]
        return marks


def chained(clock: np.ndarray, reach: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a run, were it marked: the run's last mark then, and how many marks there are from the row on."""
    at = np.arange(len(clock))
    after = np.maximum(np.searchsorted(clock, reach), at + 1)
    if most is not None:
        after = np.minimum(after, at + most)
    last, marks = np.where(after < len(clock), after, at), (after < len(clock)).astype(np.int64)
    while not np.array_equal(further := last[last], last):
        marks, last = marks + marks[last], further
    return last, marks + 1


class Part(NamedTuple):
    part: int
    rows: int
    continues: bool  # its first key has rows in the part before
    goes_on: bool  # its last key has rows in the part behind


def _parts(placed: DataFrame, keys: Sequence[str]) -> list[Part]:
    """A row for each task that wrote."""
    key = F.struct(*keys) if keys else F.lit(0)
    facts = placed.groupBy("__part").agg(F.count("*").alias("rows"), F.min_by(key, "__at").alias("first"), F.max_by(key, "__at").alias("last"))
    along = Window.orderBy("__part")
    before, behind = F.lag("last").over(along), F.lead("first").over(along)
    same = lambda a, b: b.isNotNull() & a.eqNullSafe(b)
    found = facts.select("__part", "rows", same(F.col("first"), before).alias("continues"), same(F.col("last"), behind).alias("goes_on"))
    return sorted(Part(*r) for r in found.collect())


def _narrow(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``__fresh``, whether a row's key differs from that of the row before in its part; sorted by part and place."""
    here = Window.partitionBy("__part").orderBy("__at")
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.lag(k).over(here))
    return rows.withColumn("__fresh", ~same)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Whole parts, of rows sorted by part, as arrays by column."""
    held, part = [], None

    def whole() -> tuple[int, dict[str, np.ndarray]]:
        rows = pa.Table.from_batches(held)
        return part, {n: rows.column(n).to_numpy() for n in rows.column_names}

    for batch in batches:
        if not batch.num_rows:
            continue
        of = batch.column("__part").to_numpy()
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and of[a] != part:
                yield whole()
                held = []
            part = int(of[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield whole()


_EXITS = "part int, node long, start boolean, reach long, after long, marks long"


def _exits(parts: dict[int, Part], step: int, most: int | None) -> Arrow:
    """For each row that may be a part's first mark of a key: the last mark it leads to here, by its reach and by how many rows follow
    it, if the key goes on in the next part. And a row (node -1) about the run at the part's beginning: last clock and length."""
    names = [x.split()[0] for x in _EXITS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _by_part(batches):
            clock, reach, at, p = x["__clock"], x["__reach"], x["__at"], parts[part]
            fresh = np.flatnonzero(x["__fresh"][1:]) + 1
            end, last = int(fresh[0]) if len(fresh) else len(clock), int(fresh[-1]) if len(fresh) else 0
            out = [([part], [-1], [False], [clock[end - 1]], [end], [0])]
            found = []
            if p.continues and p.goes_on and end == len(clock):
                window = int(np.searchsorted(clock, clock[0] + step)) + 1
                found.append((0, min(end, window, end if most is None else most + 1), False))
            elif p.goes_on:
                found.append((last, last + 1, True))
            for a, b, start in found:
                mark, marks = chained(clock[a:], reach[a:], most)
                mark, marks = mark[: b - a] + a, marks[: b - a]
                out.append(([part] * (b - a), at[a:b], [start] * (b - a), reach[mark], len(clock) - 1 - mark, marks))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]), t) for k, t in enumerate((pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()))], names=names)

    return run


class _Runs(NamedTuple):
    """Facts on parts in their order, for finding where a key's chain goes on."""

    parts: np.ndarray
    length: np.ndarray  # rows of the key that the part begins with
    clock: np.ndarray  # the last clock of these
    chain_end: np.ndarray  # after the last part that the key at a part's end reaches


def _located(runs: _Runs, most: int | None) -> Arrow:
    """The part that holds the next mark, with the clock and the place there that it doesn't come before both of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, node, start, reach, after, _ = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for p in np.unique(part):
                mine = part == p
                k = int(np.searchsorted(runs.parts, p))
                a, b = k + 1, int(runs.chain_end[k])
                if a >= b:
                    continue
                target = reach[mine]
                by_clock = np.searchsorted(runs.clock[a:b], target)
                before = np.concatenate([[0], np.cumsum(runs.length[a:b])])
                rest = np.full(mine.sum(), before[-1]) if most is None else most - after[mine] - 1
                by_count = np.searchsorted(before[1:], rest, "right")
                there = np.minimum(by_clock, by_count)
                known = there < b - a
                there = np.minimum(there, b - a - 1)
                place = np.minimum(rest - before[there], runs.length[a:b][there])
                yield pa.RecordBatch.from_arrays([pa.array(x[known], t) for x, t in ((runs.parts[a:b][there], pa.int32()), (target, pa.int64()), (place, pa.int64()), (node[mine], pa.int64()), (start[mine], pa.bool_()))], names=["__part", "__clock", "place", "node", "start"])

    return run


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's rows (kind 0), and then what is located in it (kind 1): edges from node to node."""
    for _, x in _by_part(batches):
        asks = x["kind"] == 1
        at, clock = x["__at"][~asks], x["__clock"][~asks]
        place = np.minimum(reached(clock, np.zeros(asks.sum(), np.int64), x["place"][asks].astype(np.int64), x["__clock"][asks]), len(at) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(x["node"][asks].astype(np.int64)), pa.array(at[place].astype(np.int64)), pa.array(x["start"][asks].astype(bool))], names=["node", "to", "start"])


def _entries(placed: DataFrame, keys: Sequence[str], parts: list[Part], step: int, most: int | None) -> tuple[dict[int, int], dict[int, int]]:
    """For each part whose first key comes from before: the place of its first mark, if it has one, and how many marks the key had."""
    spark, by = placed.sparkSession, {p.part: p for p in parts}
    chain = [p.part for p in parts if p.continues or p.goes_on]
    rows = placed.join(F.broadcast(spark.createDataFrame([(p,) for p in chain], "__part int")), "__part", "left_semi")  # a row for each task
    narrow = _narrow(rows.select("__part", "__at", "__clock", "__reach", *keys), keys).select("__part", "__at", "__clock", "__reach", "__fresh")
    exits = table(narrow.mapInArrow(_exits(by, step, most), _EXITS), "mark-exits")
    facts = sorted((r["part"], r["after"], r["reach"]) for r in exits.where("node = -1").collect())
    through = [by[p].goes_on and length == by[p].rows for p, length, _ in facts]  # the key that comes in goes on behind the part
    ends = [k + 1 for k in range(len(facts))]
    for k in range(len(facts) - 2, -1, -1):
        if by[facts[k][0]].goes_on:
            ends[k] = ends[k + 1] if through[k + 1] else k + 2
    runs = _Runs(np.array([f[0] for f in facts]), np.array([f[1] for f in facts]), np.array([f[2] for f in facts]), np.array(ends))
    asked = exits.where("node >= 0").mapInArrow(_located(runs, most), "__part int, __clock long, place long, node long, start boolean")
    own = rows.select("__part", F.lit(0).alias("kind"), "__at", "__clock", *[F.lit(0).cast("long").alias(c) for c in ("place", "node")], F.lit(False).alias("start"))
    both = own.unionByName(asked.select("__part", F.lit(1).alias("kind"), F.col("node").alias("__at"), "__clock", "place", "node", "start"))
    both = both.repartition("__part").sortWithinPartitions("__part", "kind", "__at")
    edges = table(both.mapInArrow(_resolved, "node long, to long, start boolean"), "mark-edges")
    jumps, longest = [edges.select("node", "to")], max(e - k for k, e in enumerate(ends))
    while 1 << len(jumps) < longest:
        far = jumps[-1]
        jumps.append(table(far.join(far.select(F.col("node").alias("to"), F.col("to").alias("further")), "to").select("node", F.col("further").alias("to")), "mark-jumps"))
    starts = {r["node"]: r["marks"] for r in exits.where("start").select("node", "marks").collect()}
    way = set(starts)  # one start and one entry a part at most
    of = lambda nodes: F.broadcast(spark.createDataFrame([(n,) for n in nodes], "node long"))
    for jump in reversed(jumps):
        way |= {r["to"] for r in jump.join(of(way), "node").select("to").collect()}
    entry = {n >> 33: n & _PLACE for n in way if n not in starts}
    marks = {r["node"]: r["marks"] for r in exits.join(of(way), "node", "left_semi").select("node", "marks").collect()}
    began = {n >> 33: m for n, m in starts.items()}
    earlier, total = {}, 0
    for p in parts:
        if p.continues:
            earlier[p.part] = total
            total += marks.get(p.part << 33 | entry[p.part], 0) if p.part in entry else 0
        total = began.get(p.part, total)
    return entry, earlier


def _mark(parts: dict[int, Part], entry: dict[int, int], earlier: dict[int, int], step: int, most: int | None, at: dict[str, int], names: list[str]) -> Arrow:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, number, count, part, from_before = Marks(step, most), 0, 0, None, False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            of, place, clock = batch.column(at["__part"]).to_numpy(), batch.column(at["__at"]).to_numpy() & _PLACE, batch.column(at["__clock"]).to_numpy()
            reach = batch.column(at["__reach"]).to_numpy()
            fresh = batch.column(at["__fresh"]).to_numpy(zero_copy_only=False).copy()
            enters = np.append(of[0] != part, of[1:] != of[:-1])
            fresh |= enters
            own = np.cumsum(fresh)  # 0: the run of the batch before goes on
            begins = np.flatnonzero(fresh)
            continues = np.array([from_before, *(bool(enters[i] and parts[int(of[i])].continues) for i in begins)])
            waits = continues[own]
            if waits.any():
                first = np.array([entry.get(int(p), _PLACE) for p in of[waits]]) if len(np.unique(of[waits])) > 1 else entry.get(int(of[waits][0]), _PLACE)
                waits[waits] = place[waits] < first
            marks = np.zeros(n, bool)
            marks[~waits] = fold.of((number + own)[~waits], clock[~waits], reach[~waits])
            seen = np.cumsum(marks)
            before = np.array([-count, *(int(seen[i] - marks[i]) - (earlier.get(int(of[i]), 0) if c else 0) for i, c in zip(begins, continues[1:], strict=True))])
            groups = seen - before[own]
            number, count, part, from_before = number + int(own[-1]), int(groups[-1]), of[-1], bool(continues[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks), pa.array(groups - 1)], names=names)

    return run


def marked(df: DataFrame, keys: Sequence[str], order: Sequence[str], clock: Column, step: int, most: int | None = None, mark: str = "mark", group: str = "grp", reach: Column | None = None) -> DataFrame:
    """Adds ``mark``, and ``grp``: how many marks of its key come before a row's last one. ``clock`` is a long that ascends along the
    order, ``step`` is positive. With ``reach`` each row says how far on the clock the next mark is at least if it is one, which is
    more than its own clock and ``step`` behind it at most. Null keys are a key. Rows are written once, and move twice."""
    rows = df.withColumn("__clock", clock)
    placed = _placed(rows.withColumn("__reach", F.col("__clock") + step if reach is None else reach), keys, order)
    parts = _parts(placed, keys)
    by = {p.part: p for p in parts}
    entry, earlier = _entries(placed, keys, parts, step, most) if any(p.continues for p in parts) else ({}, {})
    rows = _narrow(placed, keys)
    names = [*rows.columns, "__mark", "__grp"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + ["__mark boolean", "__grp long"])
    at = {c: rows.columns.index(c) for c in ("__part", "__at", "__clock", "__reach", "__fresh")}
    out = rows.mapInArrow(_mark(by, entry, earlier, step, most, at, names), schema)
    return out.select(*[c for c in df.columns if c not in (mark, group)], F.col("__mark").alias(mark), F.col("__grp").alias(group))
