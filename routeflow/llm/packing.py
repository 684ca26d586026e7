"""Best-fit packing with a grouping genetic algorithm on islands.

A document's ids plus an end id form one piece, cut only where they exceed the capacity; full pieces are sequences of
their own. The others are dealt by a hash into blocks of about ``BLOCK`` pieces. Each block is evolved on several
islands (tasks): a packing's genes are whole bins. Crossover injects a run of well-filled bins of one parent into the
other, takes out the bins that hold a document twice, and puts the displaced documents back: as many bins as they make up
are filled as full as can be, and the rest is best-fitted. Mutation does so with the worst filled bin, some that aren't
full and some of many small documents. Between epochs each island receives its neighbour's elite through a shuffle of
compact assignments, and in the end a block's best packing counts. The islands' table tells how many generations ran and
how many bins they gained. Evolution stops as soon as a packing meets the lower bound on bins.

No task ever holds more than a block, whatever the input's size. Blocks of thousands of pieces lose at most about one
partly filled sequence each against a packing of everything at once.

Defined cases: null or empty text is one piece that holds only the end id; a null document id packs like any other;
repeated rows are packed as often as they occur; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeflow.llm.coding import coder
from routeflow.llm.storage import in_arrow, shuffle_partitions, slices, stored

CAPACITY, BLOCK, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2048, 8192, 2, 2, 40, 4


def _cut(tokenizer: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = coder(tokenizer, 2).encode_all, end_id.to_bytes(2, "little")
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, coded in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                ids = np.frombuffer(coded + end, "<u2").astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    piece = ids[at : at + capacity]
                    rows.append((doc_id, k, at, len(piece), zlib.crc32(piece.tobytes())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all documents."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return rows.transform(in_arrow, _cut(tokenizer, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Packing:
    """Bins (lists of positions) with their fills, and for best fit the bins by free room with a bit for each room in use."""

    def __init__(self, lengths: Sequence[int], capacity: int):
        self.lengths, self.capacity, self.bins, self.fills = lengths, capacity, [], []
        self.rooms: dict[int, list[int]] = {}
        self.mask = 0

    def _offer(self, b: int) -> None:
        room = self.capacity - self.fills[b]
        if room:
            self.rooms.setdefault(room, []).append(b)
            self.mask |= 1 << room

    def add(self, bin_: list[int], fill: int) -> None:
        self.bins.append(bin_)
        self.fills.append(fill)
        self._offer(len(self.bins) - 1)

    def best_fit(self, items: Sequence[int]) -> None:
        """Puts each item, in the order given, where it leaves the least room."""
        lengths, rooms = self.lengths, self.rooms
        for i in items:
            n = lengths[i]
            fitting = self.mask >> n
            if fitting:
                room = n + (fitting & -fitting).bit_length() - 1
                held = rooms[room]
                b = held.pop()
                if not held:
                    self.mask &= ~(1 << room)
                self.bins[b].append(i)
                self.fills[b] += n
                self._offer(b)
            else:
                self.add([i], n)

    def fitness(self) -> tuple[int, int]:
        """Fewer bins first; then the more uneven the fills, the closer some bins are to vanishing."""
        return -len(self.bins), sum(f * f for f in self.fills)


def lower_bound(lengths: Sequence[int], capacity: int) -> int:
    """Words over capacity, or pieces over half the capacity with what cannot join them, whichever is more."""
    ordered, best = sorted(lengths), -(-sum(lengths) // capacity)
    for k in {n for n in ordered if n <= capacity // 2} if len(ordered) <= 64 else (capacity // 8, capacity // 4, capacity // 3, capacity // 2):
        large = sum(n > capacity - k for n in ordered)
        middle = [n for n in ordered if capacity // 2 < n <= capacity - k]
        small = sum(n for n in ordered if k <= n <= capacity // 2)
        best = max(best, large + len(middle) + max(0, -(-(small - (len(middle) * capacity - sum(middle))) // capacity)))
    return best


def _decreasing(lengths: Sequence[int], items) -> list[int]:
    return sorted(items, key=lengths.__getitem__, reverse=True)


def fullest(lengths: Sequence[int], items: Sequence[int], room: int) -> list[int]:
    """A subset of the items that leaves the least of the room: sums within reach are the bits of a number."""
    limit, sums = (1 << room + 1) - 1, [1]
    for i in items:
        sums.append((sums[-1] | sums[-1] << lengths[i]) & limit)
        if sums[-1] >> room:
            break
    at, chosen = sums[-1].bit_length() - 1, []
    for k in range(len(sums) - 1, 0, -1):
        if not sums[k - 1] >> at & 1:
            chosen.append(items[k - 1])
            at -= lengths[items[k - 1]]
    return chosen


def refit(lengths: Sequence[int], capacity: int, bins: list[tuple[list[int], int]], displaced: list[int], rng: random.Random) -> Packing:
    """The bins (with their fills) and the displaced items: bins are filled as full as these can, each around the largest
    one left and with large ones rather than small ones; what is less than a bin is best-fitted."""
    packing = Packing(lengths, capacity)
    for bin_, fill in bins:
        packing.add(list(bin_), fill)
    left, total = _decreasing(lengths, displaced), sum(lengths[i] for i in displaced)
    while total >= capacity:
        noise = {i: lengths[i] * rng.uniform(0.6, 1.0) for i in left}
        chosen = [left[0], *fullest(lengths, sorted(left[1:], key=noise.__getitem__, reverse=True), capacity - lengths[left[0]])]
        fill = sum(lengths[i] for i in chosen)
        packing.add(chosen, fill)
        gone, total = set(chosen), total - fill
        left = [i for i in left if i not in gone]
    packing.best_fit(left)
    return packing


def crossover(a: Packing, b: Packing, rng: random.Random) -> Packing:
    """A run of well-filled bins of ``a`` injected whole into ``b``; bins of ``b`` that hold one of their documents go, and
    what they and the worst-filled bins displace is put back."""
    taken, bins = bytearray(len(a.lengths)), []
    start, bar = rng.randrange(len(a.bins)), a.capacity - rng.choice((0, 1, 2, 4, 8))
    for bin_, fill in list(zip(a.bins, a.fills, strict=True))[start : start + 1 + len(a.bins) // 16]:
        if fill >= bar:
            bins.append((bin_, fill))
            for i in bin_:
                taken[i] = 1
    worst = sorted(b.fills)[min(len(b.fills), 4) - 1]
    displaced = []
    for bin_, fill in zip(b.bins, b.fills, strict=True):
        if fill <= worst or any([taken[i] for i in bin_]):
            displaced += [i for i in bin_ if not taken[i]]
        else:
            bins.append((bin_, fill))
    return refit(a.lengths, a.capacity, bins, displaced, rng)


def mutate(a: Packing, rng: random.Random) -> Packing:
    """The worst-filled bin, some others that aren't full and some of many small documents dissolved, and their documents put back."""
    order = sorted(range(len(a.bins)), key=a.fills.__getitem__)
    open_ = [k for k in order if a.fills[k] < a.capacity]
    many = sorted(order, key=lambda k: len(a.bins[k]), reverse=True)[: 1 + len(order) // 8]
    bad = {order[0], *rng.sample(open_, min(len(open_), rng.randint(4, 24))), *rng.sample(many, min(len(many), rng.randint(2, 12)))}
    displaced = [i for k in bad for i in a.bins[k]]
    return refit(a.lengths, a.capacity, [(a.bins[k], a.fills[k]) for k in range(len(a.bins)) if k not in bad], displaced, rng)


def _of_assignment(lengths: list[int], capacity: int, assignment: np.ndarray) -> Packing:
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(assignment.tolist()):
        bins.setdefault(b, []).append(i)
    packing = Packing(lengths, capacity)
    for bin_ in bins.values():
        packing.add(bin_, sum(lengths[i] for i in bin_))
    return packing


class Evolved(NamedTuple):
    assignment: np.ndarray  # bin of each position
    bins: int
    fills: int  # sum of squared fills
    gained: int  # bins fewer than what the island began with
    generations: int  # how many ran


def evolve(lengths: list[int], capacity: int, seed: str, start: list[np.ndarray], generations: int = GENERATIONS, population: int = POPULATION) -> Evolved:
    """The best packing that this island finds; it stops at the lower bound."""
    rng, bound = random.Random(seed), lower_bound(lengths, capacity)
    crowd = [_of_assignment(lengths, capacity, x) for x in start]
    if not crowd:
        crowd.append(Packing(lengths, capacity))
        crowd[0].best_fit(_decreasing(lengths, range(len(lengths))))
    crowd.sort(key=Packing.fitness, reverse=True)
    before, ran = len(crowd[0].bins), 0
    while len(crowd) < population and len(crowd[0].bins) > bound:
        noise = [n * rng.uniform(0.85, 1.0) for n in lengths]
        crowd.append(Packing(lengths, capacity))
        crowd[-1].best_fit(sorted(range(len(lengths)), key=noise.__getitem__, reverse=True))
    while ran < generations and len(crowd[0].bins) > bound:
        a, b = rng.sample(range(len(crowd)), 2) if len(crowd) > 1 else (0, 0)
        crowd += [crossover(crowd[a], crowd[b], rng), mutate(crowd[0], rng)]
        crowd = sorted(crowd, key=Packing.fitness, reverse=True)[:population]
        ran += 1
    assignment = np.empty(len(lengths), "<i4")
    for b, bin_ in enumerate(crowd[0].bins):
        assignment[bin_] = b
    bins, fills = crowd[0].fitness()
    return Evolved(assignment, -bins, fills, before + bins, ran)


_COLUMNS = (("doc_id", "<i8"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("ids_crc32", "<i8"))
_EVOLVED = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("bins", pa.int64()), ("fills", pa.int64()), ("gained", pa.int64()), ("generations", pa.int64()), ("own", pa.binary())])
_BLOCK = pa.schema([("block", pa.int64()), *((name, pa.binary()) for name, _ in _COLUMNS), ("nulls", pa.binary())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block, of rows sorted by block."""
    held: list[pa.RecordBatch] = []
    block = None

    def packed() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        columns = [rows.column(name).combine_chunks() for name, _ in _COLUMNS]
        arrays = [c.fill_null(0).to_numpy(zero_copy_only=False).astype(t).tobytes() for c, (_, t) in zip(columns, _COLUMNS, strict=True)]
        return pa.RecordBatch.from_pylist([dict(zip(_BLOCK.names, [block, *arrays, columns[0].is_null().to_numpy(zero_copy_only=False).tobytes()], strict=True))], schema=_BLOCK)

    for batch in batches:
        if not batch.num_rows:
            continue
        of = batch.column(batch.schema.get_field_index("block")).to_numpy()
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and of[a] != block:
                yield packed()
                held = []
            block = int(of[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield packed()


def _island(capacity: int, epoch: int, generations: int, population: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], "<i4").tolist()
                start = [np.frombuffer(row[k], "<i4") for k in ("own", "migrant") if row.get(k)]
                got = evolve(lengths, capacity, f"{row['block']}/{row['island']}/{epoch}", start, generations, population)
                out = {"block": row["block"], "island": row["island"], "bins": got.bins, "fills": got.fills, "gained": got.gained, "generations": got.generations, "own": got.assignment.tobytes()}
                yield pa.RecordBatch.from_pylist([out], schema=_EVOLVED)

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece's sequence and its place there, sequences without gaps."""
    for batch in batches:
        for row in batch.to_pylist():
            of = np.frombuffer(row["own"], "<i4").astype(np.int64)
            order = np.argsort(of, kind="stable")
            ids, parts, starts, lengths, crcs = (np.frombuffer(row[name], t)[order] for name, t in _COLUMNS)
            nulls, of = np.frombuffer(row["nulls"], bool)[order], of[order]
            before = np.cumsum(lengths, dtype=np.int64) - lengths
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            offset = before - np.repeat(before[first], np.diff(np.append(first, len(of))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), pa.array(parts), pa.array(starts), pa.array(lengths.astype(np.int64)), pa.array(crcs), pa.array((row["block"] << 32) + of), pa.array(offset)], names=[*(name for name, _ in _COLUMNS), "sequence_id", "offset"])


def place(parts: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION) -> DataFrame:
    """``parts`` (from :func:`pieces`, stored) with ``sequence_id`` and ``offset``; full pieces have negative sequence numbers."""
    full, part = parts.where(F.col("length") == capacity), parts.where(F.col("length") < capacity)
    n, spread = max(1, -(-part.count() // block)), shuffle_partitions(parts.sparkSession)
    # the row number spreads pieces that are alike in all else, as of null or repeated ids
    keyed = part.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32", F.monotonically_increasing_id()), F.lit(n)))
    order = ("block", "length", "doc_id", "piece")
    blocks = stored(keyed.repartition(min(n, spread), "block").sortWithinPartitions(*order).transform(in_arrow, _blocks, "block long, doc_id binary, piece binary, start binary, length binary, ids_crc32 binary, nulls binary"), "pack-blocks")
    work = blocks.select("block", F.col("length").alias("lengths"), F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"))
    best = None
    for epoch in range(epochs):
        rows = work
        if best is not None:
            elite = best.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("own").alias("migrant"))
            rows = work.join(best.select("block", "island", "own"), ["block", "island"]).join(elite, ["block", "island"])
        evolved = rows.repartition(min(n * islands, spread), "block", "island").transform(in_arrow, _island(capacity, epoch, generations, population), "block long, island int, bins long, fills long, gained long, generations long, own binary")
        best = stored(evolved, f"pack-epoch-{epoch}")
    winner = best.groupBy("block").agg(F.max_by("own", F.struct(-F.col("bins"), "fills", "island")).alias("own"))
    placed = blocks.join(winner, "block").transform(in_arrow, _placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    alone = full.select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(alone)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, **options) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents."""
    return place(stored(pieces(docs, tokenizer, end_id, capacity), "pack-pieces"), capacity, **options)
