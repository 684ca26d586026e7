"""Merkle dataset manifest: a digest of every row, a tree of digests for each group, one root over all groups, and for
each row the siblings on its way to the root, so that anyone who holds the root can check one row alone.

Nodes are numbered within their group and fall into aligned blocks of 8 ** ``LEVELS``. A first pass reduces each block to its
top by treehash; the tops are the nodes of the next tier, and so on until every group has one node, its subroot. Subroots
form the last tree in the same way. Then paths come from the top down: in each block the classic traversal moves from leaf
to leaf, with one treehash stack a level that prepares that level's next run from one leaf ahead a step, so that it holds
at most 8 nodes of each level and stack; the path that all leaves of a block share from there on is appended.

A block is one row of at most 4096 digests and goes to one task, so a group of any size spreads. A block that isn't full is
the only one or the last of its group: the first is lifted until one node is left, the last as far as its neighbours.

Defined cases: null values are part of a digest as ``-``; null groups are a group, before all others; rows with a null or
repeated order value are all leaves, nulls first, equals in the order of their digests; empty and very long texts are plain
values (texts are hashed where they are read and never shuffled); an empty table gives an empty manifest; only columns to be
carried are kept, whatever their names, but for ``leaf``, ``path``, ``subroot`` and ``root``, which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeflow.llm.storage import in_arrow, stored
from routeflow.operators.numbering import numbered

#: Nodes that become one node, and levels of a block.
WIDTH, LEVELS = 8, 4
#: Two strings of hex digests for each level: the siblings to the left and to the right.
PATH = "array<struct<left: string, right: string>>"
_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
#: What all leaves of a block share.
_UPPER = f"struct<path: {PATH}, subroot: string, root: string>"


def parent(nodes: Sequence[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """Digest of a row: each value as its UTF-8 length, a colon and itself, or ``-`` for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def proof(path: Column) -> Column:
    """Digest of all siblings of a path, from the leaf's run to the root's."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to along its path."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def height_of(block: int, n: int, levels: int) -> int:
    """Levels that a block of n leaves is lifted. Only a group's only block can be its first and not full."""
    if block or n == WIDTH**levels:
        return levels
    height = 0
    while WIDTH**height < n:
        height += 1
    return height


class Treehash:
    """Builds level ``height`` from leaves that come one after another; keeps at most ``WIDTH`` nodes of each level."""

    def __init__(self, height: int):
        self.height, self.open = height, [[] for _ in range(height + 1)]

    def add(self, node: str, last: bool) -> None:
        """``last``: no further leaf comes, so runs that aren't full end here."""
        self.open[0].append(node)
        for k in range(self.height):
            run = self.open[k]
            if len(run) == WIDTH or (last and run):
                self.open[k] = []
                self.open[k + 1].append(parent(run))

    def take(self) -> list[str]:
        """The run of nodes that stands ready at the level; the stack goes on with the next one."""
        run, self.open[self.height] = self.open[self.height], []
        return run


def top(leaves: Sequence[str], height: int) -> str:
    hashed, n = Treehash(height), len(leaves)
    for i, node in enumerate(leaves):
        hashed.add(node, i == n - 1)
    (node,) = hashed.take()
    return node


def paths(leaves: Sequence[str], height: int) -> Iterator[list[tuple[str, str]]]:
    """(left, right) siblings of each level below the top, leaf by leaf. When a level's run ends, its next one is ready:
    the level's stack has read one leaf a step since the run began."""
    n, runs, ahead = len(leaves), [], []
    for k in range(height):
        hashed = Treehash(k)
        for i in range(min(n, WIDTH ** (k + 1))):
            hashed.add(leaves[i], i == n - 1)
        runs.append(hashed.take())
        ahead.append(hashed)
    for i in range(n):
        out = []
        for k, run in enumerate(runs):
            place = i // WIDTH**k % WIDTH
            out.append(("".join(run[:place]), "".join(run[place + 1 :])))
        yield out
        for k in range(height):
            span = WIDTH ** (k + 1)
            if i + span < n:
                ahead[k].add(leaves[i + span], i + span == n - 1)
            if (i + 1) % span == 0 and i + 1 < n:
                runs[k] = ahead[k].take()


def _tops(levels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [top(x, height_of(b, len(x), levels)) for b, x in zip(batch.column(1).to_pylist(), (y.as_py() for y in batch.column(2)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["g", "block", "digest"])

    return run


def _paths(levels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (g, block, digests, upper, carried lists) to a row a leaf: (g, pos, digest, upper, path, carried)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block, leaves = batch.column(1)[r].as_py(), batch.column(2)[r].as_py()
                walk, base = paths(leaves, height_of(block, len(leaves), levels)), block * WIDTH**levels + 1
                for a in range(0, len(leaves), WIDTH**3):
                    part = leaves[a : a + WIDTH**3]
                    found = [next(walk) for _ in part]
                    places = pa.array([0, *(len(found[0]) * (k + 1) for k in range(len(part)))], pa.int32())
                    steps = pa.StructArray.from_arrays([pa.array([s[side] for p in found for s in p], pa.string()) for side in (0, 1)], fields=list(_STEP))
                    same = pa.array([0] * len(part), pa.int32())  # what a block's leaves share
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(r, 1).take(same), pa.array(range(base + a, base + a + len(part)), pa.int64()), pa.array(part, pa.string()), batch.column(3).slice(r, 1).take(same),
                            pa.ListArray.from_arrays(places, steps), *(c[r].values.slice(a, len(part)) for c in batch.columns[4:]),
                        ],
                        names=["g", "pos", "digest", "upper", "path", *batch.schema.names[4:]],
                    )

    return run


def _blocks(nodes: DataFrame, levels: int, carried: Sequence[str] = ()) -> DataFrame:
    """(g, block, digests, carried lists) of nodes (g, pos from 1, digest, carried)."""
    block = F.floor((F.col("pos") - 1) / WIDTH**levels).cast("long")
    members = F.sort_array(F.collect_list(F.struct("pos", "digest", *carried)))  # WIDTH ** levels at most
    out = nodes.groupBy("g", block.alias("block")).agg(members.alias("m"))
    return out.select("g", "block", F.col("m.digest").alias("digests"), *[F.col(f"m.{c}").alias(c) for c in carried])


def _spread(blocks: DataFrame, upper: DataFrame, levels: int, carried: Sequence[str] = ()) -> DataFrame:
    """A row a node, its path being whole in ``upper``. ``upper`` has the tier above: (g, pos, upper), one row for each block."""
    above = upper.select(F.col("g").alias("of"), (F.col("pos") - 1).alias("at"), "upper")
    rows = blocks.join(above, blocks["g"].eqNullSafe(above["of"]) & (F.col("block") == F.col("at")))
    rows = rows.select("g", "block", "digests", "upper", *carried)
    fields = [f"{c} {rows.schema[c].dataType.elementType.simpleString()}" for c in carried]
    kind = rows.schema["g"].dataType.simpleString()
    out = rows.transform(in_arrow, _paths(levels), ", ".join([f"g {kind}", "pos long", "digest string", f"upper {_UPPER}", f"path {PATH}", *fields]))
    return out.select("g", "pos", "digest", F.struct(F.concat("path", "upper.path").alias("path"), "upper.subroot", "upper.root").alias("upper"), *carried)


def _tiers(nodes: DataFrame, levels: int, carried: Sequence[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every tier, and the one node (g, digest) that each group ends in."""
    out = []
    while True:
        blocks = _blocks(nodes, levels, carried)
        out.append(stored(blocks, "merkle-blocks"))
        kind = blocks.schema["g"].dataType.simpleString()
        tops = stored(out[-1].select("g", "block", "digests").transform(in_arrow, _tops(levels), f"g {kind}, block long, digest string"), "merkle-tops")
        if tops.where("block > 0").isEmpty():
            return out, tops.select("g", "digest")
        nodes, carried = tops.select("g", (F.col("block") + 1).alias("pos"), "digest"), ()


def _walked(tiers: list[DataFrame], upper: DataFrame, levels: int, carried: Sequence[str] = ()) -> DataFrame:
    """Paths from the last tier down to the first."""
    for k in range(len(tiers) - 1, -1, -1):
        upper = _spread(tiers[k], upper, levels, carried if k == 0 else ())
        if k:
            upper = stored(upper, "merkle-paths")
    return upper


def manifest(rows: DataFrame, group: str, order: str, digest: str, carry: Sequence[str] = (), levels: int = LEVELS) -> DataFrame:
    """``carry``, ``leaf``, ``path``, ``subroot`` and ``root`` of every row: ``digest`` (hex) is its leaf, in its group's tree in
    ascending ``order``; groups ascend, null first."""
    inner = [f"c{i}" for i in range(len(carry))]
    nodes = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(digest).alias("digest"), *[F.col(c).alias(i) for c, i in zip(carry, inner, strict=True)])
    tiers, subroots = _tiers(numbered(nodes, ["g"], ["o", "digest"]), levels, inner)
    ranked = numbered(subroots, [], ["g"])
    upmost, tops = _tiers(ranked.select(F.lit(0).alias("g"), "pos", "digest", F.col("g").alias("c0")), levels, ["c0"])
    nothing = F.expr(f"named_struct('path', cast(array() as {PATH}), 'subroot', cast(null as string), 'root', cast(null as string))")
    heads = _walked(upmost, tops.select("g", F.lit(1).alias("pos"), nothing.alias("upper")), levels, ["c0"])
    shared = F.struct(F.col("upper.path").alias("path"), F.col("digest").alias("subroot"), folded(F.col("digest"), F.col("upper.path")).alias("root"))
    out = _walked(tiers, stored(heads.select(F.col("c0").alias("g"), F.lit(1).alias("pos"), shared.alias("upper")), "merkle-groups"), levels, inner)
    return out.select(*[F.col(i).alias(c) for c, i in zip(carry, inner, strict=True)], F.col("digest").alias("leaf"), "upper.path", "upper.subroot", "upper.root")
