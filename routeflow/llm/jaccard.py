"""N-gram Jaccard join by chosen paths: near-duplicate documents on word shingles.

A document's set holds its runs of ``SHINGLE`` lower-case words (of all its words, if it has fewer). Equal sets form one
class, whose smallest id represents it, and the hash of one of whose texts names it within the join. A representative's set is embedded as ``COORDS`` MinHash values. Each of several
runs is a tree: a node's path picks ``CHILDREN`` coordinates, the same ones for all sets that reach it, and each set goes
on to the child that its value at the coordinate names. Nodes of at most ``LEAF`` sets are leaves; larger nodes split
again. A node that one child inherits nearly whole is *dense*: its sets are alike, more splitting cannot help, and it
becomes a leaf too, compared in pairs of sub-blocks of ``SUB`` sets so that no task holds it whole.

Within a leaf, all pairs are compared by the exact Jaccard similarity of the shingle sets, as matrix products; pairs
never leave the task. What leaves is one row a document and leaf: its links counted there, and the smallest document it
is linked with. A pair that meets in several leaves counts in the one of the smallest key. Leaves with the same members
are compared once. The number of runs follows from the target recall of pairs at the threshold.

Classes then join into groups by alternating large-star and small-star steps over the links' star edges.

Defined cases: null and empty texts have the empty set, equal to each other's only, with no links; repeated rows are
copies; rows that share an id but hold different sets are different documents; rows without an id are compared like any
other and told their class, which has no id only if no row of its group has one; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeflow.llm.storage import in_arrow, memos, shuffle_partitions, slices, stored

SHINGLE, THRESHOLD, COORDS, CHILDREN, LEAF, SUB, DEPTH, DENSE, TARGET = 5, 0.8, 32, 2, 256, 512, 8, 0.75, 0.999
MEMO = 100_000

_words: dict[str, int] = {}
memos.append(_words.clear)
_U = np.uint64
_MULTIPLIERS = (np.random.default_rng(20).integers(0, 1 << 63, COORDS, np.uint64) << _U(1)) | _U(1)


def recall(runs: int, threshold: float = THRESHOLD, children: int = CHILDREN, depth: int = DEPTH, coords: int = COORDS) -> float:
    """Probability that a pair at the threshold meets in a leaf, if nodes split to the full depth. All runs pick from the
    same coordinates, so it is averaged over how many of those agree; given that, runs pick their paths independently."""
    total = 0.0
    for agree in range(coords + 1):
        meets = 1.0
        for _ in range(depth):
            meets = 1 - (1 - agree / coords * meets) ** children
        total += math.comb(coords, agree) * threshold**agree * (1 - threshold) ** (coords - agree) * (1 - (1 - meets) ** runs)
    return total


def runs_for(target: float = TARGET, threshold: float = THRESHOLD, children: int = CHILDREN, depth: int = DEPTH) -> int:
    """The least number of runs that reaches the target recall."""
    if recall(1000, threshold, children, depth) < target:
        raise ValueError(f"{COORDS} coordinates can't give a recall of {target} at {threshold}")
    return next(n for n in itertools.count(1) if recall(n, threshold, children, depth) >= target)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the set."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > MEMO:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out * _U(0x9E3779B97F4A7C15)) ^ h[k : len(h) - n + 1 + k]
        out = _mix(out)
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    out = np.empty(COORDS, np.uint64)
    for a in range(0, COORDS, 8):
        out[a : a + 8] = (s[:, None] * _MULTIPLIERS[None, a : a + 8]).min(0)
    return (out >> _U(32)).astype("<u4")


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        first, second, sizes, signatures = [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text)
            digest = xxhash.xxh3_128_digest(s.tobytes())
            first.append(int.from_bytes(digest[:8], "little", signed=True))
            second.append(int.from_bytes(digest[8:], "little", signed=True))
            sizes.append(len(s))
            signatures.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(sizes, pa.int32()), pa.array(signatures, pa.binary())], names=["id", "t", "h1", "h2", "n", "sig"])


def _children(parents: np.ndarray, signatures: np.ndarray, children: int) -> np.ndarray:
    """Keys of each row's child nodes. A path picks distinct coordinates; the key hashes path, coordinate and value."""
    pick = _mix(parents ^ _U(0xD6E8FEB86659FD93))
    rows, keys = np.arange(len(parents)), []
    start, step = pick % _U(COORDS), (pick >> _U(20)) % _U(COORDS // 2) * _U(2) + _U(1)  # odd steps meet no coordinate twice
    for k in range(children):
        coordinate = (start + _U(k) * step) % _U(COORDS)
        value = signatures[rows, coordinate.astype(np.int64)].astype(np.uint64)
        keys.append(_mix((parents * _U(0x9E3779B97F4A7C15)) ^ _mix((coordinate << _U(32) | value) + _U((k + 1) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF))))
    return np.stack(keys)


def _roots(runs: int, children: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, COORDS)
            keys = np.concatenate([_children(np.full(len(sig), r + 1, np.uint64), sig, children) for r in range(runs)])
            ids = np.tile(batch.column(0).to_numpy(), len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.zeros(len(ids), np.int64)), pa.array(keys.ravel().astype(np.int64))], names=["id", "parent", "key"])

    return run


def _split(children: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").reshape(-1, COORDS)
            parents = batch.column(1).to_numpy()
            keys = _children(parents.astype(np.uint64), sig, children)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(batch.column(0).to_numpy(), children)), pa.array(np.tile(parents, children)), pa.array(keys.ravel().astype(np.int64))], names=["id", "parent", "key"])

    return run


def leaves(sets: DataFrame, runs: int, children: int = CHILDREN, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """(key, n, id): the members of all leaves of two or more sets; leaves with the same members once."""
    members = "id long, parent long, key long"
    level = stored(sets.select("id", "sig").transform(in_arrow, _roots(runs, children), members), "jaccard-level-1")
    found = []
    for at in range(1, depth + 1):
        # which members a node has, as two xors of hashes
        nodes = level.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("x2"))
        nodes = stored(nodes.where(F.col("n") > 1), f"jaccard-nodes-{at}")
        large = nodes.where(F.col("n") > leaf)
        found.append((level, nodes if at == depth else nodes.where(F.col("n") <= leaf)))
        if at == depth or large.isEmpty():
            break
        inner = level.join(large.select("key", "n"), "key").select("id", "key", "n").join(sets.select("id", "sig"), "id")
        below = stored(inner.select("id", "key", "sig").transform(in_arrow, _split(children), members), f"jaccard-level-{at + 1}")
        sizes = below.groupBy("parent", "key").agg(F.count("*").alias("c")).groupBy("parent").agg(F.max("c").alias("c"))
        dense = large.join(sizes, large["key"] == sizes["parent"]).where(F.col("c") >= DENSE * F.col("n")).select(large["*"])
        dense = stored(dense, f"jaccard-dense-{at}")
        found.append((level, dense))
        level = below.join(dense.select(F.col("key").alias("parent")), "parent", "left_anti").select("id", "parent", "key")
        level = stored(level, f"jaccard-open-{at + 1}")
    nodes = None
    for _, some in found:
        part = some.select("key", "n", "x1", "x2")
        nodes = part if nodes is None else nodes.unionAll(part)
    kept = stored(nodes.groupBy("n", "x1", "x2").agg(F.min("key").alias("key")).select("key", "n"), "jaccard-leaves")
    rows = None
    for level in {id(level): level for level, _ in found}.values():
        rows = level.select("id", "key") if rows is None else rows.unionAll(level.select("id", "key"))
    return rows.join(kept, "key").select("key", "n", "id").distinct()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document and place of comparison, with the set's 64-bit hashes."""
    names = ["key", "i", "j", "b", "id", "keys", "shingles"]
    for batch in slices(batches, 200, 1 << 20):
        rows = []
        for doc_id, text, keys, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own, packed = shingles(text).tobytes(), np.sort(np.array(keys, "<i8")).tobytes()
            rows += [(p["key"], p["i"], p["j"], p["b"], doc_id, packed, own) for p in places]
        if rows:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def shared_counts(of: np.ndarray, values: np.ndarray, n: int, span: int = 4096) -> np.ndarray:
    """n x n counts of values that rows share; ``of``: each value's row, no value twice in a row."""
    distinct, place, times = np.unique(values, return_inverse=True, return_counts=True)
    place = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[place]
    keep = place >= 0
    of, place, total = of[keep], place[keep], int((times > 1).sum())
    order = np.argsort(place, kind="stable")
    of, place = of[order], place[order]
    out = np.zeros((n, n), np.float32)
    for a in range(0, total, span):
        lo, hi = np.searchsorted(place, (a, a + span))
        x = np.zeros((n, min(span, total - a)), np.float32)
        x[of[lo:hi], place[lo:hi] - a] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _compare(rows: list[tuple], threshold: float) -> Iterator[tuple[int, int, int]]:
    """(id, links counted here, smallest id linked with) of the members of one leaf, or of two of its sub-blocks."""
    key, i, j = rows[0][:3]
    block = np.array([r[3] for r in rows])
    ids = np.array([r[4] for r in rows])
    sets = [np.frombuffer(r[6], "<u8") for r in rows]
    n, sizes = len(rows), np.array([len(s) for s in sets])
    shared = shared_counts(np.repeat(np.arange(n), sizes), np.concatenate(sets), n)
    alike = shared >= threshold * (sizes[:, None] + sizes[None] - shared) - 1e-9
    np.fill_diagonal(alike, False)
    if i != j:
        alike &= block[:, None] != block[None]
    if not alike.any():
        return
    before = [k[k < key] for k in (np.frombuffer(r[5], "<i8") for r in rows)]
    elsewhere = shared_counts(np.repeat(np.arange(n), [len(k) for k in before]), np.concatenate(before), n) > 0
    links = (alike & ~elsewhere).sum(1)
    least = ids.copy()
    while True:
        near = np.where(alike, least[None], least[:, None]).min(1)
        if (near == least).all():
            break
        least = near
    for k in np.flatnonzero(alike.any(1)):
        yield int(ids[k]), int(links[k]), int(least[k])


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["id", "links", "least"])

        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                for row in zip(*(c.to_pylist() for c in batch.slice(a, 500).columns), strict=True):
                    if held and held[0][:3] != row[:3]:
                        out += _compare(held, threshold)
                        held = []
                    held.append(row)
                if len(out) > 5000:
                    yield packed()
                    out.clear()
        if held:
            out += _compare(held, threshold)
        if out:
            yield packed()

    return run


def groups(edges: DataFrame) -> DataFrame | None:
    """(id, least) of all ids in ``edges`` (id, least): connected components, each named by its smallest id. None without edges."""
    edges = stored(edges.where(F.col("id") != F.col("least")).select(F.greatest("id", "least").alias("id"), F.least("id", "least").alias("least")).distinct(), "edges-0")

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("id", "least"))).first())

    before = state(edges)
    if not before[0]:
        return None
    for turn in itertools.count(1):  # until nothing changes
        both = edges.unionAll(edges.select(F.col("least").alias("id"), F.col("id").alias("least")))
        lows = both.groupBy("id").agg(F.min("least").alias("low")).select("id", F.least("id", "low").alias("low"))
        large = both.where(F.col("least") > F.col("id")).join(lows, "id").select(F.col("least").alias("id"), F.col("low").alias("least")).where(F.col("id") != F.col("least")).distinct()
        low = large.groupBy("id").agg(F.min("least").alias("low"))
        small = large.join(low, "id")
        small = small.select(F.col("least").alias("id"), F.col("low").alias("least")).unionAll(small.select("id", F.col("low").alias("least")))
        edges = stored(small.where(F.col("id") != F.col("least")).distinct(), f"edges-{turn}")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges


def _named(docs: DataFrame, id_col: str, text_col: str, threshold: float, target: float) -> tuple[DataFrame, DataFrame]:
    """(id, t, h1, h2) of every row, and (h1, h2, first, rep, n_links) of every set: ``t`` hashes the text; ``rep`` is the
    set's smallest id; ``first`` (no, id, t) is the row that stands for the group, ids before none."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    sketches = stored(rows.transform(in_arrow, _sketch, "id long, t long, h1 long, h2 long, n int, sig binary"), "jaccard-sketches")
    first = F.struct(F.col("id").isNull().alias("no"), "id", "t")
    reps = sketches.groupBy("h1", "h2").agg(F.min(first).alias("own"), F.min_by("sig", first).alias("sig"))
    reps = stored(reps, "jaccard-sets")
    sets = reps.where(F.col("sig").isNotNull()).select(F.col("own.t").alias("id"), "sig")
    member = stored(leaves(sets, runs_for(target, threshold)), "jaccard-members")
    blocks = F.ceil(F.col("n") / SUB).cast("int")
    b = F.pmod(F.xxhash64(F.lit("sub"), "id"), blocks).cast("int")
    places = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(F.col("key").alias("key"), F.least(x, b).alias("i"), F.greatest(x, b).alias("j"), b.alias("b")))
    needed = member.groupBy("id").agg(F.collect_list("key").alias("keys"), F.flatten(F.collect_list(places)).alias("places"))
    needed = needed.withColumnRenamed("id", "t").join(reps.select("own.t", F.col("own.id").alias("rep")), "t")
    with_id = rows.where(F.col("id").isNotNull()).join(needed.withColumnRenamed("rep", "id"), ["id", "t"])
    without = rows.where(F.col("id").isNull()).dropDuplicates(["t"]).join(needed.where(F.col("rep").isNull()).drop("rep"), "t")
    texts = with_id.select("t", "text", "keys", "places").unionAll(without.select("t", "text", "keys", "places")).dropDuplicates(["t"]).withColumnRenamed("t", "id")
    order = ("key", "i", "j", "id")
    dealt = texts.transform(in_arrow, _sets, "key long, i int, j int, b int, id long, keys binary, shingles binary").repartition(shuffle_partitions(spark), "key", "i", "j").sortWithinPartitions(*order)
    links = stored(dealt.transform(in_arrow, _verify(threshold), "id long, links long, least long"), "jaccard-links")
    counts = links.groupBy(F.col("id").alias("t")).agg(F.sum("links").alias("n_links"))
    named = groups(links.select("id", "least"))
    facts = reps.select("h1", "h2", "own", "own.t").join(counts, "t", "left")
    if named is None:
        facts = facts.withColumn("first", F.col("own"))
    else:
        # a group's smallest member has no edge of its own
        named = named.select(F.col("id").alias("t"), "least").unionAll(named.select(F.col("least").alias("t"), "least")).distinct()
        best = named.join(reps.select("own.t", "own"), "t").groupBy("least").agg(F.min("own").alias("best"))
        facts = facts.join(named.join(best, "least").select("t", "best"), "t", "left").withColumn("first", F.coalesce("best", "own"))
    return sketches.select("id", "t", "h1", "h2"), facts.select("h1", "h2", "first", F.col("own.id").alias("rep"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """(id, class_id, set_id, n_links) of every row. ``set_id``: smallest id with an equal set; ``class_id``: smallest id of
    the group that links connect; ``n_links``: how many different sets are similar to this one at the threshold."""
    rows, facts = _named(docs, id_col, text_col, threshold, target)
    facts = facts.select("h1", "h2", F.col("first.id").alias("class_id"), F.col("rep").alias("set_id"), "n_links")
    return rows.select("id", "h1", "h2").join(facts, ["h1", "h2"], "left").select("id", "class_id", "set_id", "n_links")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest id. A group without any id keeps one of its rows, and
    rows that share an id but belong to different groups all stay."""
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names of our own can't clash
    id_col, text_col = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    _, facts = _named(own, id_col, text_col, threshold, target)
    kept = facts.select(F.col("first.id").alias("k_id"), F.col("first.t").alias("k_t")).distinct()
    rows = own.withColumn("k_id", F.col(id_col).cast("long")).withColumn("k_t", F.xxhash64(text_col))
    with_id = rows.where(F.col("k_id").isNotNull()).join(kept, ["k_id", "k_t"]).dropDuplicates(["k_id", "k_t"])
    without = rows.where(F.col("k_id").isNull()).dropDuplicates(["k_t"]).join(kept.where(F.col("k_id").isNull()).drop("k_id"), "k_t")
    return with_id.select(*own.columns).unionAll(without.select(*own.columns)).toDF(*docs.columns)
