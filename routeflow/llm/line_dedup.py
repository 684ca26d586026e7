"""Line dedup: range-partitioned line hashes, first occurrences found in one streaming pass.

A line's key is the line without ASCII white space at either end and with A-Z lowered. Keys of at least ``min_chars``
code points that occur in two or more documents lose all their lines except those in the smallest document id.

The hashes (128 bits) are written once, so that texts are read once for them, and range-partitioned by (hash, document,
position), so that one very common line spreads over as many partitions as it fills. Each partition streams its sorted
rows and knows the first document of every hash it starts itself; for the one hash that may have begun in an earlier
partition it emits an *edge*, and edges are settled by a small aggregation. Only the places of dropped lines (document,
hash of its text, position) leave that pass, and meet the texts as one compressed bitmap a document.

Defined cases: null text is one empty line; a null document id neither drops lines nor causes drops; rows that share
a document id count as one document, but each loses only lines that it has itself; an empty table gives an empty result;
other columns pass through untouched, whatever their names, but for ``n_lines`` and ``n_dropped``, which are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeflow.llm.storage import in_arrow, shuffle_partitions, slices, stored

#: Fixed value: the white space that a key loses at both ends.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_HITS = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64()), ("t", pa.int64()), ("pos", pa.int32())])
_DROP, _CANDIDATE, _SEEN = 0, 1, 2


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(h1, h2, id, t, pos) of every line whose key is long enough to count; ``t`` hashes the document's text."""
    lines = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line")
    )
    keys = lines.select("id", "t", "pos", F.translate(F.btrim("line", F.lit(BLANKS)), UPPER, LOWER).alias("key"))
    return keys.where(F.length("key") >= min_chars).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), "id", "t", "pos")


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (h1, h2, id, t, pos). Emits dropped rows, and edges for the partition's first and last hash."""
    start = current = None  # hash the partition began with; (hash, its first id here)
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, ids, texts, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        fresh = np.empty(len(h1), bool)
        fresh[0] = current is None or (h1[0], h2[0]) != current[0]
        fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(h1)), -1))
        first = np.where(run >= 0, ids[np.maximum(run, 0)], current[1] if current else 0)
        if start is None:
            start = (h1[0], h2[0])
        drop = ids != first
        candidate = ~drop & (h1 == start[0]) & (h2 == start[1])
        for kind, rows in ((_DROP, drop), (_CANDIDATE, candidate)):
            if rows.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(rows.sum()), kind, np.int32)), *(pa.array(x[rows]) for x in (h1, h2, ids, texts, pos.astype(np.int32)))], schema=_HITS)
        current = ((h1[-1], h2[-1]), first[-1])
    if current:
        yield pa.RecordBatch.from_pylist([{"kind": _SEEN, "h1": int(current[0][0]), "h2": int(current[0][1]), "id": int(current[1]), "t": 0, "pos": -1}], schema=_HITS)


def pack_keep_bitmap(dropped: np.ndarray) -> bytes:
    """Deflated bits, one a line, 1 = keep; lines past the last bit are kept."""
    bits = np.ones(int(dropped.max()) + 1, np.uint8)
    bits[dropped] = 0
    return zlib.compress(np.packbits(bits).tobytes() + int(len(bits) % 8).to_bytes(1, "little"), 6)


def dropped_lines(bitmap: bytes) -> np.ndarray:
    raw = zlib.decompress(bitmap)
    n = (len(raw) - 1) * 8 - (8 - raw[-1]) % 8
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw[:-1], np.uint8))[:n] == 0)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [np.asarray(x.values if hasattr(x, "values") else x) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in lists], pa.int64()), pa.array([pack_keep_bitmap(x) for x in lists], pa.binary())], names=["id", "t", "n_dropped", "keep_bitmap"])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(id, t, n_dropped, keep_bitmap) of every document and text that loses a line; see :func:`pack_keep_bitmap`."""
    n = shuffle_partitions(docs.sparkSession)
    keys = ("h1", "h2", "id", "t", "pos")
    hashes = stored(line_hashes(docs, id_col, text_col, min_chars), "line-hashes")
    rows = hashes.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    hits = stored(rows.transform(in_arrow, _first_occurrences, "kind int, h1 long, h2 long, id long, t long, pos int"), "line-hits")
    edges = hits.where(F.col("kind") != _DROP)
    firsts = edges.groupBy("h1", "h2").agg(F.min("id").alias("first"))
    late = edges.where(F.col("kind") == _CANDIDATE).join(firsts, ["h1", "h2"]).where(F.col("id") > F.col("first"))
    dropped = hits.where(F.col("kind") == _DROP).select("id", "t", "pos").unionAll(late.select("id", "t", "pos"))
    # a set: repeated rows name the same lines
    return dropped.groupBy("id", "t").agg(F.collect_set("pos").alias("pos")).transform(in_arrow, _pack, "id long, t long, n_dropped long, keep_bitmap binary")


def _apply(text_at: int, bitmap_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, total = [], []
            for text, bitmap in zip(batch.column(text_at).to_pylist(), batch.column(bitmap_at).to_pylist(), strict=True):
                text = text or ""
                if bitmap is None:
                    total.append(text.count("\n") + 1)
                else:
                    lines = text.split("\n")
                    total.append(len(lines))
                    for i in dropped_lines(bitmap):
                        lines[i] = None
                    text = "\n".join(x for x in lines if x is not None)
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if i == text_at else batch.column(i) for i in range(batch.num_columns) if i != bitmap_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64())], names=[str(i) for i in range(len(columns) + 1)])

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` reduced to the kept lines, plus ``n_lines`` and ``n_dropped``."""
    docs = docs.drop("n_lines", "n_dropped")
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names of our own can't clash
    own, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    marks = keep_bitmaps(rows, own, text, min_chars).toDF("m_id", "m_text", "m_dropped", "m_bitmap")
    joined = rows.join(marks, (F.col(own).cast("long") == F.col("m_id")) & (F.xxhash64(text) == F.col("m_text")), "left").drop("m_id", "m_text")
    fields = [f for f in joined.schema.fields if f.name != "m_bitmap"]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in fields] + ["lines long"])
    out = joined.transform(in_arrow, _apply(names.index(text_col), joined.columns.index("m_bitmap")), schema)
    return out.select(*rows.columns, "lines", F.coalesce("m_dropped", F.lit(0).cast("long"))).toDF(*names, "n_lines", "n_dropped")
