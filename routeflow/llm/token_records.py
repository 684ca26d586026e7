"""Token ids in length-delimited binary records, with a separate index of offsets.

A shard is two files. ``NAME.rec`` holds one record a document, in ascending id order::

    u64 length | u32 masked checksum of those 8 bytes | payload | u32 masked checksum of the payload
    payload = i64 document id | u8 1 if it is null | u8 bytes per token id | token ids, little endian

``NAME.idx`` holds (i64 document id, u8 1 if it is null, u64 offset of its record, u64 number of ids) for each record, so
that a shuffled reader seeks straight to any record. Checksums are CRC-32, rotated and shifted by a constant, so that a checksum of
data that itself holds checksums stays sound.

Documents are range-partitioned by id, then a hash of the text, then the row's place in the input, so that one id with very
many rows spreads over many shards and reruns give the same order up to equal rows. Every task writes one shard under a name of its own attempt; only attempts
that the manifest (a Parquet table committed by Spark) names count, so lost executors and retries leave no double rows.

Defined cases: null text is empty and gives the end id only; null document ids are written first; repeated rows give
repeated records; other columns are not read; an empty table gives no shards and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeflow.llm.coding import coder
from routeflow.llm.storage import fresh_path, in_arrow, open_fs, shuffle_partitions, slices, stored

#: Fixed value: the constant of masked checksums.
MASK_DELTA = 0xA282EAD8
_MANIFEST = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())])
INDEX = np.dtype([("id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("n", "<u8")])


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, width: int, ids: bytes) -> bytes:
    payload = struct.pack("<qBB", doc_id or 0, doc_id is None, width) + ids
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def read_record(f) -> tuple[int | None, np.ndarray] | None:
    """The next record's document id and token ids (u32), or None at the end of the file."""
    head = f.read(12)
    if not head:
        return None
    size, check = struct.unpack("<QI", head)
    if check != masked(head[:8]):
        raise ValueError("record length is damaged")
    payload = f.read(size)
    if len(payload) != size or struct.unpack("<I", f.read(4))[0] != masked(payload):
        raise ValueError("record is damaged")
    doc_id, null, width = struct.unpack_from("<qBB", payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=10).astype("<u4")


def _writer(folder: str, tokenizer: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        name, encode, end = f"{shard:06d}-{uuid.uuid4().hex}", coder(tokenizer, width).encode_all, end_id.to_bytes(width, "little")
        files, root = open_fs(folder)
        files.create_dir(root, recursive=True)
        at = total = docs = 0
        first = last = None
        out = index = None
        for part in slices(batches):
            places = np.empty(part.num_rows, INDEX)
            for i, (doc_id, ids) in enumerate(zip(part.column(0).to_pylist(), encode(part.column(1)), strict=True)):
                record = frame(doc_id, width, ids := ids + end)
                if out is None:
                    out, index, first = files.open_output_stream(f"{root}/{name}.rec"), files.open_output_stream(f"{root}/{name}.idx"), doc_id
                out.write(record)
                places[i] = doc_id or 0, doc_id is None, at, len(ids) // width
                at, total, docs, last = at + len(record), total + len(ids) // width, docs + 1, doc_id
            index.write(places.tobytes())
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{folder}/{name}", "n_docs": docs, "n_tokens": total, "first_id": first, "last_id": last}], schema=_MANIFEST)

    return run


def write_records(docs: DataFrame, tokenizer: str, end_id: int = 2, width: int = 2, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Write all texts as shards under ``folder``; returns the manifest, one row a shard, in ascending id order."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-records")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"), F.monotonically_increasing_id().alias("row"))
    order = (F.col("id").asc_nulls_first(), "t", "row")
    dealt = rows.repartitionByRange(shards or shuffle_partitions(spark), *order).sortWithinPartitions(*order).select("id", "text")
    return stored(dealt.transform(in_arrow, _writer(folder, tokenizer, end_id, width), "shard int, path string, n_docs long, n_tokens long, first_id long, last_id long"), "token-manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            files, name = open_fs(path)
            rows: list[tuple] = []
            with files.open_input_stream(f"{name}.rec", buffer_size=1 << 20) as f:
                while (record := read_record(f)) is not None:
                    doc_id, ids = record
                    rows.append((doc_id, base, len(ids), zlib.crc32(ids.tobytes())))
                    base += len(ids)
                    if len(rows) >= 500:
                        yield _rows(rows)
                        rows = []
            if rows:
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "start", "n_tokens", "ids_crc32"])


def read_records(manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every record, read from the shards and checked; ``start`` counts all ids before it.

    The manifest has one row a shard, so that its running sum is small however long the texts are.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("base"))
    n = shuffle_partitions(manifest.sparkSession)
    return shards.repartition(n, "path").transform(in_arrow, _reader, "id long, start long, n_tokens long, ids_crc32 long")


def read_at(path: str, position: int) -> tuple[int, np.ndarray]:
    """Random access: the record at a position of a shard's index."""
    files, name = open_fs(path)
    with files.open_input_file(f"{name}.idx") as f:
        f.seek(position * INDEX.itemsize)
        place = np.frombuffer(f.read(INDEX.itemsize), INDEX)[0]
    with files.open_input_file(f"{name}.rec") as f:
        f.seek(int(place["offset"]))
        return read_record(f)
