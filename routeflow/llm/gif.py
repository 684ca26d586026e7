"""Media columns: GIF images, decoded into timed frames with colour histograms.

The decoder reads any GIF87a or GIF89a: LZW code streams of variable width (with early or deferred clear codes), global
and local palettes, interlacing, transparency, and disposal of each frame (keep, background, previous). Each frame comes
with its delay and a histogram of the composed canvas, as columns.

``encode_samples`` stores bytes losslessly as 8-bit samples: a palette whose red is the sample, rows of ``WIDTH`` pixels, and as
many frames as the rows need.

Between clear codes the width of the k-th code is known beforehand, so that codes are packed and unpacked as whole
arrays. The decoder keeps no string table: an entry's text stands in the output, and array operations follow the links.

Defined cases: null media gives no frames; media that is no GIF, is damaged or cut short, or claims a canvas or frame of
more than ``pixels`` pixels gives the frames before the fault and a row with ``error`` and no frame; repeated rows are decoded
as often as they occur; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeflow.llm.storage import in_arrow, slices

WIDTH, ROWS, DELAY, BINS, PIXELS = 64, 2048, 4, 4, 1 << 26
_SINGLE = [bytes([i]) for i in range(256)]


def _widths(code_size: int, n: int) -> np.ndarray:
    """Width of each of the first n codes after a clear code: one entry joins the table with each code but the first."""
    table = np.minimum((1 << code_size) + 2 + np.maximum(np.arange(n) - 1, 0), 4095)
    return np.floor(np.log2(table)).astype(np.int64) + 1


_LAYOUT: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_SPAN = 4096


def _layout(code_size: int) -> tuple[np.ndarray, np.ndarray]:
    if code_size not in _LAYOUT:
        w = _widths(code_size, _SPAN)
        _LAYOUT[code_size] = (w, np.cumsum(w) - w)
    return _LAYOUT[code_size]


def lzw_encode(data: bytes) -> bytes:
    """8-bit samples as an LZW code stream: a clear code first and whenever the table is full, an end code last."""
    codes, table, cuts = [256 << 8], {}, [1]
    get, emit = table.get, codes.append
    entry, free = data[0] << 8, 258  # codes stand shifted, ready to take the next sample
    for c in data[1:]:
        known = get(entry | c)
        if known:
            entry = known
            continue
        emit(entry)
        if free < 4096:
            table[entry | c] = free << 8
            free += 1
        else:
            emit(256 << 8)
            cuts.append(len(codes))
            table.clear()
            free = 258
        entry = c << 8
    codes += [entry, 257 << 8]
    cuts.append(len(codes))
    layout = _layout(8)[0]
    flat = np.array(codes, np.int64) >> 8
    widths = np.concatenate([layout[:1], *(layout[: b - a] for a, b in zip(cuts, cuts[1:], strict=False))])
    ends = np.cumsum(widths)
    at = ends - widths
    flat <<= at & 7
    at >>= 3
    size = int(ends[-1] + 7 >> 3)
    packed = np.zeros(size + 2, np.uint8)
    for k in range(3):  # no two codes share a bit, so sums are the bytes
        packed[k : k + int(at[-1]) + 1] += np.bincount(at, flat >> 8 * k & 255).astype(np.uint8)
    return packed[:size].tobytes()


def _strings(codes: np.ndarray, place: np.ndarray, clear: int) -> np.ndarray:
    """Samples of codes between clear codes; ``place`` counts each code from its clear code.

    The table's entry number j is the text of code j and one sample more, which stand in the output itself. So every
    sample either is a literal or repeats an earlier one, and following those links, doubling, finds all literals.
    """
    literal = codes < clear
    entry = codes - (clear + 2)
    if ((entry >= place) & ~literal).any() or (codes == clear + 1).any():
        raise ValueError("LZW code out of range")
    index = np.arange(len(codes))
    parent = np.where(literal, index, index - place + entry)
    length, up = (~literal).astype(np.int64), parent
    while True:  # lengths: links from code to code up to a literal
        more = length[up]
        if not more.any():
            break
        length = length + more
        up = up[up]
    length += 1
    starts = np.cumsum(length) - length
    link = np.arange(int(length.sum())) - np.repeat(starts - starts[parent], length)
    values = np.zeros(len(link), np.uint8)
    values[starts[literal]] = codes[literal]
    while True:
        further = link[link]
        if (further == link).all():
            return values[link]
        link = further


def lzw_decode(stream: bytes, code_size: int, expected: int) -> bytes:
    """Samples of a code stream; ``expected`` ends streams without an end code."""
    clear, end = 1 << code_size, (1 << code_size) + 1
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.uint32)
    words = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16
    total, (widths, offsets) = len(stream) * 8, _layout(code_size)
    found: list[tuple[np.ndarray, int]] = []  # codes, and how many came since the last clear code
    bit = place = 0
    while True:
        if place >= _SPAN:  # the table stays full until a clear code comes
            at, width = bit + 12 * np.arange(_SPAN), np.full(_SPAN, 12)
        else:
            at, width = bit + offsets[place:] - offsets[place], widths[place:]
        fits = int(np.searchsorted(at + width, total, "right"))
        if not fits:
            break
        at, width = at[:fits], width[:fits]
        codes = ((words[at >> 3] >> (at & 7).astype(np.uint32)) & ((1 << width) - 1).astype(np.uint32)).astype(np.int64)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stops[0]) if len(stops) else fits
        found.append((codes[:n], place))
        if len(stops):
            if codes[n] == end:
                break
            bit, place = int(at[n] + width[n]), 0
        else:
            bit, place = int(at[-1] + width[-1]), place + n
    if not found:
        raise ValueError("LZW stream is short")
    data = _strings(np.concatenate([c for c, _ in found]), np.concatenate([np.arange(p, p + len(c)) for c, p in found]), clear)
    if len(data) < expected:
        raise ValueError("LZW stream is short")
    return data[:expected].tobytes()


def _sub_blocks(data: bytes) -> bytes:
    return b"".join([_SINGLE[min(255, len(data) - i)] + data[i : i + 255] for i in range(0, len(data), 255)]) + b"\0"


#: Red is the sample itself; green and blue spread neighbouring samples over the colour cube.
_PALETTE = bytes(v for i in range(256) for v in (i, 37 * i % 256, 101 * i % 256))


def encode_samples(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A GIF89a whose pixels, frame after frame and row after row, are the payload; its length must be a multiple of ``width``."""
    height = min(rows, len(payload) // width)
    parts = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), _PALETTE]
    for at in range(0, len(payload), width * rows):
        pixels = payload[at : at + width * rows]
        parts += [b"\x21\xf9\x04", struct.pack("<BHBB", 1 << 2, delay, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(pixels) // width, 0), b"\x08", _sub_blocks(lzw_encode(pixels))]
    return b"".join(parts) + b"\x3b"


class Frame(NamedTuple):
    left: int
    top: int
    samples: np.ndarray  # palette indices of the frame's own rectangle
    colours: np.ndarray  # the same through the palette: packed RGBA, red lowest
    delay: int  # hundredths of a second
    disposal: int
    transparent: int  # palette index, or -1
    canvas: np.ndarray  # packed RGBA after drawing this frame; 0 where nothing is drawn


def _palette(data: bytes, at: int, n: int) -> np.ndarray:
    rgb = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3).astype(np.uint32)
    return rgb[:, 0] | rgb[:, 1] << 8 | rgb[:, 2] << 16 | np.uint32(0xFF000000)


def decode(data: bytes, pixels: int = PIXELS) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    width, height, flags, back, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > pixels:
        raise ValueError("canvas too large")
    at, shared = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared, at = _palette(data, at, n), at + 3 * n
    canvas = np.zeros((height, width), np.uint32)
    delay, disposal, transparent = 0, 0, -1
    while True:
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            if data[at + 1] == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", data, at + 3)
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else -1
            at += 2
            while data[at]:
                at += data[at] + 1
            at += 1
            continue
        if kind != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
        if w * h > pixels:
            raise ValueError("frame too large")
        at, palette = at + 10, shared
        if packed & 0x80:
            n = 2 << (packed & 7)
            palette, at = _palette(data, at, n), at + 3 * n
        if palette is None:
            raise ValueError("no palette")
        code_size, at, stream = data[at], at + 1, []
        if not 1 < code_size < 9:
            raise ValueError("bad code size")
        while data[at]:
            stream.append(data[at + 1 : at + 1 + data[at]])
            at += data[at] + 1
        at += 1
        samples = np.frombuffer(lzw_decode(b"".join(stream), code_size, w * h), np.uint8).reshape(h, w)
        if packed & 0x40:  # interlaced: rows come in four passes
            order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            samples = samples[np.argsort(order)]
        if int(samples.max(initial=0)) >= len(palette):
            raise ValueError("sample outside the palette")
        colours = palette[samples]
        before = canvas.copy() if disposal == 3 else None
        part = canvas[top : top + h, left : left + w]
        seen = colours[: part.shape[0], : part.shape[1]]
        if transparent < 0:
            part[:] = seen
        else:
            np.copyto(part, seen, where=samples[: part.shape[0], : part.shape[1]] != transparent)
        yield Frame(left, top, samples, colours, delay, disposal, transparent, canvas)
        if disposal == 2:
            canvas[top : top + h, left : left + w] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, transparent = 0, 0, -1


def histogram(canvas: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Pixels by colour cube cell, ``bins`` a channel (a power of two); transparent pixels don't count."""
    shift = 9 - bins.bit_length()
    red, green, blue = (canvas >> (8 * k + shift) & (bins - 1) for k in range(3))
    cell = np.where(canvas != 0, (red * bins + green) * bins + blue, bins**3)
    return np.bincount(cell.ravel(), minlength=bins**3 + 1)[:-1]


_FRAMES = "{id} {kind}, frame int, left int, top int, width int, height int, delay_ms int, disposal int, transparent int, samples binary, histogram array<long>, canvas_sha256 string, error string"


def _frames(bins: int, pixels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["frame", "left", "top", "width", "height", "delay_ms", "disposal", "transparent"]
        for batch in batches:
            for i, media in enumerate(batch.column(1)):
                if (data := media.as_py()) is None:
                    continue
                rows = []
                try:
                    for k, f in enumerate(decode(data, pixels)):
                        h, w = f.samples.shape
                        rows.append(dict(zip(names, (k, f.left, f.top, w, h, 10 * f.delay, f.disposal, f.transparent), strict=True)) | {"samples": f.samples.tobytes(), "histogram": histogram(f.canvas, bins).tolist(), "canvas_sha256": hashlib.sha256(f.canvas.tobytes()).hexdigest(), "error": None})
                except (ValueError, IndexError, struct.error) as e:
                    rows.append(dict.fromkeys([*names, "samples", "histogram", "canvas_sha256"]) | {"error": str(e) or type(e).__name__})
                if rows:
                    kinds = [*[pa.int32()] * 8, pa.binary(), pa.list_(pa.int64()), pa.string(), pa.string()]
                    arrays = [pa.array([r[n] for r in rows], t) for n, t in zip([*names, "samples", "histogram", "canvas_sha256", "error"], kinds, strict=True)]
                    ids = batch.column(0).take(pa.array([i] * len(rows)))
                    yield pa.RecordBatch.from_arrays([ids, *arrays], names=["id", *names, "samples", "histogram", "canvas_sha256", "error"])

    return run


def gif_frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", bins: int = BINS, pixels: int = PIXELS) -> DataFrame:
    """One row a frame: place, size, delay, disposal, samples and the composed canvas's colour histogram. Images of any legal
    size are decoded where ``pixels`` allows them (65535 ** 2 for all; a task then holds 13 bytes for each pixel)."""
    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, media_col).transform(in_arrow, _frames(bins, pixels), _FRAMES.format(id=id_col, kind=kind))


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 256):
        texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
        if texts:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode_samples(padded(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])


def text_gifs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text's UTF-8 bytes, padded, stored as a GIF."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).transform(in_arrow, _store, "doc_id long, n_bytes long, media binary")


_DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_ms long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _DIGESTS.split(", ")][2:]
    for batch in slices(batches, 256):
        rows = []
        for media in batch.column(2).to_pylist():
            payload, counts, duration, n = [], 0, 0, 0
            for f in decode(media):
                payload.append(f.colours.astype(np.uint8).tobytes())  # red
                counts, duration, n = counts + histogram(f.canvas), duration + 10 * f.delay, n + 1
            data = b"".join(payload)
            used = np.flatnonzero(counts)
            feature = ",".join(f"{k}:{counts[k]}" for k in used)
            rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, n, duration))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True))], names=["doc_id", "n_bytes", *names])


def digests(stored_media: DataFrame) -> DataFrame:
    """Digest columns of stored texts, all from the media's bytes: the payload read back, and its frames' histograms summed."""
    return stored_media.transform(in_arrow, _digests, _DIGESTS)
