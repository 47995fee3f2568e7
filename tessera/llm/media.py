"""Media columns: animated GIFs.

The decoder follows the format: LZW code streams with changing widths and clear
codes, global and local palettes, interlacing, transparency, and the four ways of
disposing a frame; it gives timed frames with colour histograms. The encoder
stores any bytes losslessly as 8-bit samples of such an animation.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import pick, stored, table

WIDTH = 576
#: Rows of samples in a frame that the encoder writes, and its time on screen in hundredths of a second.
ROWS, DELAY = 64, 4
FRAMES = "id long, frame int, start_ms long, delay_ms int, x int, y int, width int, height int, pixels binary, histogram array<int>, error string"
TIMED = "array<struct<start_ms:long,delay_ms:int,x:int,y:int,width:int,height:int,histogram:array<int>>>"
SUMMARY = f"id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, frames int, timed {TIMED}, error string, media_bytes long, media_sha256 string"
#: Pixels of the largest canvas that is decoded.
MOST_PIXELS = 1 << 26
#: What the decoder raises on a stream that is not a whole GIF.
BROKEN = (ValueError, IndexError, KeyError, struct.error)


def _widths(first: int, n: int) -> np.ndarray:
    """The bits of each of the n codes after a clear code; first is the smallest code free at the start."""
    free = first + np.maximum(np.arange(n) - 1, 0)
    return np.clip(np.ceil(np.log2(free + 1)).astype(np.int64), (first - 1).bit_length(), 12)


_WIDTH = {k: _widths((1 << k) + 2, 5000) for k in range(2, 9)}
_OFFSET = {k: np.concatenate([[0], np.cumsum(w)]) for k, w in _WIDTH.items()}


def lzw_encoded(data: bytes) -> bytes:
    """The LZW code stream of 8-bit samples, from a first clear code to the end code."""
    codes, cuts = [256], [1]
    if data:
        known: dict[int, int] = {}
        get, put, free, prefix = known.get, codes.append, 258, data[0]
        for b in data[1:]:
            key = prefix << 8 | b
            code = get(key)
            if code is not None:
                prefix = code
                continue
            put(prefix)
            prefix = b
            if free < 4095:
                known[key] = free
                free += 1
            else:
                put(256)
                known.clear()
                free = 258
                cuts.append(len(codes))
        put(prefix)
    put_end = [*codes, 257]
    cuts.append(len(put_end))
    widths = np.concatenate([[9], *[_WIDTH[8][: b - a] for a, b in zip(cuts, cuts[1:], strict=False)]])
    bits = (np.asarray(put_end, dtype=np.uint16)[:, None] >> np.arange(12, dtype=np.uint16)) & 1
    return np.packbits(bits[np.arange(12) < widths[:, None]].astype(np.uint8), bitorder="little").tobytes()


def lzw_decoded(data: bytes, least: int, size: int) -> bytes:
    """At most `size` samples of the code stream `data` whose least code size is `least`."""
    clear, end, single = 1 << least, (1 << least) + 1, [bytes([i]) for i in range(1 << least)] + [b"", b""]
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
    total, at, out, got = 8 * len(data), 0, [], 0
    widths, offsets = _WIDTH[least], _OFFSET[least]
    known, last, nth = single[:], None, 0
    while got < size:
        # the codes up to the next clear code have known widths, so they are cut out together
        if nth + 1 < len(widths):
            w, begin = widths[nth:], at + offsets[nth:-1] - offsets[nth]
        else:
            w, begin = np.full(4096, 12), at + 12 * np.arange(4096)
        n = int(np.searchsorted(begin + w, total, "right"))
        if not n:
            break
        w, begin = w[:n], begin[:n]
        byte = begin >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (begin & 7).astype(np.uint32) & ((1 << w) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        k = int(stop[0]) if len(stop) else n
        put, grow, free = out.append, known.append, len(known)
        for code in codes[:k].tolist():
            if code < free:
                entry = known[code]
            elif last is not None and code == free:
                entry = last + last[:1]
            else:
                raise ValueError("the code is not in the table")
            put(entry)
            got += len(entry)
            if last is not None and free < 4096:
                grow(last + entry[:1])
                free += 1
            last = entry
        nth += k
        if not len(stop):
            at = int(begin[-1] + w[-1])
            continue
        at = int(begin[k] + w[k])
        if codes[k] == end:
            break
        known, last, nth = single[:], None, 0
    return b"".join(out)[:size]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(p)]) + p for p in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def gif_of(payload: bytes, n_bytes: int) -> bytes:
    """payload (a positive multiple of WIDTH) as frames of grey samples; n_bytes goes into a comment."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), bytes(v for i in range(256) for v in (i, i, i)), b"\x21\xfe" + _blocks(b"bytes %d" % n_bytes)]
    for top in range(0, rows, ROWS):
        part = payload[top * WIDTH : (top + ROWS) * WIDTH]
        out += [b"\x21\xf9\x04", struct.pack("<BHBB", 1 << 2, DELAY, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08", _blocks(lzw_encoded(part))]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    start_ms: int
    delay_ms: int
    box: tuple[int, int, int, int]  # x, y, width, height
    canvas: np.ndarray  # (height, width) of 0xAARRGGBB as shown


def _sub(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    rgb = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3).astype(np.uint32)
    full = np.full(256, 0xFF000000, dtype=np.uint32)
    full[:n] |= rgb[:, 0] << 16 | rgb[:, 1] << 8 | rgb[:, 2]
    return full, at + 3 * n


def gif_frames(data: bytes, comments: list[bytes] | None = None) -> Iterator[Frame]:
    """The frames as shown. A frame's disposal takes effect before the next one is drawn."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > MOST_PIXELS:
        raise ValueError("the canvas is too large")
    shared, at = _palette(data, 13, flags)
    canvas = np.zeros((height, width), dtype=np.uint32)
    dispose, delay, clear_index, clock = 0, 0, None, 0
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = _sub(data, at + 2)
            if label == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", body)
                dispose, clear_index = packed >> 2 & 7, index if packed & 1 else None
            elif label == 0xFE and comments is not None:
                comments.append(body)
            continue
        if data[at] != 0x2C:
            raise ValueError("an unknown block")
        x, y, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        own, at = _palette(data, at + 10, flags)
        least = data[at]
        stream, at = _sub(data, at + 1)
        samples = np.frombuffer(lzw_decoded(stream, least, w * h), dtype=np.uint8)
        if len(samples) < w * h:
            raise ValueError("the frame is cut off")
        samples = samples.reshape(h, w)
        if flags & 0x40:  # interlaced: every eighth row, those between, and so on
            order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, h, step)]
            rows = np.empty_like(samples)
            rows[order] = samples
            samples = rows
        before = canvas.copy() if dispose == 3 else None
        colours = (own if own is not None else shared if shared is not None else np.zeros(256, np.uint32))[samples]
        view = canvas[y : y + h, x : x + w]
        colours = colours[: view.shape[0], : view.shape[1]]
        if clear_index is None:
            view[:] = colours
        else:
            np.copyto(view, colours, where=samples[: view.shape[0], : view.shape[1]] != clear_index)
        yield Frame(clock, delay * 10, (x, y, w, h), canvas.copy() if dispose > 1 else canvas)
        clock += delay * 10
        if dispose == 2:
            view[:] = 0
        elif dispose == 3:
            canvas = before
        dispose, delay, clear_index = 0, 0, None


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels of each of 64 colours: two bits of red, green and blue."""
    bins = canvas >> 18 & 0x30 | canvas >> 12 & 0x0C | canvas >> 6 & 0x03
    return np.bincount(bins.ravel(), minlength=64)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, media, held = [], [], 0
        for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            raw = (text.as_py() or "").encode()
            ids.append(i)
            media.append(gif_of(raw + b"\xff" * (-len(raw) % WIDTH if raw else WIDTH), len(raw)))
            held += len(media[-1])
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], names=["id", "media"])
                ids, media, held = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], names=["id", "media"])


def _summary(media: bytes) -> tuple:
    """n_bytes, the payload's length, hash and tail checksum, a feature, the number of frames, and these with their times and histograms; read from the media."""
    comments: list[bytes] = []
    sha, size, tail, total, ms, timed = hashlib.sha256(), 0, b"", np.zeros(64, np.int64), 0, []
    for f in gif_frames(media, comments):
        x, y, w, h = f.box
        shown = f.canvas[y : y + h, x : x + w]
        samples = (shown & 0xFF).astype(np.uint8).tobytes()
        sha.update(samples)
        size, tail, ms = size + len(samples), (tail + samples[-32:])[-32:], f.start_ms + f.delay_ms
        own = histogram(shown)
        total += own
        timed.append((f.start_ms, f.delay_ms, x, y, w, h, own.tolist()))
    n_bytes = int(comments[0].removeprefix(b"bytes ")) if comments and comments[0].startswith(b"bytes ") else None
    feature = f"{len(timed)} frames {ms} ms " + " ".join(f"{i}:{v}" for i, v in enumerate(total.tolist()) if v)
    return n_bytes, size, sha.hexdigest(), zlib.crc32(tail), feature, len(timed), timed


_HISTOGRAM = pa.list_(pa.int32())
_TIMED = pa.list_(pa.struct([("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", _HISTOGRAM)]))
_TIMED_NAMES = [f.name for f in _TIMED.value_type]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), _TIMED, pa.string(), pa.int64(), pa.string())
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "feature", "frames", "timed", "error", "media_bytes", "media_sha256"]
    for b in batches:
        rows = []
        for i, m in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            data, error = m.as_py(), None
            if data is None:
                rows.append((i, *[None] * 10))
                continue
            try:
                got = _summary(data)
                got = (*got[:-1], [dict(zip(_TIMED_NAMES, t, strict=True)) for t in got[-1]])
            except BROKEN as e:
                got, error = (None,) * 7, f"{type(e).__name__}: {e}"
            rows.append((i, *got, error, len(data), hashlib.sha256(data).hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), _HISTOGRAM, pa.string())
    names = [x.split()[0] for x in FRAMES.split(", ")]
    batch = lambda row: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)
    for b in batches:
        for i, media in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if not media.is_valid:
                continue
            try:  # a stream that breaks off later has no frames at all, so it is read through before
                for _ in gif_frames(media.as_py()):
                    pass
            except BROKEN as e:
                yield batch((i, *[None] * 9, f"{type(e).__name__}: {e}"))
                continue
            for k, f in enumerate(gif_frames(media.as_py())):
                h, w = f.canvas.shape
                yield batch((i, k, f.start_ms, f.delay_ms, *f.box[:2], w, h, f.canvas.astype("<u4").tobytes(), histogram(f.canvas).tolist(), None))


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each whole text's UTF-8 bytes, padded with 255 to a positive multiple of WIDTH, as a GIF.

    Null text: as empty, one row of padding. Repeated rows: each its own media.
    Long texts take more frames; an empty table gives none. Other columns are not read.
    """
    return pick(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_encode, "id long, media binary")


def frames(media: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """A row for each timed frame of GIFs of any origin: the canvas shown (0xAARRGGBB) and its histogram.

    Null media has no frames. Media that is not a whole GIF, or whose canvas has more than MOST_PIXELS, gives one row that
    has an error and no frame. Repeated rows each give their frames; an empty table gives none; other columns are not read.
    """
    return pick(media, id_col, media_col).mapInArrow(_frames, FRAMES)


def summaries(media: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """A row for each of media, read back from the media alone: what encoded() stored, and the frames with their times, places and
    histograms (`timed`). Null media gives nulls, broken media an error; other GIFs have no n_bytes."""
    return pick(media, id_col, media_col).mapInArrow(_summaries, SUMMARY)


def op1_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as GIFs, stored; then their timed frames with histograms, stored as well; and from these the digests."""
    media = stored(encoded(table(spark, sf_dir, "documents")))
    timed = stored(summaries(media))
    return timed.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames")
