"""GIF columns: write payloads as GIF, decode any GIF to timed frames and colour histograms.

``decode`` reads the LZW code streams, applies global or local palettes, interlacing,
transparency and disposal, and gives for every frame its delay, its raw palette
indices and the composed canvas. ``store`` packs arbitrary bytes losslessly: one byte
is one pixel index of a 192-wide image, up to ``ROWS`` rows a frame.

Defined cases: null and empty payloads become one unit of spaces (``pad``); null GIF
bytes give null results; a damaged or oversized file raises ValueError in ``decode`` and
gives null results with the reason in ``error`` in ``gif_columns``, so no file fails a job.
Frames are handed on one at a time: memory holds one canvas, however many there are.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dendra.llm.common import lean, small_batches

UNIT = 192
ROWS = 128
DELAY = 4  # hundredths of a second
#: Larger canvases and images are refused: a header of some bytes may claim four billion pixels.
MOST_PIXELS = 1 << 26


def palette() -> np.ndarray:
    """256 distinct colours by rule: index i has 3 bits of red, 3 of green, 2 of blue, spread over 0..255."""
    i = np.arange(256)
    return np.stack([(i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 85], 1).astype(np.uint8)


def code_widths(least: int, n: int) -> np.ndarray:
    """Bits of the first n codes after a clear code: the reader's table has one entry fewer than codes read."""
    size = (1 << least) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.minimum(np.maximum(np.floor(np.log2(size)).astype(np.int64) + 1, least + 1), 12)


_WIDTHS: dict[int, np.ndarray] = {}


def _widths(least: int, n: int) -> np.ndarray:
    have = _WIDTHS.get(least)
    if have is None or len(have) < n:
        have = _WIDTHS[least] = code_widths(least, max(n, 4200))
    return have[:n]


def lzw_encode(data: bytes, least: int = 8) -> bytes:
    """Greedy LZW with a clear code whenever the table is full."""
    clear, end = 1 << least, (1 << least) + 1
    if not data:
        codes, starts = [clear, end], [0]
    else:
        codes, starts = [clear], [0]  # starts: where each table's code count begins anew
        put = codes.append
        table: dict[int, int] = {}
        get, following = table.get, end + 1
        it = iter(data)
        cur = next(it)
        for b in it:
            key = cur << 8 | b
            c = get(key)
            if c is not None:
                cur = c
                continue
            put(cur)
            cur = b
            if following < 4096:
                table[key] = following
                following += 1
            else:
                put(clear)
                starts.append(len(codes))
                table.clear()
                following = end + 1
        put(cur)
        put(end)
    values = np.array(codes, dtype=np.uint16)
    width = np.empty(len(values), dtype=np.int64)
    width[0] = least + 1
    edges = [1, *starts[1:], len(values)]
    for a, b in zip(edges, edges[1:], strict=False):
        width[a:b] = _widths(least, b - a)
    ends = np.cumsum(width)
    starts = ends - width
    shifted = values.astype(np.int64) << (starts & 7)  # spans three bytes at most
    first, n = starts >> 3, int(ends[-1] + 7) // 8
    out = np.zeros(n + 2, np.int64)
    for k in range(3):  # codes share bytes but no bits, so sums are unions
        out += np.bincount(first + k, shifted >> 8 * k & 255, minlength=n + 2).astype(np.int64)
    return out[:n].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, least: int = 8) -> bytes:
    """Bytes of a code stream; table full: no further entries until the next clear code."""
    clear, end = 1 << least, (1 << least) + 1
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int32)
    words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16  # the 24 bits from each byte on
    total, at, out = 8 * len(stream), 0, []
    block = min(4096, total // (least + 1) + 1)
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, prev, seen = list(base), None, 0
    while True:
        width = _widths(least, seen + block)[seen:]
        ends = at + np.cumsum(width)
        fit = int(np.searchsorted(ends, total, side="right"))
        if fit == 0:
            raise ValueError("LZW stream without an end code")
        width, starts = width[:fit], ends[:fit] - width[:fit]
        codes = words[starts >> 3] >> (starts & 7) & (1 << width) - 1
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else fit
        put, add, room = out.append, table.append, 4096 - len(table)
        todo = codes[:stop].tolist()
        if prev is None and todo:
            if todo[0] >= clear:
                raise ValueError("LZW stream begins with an unknown code")
            prev = base[todo[0]]
            put(prev)
            del todo[0]
        for c in todo[:room]:  # each adds an entry
            try:
                e = table[c]
            except IndexError:
                if c != len(table):
                    raise ValueError("LZW code outside the table") from None
                e = prev + prev[:1]
            add(prev + e[:1])
            put(e)
            prev = e
        for c in todo[room:]:  # the table is full
            prev = table[c]
            put(prev)
        if stop < fit:
            at = int(ends[stop])
            if codes[stop] == end:
                return b"".join(out)
            table, prev, seen = list(base), None, 0
        else:
            at, seen = int(ends[fit - 1]), seen + fit


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(c)]) + c for c in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def pad(text: str | bytes | None) -> bytes:
    raw = text.encode("utf-8") if isinstance(text, str) else text or b""
    return raw + b" " * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def store(payload: bytes) -> bytes:
    """A GIF89a whose frames, read as palette indices one after another, are the payload (a multiple of UNIT bytes)."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"a payload is a positive multiple of {UNIT} bytes")
    rows = len(payload) // UNIT
    out = [b"GIF89a", struct.pack("<HHBBB", UNIT, min(rows, ROWS), 0xF7, 0, 0), palette().tobytes(), b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for i in range(0, len(payload), UNIT * ROWS):
        part = payload[i : i + UNIT * ROWS]
        out += [b"\x21\xf9\x04\x04" + struct.pack("<H", DELAY) + b"\0\0", b"\x2c" + struct.pack("<HHHHB", 0, 0, UNIT, len(part) // UNIT, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join([*out, b";"])


@dataclass
class Frame:
    delay: int
    left: int
    top: int
    indices: np.ndarray  # rows x columns, as stored (interlacing undone)
    canvas: np.ndarray  # height x width x 4, composed, alpha 0 where nothing was painted


class Reader:
    """Bytes of a file from front to back; ValueError beyond its end."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        part = self.data[self.at : self.at + n]
        if len(part) < n:
            raise ValueError("GIF ends early")
        self.at += n
        return part

    def chain(self) -> bytes:
        """Sub-blocks up to the empty one."""
        parts = []
        while n := self.take(1)[0]:
            parts.append(self.take(n))
        return b"".join(parts)

    def colours(self, flags: int) -> np.ndarray | None:
        return np.frombuffer(self.take(3 * (2 << (flags & 7))), np.uint8).reshape(-1, 3) if flags & 0x80 else None


def decode(data: bytes, compose: bool = True) -> list[Frame]:
    """All frames; compose=False leaves the canvases out."""
    return list(frames(data, compose))


def frames(data: bytes, compose: bool = True) -> Iterator[Frame]:
    """The frames one after another. ValueError for whatever isn't a whole GIF."""
    file = Reader(data)
    if file.take(6) not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _background, _ = struct.unpack("<HHBBB", file.take(7))
    if width * height > MOST_PIXELS:
        raise ValueError(f"more than {MOST_PIXELS} pixels")
    common = file.colours(flags)
    canvas = np.zeros((height, width, 4), np.uint8) if compose else None
    delay, disposal, clear_index = 0, 0, -1
    while (kind := file.take(1)[0]) != 0x3B:
        if kind == 0x21:
            label, body = file.take(1)[0], file.chain()
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, body[1] | body[2] << 8
                clear_index = body[3] if body[0] & 1 else -1
            continue
        if kind != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, flags = struct.unpack("<HHHHB", file.take(9))
        own = file.colours(flags)
        colours = common if own is None else own
        least = file.take(1)[0]
        if not 1 <= least <= 8 or w * h > MOST_PIXELS:
            raise ValueError("unknown code size or too many pixels")
        pixels = np.frombuffer(lzw_decode(file.chain(), least), np.uint8)
        if len(pixels) < w * h:
            raise ValueError("too few pixels")
        pixels = pixels[: w * h].reshape(h, w)
        if flags & 0x40:
            order = [r for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(start, h, step)]
            straight = np.empty_like(pixels)
            straight[order] = pixels
            pixels = straight
        shown = None
        if compose:
            if colours is None:
                raise ValueError("no palette")
            before = canvas.copy() if disposal == 3 else None
            area = canvas[top : top + h, left : left + w]
            part = pixels[: area.shape[0], : area.shape[1]]
            rgba = np.full((*part.shape, 4), 255, np.uint8)
            rgba[..., :3] = colours[np.minimum(part, len(colours) - 1)]
            seen = part != clear_index
            area[seen] = rgba[seen]
            shown = canvas.copy()
            if disposal == 2:
                area[...] = 0
            elif disposal == 3:
                canvas = before
        yield Frame(delay, left, top, pixels, shown)
        delay, disposal, clear_index = 0, 0, -1


def histogram(frame: Frame) -> np.ndarray:
    """Painted pixels of a composed frame by 4 levels of red, green and blue: 64 counts."""
    seen = frame.canvas[frame.canvas[..., 3] > 0] >> 6
    return np.bincount(seen[:, 0].astype(np.int64) * 16 + seen[:, 1] * 4 + seen[:, 2], minlength=64)


def gif_columns(df: DataFrame, id_col: str, gif_col: str) -> DataFrame:
    """One row per GIF: width, height, frames (array of delay, left, top, rows, columns, pixel indices), colour_histogram over all frames, and error (null for a whole GIF)."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    frame = pa.struct([("delay", pa.int32()), ("left", pa.int32()), ("top", pa.int32()), ("rows", pa.int32()), ("columns", pa.int32()), ("pixels", pa.binary())])

    def read(data: bytes | None) -> tuple:
        if data is None:
            return None, None, None, None, None
        found, total = [], np.zeros(64, np.int64)
        try:
            for f in frames(data):
                found.append(dict(delay=f.delay, left=f.left, top=f.top, rows=f.indices.shape[0], columns=f.indices.shape[1], pixels=f.indices.tobytes()))
                total += histogram(f)
        except ValueError as e:
            return None, None, None, None, str(e)
        return *struct.unpack("<HH", data[6:10]), found, total.tolist(), None

    kinds = [pa.int32(), pa.int32(), pa.list_(frame), pa.list_(pa.int64()), pa.string()]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = zip(*map(read, batch.column(1).to_pylist()), strict=True) if batch.num_rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], [id_col, "width", "height", "frames", "colour_histogram", "error"])

    return df.select(id_col, gif_col).mapInArrow(run, f"`{id_col}` {kind}, width int, height int, frames array<struct<delay:int,left:int,top:int,rows:int,columns:int,pixels:binary>>, colour_histogram array<bigint>, error string")


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Store each text as a GIF, read it back, and describe both.

    Columns: id, n_bytes, payload_bytes, payload_sha256 and tail_crc32 (of the bytes read back), media_bytes,
    media_sha256, feature (frames, total delay and the 64 histogram counts as text), and the GIF itself as ``media`` if asked for.
    """
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode("utf-8")
                media = store(pad(raw))
                digest, counts, n, size, time, tail = hashlib.sha256(), np.zeros(64, np.int64), 0, 0, 0, b""
                for f in frames(media):
                    part = f.indices.tobytes()
                    digest.update(part)
                    counts += histogram(f)
                    n, size, time, tail = n + 1, size + len(part), time + f.delay, (tail + part)[-16:]
                feature = f"frames={n};time={time};rgb64=" + ",".join(map(str, counts.tolist()))
                rows.append((len(raw), size, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature, media if keep_media else None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
            take = 8 if keep_media else 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols[:take], kinds, strict=False)]], [id_col, *names[:take]])

    return df.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string" + (", media binary" if keep_media else "")
    )
