"""Media columns: GIF.

``decode`` reads GIF87a and GIF89a: logical screen, global and local palettes, interlace, graphic
control (delay, transparency, disposal), loop extension, and LZW code streams with deferred clear
codes; it composes full RGB frames.  ``encode`` writes palette samples as frames of LZW data.

``text_media`` stores every text as an animation of 64 grey samples a row and frames of at most
FRAME_ROWS rows, reads the stored bytes back and derives columns from what was read.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64
FRAME_ROWS = 256
BINS = 16
DELAY = 4
_MAX_CODES = 4096


class Frame(NamedTuple):
    left: int
    top: int
    indices: np.ndarray  # height x width, uint8
    palette: np.ndarray  # colours x 3
    transparent: int | None
    disposal: int
    delay: int  # hundredths of a second


class Gif(NamedTuple):
    width: int
    height: int
    background: int
    palette: np.ndarray | None
    frames: list[Frame]
    loops: int | None


class GifError(ValueError):
    pass


@functools.lru_cache(maxsize=None)
def _widths(least: int) -> np.ndarray:
    """Bits of the codes after a clear code, up to where the table is full; all later ones have 12.

    Every code but the first adds an entry, so a code's width follows from its place alone.
    """
    full = [(1 << least) + 2 + i for i in range(_MAX_CODES - (1 << least) - 1)]
    return np.array([least + 1] + [min(12, n.bit_length()) for n in full], np.int64)


_BYTES = [bytes([i]) for i in range(256)]


def lzw_codes(data: bytes, least: int) -> tuple[list[int], np.ndarray]:
    """Codes and their widths, with the clear code first and the end code last."""
    clear, end = 1 << least, (1 << least) + 1
    codes = [clear]
    table: dict[int, int] = {}
    get, put = table.get, codes.append
    fresh = end + 1
    it = iter(data)
    prefix = next(it, None)
    if prefix is not None:
        for b in it:
            key = (prefix << 8) | b
            code = get(key)
            if code is not None:
                prefix = code
                continue
            put(prefix)
            prefix = b
            if fresh < _MAX_CODES:
                table[key] = fresh
                fresh += 1
            else:
                put(clear)
                table.clear()
                fresh = end + 1
        put(prefix)
    put(end)
    # each stretch that ends with a clear code fills the table and has the same number of codes
    widths = _widths(least)
    return codes, np.concatenate([widths[:1], np.resize(widths, len(codes) - 1)])


def pack_codes(codes: list[int], widths: np.ndarray) -> bytes:
    """Least significant bit first."""
    bits = np.unpackbits(np.array(codes, "<u2").view(np.uint8), bitorder="little").reshape(-1, 16)
    return np.packbits(bits[np.arange(16) < np.asarray(widths)[:, None]], bitorder="little").tobytes()


def lzw_decode(data: bytes, least: int, expected: int) -> bytes:
    """Samples of one code stream; GifError if it is broken or ends early."""
    if not 1 <= least <= 8:
        raise GifError("code size")
    clear, end = 1 << least, (1 << least) + 1
    roots = _BYTES[:clear] + [b"", b""]
    widths, room = _widths(least), _MAX_CODES - len(roots)
    raw = np.frombuffer(data + b"\0\0", np.uint8).astype(np.int64)
    held = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16  # the 24 bits from each byte on
    table, before = list(roots), b""
    out: list[bytes] = []
    put = out.append
    at, total, seen = 0, 8 * len(data), 0  # bits read, bits there, codes since the table was cleared
    while True:
        # all codes that may follow, read at once by their widths, up to the first clear or end code
        w = widths if not seen else np.full(_MAX_CODES, 12)
        ends = at + np.cumsum(w)
        n = int(np.searchsorted(ends, total, "right"))
        if not n:
            break
        starts = ends[:n] - w[:n]
        codes = held[starts >> 3] >> (starts & 7) & ((1 << w[:n]) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        read = codes[: stop[0]].tolist() if len(stop) else codes.tolist()
        grow = max(0, room + 1 - seen)  # that many codes, the first with them, find the table not full
        if read and not seen:
            if read[0] >= clear:
                raise GifError("code beyond the table")
            before = table[read[0]]
            put(before)
        add = table.append
        for code in read[not seen : grow]:
            try:
                entry = table[code]
            except IndexError:
                if code != len(table):
                    raise GifError("code beyond the table") from None
                entry = before + before[:1]
            add(before + entry[:1])
            put(entry)
            before = entry
        out += [table[code] for code in read[max(grow, not seen) :]]
        seen += len(read)
        if not len(stop):
            at = int(ends[n - 1])
            continue
        at = int(ends[stop[0]])
        if codes[stop[0]] == end:
            got = b"".join(out)
            if len(got) < expected:
                raise GifError("too few samples")
            return got[:expected]
        table, before, seen = list(roots), b"", 0
    got = b"".join(out)
    if len(got) < expected:
        raise GifError("no end code")
    return got[:expected]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(p)]) + p for p in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def encode(frames: list[Frame], width: int, height: int, palette: np.ndarray, background: int = 0, loops: int | None = None) -> bytes:
    """A GIF89a file; palettes have 2, 4, ... or 256 colours.  A frame with the global palette has no own one."""
    bits = max(1, (len(palette) - 1).bit_length())
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x80 | (7 << 4) | (bits - 1), background, 0), palette.astype(np.uint8).tobytes()]
    if loops is not None:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", loops) + b"\0")
    for f in frames:
        flags = (f.disposal << 2) | (f.transparent is not None)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", flags, f.delay, f.transparent or 0) + b"\0")
        own = f.palette is not palette
        own_bits = max(1, (len(f.palette) - 1).bit_length())
        h, w = f.indices.shape
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, w, h, (0x80 | (own_bits - 1)) if own else 0))
        if own:
            out.append(f.palette.astype(np.uint8).tobytes())
        least = max(2, own_bits if own else bits)
        out.append(bytes([least]) + _blocks(pack_codes(*lzw_codes(f.indices.astype(np.uint8).tobytes(), least))))
    return b"".join([*out, b"\x3b"])


def _rows(height: int) -> np.ndarray:
    """The order in which an interlaced picture's rows are stored."""
    return np.concatenate([np.arange(a, height, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes) -> Gif:
    try:
        return _decode(data)
    except (IndexError, struct.error) as e:
        raise GifError("the file ends early") from e


def _decode(data: bytes) -> Gif:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise GifError("signature")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, palette = 13, None

    def colours(at: int, flags: int) -> tuple[np.ndarray, int]:
        n = 3 << ((flags & 7) + 1)
        if at + n > len(data):
            raise GifError("palette")
        return np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(parts), at + 1

    if flags & 0x80:
        palette, at = colours(at, flags)
    frames: list[Frame] = []
    loops = transparent = None
    disposal = delay = 0
    while (kind := data[at]) != 0x3B:
        if kind == 0x21:
            label = data[at + 1]
            body, at = blocks(at + 2)
            if label == 0xF9 and len(body) >= 4:
                f, delay, index = struct.unpack_from("<BHB", body)
                disposal, transparent = (f >> 2) & 7, index if f & 1 else None
            elif label == 0xFF and body[:11] == b"NETSCAPE2.0" and len(body) >= 14 and body[11] == 1:
                loops = struct.unpack_from("<H", body, 12)[0]
        elif kind == 0x2C:
            left, top, w, h, f = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            own = palette
            if f & 0x80:
                own, at = colours(at, f)
            if own is None:
                raise GifError("no palette")
            least = data[at]
            body, at = blocks(at + 1)
            samples = np.frombuffer(lzw_decode(body, least, w * h), np.uint8).reshape(h, w)
            if f & 0x40:
                straight = np.empty_like(samples)
                straight[_rows(h)] = samples
                samples = straight
            frames.append(Frame(left, top, samples, own, transparent, disposal, delay))
            transparent, disposal, delay = None, 0, 0
        else:
            raise GifError("block")
    return Gif(width, height, background, palette, frames, loops)


def composed(gif: Gif) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each frame: start in hundredths of a second, RGB canvas, and where the canvas is opaque."""
    for time, rgb, drawn in _canvases(gif):
        yield time, rgb.copy(), drawn.copy()


def _canvases(gif: Gif) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """As ``composed``, but the canvas is the one that the next frame is drawn on."""
    rgb = np.zeros((gif.height, gif.width, 3), np.uint8)
    drawn = np.zeros((gif.height, gif.width), bool)
    time = 0
    for f in gif.frames:
        was = (rgb.copy(), drawn.copy()) if f.disposal == 3 else None
        h = max(0, min(f.indices.shape[0], gif.height - f.top))
        w = max(0, min(f.indices.shape[1], gif.width - f.left))
        part = f.indices[:h, :w]
        box = np.s_[f.top : f.top + h, f.left : f.left + w]
        colours = np.take(f.palette, part, axis=0, mode="clip")
        if f.transparent is None:
            rgb[box], drawn[box] = colours, True
        else:
            show = part != f.transparent
            rgb[box][show] = colours[show]
            drawn[box] |= show
        yield time, rgb, drawn
        time += f.delay
        if f.disposal == 2:
            rgb[box], drawn[box] = 0, False
        elif was:
            rgb, drawn = was


GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)


def store(payload: bytes, width: int = WIDTH, rows: int = FRAME_ROWS) -> bytes:
    """A payload of whole rows as an animation, one grey sample a byte, row by row."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, width)
    frames = [Frame(0, 0, samples[i : i + rows], GREY, None, 1, DELAY) for i in range(0, len(samples), rows)]
    return encode(frames, width, min(rows, len(samples)), GREY)


def restore(gif: Gif) -> bytes:
    """The samples of all frames through their palettes."""
    return b"".join(f.palette[f.indices][:, :, 0].tobytes() for f in gif.frames)


def timed(gif: Gif, bins: int = BINS) -> Iterator[tuple[int, int, np.ndarray]]:
    """Start, delay (hundredths of a second) and histogram (pixels in bins of the first channel) of
    each frame as it is shown: what the frame leaves of those before counts, what nothing has drawn does not."""
    for f, (start, rgb, drawn) in zip(gif.frames, _canvases(gif), strict=True):
        first = rgb[..., 0]
        yield start, f.delay, np.bincount(first.ravel() if drawn.all() else first[drawn], minlength=256).reshape(bins, -1).sum(axis=1)


def feature(gif: Gif, bins: int = BINS) -> str:
    """Size, frames, duration and the colour histogram (shares of bins of grey over all shown frames, in thousandths)."""
    counts = sum((h for _, _, h in timed(gif, bins)), np.zeros(bins, np.int64))
    h = counts * 1000 // max(1, counts.sum())
    return f"{gif.width}x{gif.height};frames={len(gif.frames)};cs={sum(f.delay for f in gif.frames)};grey={','.join(map(str, h))}"


def media_frames(files: DataFrame, *, doc_id: str = "doc_id", media: str = "media", bins: int = BINS) -> DataFrame:
    """One row for each frame of each file: ``frame``, ``start``, ``delay`` and ``histogram`` as in ``timed``; null files have none."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    schema = pa.schema(list(zip(["doc_id", "frame", "start", "delay", "histogram"], kinds, strict=True)))

    def run(batches):
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(doc, i, *x) for i, x in enumerate(timed(decode(raw), bins))] if raw is not None else []
                if rows:
                    yield pa.record_batch([pa.array([r[i].tolist() if i == 4 else r[i] for r in rows], k) for i, k in enumerate(kinds)], schema=schema)

    return files.select(F.col(doc_id).cast("long"), F.col(media)).mapInArrow(run, "doc_id long, frame int, start long, delay long, histogram array<long>")


def text_media(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, with_media: bool = False) -> DataFrame:
    """Every row's text (null: empty), padded with zero bytes to a positive multiple of ``width``,
    stored as GIF and read back.

    ``payload_*`` and ``tail_crc32`` are of the bytes read back, ``media_*`` of the stored file,
    ``feature`` of the frames as shown.  Rows do not influence each other; repeated rows and null ids
    stay.  ``with_media`` adds the file itself.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * with_media
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * with_media
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def row(raw: bytes) -> tuple:
        payload = raw + bytes(max(width, -(-len(raw) // width) * width) - len(raw))
        media = store(payload, width)
        gif = decode(media)
        back = restore(gif)
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-width:]), len(media), hashlib.sha256(media).hexdigest(), feature(gif), media

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [row((x or "").encode()) for x in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds[1:])]], schema=schema)

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media)
