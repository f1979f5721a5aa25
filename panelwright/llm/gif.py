"""GIF as a column type: a codec in numpy and Python, frames and histograms.

The decoder reads the format in general: global and local palettes, LZW code
streams of any starting width, interlacing, transparency, disposal and delays.
The encoder writes 8-bit images with LZW.  A frame's codes are cut out of the
stream at once, because code widths follow from positions alone.

A payload is stored as a film.  Its palette gives each byte a colour of its own;
a frame shows the next rows over those before it, writes a sample that it doesn't
hold where a byte stays as it was, and names that sample transparent.  Frames are
never cleared away (disposal 1), so reading composes canvases, as any viewer does.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw

#: Bytes of a row of a payload's image, and its rows in a frame.
WIDTH, ROWS = 192, 16
#: Pixels of the largest canvas or frame that is decoded (an RGBA canvas of 256 MB).
MOST = 1 << 26


@dataclass
class Frame:
    indices: np.ndarray
    left: int = 0
    top: int = 0
    delay_ms: int = 0
    disposal: int = 0
    transparent: int | None = None
    palette: np.ndarray | None = None


@dataclass
class Image:
    width: int
    height: int
    palette: np.ndarray | None
    background: int = 0
    frames: list[Frame] = field(default_factory=list)


def _widths(clear: int, n: int) -> np.ndarray:
    """The width of each of the n codes after a clear code (the first is a plain sample)."""
    # after the i-th code the table holds clear + 2 + i - 1 entries; a full 12-bit table grows no more
    entries = clear + 1 + np.arange(n)
    return np.minimum(12, np.maximum(int(clear).bit_length(), np.floor(np.log2(np.maximum(entries, 1))).astype(np.int64) + 1))


_FULL: dict[int, np.ndarray] = {}


def widths(clear: int, n: int) -> np.ndarray:
    """As ``_widths``, from a kept table."""
    most = _FULL.get(clear)
    if most is None or len(most) < n:
        most = _FULL[clear] = _widths(clear, max(n, 8192))
    return most[:n]


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """An LZW code stream; the table is cleared when it is full."""
    clear = 1 << bits
    codes: list[int] = []
    ends: list[int] = []
    if data:
        # keys and values hold codes shifted by a byte, so that the next sample only has to be put in
        table: dict[int, int] = {}
        get, put, free, prefix = table.get, codes.append, clear + 2, data[0] << 8
        for sample in memoryview(data)[1:]:
            code = get(prefix | sample)
            if code:
                prefix = code
                continue
            put(prefix)
            if free < 4096:
                table[prefix | sample] = free << 8
                free += 1
            else:
                table.clear()
                free = clear + 2
                ends.append(len(codes))
            prefix = sample << 8
        put(prefix)
        ends.append(len(codes))
    runs = [e - s for s, e in zip([0, *ends], ends)]
    every, marks = np.array(codes, np.int64) >> 8, [np.array([clear]), np.array([clear + 1])]
    out, size, last, wide = [], [], 0, bits + 1
    for r in runs:
        # the clear code before a run has the width that the run before it came to
        out += [marks[0], every[last : last + r]]
        size += [np.array([wide]), widths(clear, r)]
        wide, last = _next_width(clear, r), last + r
    if not runs:
        out, size = [marks[0]], [np.array([wide])]
    return pack_codes(np.concatenate([*out, marks[1]]), np.concatenate([*size, np.array([wide])]))


def _next_width(clear: int, run: int) -> int:
    return int(widths(clear, run + 1)[run])


def pack_codes(codes: np.ndarray, size: np.ndarray) -> bytes:
    """Codes of given widths as a little-endian bit stream; a code touches three bytes at most, and none shares a bit."""
    ends = np.cumsum(size)
    begin = ends - size
    word, at, n = codes << (begin & 7), begin >> 3, int(ends[-1] + 7) >> 3
    out = sum(np.bincount(at + k, word >> 8 * k & 255, n + 3) for k in range(3))
    return out[:n].astype(np.uint8).tobytes()


def expand(codes: np.ndarray, clear: int) -> np.ndarray:
    """The samples that codes between two clear codes stand for.

    Code number i (with i > 0) adds the entry ``clear + 1 + i``: the samples of code
    i - 1 and the one after them.  So a code above the plain ones copies a stretch
    of earlier output, and references are followed for all samples at once by doubling.
    """
    i = np.arange(len(codes))
    plain = codes < clear
    source = np.where(plain, i, codes - clear - 2)
    if ((source >= i) & ~plain).any() or (source < 0).any():
        raise ValueError("broken code stream")
    longer, up = (~plain).astype(np.int64), source
    while longer[up].any():
        longer, up = longer + longer[up], up[up]
    length = longer + 1
    end = np.cumsum(length)
    begin = end - length
    at = np.arange(int(end[-1]) if len(end) else 0)
    root = at - np.repeat(begin - begin[source], length)
    while True:
        further = root[root]
        if np.array_equal(further, root):
            break
        root = further
    return np.repeat(codes, length)[root].astype(np.uint8)


def lzw_decode(stream: bytes, bits: int, most: int) -> bytes:
    """The samples of a code stream, ``most`` at the most."""
    clear, stop = 1 << bits, (1 << bits) + 1
    padded = np.frombuffer(stream + bytes(8), np.uint8)
    total, at, done, out, size = 8 * len(stream), 0, False, [], 0
    while not done and at + bits + 1 <= total and size < most:
        # codes up to the next clear code, as if there were none
        most_codes = (total - at) // (bits + 1) + 1
        for limit in (min(8192, most_codes), most_codes):
            w = widths(clear, limit)
            begin = at + np.concatenate(([0], np.cumsum(w)))
            n = int(np.searchsorted(begin[1:], total, side="right"))
            begin, w = begin[:n], w[:n]
            by = begin >> 3
            word = padded[by].astype(np.int64) | padded[by + 1].astype(np.int64) << 8 | padded[by + 2].astype(np.int64) << 16
            codes = word >> (begin & 7) & ((1 << w) - 1)
            marks = np.flatnonzero((codes == clear) | (codes == stop))
            if len(marks) or n < limit:
                break
        end = int(marks[0]) if len(marks) else n
        run = expand(codes[:end], clear)
        out.append(run)
        size += len(run)
        if len(marks):
            done = int(codes[end]) == stop
            at = int(begin[end] + w[end])
        else:
            done = True
    return np.concatenate(out).tobytes()[:most] if out else b""


def _blocks(data: bytes) -> bytes:
    """Data in sub-blocks, with the empty one at the end."""
    return b"".join(bytes([len(x := data[i : i + 255])]) + x for i in range(0, len(data), 255)) + b"\0"


def _table(palette: np.ndarray) -> tuple[int, bytes]:
    bits = max(1, int(len(palette) - 1).bit_length())
    return bits, np.pad(palette.astype(np.uint8), ((0, (1 << bits) - len(palette)), (0, 0))).tobytes()


def encode(image: Image) -> bytes:
    """A GIF file of 8-bit frames."""
    flags, colours = 0x70, b""
    if image.palette is not None:
        bits, colours = _table(image.palette)
        flags |= 0x80 | bits - 1
    out = [b"GIF89a", struct.pack("<HHBBB", image.width, image.height, flags, image.background, 0), colours]
    for f in image.frames:
        h, w = f.indices.shape
        see = f.transparent is not None
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", f.disposal << 2 | see, f.delay_ms // 10, f.transparent or 0, 0))
        bits, own = _table(f.palette) if f.palette is not None else (0, b"")
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, w, h, 0x80 | bits - 1 if own else 0) + own + b"\x08" + _blocks(lzw_encode(f.indices.astype(np.uint8).tobytes())))
    return b"".join(out) + b"\x3b"


def read(data: bytes, most: int = MOST):
    """Yield the image without frames, then its frames one by one; raises ValueError at what is no GIF, cut short, or larger than ``most`` pixels."""
    try:
        yield from _read(data, most)
    except (IndexError, struct.error) as e:
        raise ValueError("cut short") from e


def _read(data: bytes, most: int):
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > most:
        raise ValueError("canvas too large")
    at = 13

    def colours(bits: int) -> np.ndarray:
        nonlocal at
        n = 3 << bits
        at += n
        if at > len(data):
            raise ValueError("cut short")
        return np.frombuffer(data[at - n : at], np.uint8).reshape(-1, 3)

    def blocks() -> bytes:
        nonlocal at
        out = []
        while n := data[at]:
            out.append(data[at + 1 : at + 1 + n])
            at += n + 1
        at += 1
        return b"".join(out)

    yield Image(width, height, colours((flags & 7) + 1) if flags & 0x80 else None, background)
    control = {}
    while data[at] != 0x3B:
        kind = data[at]
        at += 1
        if kind == 0x21:
            label = data[at]
            at += 1
            body = blocks()
            if label == 0xF9 and len(body) >= 4:
                packed, delay, clear_at = struct.unpack_from("<BHB", body)
                control = {"delay_ms": delay * 10, "disposal": packed >> 2 & 7, "transparent": clear_at if packed & 1 else None}
        elif kind == 0x2C:
            left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at)
            at += 9
            own = colours((packed & 7) + 1) if packed & 0x80 else None
            bits = data[at]
            at += 1
            if not 1 <= bits <= 8 or w * h > most:
                raise ValueError("broken frame")
            samples = np.frombuffer(lzw_decode(blocks(), bits, w * h), np.uint8)
            if len(samples) != w * h:
                raise ValueError("short frame")
            rows = samples.reshape(h, w)
            if packed & 0x40:
                order = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
                rows = rows[np.argsort(order)]
            yield Frame(rows, left, top, palette=own, **control)
            control = {}
        else:
            raise ValueError("unknown block")


def decode(data: bytes) -> Image:
    """The image with all frames: their indices, palettes, times and disposal; raises ValueError for what is no whole GIF."""
    parts = read(data)
    image = next(parts)
    image.frames = list(parts)
    return image


GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)


def compose(image: Image, frames):
    """Yield each frame with the RGBA canvas that it shows, under palettes, transparency and disposal. The next frame draws on the canvas: copy what is kept."""
    canvas = np.zeros((image.height, image.width, 4), np.uint8)
    for f in frames:
        palette = f.palette if f.palette is not None else image.palette if image.palette is not None else GREY
        colours = np.concatenate((palette, np.full((len(palette), 1), 255, np.uint8)), axis=1)
        before = canvas.copy() if f.disposal == 3 else None
        h, w = f.indices.shape
        area = (slice(f.top, f.top + h), slice(f.left, f.left + w))
        spot = canvas[area]
        indices = f.indices[: spot.shape[0], : spot.shape[1]]
        shown = colours[np.minimum(indices, len(palette) - 1)]
        if f.transparent is None:
            spot[...] = shown
        else:
            seen = indices != f.transparent
            spot[seen] = shown[seen]
        yield f, canvas
        if f.disposal == 2:
            canvas[area] = 0
        elif before is not None:
            canvas = before


def canvases(image: Image):
    """Yield the RGBA canvas shown for each frame."""
    for _, shown in compose(image, image.frames):
        yield shown.copy()


def colour_histogram(shown: np.ndarray) -> np.ndarray:
    """Pixels of an RGBA picture by 64 colours, two bits a channel, clear ones left out."""
    pixel = np.ascontiguousarray(shown).view("<u4").ravel()
    bins = (pixel >> 2 & 48) | (pixel >> 12 & 12) | (pixel >> 22 & 3)
    return np.bincount(bins[pixel >> 24 > 0], minlength=64)


def letters_palette() -> np.ndarray:
    """A colour for each byte: red is the byte itself, so colours can be read back; green tells its kind, blue a letter's place."""
    b = np.arange(256)
    letter = (b | 32 >= 97) & (b | 32 <= 122) & (b < 128)
    kind = np.select([b <= 32, letter & (b < 97), letter, (b >= 48) & (b <= 57), b < 128], [0, 85, 170, 255, 42], 213)
    return np.stack((b, kind, np.where(letter, (b & 31) * 9, 255 - kind // 2)), axis=1).astype(np.uint8)


PALETTE = letters_palette()


def payload(text: bytes, unit: int = WIDTH) -> bytes:
    """The text with spaces up to a positive multiple of the unit."""
    return text + b" " * (-len(text) % unit if text else unit)


def store(data: bytes) -> bytes:
    """A payload as a film, one sample a byte."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    last, frames = None, []
    for at in range(0, len(rows), ROWS):
        part, sample = rows[at : at + ROWS], None
        now = part
        if last is not None:
            spare = np.flatnonzero(np.bincount(part.ravel(), minlength=256) == 0)
            if len(spare):
                sample = int(spare[-1])
                now = np.where(part == last[: len(part)], np.uint8(sample), part)
        frames.append(Frame(now, delay_ms=100, disposal=1, transparent=sample))
        # rows that a short last frame leaves uncovered belong to no frame after it
        last = part
    return encode(Image(WIDTH, min(ROWS, len(rows)), PALETTE, 0, frames))


def restored(media: bytes):
    """Yield the frames of a stored payload with what each shows, whose red is its part of the payload."""
    parts = read(media)
    image = next(parts)
    for f, canvas in compose(image, parts):
        yield f, canvas[: f.indices.shape[0]]


def _film(t: bytes) -> tuple:
    kept = store(payload(t))
    back, frames, total = [], [], np.zeros(64, np.int64)
    for i, (f, shown) in enumerate(restored(kept)):
        back.append(shown[..., 0].tobytes())
        found = colour_histogram(shown)
        total += found
        frames.append({"index": i, "delay_ms": f.delay_ms, "disposal": f.disposal, "width": f.indices.shape[1], "height": f.indices.shape[0], "histogram": found.tolist()})
    data = b"".join(back)
    share = (total * 255 // max(1, int(total.sum()))).astype(np.uint8)
    return kept, frames, len(t), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(kept), hashlib.sha256(kept).hexdigest(), share.tobytes().hex()


FRAME = pa.struct([("index", pa.int32()), ("delay_ms", pa.int32()), ("disposal", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int64()))])
NAMES = ("media", "frames", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
KINDS = (pa.binary(), pa.list_(FRAME), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())


def _films(batches, want: list[str]):
    for b in batches:
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            made = list(zip(*[_film(t) for t in raw(part, "text")]))
            cols = [pa.array(made[NAMES.index(n)], KINDS[NAMES.index(n)]) for n in want]
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), *cols], ["doc_id", *want])


def _decoded(batches, most: int):
    for b in batches:
        kind = DECODED(b.schema.field(0).type)
        rows: list[dict] = []
        for at in range(b.num_rows):
            doc_id, media = b.column(0)[at].as_py(), b.column(1)[at].as_py()
            start = 0
            try:
                parts = read(media or b"", most)
                image = next(parts)
                for i, (f, shown) in enumerate(compose(image, parts)):
                    rows.append({"doc_id": doc_id, "index": i, "start_ms": start, "delay_ms": f.delay_ms, "width": image.width, "height": image.height,
                                 "rgba": shown.tobytes(), "histogram": colour_histogram(shown).tolist(), "error": None})
                    start += f.delay_ms
                    if len(rows) >= 32 or len(rows) * shown.size > 1 << 26:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows = []
            except ValueError as e:
                rows.append({"doc_id": doc_id, "error": str(e)})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kind)


def DECODED(kind: pa.DataType) -> pa.Schema:  # noqa: N802
    whole, binary = pa.int32(), pa.binary()
    return pa.schema([("doc_id", kind), ("index", whole), ("start_ms", pa.int64()), ("delay_ms", whole), ("width", whole), ("height", whole), ("rgba", binary), ("histogram", pa.list_(pa.int64())), ("error", pa.string())])


def decode_frames(media: DataFrame, most: int = MOST, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per frame of any GIF column: when it starts, how long it shows, its
    composed RGBA canvas and a histogram of 64 colours (two bits a channel, clear
    pixels left out).  What is null, no whole GIF, or larger than ``most`` pixels
    gives its good frames, then a row with ``error``.  Repeated rows are decoded as
    often as they occur; other columns are not read.
    """
    kind = media.schema[id_col].dataType.simpleString()
    return media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(
        partial(_decoded, most=most), f"doc_id {kind}, index int, start_ms long, delay_ms int, width int, height int, rgba binary, histogram array<long>, error string"
    )


def films(docs: DataFrame, want: tuple[str, ...] = NAMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the wanted columns: the stored media, its timed frames with colour
    histograms, and digests of what was read back from the stored bytes.

    Null texts are stored as empty ones (spaces alone); repeated rows give equal
    values; a long text is stored whole, in as many frames as it takes; an empty
    table gives no rows; other columns are not read, so their names may clash.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    types = dict(zip(NAMES, ("binary", "array<struct<index:int,delay_ms:int,disposal:int,width:int,height:int,histogram:array<long>>>", "long", "long", "string", "long", "long", "string", "string")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_films, want=list(want)), f"doc_id {kind}, " + ", ".join(f"{n} {types[n]}" for n in want))
