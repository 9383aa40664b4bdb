"""Container walks. One blob is one row; the walks are small per-row helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# (depth, kind, offset, length, width, height, frames); numbers are None where not carried
Segment = tuple[int, str, int, int, int | None, int | None, int | None]

SEGMENT = T.StructType(
    [
        T.StructField("depth", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("width", T.LongType()),
        T.StructField("height", T.LongType()),
        T.StructField("frames", T.LongType()),
    ]
)

_BOXES_WITH_CHILDREN = {"meta": 4, "iprp": 0, "ipco": 0}  # bytes to skip before the children


def _name(tag: bytes) -> str:
    return tag.decode("latin-1")


def _png(blob: bytes) -> Iterator[Segment]:
    at = 8
    while len(blob) - at >= 8:
        size, kind = int.from_bytes(blob[at : at + 4], "big") + 12, _name(blob[at + 4 : at + 8])
        body = blob[at + 8 : at + 16]
        w = h = frames = None
        if kind == "IHDR" and len(body) == 8:
            w, h = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:], "big")
        elif kind == "acTL" and len(body) >= 4:
            frames = int.from_bytes(body[:4], "big")
        yield 0, kind, at, size, w, h, frames
        at += size


def png_is_animated(blob: bytes) -> bool:
    """True if an animation-control chunk comes before the first image data."""
    for segment in _png(blob):
        if segment[1] in ("acTL", "IDAT"):
            return segment[1] == "acTL"
    return False


def _sub_blocks_end(blob: bytes, at: int) -> int:
    """Offset after a chain of length-prefixed GIF sub-blocks (or the end of data)."""
    while at < len(blob) and blob[at]:
        at += 1 + blob[at]
    return at + 1


def _color_table(flags: int) -> int:
    return 3 << ((flags & 7) + 1) if flags & 0x80 else 0


def _gif(blob: bytes) -> Iterator[Segment]:
    if len(blob) < 13:
        return
    at = 13 + _color_table(blob[10])
    width, height = int.from_bytes(blob[6:8], "little"), int.from_bytes(blob[8:10], "little")
    yield 0, "screen", 0, at, width, height, None
    while at < len(blob):
        start, block = at, blob[at]
        if block == 0x3B:
            yield 0, "trailer", start, 1, None, None, None
            return
        if block == 0x21:
            kind, at = "extension", _sub_blocks_end(blob, at + 2)
        elif block == 0x2C:
            kind = "image"
            if at + 10 > len(blob):
                yield 0, kind, start, len(blob) - start, None, None, None
                return
            at = _sub_blocks_end(blob, at + 11 + _color_table(blob[at + 9]))
        else:
            return
        at = min(at, len(blob))
        yield 0, kind, start, at - start, None, None, None


def _boxes(blob: bytes, at: int, end: int, depth: int) -> Iterator[Segment]:
    while end - at >= 8:
        size, kind, head = int.from_bytes(blob[at : at + 4], "big"), _name(blob[at + 4 : at + 8]), 8
        if size == 1:
            if end - at < 16:
                return
            size, head = int.from_bytes(blob[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = end - at
        if size < 8 or size > end - at:
            return
        w = h = None
        if kind == "ispe" and size - head >= 12:
            w = int.from_bytes(blob[at + head + 4 : at + head + 8], "big")
            h = int.from_bytes(blob[at + head + 8 : at + head + 12], "big")
        yield depth, kind, at, size, w, h, None
        if kind in _BOXES_WITH_CHILDREN and depth < 3:
            yield from _boxes(blob, at + head + _BOXES_WITH_CHILDREN[kind], at + size, depth + 1)
        at += size


def jpeg_segments(blob: bytes, max_markers: int) -> Iterator[tuple[int, int, int]]:
    """(marker byte, payload start, payload end). Ends at SOS, EOI or a truncated segment;
    raises ValueError on an impossible segment length."""
    at, n, seen = 2, len(blob), 0
    while at + 1 < n and seen < max_markers:
        while at < n and blob[at] == 0xFF:
            at += 1
        if at >= n:
            return
        marker, at, seen = blob[at], at + 1, seen + 1
        if marker in (0xD9, 0xDA):
            yield marker, at, at
            return
        if 0xD0 <= marker <= 0xD8:
            continue
        if at + 2 > n:
            return
        size = int.from_bytes(blob[at : at + 2], "big")
        if size < 2:
            raise ValueError("segment length below 2")
        if at + size > n:
            return
        yield marker, at + 2, at + size
        at += size


def _jpeg(blob: bytes) -> Iterator[Segment]:
    try:
        for marker, start, end in jpeg_segments(blob, len(blob)):
            w = h = None
            if 0xC0 <= marker <= 0xC3 and end - start >= 6:
                h, w = (int.from_bytes(blob[start + i : start + i + 2], "big") for i in (1, 3))
            framing = 4 if end > start or marker not in (0xD9, 0xDA) else 2
            at = start - framing if framing == 4 else start - 2
            yield 0, f"{marker:02X}", at, end - at, w, h, None
    except ValueError:
        return


def walk(blob: bytes | None) -> list[Segment]:
    """All segments of a PNG, GIF, JPEG or ISO base-media file, in file order."""
    if not blob or len(blob) < 8:
        return []
    if blob[:8] == b"\x89PNG\r\n\x1a\n":
        return list(_png(blob))
    if blob[:6] in (b"GIF87a", b"GIF89a"):
        return list(_gif(blob))
    if blob[:2] == b"\xff\xd8":
        return list(_jpeg(blob))
    if blob[4:8] == b"ftyp":
        return list(_boxes(blob, 0, len(blob), 0))
    return []


@F.pandas_udf(T.ArrayType(SEGMENT))
def segments(blobs: pd.Series) -> pd.Series:
    return blobs.map(walk)


def make_strip_png_text(keep_icc: bool = True):
    """UDF: the PNG without its text chunks; other content is returned unchanged."""
    dropped = {"tEXt", "iTXt", "zTXt"} | (set() if keep_icc else {"iCCP"})

    def strip(blob: bytes | None) -> bytes | None:
        if blob is None or blob[:8] != b"\x89PNG\r\n\x1a\n":
            return blob
        kept, done = [blob[:8]], 8
        for _, kind, at, size, *_ in _png(blob):
            if at + size > len(blob):
                break
            if kind not in dropped:
                kept.append(blob[at : at + size])
            done = at + size
        tail = blob[done:]
        return b"".join(kept) + (tail if len(tail) >= 8 else b"")

    @F.pandas_udf(T.BinaryType())
    def strip_png_text(blobs: pd.Series) -> pd.Series:
        return blobs.map(strip)

    return strip_png_text
