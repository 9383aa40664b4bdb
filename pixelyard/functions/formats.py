"""Magic-byte detection and fixed-layout headers as Column expressions."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelyard import constants as K
from pixelyard.functions.containers import png_is_animated
from pixelyard.plans.scale import lookup

PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_JXL_BOX = b"\x00\x00\x00\x0cJXL \r\n\x87\n"
_BRANDS = {
    "jxl ": "jxl", "avif": "avif", "avis": "avif", "heic": "heic", "heix": "heic", "mif1": "heic",
}
_SVG_START = "^(?i)(?:ï»¿)?[ \\t\\n\\r\\x0b\\x0c]*<(?:\\?xml|svg)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def raw(value: bytes) -> Column:
    return F.lit(bytearray(value))


def slice_bytes(content: Column, offset: int | Column, length: int | Column) -> Column:
    """Bytes [offset, offset+length), offset counted from 0."""
    start = offset + 1 if isinstance(offset, int) else (offset + 1).cast("int")
    size = length if isinstance(length, int) else length.cast("int")
    return F.substring(content, start, size)


def uint_be(content: Column, offset: int | Column, width: int) -> Column:
    """Big-endian unsigned integer of up to 7 bytes."""
    return F.conv(F.hex(slice_bytes(content, offset, width)), 16, 10).cast("bigint")


def starts(content: Column, magic: bytes, offset: int = 0) -> Column:
    return slice_bytes(content, offset, len(magic)) == raw(magic)


def _looks_like_svg(text: bytes) -> bool:
    body = text[3:] if text[:3] == b"\xef\xbb\xbf" else text
    head = body.lstrip()[:5].lower()
    return head == b"<?xml" or head[:4] == b"<svg"


def _unpacked_head(blob: bytes, piece: int = 4096) -> bytes:
    """The start of a gzip stream, leading blanks cut: no more is unpacked than tells an SVG, however far
    the stream expands. So damage further on goes unnoticed here."""
    head, bom = b"", b""
    while blob:
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            more = unpack.decompress(blob, piece)
            blob = unpack.unconsumed_tail
            if not more and not blob and not unpack.eof:
                raise EOFError("the stream ends early")
            head += more
            if not bom and head[:3] == b"\xef\xbb\xbf":
                bom, head = head[:3], head[3:]
            head = head if len(head) < 3 and not bom else head.lstrip()
            if len(head) >= 5:
                return bom + head
        blob = unpack.unused_data
    return bom + head


@F.pandas_udf(T.StringType())
def _open_ambiguous(blobs: pd.Series) -> pd.Series:
    """apng / png / svgz for the few rows whose magic bytes leave the question open."""

    def settle(blob):
        if blob is None:
            return None
        if blob[:8] == PNG_SIGNATURE:
            return "apng" if png_is_animated(blob) else "png"
        try:
            return "svgz" if _looks_like_svg(_unpacked_head(blob)) else None
        except (OSError, EOFError, zlib.error):
            return None

    return blobs.map(settle)


def isobmff_brand(content: str | Column) -> Column:
    """Format by major brand, else by the first known compatible brand."""
    content = _c(content)
    brand = lambda b: lookup(_BRANDS, F.decode(b, "ISO-8859-1"))
    size = F.length(content)
    end = F.least(uint_be(content, 0, 4), size.cast("bigint"))
    slots = F.when(end >= 20, F.sequence(F.lit(16).cast("bigint"), end - 4, F.lit(4).cast("bigint")))
    known = F.filter(
        F.transform(slots, lambda o: brand(slice_bytes(content, o, 4))), lambda b: b.isNotNull()
    )
    return F.coalesce(brand(slice_bytes(content, 8, 4)), F.get(known, F.lit(0)))


def settle(content: str | Column) -> Column:
    """The two cases that need more than magic bytes, a PNG containing the bytes ``acTL`` and a gzip
    stream. Only those blobs are sent to Python."""
    content = _c(content)
    animated = starts(content, PNG_SIGNATURE) & F.contains(content, raw(b"acTL"))
    return _open_ambiguous(F.when(animated | starts(content, b"\x1f\x8b"), content))


def detect_format(content: str | Column, deep: bool = True, settled: Column | None = None) -> Column:
    """Format name from content alone; NULL if unknown. With ``deep=False`` (file heads) neither
    ambiguous case is opened: PNG stays ``png``, gzip is unknown. ``settled`` passes the value of
    ``settle`` where a plan has it in a column already."""
    content = _c(content)
    png, zipped = starts(content, PNG_SIGNATURE), starts(content, b"\x1f\x8b")
    if settled is None:
        settled = settle(content) if deep else F.lit(None).cast("string")
    svg = F.when(F.regexp_like(F.decode(content, "ISO-8859-1"), F.lit(_SVG_START)), "svg")
    return (
        F.when(F.length(content) < 4, None)
        .when(starts(content, b"\xff\x0a"), "jxl")
        .when(starts(content, _JXL_BOX), "jxl")
        .when(png, F.coalesce(settled, F.lit("png")))
        .when(starts(content, b"\xff\xd8\xff"), "jpeg")
        .when(starts(content, b"GIF87a") | starts(content, b"GIF89a"), "gif")
        .when(starts(content, b"RIFF") & starts(content, b"WEBP", 8), "webp")
        .when(starts(content, b"BM"), "bmp")
        .when(starts(content, b"II*\x00") | starts(content, b"MM\x00*"), "tiff")
        .when((F.length(content) >= 12) & starts(content, b"ftyp", 4), isobmff_brand(content))
        .when(zipped & settled.isNotNull(), settled)
        .otherwise(svg)
    )


def mime_type(fmt: str | Column) -> Column:
    return lookup(K.MIME_TYPES, _c(fmt), "application/octet-stream")


def png_header(content: str | Column) -> Column:
    """STRUCT<width, height, bit_depth, color_type, has_alpha, is_palette>, NULL if invalid."""
    content = _c(content)
    width, height = uint_be(content, 16, 4), uint_be(content, 20, 4)
    depth, color = uint_be(content, 24, 1).cast("int"), uint_be(content, 25, 1).cast("int")
    valid = (
        (F.length(content) >= 33)
        & starts(content, PNG_SIGNATURE)
        & (slice_bytes(content, 8, 8) == raw(b"\x00\x00\x00\x0dIHDR"))
        & width.between(1, 2**31 - 1)
        & height.between(1, 2**31 - 1)
        & color.isin(0, 2, 3, 4, 6)
        & depth.isin(1, 2, 4, 8, 16)
    )
    return F.when(
        valid,
        F.struct(
            width.alias("width"),
            height.alias("height"),
            depth.alias("bit_depth"),
            color.alias("color_type"),
            color.isin(4, 6).alias("has_alpha"),
            (color == 3).alias("is_palette"),
        ),
    )


def color_type(mode: str | Column) -> Column:
    return lookup(K.MODE_COLOR_TYPE, _c(mode))


def bit_depth(mode: str | Column, header_bits: Column | None = None) -> Column:
    """Explicit header bits first, else by mode, else 8."""
    by_mode = lookup(K.MODE_BITS, _c(mode), 8)
    return by_mode if header_bits is None else F.coalesce(F.nullif(header_bits, F.lit(0)), by_mode)
