"""JPEG header reading and source-quality matching."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelyard import constants as K
from pixelyard.functions.containers import jpeg_segments

JPEG_HEADER = T.StructType(
    [
        T.StructField("width", T.LongType()),
        T.StructField("height", T.LongType()),
        T.StructField("components", T.IntegerType()),
        T.StructField("bit_depth", T.IntegerType()),
        T.StructField("subsampling", T.StringType()),
        T.StructField("progressive", T.BooleanType()),
        T.StructField("dqt_luma", T.ArrayType(T.IntegerType())),
        T.StructField("dqt_chroma", T.ArrayType(T.IntegerType())),
        T.StructField("app14_color_transform", T.IntegerType()),
        T.StructField("fallback_reason", T.StringType()),
    ]
)

_SAMPLING = {
    (0x11, 0x11, 0x11): "4:4:4",
    (0x21, 0x11, 0x11): "4:2:2",
    (0x22, 0x11, 0x11): "4:2:0",
}


def _quant_tables(payload: bytes, budget: int) -> tuple[dict[int, np.ndarray], int]:
    """Tables by id from one DQT payload, and the byte budget that is left."""
    tables: dict[int, np.ndarray] = {}
    at = 0
    while at < len(payload):
        wide, slot = payload[at] >> 4 == 1, payload[at] & 15
        size = 128 if wide else 64
        body = payload[at + 1 : at + 1 + size]
        if len(body) < size:
            break
        budget -= size
        if budget < 0:
            break
        tables[slot] = np.frombuffer(body, ">u2" if wide else "u1").astype(np.int32)
        at += 1 + size
    return tables, budget


def read_header(blob: bytes | None) -> dict | None:
    """Header fields of one JPEG, or None when it is structurally broken."""
    if blob is None or len(blob) < 4 or blob[:2] != b"\xff\xd8":
        return None
    blob = blob[: K.JPEG_HEAD_BYTES]
    frame: tuple | None = None  # (marker, precision, height, width, components, factors)
    tables: dict[int, np.ndarray] = {}
    budget, transform, lossless = K.JPEG_MAX_DQT_BYTES, None, False
    try:
        for marker, start, end in jpeg_segments(blob, K.JPEG_MAX_MARKERS):
            body = blob[start:end]
            if marker in (0xC0, 0xC1, 0xC2, 0xC3):
                if len(body) >= 6:
                    height, width = (int.from_bytes(body[i : i + 2], "big") for i in (1, 3))
                    factors = tuple(body[7 + 3 * i] for i in range(body[5]) if 8 + 3 * i < len(body))
                    frame = (marker, body[0], height, width, body[5], factors)
                if marker == 0xC3:
                    lossless = True
                    break
                if len(body) < 6 or not (height and width and body[5]):
                    return None
            elif marker == 0xDB:
                found, budget = _quant_tables(body, budget)
                tables.update(found)
            elif marker == 0xEE and len(body) >= 12 and body[:5] == b"Adobe":
                transform = body[11]
    except ValueError:
        return None
    if frame is None:
        return None
    marker, precision, height, width, components, factors = frame
    reason = None
    if lossless:
        reason, sampling = "lossless_jpeg", "other"
    else:
        if components not in (1, 3):
            reason = "non_standard_components"
        if transform not in (None, 0, 1):
            reason = "non_default_color_transform"
        if reason is None and components == 3 and 1 not in tables:
            reason = "missing_chroma_table"
        sampling = "grayscale" if components == 1 else _SAMPLING.get(factors[:3], "other")
    return {
        "width": width,
        "height": height,
        "components": components,
        "bit_depth": precision,
        "subsampling": sampling,
        "progressive": marker == 0xC2,
        "dqt_luma": tables.get(0, []),
        "dqt_chroma": tables.get(1),
        "app14_color_transform": transform,
        "fallback_reason": reason,
    }


_ARROW_HEADER = {
    "width": pa.int64(),
    "height": pa.int64(),
    "components": pa.int32(),
    "bit_depth": pa.int32(),
    "subsampling": pa.string(),
    "progressive": pa.bool_(),
    "dqt_luma": pa.list_(pa.int32()),
    "dqt_chroma": pa.list_(pa.int32()),
    "app14_color_transform": pa.int32(),
    "fallback_reason": pa.string(),
}
_EMPTY = dict.fromkeys(JPEG_HEADER.fieldNames())


@F.arrow_udf(JPEG_HEADER)
def _headers(heads: pa.Array) -> pa.Array:
    # Arrow in and out: building pandas objects for the two tables cost more than the parsing.
    rows = [read_header(h.as_py()) or _EMPTY for h in heads]
    columns = [pa.array([r[name] for r in rows], type=kind) for name, kind in _ARROW_HEADER.items()]
    return pa.StructArray.from_arrays(columns, names=list(_ARROW_HEADER))


def jpeg_header(content: str | Column) -> Column:
    """Header struct, NULL if broken. Only the first 64 KiB of JPEG rows leave the JVM."""
    parsed = raw_header(content)
    return F.when(parsed["width"].isNotNull(), parsed)


def raw_header(content: str | Column) -> Column:
    """The same as a bare struct whose fields are all NULL where there is no header."""
    content = F.col(content) if isinstance(content, str) else content
    is_jpeg = F.substring(content, 1, 2) == F.lit(bytearray(b"\xff\xd8"))
    return _headers(F.when(is_jpeg, F.substring(content, 1, K.JPEG_HEAD_BYTES)))


def scaled_tables(base: tuple[int, ...]) -> np.ndarray:
    """The (100, 64) standard tables at qualities 1..100."""
    q = np.arange(1, 101)
    scale = np.where(q < 50, 5000 // q, 200 - 2 * q)[:, None]
    return np.clip((scale * np.array(base) + 50) // 100, 1, 255)


SOURCE_QUALITY = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("nse", T.DoubleType())])


def _match(tables: np.ndarray, standard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    # sum (T-o)^2 = sum T^2 - 2 T.o + sum o^2: one matrix product per Arrow batch, exact in
    # float64 because every term is an integer far below 2^53.
    error = (
        (standard**2).sum(1)[None, :] - 2.0 * tables @ standard.T + (tables**2).sum(1)[:, None]
    )
    best = error.argmin(axis=1)
    least = error[np.arange(len(tables)), best]
    spread = ((tables - tables.mean(1, keepdims=True)) ** 2).sum(1)
    fit = np.where(spread > 0, 1.0 - least / np.where(spread > 0, spread, 1.0), 0.0)
    return best + 1, np.clip(fit, 0.0, 1.0)


def _complete(tables: pa.Array) -> np.ndarray:
    """Which rows hold a whole table of 64 entries."""
    return pc.fill_null(pc.equal(pc.list_value_length(tables), 64), False).to_numpy(zero_copy_only=False)


def _rows(tables: pa.Array, rows: np.ndarray) -> np.ndarray:
    return tables.filter(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, 64).astype(float)


@F.arrow_udf(SOURCE_QUALITY)
def source_quality(luma: pa.Array, chroma: pa.Array) -> pa.Array:
    """Best matching standard quality (lowest on ties) and goodness of fit."""
    std_luma = scaled_tables(K.ANNEX_K_LUMA).astype(float)
    std_both = np.hstack([std_luma, scaled_tables(K.ANNEX_K_CHROMA).astype(float)])
    has_luma, has_chroma = _complete(luma), _complete(chroma)
    quality, nse = np.zeros(len(luma), np.int32), np.zeros(len(luma))
    gray, color = has_luma & ~has_chroma, has_luma & has_chroma
    if gray.any():
        quality[gray], nse[gray] = _match(_rows(luma, gray), std_luma)
    if color.any():
        quality[color], nse[color] = _match(np.hstack([_rows(luma, color), _rows(chroma, color)]), std_both)
    columns = [pa.array(quality, mask=~has_luma), pa.array(nse, mask=~has_luma)]
    return pa.StructArray.from_arrays(columns, names=["q", "nse"])
