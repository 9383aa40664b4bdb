"""Image kernels: PSNR as expressions; SSIM, thumbnails and gradients in numpy per Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

THUMB = 64


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mean_squared_error(reference: str | Column, distorted: str | Column) -> Column:
    """MSE of two equally long ARRAY<DOUBLE>; NULL on a length mismatch."""
    a, b = _c(reference), _c(distorted)
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    total = F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total / F.size(a))


def psnr(mse: str | Column, digits: int | None = 4) -> Column:
    """dB for signals in [0, 1]; NULL when identical (a perfect match) or not comparable."""
    mse = _c(mse)
    db = F.when(mse > 0, 10.0 * F.log10(F.lit(1.0) / mse))
    return db if digits is None else F.bround(db, digits)


def _box_means(stack: np.ndarray, window: int) -> np.ndarray:
    """Means of all ``window`` x ``window`` squares of (N, H, W, C) images. Summed areas give each
    with four look-ups, whatever the window. The first window of each axis is not part of the map."""
    n, h, w, c = stack.shape
    area = np.zeros((n, h + 1, w + 1, c))
    area[:, 1:, 1:] = stack.cumsum(1).cumsum(2)
    squares = area[:, window:, window:] - area[:, :-window, window:] - area[:, window:, :-window] + area[:, :-window, :-window]
    return squares[:, 1:, 1:] / (window * window)


def ssim_stack(ref: np.ndarray, dist: np.ndarray, window: int = 11) -> np.ndarray:
    """Mean SSIM of each pair of (N, H, W, C) images with a flat window: channels averaged, alpha
    ignored, borders reflected."""
    c1, c2, half = 0.01**2, 0.03**2, window // 2
    a, b = (np.pad(x[..., :3].astype(float), ((0, 0), (half, half), (half, half), (0, 0)), mode="reflect") for x in (ref, dist))
    ma, mb = _box_means(a, window), _box_means(b, window)
    va, vb, cov = _box_means(a * a, window) - ma * ma, _box_means(b * b, window) - mb * mb, _box_means(a * b, window) - ma * mb
    top = (2 * ma * mb + c1) * (2 * cov + c2)
    low = (ma * ma + mb * mb + c1) * (va + vb + c2)
    return np.divide(top, low, out=np.ones_like(top), where=low > 0).mean((1, 2, 3))


def ssim_of(ref: np.ndarray, dist: np.ndarray, window: int = 11) -> float | None:
    """The same for one pair of (H, W, C) images; None where their shapes differ."""
    return float(ssim_stack(ref[None], dist[None], window)[0]) if ref.shape == dist.shape else None


#: Values that one stack of images is worked on with: a few MB in each intermediate array.
STACK = 1 << 18


def stacks(shape: list[pa.Array], *columns: pa.Array, work: Callable[[int, int, int], int]) -> Iterator[tuple[np.ndarray, tuple[int, int, int], list[np.ndarray]]]:
    """Images of equal shape together: row numbers, (height, width, channels), and an (N, H, W, C) array
    for each column of lists or bytes. Rows with nulls or of another length are left out. ``work`` is the number of
    values that an image of a shape becomes on the way; a stack holds ``STACK`` of them, or one image."""
    sides = np.column_stack([s.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for s in shape])
    size, flat, begins = sides.prod(1), [], []
    ok = (sides > 0).all(1)
    for c in columns:
        wide = pa.types.is_large_binary(c.type) or pa.types.is_large_list(c.type)
        if pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type):
            bounds = np.frombuffer(c.buffers()[1], np.int64 if wide else np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
            flat.append(np.frombuffer(c.buffers()[2] or b"", np.uint8))
        else:
            bounds = c.offsets.to_numpy().astype(np.int64)
            values = c.values
            ok &= values.null_count == 0 or np.array([not x.values.null_count if x.is_valid else False for x in c])
            flat.append(values.fill_null(0).to_numpy(zero_copy_only=False))
        ok &= np.asarray(c.is_valid().to_numpy(zero_copy_only=False)) & (np.diff(bounds) == size)
        begins.append(bounds[:-1])
    rows = np.flatnonzero(ok)
    shapes, number = np.unique(sides[rows], axis=0, return_inverse=True)
    for k, (h, w, n) in enumerate(shapes.tolist()):
        same = rows[number.ravel() == k]
        step = max(1, STACK // max(h * w * n, work(h, w, n)))
        for at in range(0, len(same), step):
            part = same[at : at + step]
            yield part, (h, w, n), [f[b[part][:, None] + np.arange(h * w * n)].reshape(-1, h, w, n) for f, b in zip(flat, begins, strict=True)]


@F.arrow_udf(T.DoubleType())
def ssim(ref: pa.Array, dist: pa.Array, height: pa.Array, width: pa.Array, channels: pa.Array) -> pa.Array:
    """SSIM of flattened row-major arrays; NULL where one is missing or of another size."""
    out, known = np.zeros(len(ref)), np.zeros(len(ref), bool)
    for rows, _, (a, b) in stacks([height, width, channels], ref, dist, work=lambda h, w, c: (h + 10) * (w + 10) * c):
        out[rows], known[rows] = ssim_stack(a, b), True
    return pa.array(out, mask=~known | np.isnan(out))


def _lanczos(size: int, target: int = THUMB) -> np.ndarray:
    """(target, size) resampling weights of the three-lobed windowed sinc."""
    scale = size / target
    stretch = max(scale, 1.0)
    centre = (np.arange(target)[:, None] + 0.5) * scale
    x = (np.arange(size)[None, :] + 0.5 - centre) / stretch
    weights = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return weights / weights.sum(1, keepdims=True)


def thumbnails(stack: np.ndarray) -> np.ndarray:
    """(N, 64, 64, C) uint8 thumbnails of (N, H, W, C) uint8 images."""
    rows, cols = _lanczos(stack.shape[1]), _lanczos(stack.shape[2])
    small = np.einsum("ih,nhwc->niwc", rows, stack.astype(float), optimize=True)
    small = np.einsum("jw,niwc->nijc", cols, small, optimize=True)
    return np.clip(np.rint(small), 0, 255).astype(np.uint8)


def thumbnail(pixels: np.ndarray) -> np.ndarray:
    """(64, 64, C) uint8 thumbnail of an (H, W, C) uint8 image."""
    return thumbnails(pixels[None])[0]


def gradient(gray: np.ndarray) -> np.ndarray:
    """Sobel magnitude of (..., H, W) planes, borders mirrored."""
    edge = [(0, 0)] * (gray.ndim - 2) + [(1, 1), (1, 1)]
    p = np.pad(gray.astype(float), edge, mode="symmetric")
    smooth_rows = p[..., :-2, :] + 2 * p[..., 1:-1, :] + p[..., 2:, :]
    smooth_cols = p[..., :, :-2] + 2 * p[..., :, 1:-1] + p[..., :, 2:]
    return np.hypot(smooth_rows[..., :, 2:] - smooth_rows[..., :, :-2], smooth_cols[..., 2:, :] - smooth_cols[..., :-2, :])


THUMB_FEATURES = T.StructType(
    [
        T.StructField("log10_unique_colors", T.DoubleType()),
        T.StructField("mean_sobel", T.DoubleType()),
        T.StructField("edge_density", T.DoubleType()),
    ]
)


def features_stack(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of (N, H, W, C) images whose channels are in RGB(A) order: log10 of the thumbnail's
    distinct colours, mean gradient, and share of pixels whose gradient is above 32."""
    small = thumbnails(stack)
    n, channels = len(small), small.shape[3]
    packed = sum(small[..., c].astype(np.int64) << (8 * c) for c in range(channels)).reshape(n, -1)
    colors = 1 + (np.diff(np.sort(packed, 1), axis=1) != 0).sum(1)
    # Luma in 16-bit fixed point.
    gray = small[..., 0].astype(np.int64) if channels < 3 else (small[..., :3].astype(np.int64) @ np.array([19595, 38470, 7471]) + 32768) >> 16
    edges = gradient(gray)
    return np.log10(colors), edges.mean((1, 2), dtype=float), (edges > 32.0).mean((1, 2))


def features_of(pixels: np.ndarray) -> tuple[float, float, float]:
    """Features of one (H, W, C) image."""
    return tuple(float(x[0]) for x in features_stack(pixels[None]))


@F.arrow_udf(THUMB_FEATURES)
def thumbnail_features(height: pa.Array, width: pa.Array, channels: pa.Array, data: pa.Array) -> pa.Array:
    """Colour and edge features of images from Spark's image source (BGR(A) bytes, one, three or four
    channels); NULL for others."""
    out, known = np.zeros((3, len(data))), np.zeros(len(data), bool)
    for rows, (_, _, c), (images,) in stacks([height, width, channels], data, work=lambda h, w, c: THUMB * max(THUMB, w) * c):
        if c in (1, 3, 4):
            rgb = images if c == 1 else images[..., [2, 1, 0, *range(3, c)]]
            out[:, rows], known[rows] = features_stack(rgb), True
    return pa.StructArray.from_arrays([pa.array(x, mask=~known) for x in out], names=THUMB_FEATURES.fieldNames())
