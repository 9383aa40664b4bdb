"""Queries over small images made from embeddings: quality, thumbnails, fitted estimates, decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelyard import constants as K
from pixelyard.operators import estimate
from pixelyard.operators import quality as Q
from pixelyard.plans.scale import scratch_path
from pixelyard.sources import assets
from pixelyard.sources.files import write_files
from pixelyard.sources.tables import read_table
from pixelyard.workload import frames as W
from pixelyard.workload.assets import predict_sql
from pixelyard.workload.registry import query
from pixelyard.workload.statistics import _patches

# --- SSIM --------------------------------------------------------------------------------------

#: Windows of 11 x 11 pixels over 8 x 8 patches whose borders are reflected; the first row and column of windows is left out.
_SSIM = """WITH pairs AS (SELECT a.vec_id, list_transform(a.embedding, lambda x: (CAST(x AS DOUBLE) + 8) / 16) AS ref, list_transform(b.embedding, lambda x: (CAST(x AS DOUBLE) + 8) / 16) AS dist
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
 side AS (SELECT w, CASE WHEN p < 5 THEN 5 - p WHEN p < 13 THEN p - 5 ELSE 19 - p END AS i FROM (SELECT w, w + unnest(range(11)) AS p FROM range(1, 8) t(w))),
 cells AS (SELECT y.w AS wy, x.w AS wx, y.i * 8 + x.i + 1 AS pos FROM side y, side x),
 sums AS (SELECT vec_id, wy, wx, avg(ref[pos]) AS ma, avg(dist[pos]) AS mb, avg(ref[pos] * ref[pos]) AS aa, avg(dist[pos] * dist[pos]) AS bb, avg(ref[pos] * dist[pos]) AS ab
  FROM pairs, cells GROUP BY ALL)
 SELECT vec_id, avg((2 * ma * mb + 0.0001) * (2 * (ab - ma * mb) + 0.0009) / ((ma * ma + mb * mb + 0.0001) * (aa - ma * ma + bb - mb * mb + 0.0009))) AS ssim FROM sums GROUP BY vec_id"""


@query("ssim_pairs", _SSIM, rounded="ssim")
def _(spark, folder):
    """Each 8x8 patch against the next one, with 11x11 windows."""
    pairs = _patches(spark, folder).withColumns({"height": F.lit(8), "width": F.lit(8), "channels": F.lit(1)})
    return Q.ssim_pairs(pairs).select("vec_id", "ssim")


# --- thumbnails ---------------------------------------------------------------------------------


def _hex(values):
    return F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("bigint")), 2, "0")), "")


def _level(x):
    """A byte from an embedding's component."""
    return F.least(F.greatest(F.floor((x.cast("double") + 0.6) * 212), F.lit(0)), F.lit(255)).cast("bigint")


def small_images(spark, folder):
    """Every embedding as an 8x8 image of one, three or four channels (vec_id % 3) in blue, green, red, alpha order."""
    e = read_table(spark, folder, "embeddings")
    kind = F.col("vec_id") % 3
    levels = F.transform("embedding", _level)

    def pixel(v):
        grey = F.array(v)
        rgb = F.array(255 - v, v * 3 % 256, v)
        return F.when(kind == 0, grey).when(kind == 1, rgb).otherwise(F.concat(rgb, F.array(v * 7 % 256)))

    data = F.unhex(_hex(F.flatten(F.transform(levels, pixel))))
    image = F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.element_at(F.array(F.lit(1), F.lit(3), F.lit(4)), (kind + 1).cast("int")).alias("nChannels"), data.alias("data"))
    return e.select("vec_id", (F.col("vec_id") * 7 % 600 + 20).alias("length"), W.pick([40, 60, 75], F.col("vec_id") % 4 % 3).alias("quality"), image.alias("image"))


_LEVELS = """SELECT vec_id, vec_id % 3 AS kind, unnest(range(64)) AS pos, CAST(least(greatest(floor((CAST(unnest(embedding) AS DOUBLE) + 0.6) * 212), 0), 255) AS BIGINT) AS v FROM embeddings"""
#: The three-lobed windowed sinc from 8 to 64 positions, normalised; then both axes, rounding, and the gradient with mirrored borders.
_FEATURES = f"""WITH levels AS ({_LEVELS}),
 pixels AS (SELECT vec_id, kind, pos // 8 AS y, pos % 8 AS x, 0 AS c, v FROM levels
  UNION ALL SELECT vec_id, kind, pos // 8, pos % 8, 1, v * 3 % 256 FROM levels WHERE kind > 0
  UNION ALL SELECT vec_id, kind, pos // 8, pos % 8, 2, 255 - v FROM levels WHERE kind > 0
  UNION ALL SELECT vec_id, kind, pos // 8, pos % 8, 3, v * 7 % 256 FROM levels WHERE kind = 2),
 lobes AS (SELECT i, s, CASE WHEN abs(d) >= 3 THEN 0 WHEN d = 0 THEN 1 ELSE sin(pi() * d) / (pi() * d) * sin(pi() * d / 3) / (pi() * d / 3) END AS w
  FROM (SELECT i, s, s + 0.5 - (i + 0.5) * 0.125 AS d FROM range(64) a(i), range(8) b(s))),
 taps AS (SELECT i, s, w / sum(w) OVER (PARTITION BY i) AS w FROM lobes),
 tall AS (SELECT vec_id, kind, c, i, x, sum(v * w) AS v FROM pixels JOIN taps ON s = y GROUP BY ALL),
 thumb AS (SELECT vec_id, kind, c, t.i AS y, taps.i AS x, CAST(least(greatest(round_even(sum(v * w), 0), 0), 255) AS BIGINT) AS v FROM tall t JOIN taps ON s = x GROUP BY ALL),
 colour AS (SELECT vec_id, kind, y, x, coalesce(max(v) FILTER (WHERE c = 0), 0) AS r, coalesce(max(v) FILTER (WHERE c = 1), 0) AS g, coalesce(max(v) FILTER (WHERE c = 2), 0) AS b, coalesce(max(v) FILTER (WHERE c = 3), 0) AS a
  FROM thumb GROUP BY ALL),
 grey AS (SELECT *, CASE WHEN kind = 0 THEN r ELSE (r * 19595 + g * 38470 + b * 7471 + 32768) >> 16 END AS l FROM colour),
 plane AS (SELECT vec_id, list(l ORDER BY y, x) AS l, count(DISTINCT r + 256 * g + 65536 * b + 16777216 * a) AS colours FROM grey GROUP BY vec_id),
 around AS (SELECT vec_id, colours, l, greatest(y - 1, 0) * 64 + 1 AS u, y * 64 + 1 AS m, least(y + 1, 63) * 64 + 1 AS o, greatest(x - 1, 0) AS p, x AS q, least(x + 1, 63) AS n FROM plane, range(64) a(y), range(64) b(x)),
 edges AS (SELECT vec_id, colours, sqrt(pow(l[u + n] + 2 * l[m + n] + l[o + n] - l[u + p] - 2 * l[m + p] - l[o + p], 2) + pow(l[o + p] + 2 * l[o + q] + l[o + n] - l[u + p] - 2 * l[u + q] - l[u + n], 2)) AS e FROM around),
 image AS (SELECT vec_id, log10(any_value(colours)) AS log10_unique_colors, avg(e) AS mean_sobel, avg(CAST(e > 32 AS DOUBLE)) AS edge_density FROM edges GROUP BY vec_id),
 facts AS (SELECT vec_id, vec_id * 7 % 600 + 20 AS length, ([40,60,75])[vec_id % 4 % 3 + 1] AS quality, CAST(vec_id % 3 = 2 AS DOUBLE) AS has_alpha, (vec_id * 7 % 600 + 20) * 8.0 / 64 AS input_bpp FROM embeddings)
 SELECT * FROM facts JOIN image USING (vec_id)"""
_NAMES = ["has_alpha", "log10_unique_colors", "mean_sobel", "edge_density", "quality", "log10_orig_pixels", "input_bpp"]


@query(
    "png_features",
    f"SELECT vec_id, 64 AS pixels, {', '.join(f'CASE WHEN input_bpp <= 64 THEN {n} END AS {n}' for n in _NAMES)} FROM (SELECT *, log10(64) AS log10_orig_pixels FROM ({_FEATURES}))",
    rounded=" ".join(n for n in _NAMES),
)
def _(spark, folder):
    """Thumbnail features of 8x8 images; those of more than 64 bits a pixel have none."""
    return estimate.png_features(small_images(spark, folder)).select("vec_id", "pixels", *_NAMES)


_THUMB_BPP = f"""SELECT vec_id, raw, CASE WHEN input_bpp > 64 THEN 'mode_unsupported_or_oob' WHEN raw < 0.001 OR raw > 32 THEN 'prediction_oob'
 WHEN raw / input_bpp < CASE WHEN quality < 50 THEN 0.05 WHEN quality < 70 THEN 0.10 ELSE 0.40 END OR raw / input_bpp > 1.1 THEN 'prediction_disagreement' END AS fallback_reason
 FROM (SELECT *, {predict_sql(K.PNG_THUMBNAIL_MODEL, {n: n for n in _NAMES})} AS raw FROM (SELECT *, log10(64) AS log10_orig_pixels FROM ({_FEATURES})))"""


@query("png_fitted_bpp", f"SELECT vec_id, CASE WHEN fallback_reason IS NULL THEN raw END AS bpp, fallback_reason FROM ({_THUMB_BPP})", rounded="bpp")
def _(spark, folder):
    """The fitted model on those features, with its plausibility checks."""
    return estimate.png_fitted_bpp(estimate.png_features(small_images(spark, folder))).select("vec_id", "bpp", "fallback_reason")


# --- decoding -----------------------------------------------------------------------------------


def bitmaps(spark, folder):
    """Every embedding as an 8x8 bitmap file of three channels; one in eleven is cut after its header."""
    e = read_table(spark, folder, "embeddings")
    # 54 bytes of header: sizes and offsets are little-endian, rows go from the bottom up.
    header = "424DF6000000000000003600000028000000080000000800000001001800" + "00000000C0000000" + "00" * 16
    row = lambda y: F.flatten(F.transform(F.slice("levels", y * 8 + 1, 8), lambda v: F.array(255 - v, v * 3 % 256, v)))
    rows = F.flatten(F.transform(F.sequence(F.lit(7), F.lit(0)), row))
    body = F.when(F.col("vec_id") % 11 == 0, "").otherwise(_hex(rows))
    made = e.select("vec_id", F.transform("embedding", _level).alias("levels")).withColumn("content", F.unhex(F.concat(F.lit(header), body)))
    return made.select(F.concat(F.lit("v"), F.col("vec_id"), F.lit(".bmp")).alias("name"), "content")


@query(
    "decode_pixels",
    f"""SELECT 'v' || vec_id || '.bmp' AS name, vec_id % 11 <> 0 AS decoded, CASE WHEN vec_id % 11 <> 0 THEN 8 END AS height, CASE WHEN vec_id % 11 <> 0 THEN 8 END AS width,
 CASE WHEN vec_id % 11 <> 0 THEN 3 END AS channels, CASE WHEN vec_id % 11 <> 0 THEN sum((pos * 3 + 1) * (255 - v) + (pos * 3 + 2) * (v * 3 % 256) + (pos * 3 + 3) * v) END AS weighted
 FROM ({_LEVELS}) GROUP BY vec_id""",
)
def _(spark, folder):
    """Bitmap files written from rows and decoded again; every byte of the pixels is weighted by its place."""
    path = write_files(bitmaps(spark, folder), scratch_path(spark, "bitmaps"))
    out = assets.decode_pixels(spark, path, drop_invalid=False)
    pairs = F.sequence(F.lit(1), F.length("image.data"))
    value = lambda i: F.conv(F.hex(F.substring(F.col("image.data"), i, F.lit(1))), 16, 10).cast("bigint")
    weighted = F.when(F.col("decoded"), F.aggregate(pairs, F.lit(0).cast("bigint"), lambda s, i: s + i * value(i)))
    return out.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "decoded", "height", "width", "channels", weighted.alias("weighted"))
