"""Estimates: strategies, every fallback reason, formulas against numpy, extrapolation rules."""

import math

import numpy as np
import pytest
from blobs import jpeg, png_head
from pyspark.sql import functions as F

from pixelyard import constants as K
from pixelyard.functions import formats as FF
from pixelyard.functions import jpeg as FJ
from pixelyard.functions.pixels import features_of, gradient, thumbnail
from pixelyard.operators import estimate as E
from pixelyard.operators import outcomes as O
from pixelyard.plans.assets import estimate_assets


def predict(model, x):
    a = (np.array([x[f] for f in model["features"]]) - model["scaler"]["mean"]) / model["scaler"]["scale"]
    y = model["coefficients"]["intercept"] + float(np.dot(a, model["coefficients"]["betas"]))
    return y + sum(model["coefficients"][k] * max(0.0, x[f] - at) for k, (f, at) in model["knots"].items())


def png_rows(spark, rows):
    df = spark.createDataFrame([(bytearray(b), n, q) for b, n, q in rows], "content binary, length bigint, quality int")
    return E.png_header_bpp(df.withColumn("header", FF.png_header("content"))).collect()


def test_png_header_model(spark):
    out = png_rows(spark, [(png_head(1000, 800, color=6), 500_000, 60), (png_head(1000, 800, color=2), 900_000, 40), (png_head(1000, 800), 600_000, 75)])
    for r, (size, q, alpha) in zip(out, [(500_000, 60, 1.0), (900_000, 40, 0.0), (600_000, 75, 1.0)]):
        x = {"has_alpha": alpha, "quality": q, "log10_orig_pixels": math.log10(800_000), "input_bpp": size * 8 / 800_000}
        want = predict(K.PNG_HEADER_MODEL, x)
        ratio = want / x["input_bpp"]
        if (0.05 if q < 50 else 0.1 if q < 70 else 0.4) <= ratio <= 1.1:
            assert r["bpp"] == pytest.approx(want, rel=1e-12) and r["fallback_reason"] is None
        else:
            assert r["bpp"] is None and r["fallback_reason"] == "prediction_oob"


def test_png_fallback_reasons(spark):
    out = png_rows(spark, [(b"x", 9, 60), (png_head(10001, 10000), 10**7, 60), (png_head(10, 10), 100_000, 60), (png_head(10, 10), 0, 60), (png_head(1000, 1000), 20, 60)])
    assert [r["fallback_reason"] for r in out] == ["header_parse_error", "feature_oob", "feature_oob", "feature_oob", "prediction_oob"]
    df = spark.createDataFrame([(bytearray(png_head()), 5000, 60)], "content binary, length bigint, quality int").withColumn("header", FF.png_header("content"))
    assert E.png_header_bpp(df, model=None).first()["fallback_reason"] == "model_load_failed"


def jpeg_rows(spark, rows):
    df = spark.createDataFrame([(bytearray(b), n, q, True) for b, n, q in rows], "content binary, length bigint, quality int, progressive_jpeg boolean")
    return E.jpeg_header_bpp(df.withColumn("header", FJ.jpeg_header("content"))).collect()


def test_jpeg_header_model_and_reasons(spark):
    big = jpeg(2000, 1500)
    rows = [
        (big, 600_000, 60), (b"zz", 10, 60), (jpeg(sof=0xC3), 10, 60), (jpeg(sampling=(0x11,) * 4), 10, 60), (jpeg(adobe=2), 10, 60), (jpeg(chroma=False), 10, 60),
        (jpeg(20000, 6000), 10**7, 60), (jpeg(100, 100), 10**6, 60), (jpeg(2000, 1500, luma=[16] * 64), 600_000, 60), (big, 90_000, 75), (big[:140], 600_000, 60),
    ]
    out = jpeg_rows(spark, rows)
    luma, chroma = np.array(FJ.read_header(big)["dqt_luma"]), np.array(FJ.read_header(big)["dqt_chroma"])
    x = dict(zip(K.JPEG_HEADER_MODEL["features"], [60, 85, 1.0, 0, 0, 1, 1, math.log10(3e6), 1.6, luma.mean(), luma.std(), chroma.mean(), chroma.std()]))
    assert out[0]["bpp"] == pytest.approx(predict(K.JPEG_HEADER_MODEL, x), rel=1e-9) and out[0]["fallback_reason"] is None
    assert [r["fallback_reason"] for r in out[1:]] == [
        "header_parse_error", "lossless_jpeg", "non_standard_components", "non_default_color_transform", "missing_chroma_table", "feature_oob", "feature_oob",
        "custom_quantization", "prediction_oob", "header_parse_error",
    ]


@pytest.mark.parametrize(
    ("args", "plain", "fitted"),
    [
        (("svg", None, 10, 1), "exact", "exact"), (("gif", 10**6, 10, 1), "exact", "exact"), (("webp", 10**6, 10**6, 2), "exact", "exact"),
        (("bmp", 150_000, 10**6, 1), "exact", "exact"), (("bmp", 150_001, 10**6, 1), "generic_fallback_sample", "generic_fallback_sample"),
        (("png", 10**6, 249_999, 1), "exact", "exact"), (("png", 10**6, 250_000, 1), "direct_encode_sample", "png_header_only"),
        (("png", 10**8, 1_048_576, 1), "exact", "png_header_only"), (("jpeg", 10**6, 10**6, 1), "exact", "exact"), (("jpeg", 10**6, 1_000_001, 1), "direct_encode_sample", "jpeg_header_only"),
        (("tiff", 10**6, 10, 1), "direct_encode_sample", "direct_encode_sample"), (("jxl", 10**6, 10, 1), "generic_fallback_sample", "generic_fallback_sample"), ((None, 1, 1, 1), None, None),
    ],
)
def test_strategy(spark, args, plain, fitted):
    df = spark.createDataFrame([args], "f string, px bigint, n bigint, fr int")
    r = df.select(E.estimate_strategy("f", "px", "n", "fr").alias("a"), E.estimate_strategy("f", "px", "n", "fr", fitted=True).alias("b")).first()
    assert (r["a"], r["b"]) == (plain, fitted)


def test_plausibility(spark):
    rows = [(float("nan"), 1.0, 60), (float("inf"), 1.0, 60), (None, 1.0, 60), (0.0009, 1.0, 60), (33.0, 40.0, 60), (0.04, 1.0, 40), (0.06, 1.0, 40), (0.09, 1.0, 60), (0.39, 1.0, 75), (1.11, 1.0, 75), (1.1, 1.0, 75), (5.0, 0.0, 60)]
    df = spark.createDataFrame(rows, "b double, i double, q int").select(E.plausible(F.col("b"), F.col("i"), F.col("q"), "prediction_disagreement").alias("r"))
    p, d = "prediction_oob", "prediction_disagreement"
    assert [r["r"] for r in df.collect()] == [p, p, p, p, p, d, None, d, d, d, None, None]


def test_extrapolation_rules(spark):
    rows = [
        ("jpeg", 2400, 1600, 10**6, 96_000, "x", 60, True, None), ("jpeg", 2400, 1600, 10**6, 96_000, "x", 60, True, 20.0), ("heic", 2400, 1600, 10**6, 50_000, "x", 60, True, 20.0),
        ("tiff", 2400, 1600, 10**6, 80_000, "tiff_lzw", 75, True, None), ("tiff", 2400, 1600, 10**6, 80_000, "tiff_jpeg", 60, True, None),
        ("png", 1000, 1000, 2_000_000, 500_000, "oxipng", 75, True, None), ("png", 1000, 1000, 2_000_000, 500_000, "x", 60, True, None), ("webp", 100, 1, 10, 10**6, "x", 60, True, None),
        ("png", 1000, 1000, 2_000_000, None, None, 60, True, None),
    ]
    df = spark.createDataFrame(rows, "format string, width int, height int, length bigint, sample_size bigint, sample_method string, quality int, png_lossy boolean, max_reduction double")
    out = E.extrapolate(df).collect()
    assert out[0]["estimated_size"] == int(96_000 * 8 / (1200 * 800) * 2400 * 1600 / 8) and out[0]["reduction"] == 61.6
    assert (out[1]["estimated_size"], out[1]["reduction"]) == (800_000, 20.0)
    assert out[2]["reduction"] > 20
    bpp = 80_000 * 8 / (800 * 533)
    assert out[3]["estimated_size"] == int(bpp / (1 + 0.35 * math.log(3)) * 2400 * 1600 / 8)
    assert out[4]["estimated_size"] == int(bpp * 2400 * 1600 / 8)
    assert (out[5]["estimated_size"], out[5]["reduction"]) == (1_900_000, 5.0) and out[6]["reduction"] > 5
    assert (out[7]["estimated_size"], out[7]["reduction"]) == (10, 0.0)
    assert out[8]["estimated_size"] is None and out[8]["reduction"] is None


def test_thumbnail_and_untouched_sample(spark):
    df = spark.createDataFrame([(4_000_000, 20_000_000, 40_000, 5_000, "x"), (4_000_000, 20_000_000, 40_000, 5_000, "none")], "pixels bigint, length bigint, thumb_pixels bigint, thumb_size bigint, thumb_method string")
    a, b = E.estimate_from_thumbnail(df).collect()
    assert (a["estimated_size"], a["reduction"], a["confidence"], a["path"]) == (500_000, 97.5, "medium", "direct_encode_sample")
    assert (b["estimated_size"], b["reduction"]) == (20_000_000, 0.0)


def test_assets_end_to_end(spark):
    rows = [("png", png_head(3000, 2000, color=2), 4_000_000), ("small", png_head(100, 100), 5_000), ("jpeg", jpeg(3000, 2000), 2_000_000), ("big", b"BM" + b"\0" * 40, 40_000_000), ("odd", b"zzzz", 10)]
    df = spark.createDataFrame([(k, bytearray(b), n) for k, b, n in rows], "path string, content binary, length bigint")
    samples = spark.createDataFrame([("small", "exact", 2_000, "oxipng", 10_000), ("jpeg", "sample", 9, "x", 9)], "path string, kind string, optimized_size bigint, method string, sample_pixels bigint")
    out = {r[0]: r for r in estimate_assets(df, quality=60, samples=samples).collect()}
    assert out["png"]["estimated_optimized_size"] < 4_000_000 and out["png"]["method"] == "png_header_only" and out["png"]["confidence"] == "medium"
    assert out["small"]["estimated_optimized_size"] == 2_000 and out["small"]["estimated_reduction_percent"] == 60.0 and out["small"]["optimization_potential"] == "high"
    assert out["big"]["error_code"] == "file_too_large" and out["odd"]["error_code"] == "unsupported_format"
    assert out["big"]["estimated_optimized_size"] is None and out["odd"]["already_optimized"] is None
    assert len(out) == len(rows)


def test_never_larger_best_and_cap(spark):
    df = spark.createDataFrame([(100, 100, "a"), (100, 99, "a"), (100, 250, "a"), (3, 2, "b")], "original_size int, optimized_size int, method string")
    out = O.never_larger(df).collect()
    assert [(r["optimized_size"], r["reduction_percent"], r["method"]) for r in out] == [(100, 0.0, "none"), (99, 1.0, "a"), (100, 0.0, "none"), (2, 33.3, "b")]
    cands = spark.createDataFrame([(1, 0, 50, "x"), (1, 1, 50, "y"), (1, 2, 60, "z"), (2, 0, None, "x")], "k int, ord int, size int, method string").withColumn("original_size", F.lit(70))
    best = {r["k"]: (r["optimized_size"], r["method"]) for r in O.best_candidate(cands, ["k"]).collect()}
    assert best == {1: (50, "x"), 2: (70, "none")}
    ladder = spark.createDataFrame([(1, q, 100 - 60 + q // 2) for q in range(0, 101, 10)] + [(2, 90, 10)], "k int, quality int, size int").withColumn("original_size", F.lit(100))
    cap = {r["k"]: (r["quality"], r["size"]) for r in O.cap_reduction(ladder, ["k"], 31).collect()}
    assert cap == {1: (60, 70), 2: (None, None)}


def test_thumbnail_kernels():
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, (130, 200, 3), dtype=np.uint8)
    assert thumbnail(img).shape == (64, 64, 3)
    flat = np.full((90, 70, 3), 77, np.uint8)
    assert (thumbnail(flat) == 77).all() and features_of(flat) == (0.0, 0.0, 0.0)
    same = rng.integers(0, 256, (64, 64, 3), dtype=np.uint8)
    assert (thumbnail(same) == same).all()
    g = rng.integers(0, 256, (9, 9)).astype(float)
    p = np.pad(g, 1, mode="symmetric")
    kx = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    want = np.array([[np.hypot((p[i : i + 3, j : j + 3] * kx).sum(), (p[i : i + 3, j : j + 3] * kx.T).sum()) for j in range(9)] for i in range(9)])
    assert np.allclose(gradient(g), want, rtol=1e-5)
