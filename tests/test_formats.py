"""Detection, headers, containers: every branch, and never a failed task on bad bytes."""

import gzip
import random

import numpy as np
import pytest
from blobs import avif, box, chunk, gif, jpeg, png_head, png_image, quality_table
from pyspark.sql import functions as F

from pixelyard import constants as K
from pixelyard.functions import formats as FF
from pixelyard.functions import jpeg as FJ
from pixelyard.functions.containers import walk
from pixelyard.operators import containers as OC
from pixelyard.operators.screening import skip_gate_avif
from pixelyard.plans.assets import estimate_assets, identify


def frame(spark, blobs):
    return spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blobs)], "path int, content binary")


ACTL = png_head() + chunk(b"acTL", b"\0\0\0\7\0\0\0\0") + chunk(b"IDAT", b"x")
LATE = png_head() + chunk(b"tEXt", b"acTL") + chunk(b"IDAT", b"x") + chunk(b"acTL", b"\0" * 8)
CASES = [
    (b"\xff\x0a\0\0", "jxl"), (b"\0\0\0\x0cJXL \r\n\x87\n", "jxl"), (png_head(), "png"), (ACTL, "apng"), (LATE, "png"),
    (b"\xff\xd8\xff\xe0", "jpeg"), (b"GIF87a", "gif"), (b"GIF89a..", "gif"), (b"RIFF1234WEBPVP8 ", "webp"), (b"RIFF1234WAVE", None),
    (b"BM12", "bmp"), (b"II*\0", "tiff"), (b"MM\0*", "tiff"), (box(b"ftyp", b"avis\0\0\0\0"), "avif"), (box(b"ftyp", b"heix\0\0\0\0"), "heic"),
    (box(b"ftyp", b"jxl \0\0\0\0"), "jxl"), (box(b"ftyp", b"isom\0\0\0\0mp42mif1avif"), "heic"), (box(b"ftyp", b"isom\0\0\0\0mp42"), None),
    (box(b"ftyp", b"isom\0\0\0\0") + b"avif", None), (gzip.compress(b"<svg/>"), "svgz"), (gzip.compress(b"text"), None), (b"\x1f\x8b\0\0broken", None),
    (b"\xef\xbb\xbf \n<?xml version='1.0'?>", "svg"), (b" " * 3000 + b"<SVG>", "svg"), (b"<html>", None), (b"abc", None), (b"", None), (b"%PDF-1", None),
]


def test_detect_format_branches(spark):
    out = frame(spark, [b for b, _ in CASES]).select("path", FF.detect_format("content").alias("f")).collect()
    assert {r["path"]: r["f"] for r in out} == {i: f for i, (_, f) in enumerate(CASES)}


def test_heads_only_detection_stays_in_the_jvm(spark):
    df = frame(spark, [png_head(), gzip.compress(b"<svg/>")]).select(FF.detect_format("content", deep=False).alias("f"))
    assert [r["f"] for r in df.collect()] == ["png", None]
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


GOOD = [(200, 150, 8, 2), (64, 64, 8, 6), (32, 32, 8, 0), (10, 10, 8, 4), (256, 256, 8, 3), (1, 1, 1, 0), (5, 5, 16, 2), (2**31 - 1, 1, 8, 2)]
BAD = [
    png_head()[:32], png_head(sig=b"\x89PNG\r\n\x1a\0"), png_head(kind=b"IDAT"), png_head(length=14), png_head(color=1), png_head(color=5),
    png_head(depth=3), png_head(width=0), png_head(height=0), png_head(width=2**31), b"", b"\0" * 64,
]


def test_png_header(spark):
    rows = frame(spark, [png_head(*g) for g in GOOD]).select("path", FF.png_header("content").alias("h")).collect()
    for r in rows:
        w, h, d, c = GOOD[r["path"]]
        assert tuple(r["h"]) == (w, h, d, c, c in (4, 6), c == 3)
    bad = frame(spark, BAD).select(FF.png_header("content").alias("h")).collect()
    assert all(r["h"] is None for r in bad)


def test_jpeg_variants():
    h = FJ.read_header(jpeg())
    assert (h["width"], h["height"], h["components"], h["subsampling"], h["progressive"], h["fallback_reason"]) == (640, 480, 3, "4:2:0", False, None)
    assert FJ.read_header(jpeg(sampling=(0x11, 0x11, 0x11), sof=0xC2))["progressive"]
    assert FJ.read_header(jpeg(sampling=(0x21, 0x11, 0x11)))["subsampling"] == "4:2:2"
    assert FJ.read_header(jpeg(sampling=(0x41, 0x11, 0x11)))["subsampling"] == "other"
    assert FJ.read_header(jpeg(sampling=(0x11,), chroma=False))["subsampling"] == "grayscale"
    assert FJ.read_header(jpeg(sof=0xC3))["fallback_reason"] == "lossless_jpeg"
    assert FJ.read_header(jpeg(sampling=(0x11,) * 4))["fallback_reason"] == "non_standard_components"
    assert FJ.read_header(jpeg(adobe=2))["fallback_reason"] == "non_default_color_transform"
    assert FJ.read_header(jpeg(adobe=1))["fallback_reason"] is None
    assert FJ.read_header(jpeg(chroma=False))["fallback_reason"] == "missing_chroma_table"
    assert FJ.read_header(jpeg(sampling=(0x11,) * 4, adobe=2))["fallback_reason"] == "non_default_color_transform"


def test_jpeg_broken_inputs():
    blob = jpeg()
    assert FJ.read_header(blob[:100]) is None  # no frame header yet
    assert FJ.read_header(b"\0" * 200) is None and FJ.read_header(b"") is None and FJ.read_header(None) is None
    assert FJ.read_header(b"\xff\xd8\xff\xdb\0\1") is None
    assert FJ.read_header(jpeg(width=0)) is None
    rng = random.Random(5)
    for _ in range(300):
        FJ.read_header(b"\xff\xd8" + rng.randbytes(rng.randrange(400)))
        walk(rng.choice([b"\xff\xd8", b"\x89PNG\r\n\x1a\n", b"GIF89a", b"\0\0\0\x10ftyp"]) + rng.randbytes(rng.randrange(200)))


def test_source_quality(spark):
    rows = [(q, quality_table(K.ANNEX_K_LUMA, q), quality_table(K.ANNEX_K_CHROMA, q) if q % 2 else None) for q in range(1, 101)]
    rows += [(200, [16] * 64, None), (201, [0] * 64, None), (202, None, None), (203, [1, 2], None)]
    df = spark.createDataFrame(rows, "q int, luma array<int>, chroma array<int>")
    out = {r["q"]: r["s"] for r in df.select("q", FJ.source_quality("luma", "chroma").alias("s")).collect()}
    for q in range(2, 100):
        assert (out[q]["q"], out[q]["nse"]) == (q, 1.0)
    assert out[1]["nse"] == 0 and out[100]["nse"] == 0 and out[200]["nse"] < 0.85 and out[201]["nse"] == 0
    assert out[202]["q"] is None and out[203]["q"] is None
    # A table between two qualities matches the brute-force minimum, lowest on ties.
    odd = [v + (i % 3) for i, v in enumerate(quality_table(K.ANNEX_K_LUMA, 62))]
    errors = [sum((a - b) ** 2 for a, b in zip(quality_table(K.ANNEX_K_LUMA, q), odd)) for q in range(1, 101)]
    got = spark.createDataFrame([(odd,)], "l array<int>").select(FJ.source_quality("l", F.lit(None).cast("array<int>")).alias("s")).first()["s"]
    assert got["q"] == int(np.argmin(errors)) + 1
    assert got["nse"] == pytest.approx(1 - min(errors) / sum((v - np.mean(odd)) ** 2 for v in odd))


def test_segments_and_what_follows(spark):
    pngs = [ACTL, LATE, png_head() + chunk(b"tEXt", b"abc") + chunk(b"iCCP", b"12345") + chunk(b"IDAT", b"x" * 9) + chunk(b"IEND")]
    df = frame(spark, [*pngs, gif(), gif(local_table=True, frames=2), avif(), b"nothing"])
    segs = OC.container_segments(df).cache()
    kinds = lambda p: [r["kind"] for r in segs.where(F.col("path") == p).orderBy("seq").collect()]
    assert kinds(2) == ["IHDR", "tEXt", "iCCP", "IDAT", "IEND"]
    assert kinds(3) == ["screen"] + ["extension", "image"] * 3 + ["trailer"]
    assert kinds(5) == ["ftyp", "meta", "iprp", "ipco", "colr", "ispe", "Exif", "mdat"] and kinds(6) == []
    a = {r["path"]: r for r in OC.animation_stats(segs).collect()}
    assert (a[0]["is_apng"], a[0]["frames"], a[0]["pixel_frames"]) == (True, 7, 64 * 64 * 7)
    assert not a[1]["is_apng"] and a[1]["frames"] == 1
    assert (a[3]["frames"], a[3]["pixel_frames"], a[4]["frames"]) == (3, 150, 2)
    strip = {r["path"]: r["strippable"] for r in OC.strippable_bytes(segs).collect()}
    assert strip[2] == 15 and strip[5] == 608
    assert {r["path"]: r["strippable"] for r in OC.strippable_bytes(segs, keep_icc=False).collect()}[2] == 15 + 17
    size = {r["path"]: (r["width"], r["height"]) for r in OC.image_extent(segs).collect()}
    assert size[5] == (320, 200)
    segs.unpersist()


def test_truncated_containers_stop():
    assert [s[1] for s in walk(avif()[:-10])] == ["ftyp", "meta", "iprp", "ipco", "colr", "ispe", "Exif"]
    assert [s[1] for s in walk(gif()[:-3])][-1] == "image"
    assert walk(None) == []


def test_strip_png_text(spark):
    text, rest = chunk(b"tEXt", b"abc"), chunk(b"IDAT", b"zz") + chunk(b"IEND")
    partial = png_head() + text + chunk(b"iCCP", b"1") + b"\0\0\0\xffIDATxx"
    out = OC.strip_png_text(frame(spark, [png_head() + text + rest, partial, b"GIF89a", png_head() + rest])).orderBy("path").collect()
    assert bytes(out[0]["content"]) == png_head() + rest
    assert bytes(out[1]["content"]) == png_head() + chunk(b"iCCP", b"1") + b"\0\0\0\xffIDATxx"
    assert bytes(out[2]["content"]) == b"GIF89a" and bytes(out[3]["content"]) == png_head() + rest
    no_icc = OC.strip_png_text(frame(spark, [partial]), keep_icc=False).first()["content"]
    assert bytes(no_icc) == png_head() + b"\0\0\0\xffIDATxx"


def test_avif_gate(spark):
    rows = [(40, 100, 100, 10, 0, True, False), (60, 0, 9, 10, 0, True, False), (60, 100, 100, 600, 0, True, True), (60, 100, 100, 700, 0, True, False),
            (75, 100, 100, 9, 499, True, True), (75, 100, 100, 9, 500, True, False), (75, 100, 100, 9, 9000, False, True), (60, None, None, 9, 0, True, False)]
    df = spark.createDataFrame(rows, "q int, w int, h int, n int, m int, s boolean, want boolean")
    got = df.select(skip_gate_avif("q", "w", "h", "n", "m", "s").alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_identify_and_estimate_random_bytes(spark):
    rng = random.Random(9)
    blobs = [rng.randbytes(rng.randrange(80)) for _ in range(60)] + [png_image([[(1, 2, 3)] * 4] * 3), jpeg(), gif(), b"BM" + b"\0" * 16 + b"\7\0\0\0\5\0\0\0"]
    df = frame(spark, blobs).withColumn("length", F.length("content").cast("bigint"))
    known = {r["path"]: r for r in identify(df).collect()}
    assert (known[60]["format"], known[60]["width"], known[60]["height"], known[60]["mode"]) == ("png", 4, 3, "RGB")
    assert (known[61]["width"], known[62]["width"], known[63]["height"]) == (640, 10, 5)
    assert estimate_assets(df).count() == len(blobs)


def test_only_the_head_of_a_gzip_stream_is_unpacked():
    import gzip
    import tracemalloc

    from pixelyard.functions.formats import _looks_like_svg, _unpacked_head

    bomb = gzip.compress(b" \n" * 20 + b"<svg>" + b"\0" * 200_000_000, 9)
    tracemalloc.start()
    assert _looks_like_svg(_unpacked_head(bomb))
    assert tracemalloc.get_traced_memory()[1] < 1_000_000
    tracemalloc.stop()
    for text in (b"", b"<", b"<sv", b"\xef\xbb\xbf <SVG/>", b"\xef\xbb\xbf", b"<?xml ?>", b"plain text", b" " * 9000 + b"<svg/>"):
        assert _looks_like_svg(_unpacked_head(gzip.compress(text))) == _looks_like_svg(text)
        assert _looks_like_svg(_unpacked_head(gzip.compress(text[:2]) + gzip.compress(text[2:]))) == _looks_like_svg(text)
