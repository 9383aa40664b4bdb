"""Admission, URLs, markup, presets and encoder rules."""

import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from pixelyard import constants as K
from pixelyard.functions import text as X
from pixelyard.operators import screening as S


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_admission_first_rule_wins(spark):
    rows = [
        (33_554_432, "png", 10, 10, "RGB", 1, None, 200), (33_554_433, None, 99999, 99999, "RGB", 1, "file_too_large", 413),
        (5, None, 99999, 99999, "RGB", 1, "unsupported_format", 415), (5, "png", 10001, 10000, "L", 1, "image_too_large", 413),
        (5, "gif", 10, 10, "P", 501, "image_too_large", 413), (5, "gif", 10, 10, "P", 500, None, 200),
        (5, "tiff", 8192, 8192, "CMYK", 2, None, 200), (5, "tiff", 8193, 8192, "??", 2, "image_too_large", 413), (5, "svg", None, None, None, None, None, 200),
    ]
    df = spark.createDataFrame(rows, "length bigint, format string, width int, height int, mode string, frames int, want string, want_status int")
    out = S.admission(df).collect()
    assert [(r["error_code"], r["status"]) for r in out] == [(r["want"], r["want_status"]) for r in out]
    assert len(out) == len(rows)


URLS = [
    ("https://example.com/a.png", None), ("HTTPS://example.com", None), ("http://example.com", "scheme"), ("ftp://example.com", "scheme"), ("https:///x", "no_host"),
    ("not a url", "scheme"), ("https://metadata.google.internal/x", "blocked_host"), ("https://METADATA.google.internal./x", "blocked_host"),
    ("https://10.1.2.3/", "blocked_address"), ("https://user:pw@127.0.0.1:8443/x", "blocked_address"), ("https://172.15.0.1/", None), ("https://172.31.255.255/", "blocked_address"),
    ("https://172.32.0.0/", None), ("https://192.168.0.1#f", "blocked_address"), ("https://169.254.169.254/latest", "blocked_address"), ("https://0.1.2.3", "blocked_address"),
    ("https://8.8.8.8/", None), ("https://[::1]/", "blocked_address"), ("https://[fd12:3456::1]/", "blocked_address"), ("https://[2001:db8::1]/", None),
    ("https://a@b@10.0.0.1/", "blocked_address"), ("https://11.0.0.0", None), ("https://256.0.0.1/", None),
]


def test_urls(spark):
    df = spark.createDataFrame([(u, w) for u, w in URLS], "url string, want string")
    for r in S.screen_urls(df).collect():
        assert r["reason"] == r["want"], r["url"]
    assert S.safe_urls(df.select("url")).count() == sum(w is None for _, w in URLS)


def test_every_resolved_address_must_pass(spark):
    df = spark.createDataFrame([("https://good.example",), ("https://mixed.example",), ("https://gone.example",), ("https://8.8.8.8",)], "url string")
    dns = spark.createDataFrame([("Good.example", "93.184.216.34"), ("mixed.example", "93.184.216.34"), ("mixed.example", "10.0.0.9")], "host string, ip string")
    out = {r["host"]: r["reason"] for r in S.screen_urls(df, resolved=dns).collect()}
    assert out == {"good.example": None, "mixed.example": "blocked_address", "gone.example": "unresolved", "8.8.8.8": None}


def test_redirect_chains(spark):
    rows = [("ok", i, "https://a.example") for i in range(6)] + [("long", i, "https://a.example") for i in range(7)]
    rows += [("bad", 0, "https://a.example"), ("bad", 1, "http://a.example"), ("bad", 2, "https://10.0.0.1")]
    out = {r["chain"]: r for r in S.redirect_screen(spark.createDataFrame(rows, "chain string, hop int, url string"), "chain", "hop").collect()}
    assert out["ok"]["allowed"] and out["ok"]["n_redirects"] == 5
    assert out["long"]["reason"] == "too_many_redirects" and out["bad"]["reason"] == "scheme"


DIRTY = (
    '<svg xmlns="http://www.w3.org/2000/svg" xmlns:xlink="http://www.w3.org/1999/xlink" onload="a()"><script>alert(1)</script>'
    '<g OnClick="b()" id="k"><foreignObject><p>x</p></foreignObject></g><a href="data:text/html;base64,x">l</a><a href="data:image/png;base64,x">m</a>'
    '<use xlink:href="https://evil.example/x.svg#a"/><use href="#local"/><image href="https://ok.example/i.png"/>'
    "<style>@import url(evil.css); p{color:red}</style></svg>"
)


def test_markup_threat_counts(spark):
    r = S.markup_threats(spark.createDataFrame([(DIRTY,), ("plain onload = text",)], "t string"), "t").collect()
    assert (r[0]["n_dangerous_elements"], r[0]["n_event_handlers"], r[0]["n_data_html_hrefs"], r[0]["n_external_use"], r[0]["n_css_imports"]) == (2, 2, 1, 1, 1)
    assert r[0]["n_threats"] == 7 and r[1]["n_threats"] == 0


def test_sanitize_html_and_xml_remove_the_same(spark):
    df = spark.createDataFrame([(DIRTY,)], "t string")
    html = S.sanitize_markup(df, "t").first()["clean"]
    svg = S.sanitize_markup(df, "t", xml=True).first()["clean"]
    for clean in (html, svg):
        low = clean.lower()
        assert not any(x in low for x in ("alert", "onload", "onclick", "foreignobject", "text/html", "evil"))
        assert all(x in clean for x in ("data:image/png", "#local", "ok.example", "color:red", 'id="k"'))
    assert S.markup_threats(spark.createDataFrame([(html,)], "t string"), "t").first()["n_threats"] == 0
    assert ET.fromstring(svg) is not None


def test_malformed_and_external_entities_give_error_rows(spark):
    docs = ["<svg><g></svg>", '<!DOCTYPE svg [<!ENTITY x SYSTEM "file:///etc/passwd">]><svg>&x;</svg>', '<!DOCTYPE svg [<!ENTITY c "red">]><svg fill="&c;"/>', None]
    out = S.sanitize_markup(spark.createDataFrame([(d,) for d in docs], "t string"), "t", xml=True).collect()
    assert out[0]["clean"] is None and out[0]["error"].startswith("malformed")
    assert out[1]["clean"] is None and "root:" not in str(out[1])
    assert 'fill="red"' in out[2]["clean"] and out[2]["error"] is None
    assert out[3]["clean"] is None and out[3]["error"] is None


def test_html_without_threats_is_unchanged(spark):
    page = "<html><body class='x'><p>a < b & c</p><style>p{}</style></body></html>"
    assert S.sanitize_markup(spark.createDataFrame([(page,)], "t string"), "t").first()["clean"] == page


def test_presets_and_config(spark):
    df = spark.createDataFrame([("HIGH",), ("medium",), ("Low",), ("max",), (None,)], "preset string")
    out = S.resolve_preset(df).collect()
    assert [(r["quality"], r["png_lossy"], r["valid"]) for r in out][:3] == [(40, True, True), (60, True, True), (75, False, True)]
    assert out[3]["quality"] is None and not out[3]["valid"]
    cfg = spark.createDataFrame([(0, None), (1, 0.0), (100, 100.0), (101, None), (None, None), (50, 100.1)], "quality int, max_reduction double")
    assert [r["quality"] for r in S.valid_config(cfg).collect()] == [1, 100, 80]


def test_clamp_keeps_null(spark):
    r = one(spark, S.clamp_quality(F.lit(5)).alias("a"), S.clamp_quality(F.lit(95)).alias("b"), S.clamp_quality(F.lit(95), hi=95).alias("c"),
            S.clamp_quality(F.lit(40)).alias("d"), S.clamp_quality(F.lit(None).cast("int")).alias("e"))
    assert tuple(r) == (30, 90, 95, 50, None)


def test_buckets(spark):
    edges = [0, 10239, 10240, 102399, 102400, 1048575, 1048576, 5242879, 5242880, -1]
    out = spark.createDataFrame([(e,) for e in edges], "n bigint").select(S.size_bucket("n").alias("b")).collect()
    assert [r["b"] for r in out] == ["tiny", "tiny", "small", "small", "medium", "medium", "large", "large", "xlarge", None]
    r = one(spark, *[S.bucket_center(F.lit(b)).alias(b) for b, _, _ in K.BUCKETS], S.in_bucket(F.lit(10240), F.lit("tiny")).alias("t"), S.in_bucket(F.lit(1), F.lit("?")).alias("u"))
    assert tuple(r) == (101, 32381, 327680, 2344687, 10485760, False, None)


def test_case_ids(spark):
    ids = [("a.b.PNG@high@x", "png"), ("plain@high", "unknown"), ("", "unknown"), ("n.heic", "heic"), ("n.@low", "")]
    out = spark.createDataFrame([(i,) for i, _ in ids], "i string").select(X.extract_format("i").alias("f")).collect()
    assert [r["f"] for r in out] == [f for _, f in ids]


@pytest.mark.parametrize(
    ("row", "want"),
    [
        (("png", 40, 100, 100, 1, "RGB", True, True), {"max_colors": 64, "speed": 3, "oxipng_level": 4, "candidates": ["pngquant + oxipng", "oxipng"]}),
        (("png", 60, 2001, 2000, 1, "RGB", True, True), {"max_colors": 256, "speed": 4, "oxipng_level": 2}),
        (("png", 60, 10, 10, 1, "RGB", False, True), {"max_colors": None, "oxipng_level": 4, "candidates": ["oxipng"]}),
        (("apng", 40, 1000, 1000, 5, "RGB", True, True), {"oxipng_level": 2, "max_colors": None}),
        (("gif", 40, 100, 100, 3, "P", True, True), {"gif_lossy": 80, "gif_colors": 128, "candidates": ["gifsicle --lossy=80 --colors=128"]}),
        (("gif", 60, 1000, 1000, 101, "P", True, True), {"gif_lossy": 30, "gif_colors": None, "candidates": ["gifsicle --lossy=30 (palette skipped: large animation)"]}),
        (("gif", 80, 10, 10, 1, "P", True, True), {"gif_lossy": None, "candidates": ["gifsicle"]}),
        (("jxl", 69, 10, 10, 1, "RGB", True, True), {"encoder_quality": 79, "candidates": ["jxl-reencode"]}),
        (("heic", 75, 10, 10, 1, "RGB", True, False), {"encoder_quality": None, "candidates": []}),
        (("tiff", 40, 10, 10, 1, "CMYK", True, True), {"candidates": ["tiff_adobe_deflate", "tiff_lzw"], "parallel_candidates": True}),
        (("bmp", 60, 10, 10, 1, "RGB", True, True), {"candidates": ["pillow-bmp", "bmp-palette-lossless", "bmp-rle8-lossless", "pillow-bmp-palette"]}),
        (("svg", 60, None, None, None, None, True, True), {"svg_precision": 5, "candidates": ["scour"]}),
    ],
)
def test_encoder_plan(spark, row, want):
    df = spark.createDataFrame([row], "format string, quality int, width int, height int, frames int, mode string, png_lossy boolean, strip_metadata boolean")
    got = S.encoder_plan(df).first().asDict()
    assert {k: got[k] for k in want} == want


def test_ipv6_like_the_standard_library(spark):
    import ipaddress
    import random

    rng = random.Random(3)
    nets = [ipaddress.ip_network(n) for n in K.BLOCKED_NETWORKS]
    texts = ["", ":", "::", ":::", "1::", "::1", "0::1", "0:0::1", "::1%eth0", "1::2::3", "12345::", "g::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8:9", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "::256.1.1.1", "64:ff9b::10.0.0.1", "fdff::", "fe00::", "fbff::1", ":1::2", "1.2.3.4"]
    for _ in range(200):
        groups = [rng.choice([0, 0, 0, 1, 0xFC00, 0xFDFF, rng.randrange(65536)]) for _ in range(8)]
        a = ipaddress.IPv6Address(sum(g << 16 * (7 - i) for i, g in enumerate(groups)))
        texts += [a.compressed.upper(), a.exploded]
    got = {r.ip: (r.d, r.b) for r in spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", X.ipv6_digits("ip").alias("d"), X.blocked_ipv6("ip").alias("b")).collect()}
    for t in texts:
        try:
            a = ipaddress.IPv6Address(t)
        except ValueError:
            assert got[t] == (None, False), t
            continue
        b = a.ipv4_mapped or a
        assert got[t] == (f"{int(a):032x}", any(n.version == b.version and int(b) in range(int(n[0]), int(n[-1]) + 1) for n in nets)), t
