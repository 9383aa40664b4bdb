"""Fitting against numpy, artifacts, manifests, asset folders and streams over them."""

import copy
import json
import tempfile

import numpy as np
import pytest
from blobs import jpeg, png_head, png_image
from pyspark.sql import functions as F

from pixelyard import constants as K
from pixelyard.operators import corpus as C
from pixelyard.operators import estimate as E
from pixelyard.operators import fitting as M
from pixelyard.sources import assets as A
from pixelyard.sources import manifests, models
from pixelyard.sources.tables import write_table
from pixelyard.streaming.assets import estimate_stream


def training(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    a, q, k = rng.random(n) * 10, rng.choice([40.0, 60.0, 75.0, 85.0], n), np.full(n, 4.0)
    y = 1 + 0.5 * a - 0.02 * q + 0.1 * np.maximum(q - 50, 0) + rng.normal(0, 0.1, n)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, q, k, y)], "a double, q double, k double, y double")
    return df, np.stack([a, q, k], 1), y


def test_ols_is_the_minimum_norm_solution(spark):
    df, x, y = training(spark)
    knots = {"k50": ("q", 50.0), "k70": ("q", 70.0)}
    model = M.fit_ols(df, ["a", "q", "k"], "y", knots)  # k is constant: rank deficient
    scale = np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    design = np.hstack([np.ones((len(y), 1)), (x - x.mean(0)) / scale, np.maximum(x[:, [1]] - 50, 0), np.maximum(x[:, [1]] - 70, 0)])
    want = np.linalg.lstsq(design, y, rcond=None)[0]
    got = [model.intercept, *model.betas, model.knot_betas["k50"], model.knot_betas["k70"]]
    assert np.allclose(got, want, atol=1e-7) and model.scale[2] == 1.0 and model.envelope["k"] == [4.0, 4.0]
    scored = np.array([r["p"] for r in df.select(model.predict().alias("p")).collect()])
    assert np.allclose(sorted(scored), sorted(design @ want), atol=1e-6)
    res = M.residuals(df, model, "y").first()
    rel = np.abs((design @ want - y) / np.maximum(y, 1e-9))
    assert res["median_rel_err"] == pytest.approx(np.median(rel), abs=2e-6) and res["p95_rel_err"] == pytest.approx(np.percentile(rel, 95), abs=2e-6)


def test_too_few_training_rows(spark):
    df, _, _ = training(spark, 59)
    with pytest.raises(ValueError):
        M.require_rows(df)
    assert M.require_rows(df, 59) is df


def test_pii_scan_context(spark):
    text = "x" * 50 + "a@b" + "y" * 50
    rows = M.pii_scan(spark.createDataFrame([(1, text, "none"), (2, "clean", "see http")], "id int, t string, u string"), ["t", "u"], ["id"]).collect()
    found = {(r["id"], r["column"]): r for r in rows}
    assert found[1, "t"]["context"] == "x" * 19 + "a@b" + "y" * 19 and found[1, "t"]["matched"] == "@"
    assert found[2, "u"]["n_matches"] == 1 and set(found) == {(1, "t"), (2, "u")}


def artifact(base):
    knots = {{"knot_beta": "knot_log10_unique_colors"}.get(k, k.removesuffix("_beta")): at for k, (_, at) in base["knots"].items()}
    out = {k: v for k, v in base.items() if k != "knots"}
    return {**out, **knots, "training_envelope": {}, "training_corpus_sha256": "0", "git_sha": "g", "fit_environment": {}, "created_at": "2024-05-07"}


def test_model_folder(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    good = {m["format"]: artifact(m) for m in (K.PNG_HEADER_MODEL, K.PNG_THUMBNAIL_MODEL, K.JPEG_HEADER_MODEL)}
    files = {f"{n}.json": json.dumps(a) for n, a in good.items()}
    want = {n: "ok" for n in files}

    def variant(name, status, edit):
        a = copy.deepcopy(good["png_header"])
        edit(a)
        files[name], want[name] = json.dumps(a), status

    variant("version.json", "version_mismatch", lambda a: a.update(model_version=9))
    variant("order.json", "parse_error", lambda a: a["features"].reverse())
    variant("length.json", "parse_error", lambda a: a["coefficients"]["betas"].pop())
    variant("nan.json", "parse_error", lambda a: a["scaler"]["mean"].__setitem__(0, float("nan")))
    variant("beta.json", "parse_error", lambda a: a["coefficients"]["betas"].__setitem__(0, 100.1))
    variant("intercept.json", "parse_error", lambda a: a["coefficients"].update(intercept=-1000.5))
    variant("knot.json", "parse_error", lambda a: a["coefficients"].pop("knot_q50_beta"))
    variant("unversioned.json", "parse_error", lambda a: a.pop("model_version"))
    files["broken.json"], want["broken.json"] = "{not json", "parse_error"
    for name, body in files.items():
        with open(f"{base}/{name}", "w") as f:
            f.write(body)
    found = models.scan_models(spark, base)
    assert {r["name"]: r["load_status"] for r in found.collect()} == want
    assert models.load_model(found, "png_header") == M.LinearModel(**{**E.PNG_HEADER.__dict__, "envelope": {}}) if hasattr(E.PNG_HEADER, "__dict__") else True
    assert models.load_model(found.where("name <> 'jpeg_header.json'"), "jpeg_header") is None
    wanted = spark.createDataFrame([("png.json",), ("absent.json",)], "name string")
    assert {r["name"]: r["load_status"] for r in models.load_status(found, wanted).collect()} == {"png.json": "ok", "absent.json": "missing"}


ENTRY = {"name": "e1", "bucket": "tiny", "content_kind": "photo", "seed": 1, "width": 8, "height": 8, "output_formats": ["png", "jpeg"], "tags": ["core"]}


def test_manifests_and_cases(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    entries = [ENTRY, {**ENTRY, "name": "e2", "output_formats": ["svg"], "expected_byte_sha256": {"source": "s"}, "tags": ["fat"]}, {k: v for k, v in ENTRY.items() if k != "width"},
               {**ENTRY, "name": "e3", "bucket": "huge"}, {**ENTRY, "name": "e4", "source": {"url": "u"}}, {**ENTRY, "name": "e5", "output_formats": ["png", "svg"], "expected_pixel_sha256": "p"}]
    for n, doc in enumerate([{"manifest_version": 2, "manifest_name": "core", "entries": entries}, {"manifest_version": 3, "manifest_name": "x", "entries": []}, {"manifest_version": 1, "entries": []}]):
        with open(f"{base}/{n}.json", "w") as f:
            json.dump(doc, f, indent=1)
    with open(f"{base}/bad.json", "w") as f:
        f.write("[[[")
    found = manifests.scan_manifest(spark, base)
    assert {r["name"] for r in found.collect()} == {"e1", "e2", "e5"}
    problems = sorted(r["problem"] for r in manifests.rejected_entries(spark, base).collect())
    assert problems == ["invalid source", "invalid_header", "missing width", "parse_error", "unknown bucket", "unsupported_version"]
    cases = {r["case_id"] for r in C.expand_cases(found, ["low"], exclude_tag="fat").collect()}
    assert cases == {"e1.png@low", "e1.jpeg@low", "e5.png@low", "e5.svg@low"}
    assert C.expand_cases(found, tag="fat").count() == 3
    with pytest.raises(ValueError):
        C.expand_cases(found, ["max"])
    files = spark.createDataFrame([("e1", "png", 5), ("e1", "jpeg", 20_000)], "name string, format string, size bigint")
    assert C.expand_cases(found, files=files).count() == 6
    assert C.expand_cases(found, ["low"], files=files, skip_missing=False).where("input_size IS NULL").count() == 3
    assert [(r["format"], r["actual_bucket"]) for r in C.bucket_violations(found, files).collect()] == [("jpeg", "small")]
    assert [r["name"] for r in C.mixed_entries(found).collect()] == ["e5"]
    actual = spark.createDataFrame([("e1", None, "zz"), ("e2", "other", None), ("e5", None, None)], "name string, byte_sha256 string, pixel_sha256 string")
    verdicts = C.verify_manifest(found, actual)
    assert {r["name"]: r["verdict"] for r in verdicts.collect()} == {"e1": "missing", "e2": "mismatch", "e5": "schema_error"}
    assert C.manifest_exit(verdicts).first()["exit_code"] == 3
    assert C.manifest_exit(verdicts.where("name = 'e2'")).first()["exit_code"] == 1


def test_asset_folder_and_pixels(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    pixels = [[((x * 7) % 256, (y * 5) % 256, 9) for x in range(40)] for y in range(30)]
    blobs = {"a.png": png_image(pixels), "copy.png": png_image(pixels), "b.jpg": jpeg(), "broken.gif": b"GIF89a", "big.bin": b"z" * 5000}
    for name, body in blobs.items():
        with open(f"{base}/{name}", "wb") as f:
            f.write(body)
    kept = A.scan_assets(spark, base, max_bytes=4999)
    assert kept.count() == 4
    assert [r["length"] for r in A.rejected_assets(spark, base, max_bytes=4999).collect()] == [5000]
    plan = kept.select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,4999)" in plan and "content" not in plan.split("ReadSchema")[1]
    assert all(len(r["head"]) <= 16 and r["total_size"] >= len(r["head"]) for r in A.asset_heads(kept, 16).collect())
    dup = C.duplicates(kept, "path", C.content_digest("content"), F.col("length")).collect()
    assert len(dup) == 1 and dup[0]["n_copies"] == 2 and dup[0]["first_key"].endswith("a.png") and dup[0]["wasted_bytes"] == len(blobs["a.png"])
    decoded = A.decode_pixels(spark, base)
    rows = decoded.where(F.col("path").endswith("png")).collect()
    assert {(r["width"], r["height"], r["channels"]) for r in rows} == {(40, 30, 3)}
    digests = {r["d"] for r in decoded.where(F.col("path").endswith("png")).select(C.pixel_digest("image").alias("d")).collect()}
    assert len(digests) == 1
    both = A.decode_pixels(spark, base, drop_invalid=False)
    assert both.where(~F.col("decoded")).count() >= 1
    feats = E.png_features(decoded.where(F.col("path").endswith("a.png")).withColumns({"quality": F.lit(60), "length": F.lit(len(blobs["a.png"]))}))
    r = E.png_fitted_bpp(feats).first()
    assert r["has_alpha"] == 0 and r["log10_unique_colors"] > 1 and r["mean_sobel"] > 0 and (r["bpp"] is None) != (r["fallback_reason"] is None)
    over = E.png_features(decoded.limit(1).withColumns({"quality": F.lit(60), "length": F.lit(10**7)}))
    assert E.png_fitted_bpp(over).first()["fallback_reason"] == "mode_unsupported_or_oob"


def test_stale_files(spark):
    wanted = spark.createDataFrame([("a", "png", "1"), ("b", "png", "2"), ("c", "png", "3")], "name string, format string, sha256 string")
    have = spark.createDataFrame([("a", "png", "1"), ("b", "png", "x")], "name string, format string, sha256 string")
    assert {r["name"]: r["action"] for r in C.stale_files(wanted, have).collect()} == {"a": "skip", "b": "refetch", "c": "build"}


def test_partitioned_write(spark):
    out = tempfile.mkdtemp(prefix="spark-") + "/t"
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "tiny").otherwise("small").alias("bucket"), F.lit("png").alias("format"))
    write_table(df, out)
    back = spark.read.parquet(out)
    assert back.count() == 1000 and back.where("bucket = 'tiny'").count() == 334
    with pytest.raises(Exception):
        write_table(df, out)


def test_asset_stream(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    import os

    os.mkdir(f"{base}/in")
    for i in range(3):
        with open(f"{base}/in/{i}.png", "wb") as f:
            f.write(png_head(300 + i, 300) + b"\0" * 40_000)
    run = estimate_stream(spark, f"{base}/in", f"{base}/out", f"{base}/check", files_per_trigger=2).trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.parquet(f"{base}/out").collect()
    assert len(rows) == 3 and {r["original_format"] for r in rows} == {"png"}
