"""Comparison, quality, load, scorecard, trend and run documents."""

import json
import math
import random
import statistics
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelyard.functions import stats as S
from pixelyard.functions.pixels import ssim_of
from pixelyard.operators import cases as C
from pixelyard.operators import compare as CMP
from pixelyard.operators import load as L
from pixelyard.operators import quality as Q
from pixelyard.operators import ranking as R
from pixelyard.operators import scorecard as SC
from pixelyard.plans.runs import compare_runs
from pixelyard.sources import runs as RUNS


def walls(spark, values, case="img.png@high"):
    rows = [(case, float(v), i) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "case_id string, wall_ms double, pos int")
    return df.withColumns({"error": F.lit(None).cast("string"), "method": F.lit("pngquant"), "reduction_pct": F.lit(60.0), "optimized_size": F.lit(26214)})


@pytest.mark.parametrize(
    ("base", "head", "label", "code"),
    [
        ([100], [130], "noise_floor_regression", 1), ([100], [105], "noise_floor_ok", 0), ([100], [125], "noise_floor_regression", 1), ([100], [50], "improvement", 0),
        ([0.5], [0.9], "noise_floor_ok", 0), ([100 + 0.1 * i for i in range(5)], [130 + 0.1 * i for i in range(5)], "significant", 1),
        ([100 + 0.05 * i for i in range(5)], [105 + 0.05 * i for i in range(5)], "ok", 0), ([100, 100.1], [50, 50.1], "improvement", 0), ([50, 150, 100], [70, 190, 115], "below_threshold", 0),
    ],
)
def test_timing_labels(spark, base, head, label, code):
    parts = compare_runs(walls(spark, base), walls(spark, head))
    assert parts["timing"].first()["label"] == label
    assert parts["verdict"].first()["exit_code"] == code


def test_swapping_sides_flips_signs(spark):
    a, b = walls(spark, [10, 11, 12, 13]), walls(spark, [14, 15, 17, 18])
    one, two = CMP.timing_diff(a, b, p_value=True).first(), CMP.timing_diff(b, a, p_value=True).first()
    assert one["cohens_d"] == -two["cohens_d"] and one["t"] == -two["t"] and one["delta_pct"] > 0 > two["delta_pct"]
    assert one["p_value"] == two["p_value"] == pytest.approx(2 * (1 - statistics.NormalDist().cdf(abs(one["t"]))), abs=1e-12)


def test_statistics_columns(spark):
    def stat(a, b):
        args = [F.lit(x) for v in (a, b) for x in (len(v), statistics.fmean(v), statistics.stdev(v) if len(v) > 1 else 0.0)]
        na, ma, sa, nb, mb, sb = args
        return spark.range(1).select(S.cohens_d(*args).alias("d"), S.welch_t(*args).alias("t"), S.welch_df(na, sa, nb, sb).alias("df"), S.differs(*args).alias("x")).first()

    a, b = [2.0, 4, 4, 4, 5, 5, 7, 9], [1.0, 2, 3]
    r = stat(a, b)
    va, vb = statistics.variance(a), statistics.variance(b)
    assert r["d"] == pytest.approx((5 - 2) / math.sqrt((7 * va + 2 * vb) / 9)) and r["t"] == pytest.approx(3 / math.sqrt(va / 8 + vb / 3))
    assert r["df"] == pytest.approx((va / 8 + vb / 3) ** 2 / ((va / 8) ** 2 / 7 + (vb / 3) ** 2 / 2))
    assert tuple(stat([1.0], [2.0, 3.0])) == (0.0, 0.0, 0.0, False) and tuple(stat([3.0, 3.0], [3.0, 3.0])) == (0.0, 0.0, 0.0, False)
    sd = spark.createDataFrame([(float(x),) for x in a], "v double").agg(S.sample_std("v").alias("s")).first()["s"]
    assert sd == pytest.approx(2.138089935)


def test_compression_estimation_and_errors(spark):
    cols = "case_id string, pos int, error string, method string, reduction_pct double, optimized_size bigint, path string, size_rel_error_pct double, wall_ms double"
    a = spark.createDataFrame([("a", 0, None, "x", 50.0, 100, "exact", 1.0, 1.0), ("b", 0, "boom", "x", 1.0, 1, "exact", 1.0, 1.0), ("b", 1, None, "x", 50.0, 100, "exact", -2.0, 1.0), ("c", 0, None, None, 1.0, 1, None, None, 1.0), ("c", 1, None, "x", 9.0, 9, "exact", 0.0, 1.0)], cols)
    b = spark.createDataFrame([("a", 0, None, "none", 47.0, 105, "sample", -12.0, 1.0), ("b", 0, None, "x", 47.1, 104, "exact", 3.0, 1.0), ("c", 0, '{"phase":"optimize","message":"bad"}', "x", 9.0, 9, "exact", 0.0, 1.0), ("d", 0, "late", None, None, None, None, None, 1.0)], cols)
    comp = {r["case_id"]: r for r in CMP.compression_diff(a, b, error="error").collect()}
    assert set(comp) == {"a", "b"}
    assert comp["a"]["downgraded_to_none"] and comp["a"]["reduction_regressed"] and comp["a"]["size_regressed"] and not comp["b"]["threshold_breach"]
    est = {r["case_id"]: r for r in CMP.estimation_diff(a, b, error="error").collect()}
    assert est["a"]["error_regressed"] and est["a"]["path_shifted"] and est["b"]["error_delta_pp"] == 1.0
    new = {r["case_id"]: r["message"] for r in CMP.head_only_errors(a, b).collect()}
    assert new == {"c": "[optimize] bad", "d": "late"}
    pairs = {r["case_id"]: r["side"] for r in CMP.pair_cases(a, b).collect()}
    assert pairs == {"a": "common", "b": "common", "c": "common", "d": "only_in_b"}
    rollup = CMP.compression_rollup(CMP.compression_diff(a, b, error="error"), F.lit("png")).first()
    assert (rollup["n_cases"], rollup["method_changes"], rollup["status"]) == (2, 1, "regression")
    assert compare_runs(a, b)["verdict"].first()["exit_code"] == 1
    sym = CMP.estimation_symmetry(a, b.withColumn("path", F.lit(None).cast("string"))).first()
    assert sym["asymmetric"] and sym["baseline_has_accuracy"]


def test_conditions(spark):
    cond = lambda *v: spark.createDataFrame([v], "mode string, cpu_count int, isolate boolean, platform string")
    r = CMP.comparable(cond("quick", 0, False, "linux"), cond("quick", 8, True, "darwin")).first()
    assert r["comparable"] and r["isolate_warning"] and r["platform_warning"]
    assert not CMP.comparable(cond("quick", 4, False, "l"), cond("quick", 8, False, "l")).first()["comparable"]
    assert not CMP.comparable(cond("quick", 4, False, "l"), cond("timing", 4, False, "l")).first()["comparable"]
    parts = compare_runs(walls(spark, [1]), walls(spark, [1]), conditions=(cond("quick", 4, False, "l"), cond("timing", 4, False, "l")))
    assert parts["verdict"].first()["exit_code"] == 2


def brute_ssim(a, b):
    pa, pb = (np.pad(x, 5, mode="reflect") for x in (a, b))
    scores = []
    for i in range(1, a.shape[0]):
        for j in range(1, a.shape[1]):
            x, y = pa[i : i + 11, j : j + 11], pb[i : i + 11, j : j + 11]
            mx, my = x.mean(), y.mean()
            vx, vy, c = (x * x).mean() - mx**2, (y * y).mean() - my**2, (x * y).mean() - mx * my
            scores.append((2 * mx * my + 1e-4) * (2 * c + 9e-4) / ((mx**2 + my**2 + 1e-4) * (vx + vy + 9e-4)))
    return float(np.mean(scores))


def test_ssim(spark):
    rng = np.random.default_rng(2)
    a, b = rng.random((14, 17)), rng.random((14, 17))
    assert ssim_of(a[..., None], b[..., None]) == pytest.approx(brute_ssim(a, b), rel=1e-9)
    assert ssim_of(a[..., None], a[..., None]) == pytest.approx(1.0) and ssim_of(a[..., None], b[:, :9, None]) is None
    rgb, other = rng.random((12, 12, 4)), rng.random((12, 12, 4))
    assert ssim_of(rgb, other) == pytest.approx(np.mean([brute_ssim(rgb[..., c], other[..., c]) for c in range(3)]))
    df = spark.createDataFrame([(a.ravel().tolist(), b.ravel().tolist(), 14, 17, 1), (a.ravel().tolist(), [0.1], 14, 17, 1)], "ref array<double>, dist array<double>, height int, width int, channels int")
    out = [r["ssim"] for r in Q.ssim_pairs(df).collect()]
    assert out[0] == pytest.approx(brute_ssim(a, b)) and out[1] is None


def test_psnr(spark):
    df = spark.createDataFrame([([0.0, 0.5], [0.0, 0.4]), ([0.1], [0.1]), ([0.1], [0.1, 0.2])], "ref array<double>, dist array<double>")
    a, b, c = Q.psnr_pairs(df).collect()
    assert a["psnr_db"] == pytest.approx(23.0103) and not a["perfect_match"]
    assert b["psnr_db"] is None and b["perfect_match"] and c["mse"] is None and c["perfect_match"] is None


def test_load_case(spark):
    rows = [(0, "success", 0, 10, 100, 10.0, 7, "a"), (1, "success", 5, 25, 205, 20.0, 8, "b"), (2, "success", 6, 7, 8, 30.0, 9, "b"), (3, "success", 7, 8, 9, 0.0, 9, "a"), (4, "503_queue", 1, None, 2, None, None, None), (5, "503_memory", 1, None, 2, None, None, None), (6, "error", 1, None, 2, None, None, None)]
    df = spark.createDataFrame([("c", p, s, a * 10**6, g and g * 10**6, r * 10**6, x, n, m) for p, s, a, g, r, x, n, m in rows], "case_id string, pos int, status string, start_ns bigint, grant_ns bigint, release_ns bigint, reduction double, size int, method string")
    df = df.unionByName(df.where("pos = 6").withColumn("case_id", F.lit("dead")))
    out = {r["case_id"]: r for r in L.load_case(df).collect()}
    c = out["c"]
    assert (c["n_requests"], c["n_success"], c["n_503"], c["n_503_queue"], c["n_error"], c["method"]) == (7, 4, 2, 1, 1, "a")
    assert c["latency_max_ms"] == 200 and c["latency_p50_ms"] == 51 and c["queue_wait_max_ms"] == 20 and c["mean_optimized_size"] == 8 and c["mean_reduction"] == 15
    assert c["throughput_per_sec"] == pytest.approx(4 / 0.205) and c["ok_rate"] == pytest.approx(4 / 7)
    d = out["dead"]
    assert (d["latency_p95_ms"], d["throughput_per_sec"], d["method"], d["mean_optimized_size"]) == (0.0, 0.0, "", 0)


def test_peak_concurrency_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(1500):
        s = rng.randrange(50_000)
        rows.append(("hot" if rng.random() < 0.5 else f"k{rng.randrange(4)}", s, s + rng.randrange(0, 900)))
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint")
    out = {r["k"]: r["peak"] for r in L.peak_concurrency(df, ["k"], "s", "e", 500).collect()}
    for k in out:
        mine = [(s, e) for key, s, e in rows if key == k]
        assert out[k] == max(sum(s <= t < e for s, e in mine) for t, _ in mine)
    back_to_back = spark.createDataFrame([(0, 10), (10, 20)], "s bigint, e bigint")
    assert L.peak_concurrency(back_to_back, [], "s", "e").first()["peak"] == 1


def test_curve_maxpool(spark):
    for n in (1, 5, 24, 25, 60, 101):
        values = [(i * 37) % 101 for i in range(n)]
        df = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(values)], "case_id string, position bigint, value double")
        got = [r["bucket_max"] for r in C.curve_maxpool(df).orderBy("bucket").collect()]
        if n > 24:
            size = n / 24
            want = [max(values[int(i * size) : max(int(i * size) + 1, int((i + 1) * size))]) for i in range(24)]
        else:
            want = values
        assert got == want


def test_accuracy_and_failures(spark):
    df = spark.createDataFrame([(110, 100, 10.0, 12.5), (90, 0, 1.0, 1.0)], "predicted_size int, actual_size int, predicted_reduction_pct double, actual_reduction_pct double")
    a, b = C.accuracy_errors(df).collect()
    assert (a["size_abs_error_bytes"], a["size_rel_error_pct"], a["reduction_abs_error_pct"], a["reduction_abs_error_pct_abs"]) == (10, 10.0, -2.5, 2.5) and b["size_rel_error_pct"] == 0.0
    errs = spark.createDataFrame([("r", i, f"c{i}", e) for i, e in enumerate(["boom", '{"phase":"estimate","message":"m"}', '{"x":1}', None, '"quoted"'])], "run_id string, pos int, case_id string, error string")
    out = {r["case_id"]: r["failure"] for r in C.failure_summary(errs).collect()}
    assert out == {"c0": "boom", "c1": "[estimate] m", "c2": "[?] unknown error", "c4": "quoted"}
    many = spark.range(100).select(F.lit("r").alias("run_id"), F.col("id").alias("pos"), F.col("id").cast("string").alias("case_id"), F.lit("e").alias("error"))
    rows = C.failure_summary(many).collect()
    assert len(rows) == 10 and rows[0]["n_failures"] == 100


def test_rankings(spark):
    rows = [("a.jpeg@high", "jpeg", "high", 0.94, 0), ("a.jpeg@high", "jpeg", "high", 0.1, 1), ("b.jpeg@low", "jpeg", "low", 0.94, 2), ("c.webp@low", "webp", "low", None, 3), ("d.png@low", "png", "low", 0.1, 4)]
    df = spark.createDataFrame(rows, "case_id string, format string, preset string, ssim double, pos int").withColumns({"psnr_db": F.lit(30.0), "input_size": F.lit(2048), "optimized_size": F.lit(1024), "reduction_pct": F.lit(50.0)})
    out = {r["format"]: r for r in R.worst_per_format(df).collect()}
    assert len(out) == 12
    assert (out["jpeg"]["case_id"], out["jpeg"]["status"], out["jpeg"]["ssim_threshold"]) == ("a.jpeg@high", "warn", 0.95)
    assert out["webp"]["no_data"] and out["png"]["lossless"] and not out["png"]["no_data"]
    ordered = R.severity_order(spark.createDataFrame([("b", "ok"), ("a", "ok"), ("z", "fail"), ("y", "warn")], "format string, overall_status string")).collect()
    assert [r["format"] for r in ordered] == ["z", "y", "a", "b"]
    assert [r["id"] for r in R.last_n(spark.range(10), 3, "id").collect()] == [7, 8, 9]


def document(n=3, version=2, extra=None):
    base = {"case_id": "img.jpeg@high", "name": "img", "bucket": "small", "format": "jpeg", "preset": "high", "input_size": 65536, "optimized_size": 26214, "reduction_pct": 60.0, "method": "jpegli"}
    m = {"wall_ms": 100.0, "children_user_ms": 40.0, "children_sys_ms": 10.0, "parallelism": 0.5, "parent_peak_rss_kb": 1000, "children_peak_rss_kb": 2000, "rss_samples": [[0.0, 5.0], [1.0, 9.0]]}
    its = [{**base, "iteration": i, "measurement": {**m, "wall_ms": 100.0 + i}, "quality": {"ssim": 0.96}, "accuracy": {"size_rel_error_pct": 20.0, "reduction_abs_error_pct_abs": 1.0}} for i in range(n)]
    its += [{**base, "case_id": "bad.png@low", "error": "boom"}, {**base, "case_id": "worse.png@low", "error": {"phase": "optimize", "message": "m"}}]
    return {"schema_version": version, "timestamp": "2024-01-01T00:00:00+00:00", "mode": "pr", "git": {"commit": "c0ffee1234"}, "host": {"platform": "linux", "cpu_count": 8}, "config": {"isolate": True}, "iterations": its, "stats": [], **(extra or {})}


def test_run_documents_round_trip(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    for name, doc in (("a", document()), ("old", document(version=1))):
        with open(f"{base}/{name}.json", "w") as f:
            json.dump(doc, f, indent=2)
    with open(f"{base}/broken.json", "w") as f:
        f.write('{"schema_version": 2, ')
    found = RUNS.scan_runs(spark, base)
    assert found.count() == 1 and found.first()["run_id"] == "c0ffee1234@2024-01-01T00:00:00+00:00"
    assert {r["reason"] for r in RUNS.rejected_runs(spark, base).collect()} == {"unsupported_version", "parse_error"}
    it = RUNS.iterations(found)
    assert [r["pos"] for r in it.orderBy("pos").collect()] == [0, 1, 2, 3, 4]
    texts = {r["case_id"]: r["failure"] for r in C.failures(it).collect()}
    assert texts == {"bad.png@low": "boom", "worse.png@low": "[optimize] m"}
    assert RUNS.conditions(found).first()["isolate"]
    flat = RUNS.flatten(it)
    cases = C.summarize_cases(flat, error="error", position="pos")
    row = cases.first()
    assert cases.count() == 1 and row["iterations"] == 3 and row["p50_ms"] == 101 and row["mad_ms"] == 1 and row["children_cpu_p50_ms"] == 50 and row["children_peak_rss_p95_kb"] == 2000
    assert row["method"] == "jpegli" and C.curve_points(cases).count() == 2
    card = SC.scorecard(cases, flat.where(F.col("error").isNull()))
    r = card.first()
    assert (r["n_cases"], r["quality_status"], r["accuracy_status"], r["overall_status"], r["ssim_threshold"]) == (1, "ok", "warn", "warn", 0.95)
    assert r["speed_by_bucket"][0].asDict() == {"bucket": "small", "p95_ms": 101.9, "slo_ms": 500, "status": "ok"}
    k = SC.kpis(card).first()
    assert (k["avg_reduction_pct"], k["quality_green"], k["speed_total"], k["accuracy_green"], k["accuracy_total"]) == (60.0, 1, 1, 0, 1)
    quick = SC.scorecard(cases).first()
    assert quick["quality_status"] is None and quick["overall_status"] == "ok"

    out = tempfile.mkdtemp(prefix="spark-") + "/run"
    RUNS.write_run(it.drop("run_id", "mode", "timestamp", "commit"), {"mode": "pr", "commit": "abc", "timestamp": "t", "run_id": "again", "config": {"isolate": True}}, out, rows_per_document=2)
    again = RUNS.scan_runs(spark, out)
    assert again.count() == 3 and {r["run_id"] for r in again.collect()} == {"again"}
    back = RUNS.iterations(again).orderBy("pos").collect()
    assert [(r["pos"], r["case_id"], r["error"]) for r in back] == [(r["pos"], r["case_id"], r["error"]) for r in it.orderBy("pos").collect()]
    stat = RUNS.case_rows(again).collect()
    assert len(stat) == 1 and stat[0]["p50_ms"] == 101 and stat[0]["mad_ms"] == 1
    same = compare_runs(flat, RUNS.flatten(RUNS.iterations(again)))["verdict"].first()
    assert same["exit_code"] == 0


def test_trend(spark):
    runs = spark.createDataFrame([(f"r{i}", 86_400 * i, f"{i}abcdefgh", "quick") for i in range(5)], "run_id string, unix_ts bigint, commit string, mode string")
    cases = spark.createDataFrame([(f"r{i}", "png", 10.0 * i + j, 20.0, 100 + j, 7) for i in range(5) for j in range(3)], "run_id string, format string, p50_ms double, p95_ms double, parent_peak_rss_p95_kb bigint, children_peak_rss_p95_kb bigint")
    errors = spark.createDataFrame([("r4",), ("r4",)], "run_id string")
    out = C.trend(cases, errors, runs, 3).collect()
    assert [(r["run_id"], r["iso_date"], r["p50_ms"], r["peak_rss_kb"], r["n_errors"], r["p50_delta_ms"]) for r in out] == [
        ("r2", "1970-01-03", 21.0, 108, 0, None), ("r3", "1970-01-04", 31.0, 108, 0, 10.0), ("r4", "1970-01-05", 41.0, 108, 2, 10.0),
    ]
    assert out[0]["short_sha"] == "2abcdef"
