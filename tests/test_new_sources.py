"""Published tables, rows as files, end markers, sketches, p values, stacks of images."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelyard.functions.pixels import features_of, ssim_of, thumbnail_features
from pixelyard.functions.stats import erfc, two_sided_p
from pixelyard.functions.register import register_statistics
from pixelyard.operators.cases import error_text
from pixelyard.operators.quality import ssim_pairs
from pixelyard.plans import quantiles
from pixelyard.sources import assets
from pixelyard.sources.files import write_files
from pixelyard.sources.publish import current, publish, sweep
from pixelyard.sources.tables import publish_table, read_published


def test_publish_is_all_or_nothing(spark, tmp_path):
    path = f"{tmp_path}/table"
    with pytest.raises(FileNotFoundError):
        current(spark, path)
    first = spark.range(10).select("id", F.lit("a").alias("bucket"), F.lit("b").alias("format"))
    publish_table(first, path)
    with pytest.raises(Exception, match="midway"):
        publish_table(first.withColumn("id", F.when(F.col("id") > 5, F.raise_error(F.lit("midway")).cast("bigint")).otherwise(F.col("id"))), path)
    assert read_published(spark, path).count() == 10
    publish_table(first.limit(3), path)
    assert read_published(spark, path).count() == 3
    assert sweep(spark, path) >= 1 and read_published(spark, path).count() == 3


def test_a_failed_writer_leaves_the_pointer(spark, tmp_path):
    path = f"{tmp_path}/any"
    kept = publish(spark, path, lambda folder: spark.range(1).write.parquet(folder))

    def broken(folder):
        spark.range(5).write.parquet(folder)
        raise OSError("gone")

    with pytest.raises(OSError):
        publish(spark, path, broken)
    assert current(spark, path) == kept


def test_rows_as_files(spark, tmp_path):
    rows = [("a/x.bin", b"123"), ("a/y.bin", b""), ("z.bin", None), (None, b"left out"), ("big.bin", b"0" * 5000)]
    folder = write_files(spark.createDataFrame(rows, "name string, content binary").repartition(3), f"{tmp_path}/files")
    names = lambda df: {r["path"].split(folder)[-1].lstrip("/"): r["length"] for r in df.collect()}
    assert names(assets.scan_assets(spark, folder, 1000)) == {"a/x.bin": 3}  # Spark skips files without bytes
    assert names(assets.rejected_assets(spark, folder, 1000)) == {"big.bin": 5000}
    assert sorted(os.listdir(f"{folder}/a")) == ["x.bin", "y.bin"] and os.path.getsize(f"{folder}/z.bin") == 0
    plan = assets.scan_assets(spark, folder, 1000)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(length), LessThanOrEqual(length,1000)]" in plan
    plan = assets.rejected_assets(spark, folder, 1000)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_percentiles_read_their_input_once(spark, tmp_path):
    """Plain aggregates, percentiles and deviations of several measures: one scan, whatever reads the result."""
    df = spark.range(5000).select((F.col("id") % 7).alias("k"), (F.col("id") * 37 % 1009).cast("double").alias("v"), F.when(F.col("id") % 3 == 0, F.col("id").cast("double")).alias("w"))
    df.write.parquet(f"{tmp_path}/t")
    out = quantiles.aggregate(spark.read.parquet(f"{tmp_path}/t"), ["k"], [("v95", "v", 95), ("w50", "w", 50)], [F.count(F.lit(1)).alias("n"), F.max("w").alias("top")], deviations=[("mad", "v")])
    rows = {r["k"]: r for r in out.collect()}
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 1
    local = df.toPandas()
    for k, part in local.groupby("k"):
        v = part["v"].to_numpy()
        assert rows[k]["n"] == len(v) and rows[k]["top"] == part["w"].max()
        assert rows[k]["v95"] == pytest.approx(np.percentile(v, 95)) and rows[k]["w50"] == pytest.approx(np.nanpercentile(part["w"], 50))
        assert rows[k]["mad"] == pytest.approx(np.median(np.abs(v - np.median(v))))


def test_sketches_stay_within_their_error(spark):
    df = spark.range(30_000).select((F.col("id") % 3).alias("k"), F.exp(F.randn(5) * 3).alias("v")).persist()
    out = quantiles.aggregate(df, ["k"], [("p5", "v", 5), ("p50", "v", 50), ("p99", "v", 99)], [F.count(F.lit(1)).alias("n")], deviations=[("mad", "v")], approx=512)
    bound = quantiles.rank_error(512)
    for r in out.collect():
        v = np.array([x["v"] for x in df.where(F.col("k") == r["k"]).collect()])
        for p in (5, 50, 99):
            assert abs((v <= r[f"p{p}"]).mean() - p / 100) <= bound + 1 / len(v)
        exact = np.abs(v - np.median(v))
        assert abs((exact <= r["mad"]).mean() - 0.5) <= 4 * bound
    df.unpersist()


def test_sketch_of_nothing(spark):
    row = quantiles.aggregate(spark.createDataFrame([("a", None)], "k string, v double"), ["k"], [("p50", "v", 50)], approx=64).first()
    assert row["p50"] is None


def test_erfc(spark):
    points = [0.0, 1e-9, 0.1, 0.5, 1.0, 2.0, 2.4999, 2.5, 2.6, 3.0, 5.0, 10.0, 26.0, 40.0]
    got = spark.createDataFrame([(x,) for x in points], "x double").select("x", erfc("x").alias("y")).collect()
    assert max(abs(r["y"] - math.erfc(r["x"])) for r in got) < 1e-14
    assert all(r["y"] == pytest.approx(math.erfc(r["x"]), rel=1e-11) for r in got if r["x"] >= 2.5)
    ps = spark.createDataFrame([(-1.96,), (1.96,), (None,)], "t double").select(two_sided_p("t").alias("p")).collect()
    assert ps[0]["p"] == ps[1]["p"] == pytest.approx(0.0499957902964409) and ps[2]["p"] is None


def test_statistics_by_sql_name(spark):
    spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 2.0), ("b", 9.0), ("c", 5.0), ("a", None)], "grp string, value double").createOrReplaceTempView("__few")
    register_statistics(spark, "__few")
    assert {r["grp"]: r["mad"] for r in spark.sql("SELECT * FROM mad()").collect()} == {"a": 1.0, "b": 3.5, "c": 0.0}
    t, df, p = spark.sql("SELECT t, df, p FROM welch('a', 'b')").first()
    assert t == pytest.approx((7 / 3 - 5.5) / math.sqrt(7 / 9 + 49 / 4)) and p == pytest.approx(math.erfc(abs(t) / math.sqrt(2))) and df > 1
    assert spark.sql("SELECT t FROM welch('a', 'c')").first()["t"] == 0.0
    assert spark.sql("SELECT d FROM cohens_d('b', 'a')").first()["d"] > 0


def test_errors_of_every_kind(spark):
    texts = ['{"phase":"p","message":"m"}', '{"message":7}', "{}", '"said \\"x\\""', '["a",1]', "12", '{"phase":"x', "ValueError: y", None]
    got = [r[0] for r in spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "e string, i int").orderBy("i").select(error_text("e")).collect()]
    assert got == ["[p] m", "[?] 7", "[?] unknown error", 'said "x"', '["a",1]', "12", '{"phase":"x', "ValueError: y", None]


def test_stacks_of_images_of_any_shape(spark):
    rng = np.random.default_rng(3)
    rows, want = [], []
    for i, (h, w, c) in enumerate([(8, 8, 1), (12, 9, 3), (8, 8, 1), (20, 7, 4), (12, 9, 3)]):
        a, b = rng.random((h, w, c)), rng.random((h, w, c))
        rows.append((i, a.ravel().tolist(), b.ravel().tolist(), h, w, c))
        want.append(ssim_of(a, b))
    rows += [(5, None, [1.0], 1, 1, 1), (6, [0.5] * 63, [0.5] * 63, 8, 8, 1), (7, [0.5] * 64, [0.5] * 64, 8, 8, 1)]
    df = spark.createDataFrame(rows, "i int, ref array<double>, dist array<double>, height int, width int, channels int").coalesce(1)
    got = {r["i"]: r["ssim"] for r in ssim_pairs(df).collect()}
    assert [got[i] for i in range(5)] == pytest.approx(want) and got[5] is None and got[6] is None and got[7] == 1.0
    images = [(i, h, w, c, bytearray(rng.integers(0, 256, h * w * c, np.uint8).tobytes())) for i, (h, w, c) in enumerate([(5, 90, 3), (64, 64, 4), (5, 90, 3), (3, 3, 1), (2, 2, 2)])]
    out = spark.createDataFrame(images, "i int, h int, w int, c int, d binary").coalesce(1).select("i", thumbnail_features("h", "w", "c", "d").alias("f")).collect()
    for r in out:
        i, h, w, c, d = images[r["i"]]
        if c == 2:
            assert r["f"]["mean_sobel"] is None
            continue
        pixels = np.frombuffer(bytes(d), np.uint8).reshape(h, w, c)
        assert tuple(r["f"]) == pytest.approx(features_of(pixels if c == 1 else pixels[..., [2, 1, 0, *range(3, c)]]))
