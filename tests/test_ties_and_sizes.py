"""Ties have one answer, and SQL holds for tables of any size."""

import gzip

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pixelyard.functions import pixels
from pixelyard.operators import outcomes as O
from pixelyard.operators import scorecard as SC
from pixelyard.operators.ranking import first_per_case
from pixelyard.plans import quantiles, scale
from pixelyard.sources import assets, runs
from pixelyard.sources.files import ANNOUNCED, append_files
from pixelyard.streaming.assets import estimate_stream


def both(spark, folder, name):
    """A query's rows and its SQL's, over the parquet files of a folder."""
    df = entry.queries()[name](spark, str(folder))
    con = duckdb.connect()
    for file in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}/*.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    return sorted(map(tuple, df.select(*columns).collect()), key=repr), sorted(cur.fetchall(), key=repr)


LINE = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"


@pytest.mark.parametrize("sizes", [(900, 800), (800, 900)])
def test_cap_reduction_takes_the_smallest_size_of_a_quality(spark, sizes):
    ladder = spark.createDataFrame([("a", 50, s, 1000) for s in sizes], "k string, quality int, size int, original_size int").coalesce(1)
    assert tuple(O.cap_reduction(ladder, ["k"], 40).first()) == ("a", 50, 800)


def test_cap_reduction_agrees_with_its_sql_on_ties(spark, tmp_path):
    rows = [(k, 7, 1, 2, 1.0, 70_000.0 + (i if k % 2 else 9 - i), 0.0, 0.0, "A") for k in range(50) for i in range(10)]
    spark.createDataFrame(rows, LINE).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    ours, theirs = both(spark, tmp_path, "cap_reduction")
    assert ours == theirs and all(size == 70_000 for _, _, size in ours)


def test_every_refused_manifest_is_counted(spark, tmp_path):
    """Of 4,000 parts in eight documents, the third, sixth and no other are refused; none of fewer than 1,000."""
    part = spark.range(4000).select(F.col("id").alias("p_partkey"), F.lit("n").alias("p_name"), F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"), F.lit(1).alias("p_size"))
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    ours, theirs = both(spark, tmp_path, "manifest_rejects")
    assert ours == theirs and dict(ours)["unsupported_version"] == 2


def test_case_detail_orders_rows_of_one_position(spark, tmp_path):
    """Rows of a case at one position, in both orders: the first is told by the other columns."""
    rows = [(k, k, 1, 2, 1.0 + i, 1000.0 * (i + 1), 0.01 * (i if k % 2 else 9 - i), 0.0, "A") for k in range(40) for i in range(10)]
    spark.createDataFrame(rows, LINE).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    ours, theirs = both(spark, tmp_path, "case_detail")
    assert ours == theirs and {r[5] for r in ours} == {0.0}


def test_first_row_without_an_order_of_maps(spark):
    df = spark.createDataFrame([("a", 1, "y", {"m": 1}), ("a", 1, "x", {"m": 2}), ("a", None, "w", {}), ("b", None, "w", {})], "case_id string, pos int, s string, m map<string,int>")
    got = {r["case_id"]: (r["pos"], r["s"], r["m"]) for r in first_per_case(df).collect()}
    assert got == {"a": (1, "x", {"m": 2}), "b": (None, None, None)}


def test_small_images_are_worked_on_in_bounded_stacks(monkeypatch):
    """A batch of 8x8 images grows to 64x64 thumbnails and padded planes: no stack of them exceeds the bound."""
    n, seen = 10_000, []
    shape = [pa.array(np.full(n, s, np.int32)) for s in (8, 8, 1)]
    data = pa.array([bytes([i % 251] * 64) for i in range(n)], pa.binary())
    planes = pa.array(np.random.default_rng(1).random((n, 64)).tolist())
    for name, side in (("features_stack", 64), ("ssim_stack", 18)):
        whole = getattr(pixels, name)
        monkeypatch.setattr(pixels, name, lambda x, *rest, whole=whole, side=side: seen.append(len(x) * side * side) or whole(x, *rest))
    features, scores = pixels.thumbnail_features.func(*shape, data), pixels.ssim.func(planes, planes, *shape)
    assert max(seen) <= pixels.STACK and features.null_count == 0 and scores.to_pylist() == [1.0] * n


def test_small_and_crowded_groups_give_the_same_numbers(spark, monkeypatch):
    """Groups on both sides of the limit, a NULL key and NULL values: lists and buckets agree with numpy, for each way of reading."""
    monkeypatch.setattr(quantiles, "CROWDED", 20)
    rows = [(f"k{i % 40}" if i % 3 else "hot", float(i * 37 % 101), float(i) if i % 5 else None) for i in range(600)] + [(None, 4.0, None), (None, 8.0, 2.0), ("void", None, None)]
    df = spark.createDataFrame(rows, "k string, v double, w double")
    for options in ({}, {"reread": True}, {"few": True}, {"few": True, "reread": True}):
        got = {r["k"]: r for r in quantiles.aggregate(df, ["k"], [("v5", "v", 5), ("v50", "v", 50), ("w95", "w", 95)], [F.count(F.lit(1)).alias("n")], [("mad", "v")], **options).collect()}
        assert set(got) == {r[0] for r in rows}
        for key, r in got.items():
            v, w = (np.array([x[i] for x in rows if x[0] == key and x[i] is not None]) for i in (1, 2))
            assert r["n"] == sum(x[0] == key for x in rows)
            want = [np.percentile(v, 5), np.median(v), np.median(np.abs(v - np.median(v)))] if len(v) else [None] * 3
            assert [r["v5"], r["v50"], r["mad"]] == (pytest.approx(want, rel=1e-12) if len(v) else want) and r["w95"] == (pytest.approx(np.percentile(w, 95)) if len(w) else None)


def test_many_small_cases_are_shuffled_as_rows(spark, tmp_path):
    """A case's rows are dealt once, by the case, with the statistics that a query reads: not each value of each measure."""
    rows = [(k, k % 50, 1, 2, 1.0 + k, 1000.0 * k, 0.01, 0.0, "A") for k in range(200)]
    spark.createDataFrame(rows, LINE).write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = entry.queries()["memory_table"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(children_peak_rss_kb" in plan and "wall_ms" not in plan
    plan = entry.queries()["kpis"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "parallelism" not in plan and "children_cpu_ms" not in plan


def test_run_documents_are_compressed_and_read_back(spark, tmp_path):
    """Field names repeat in every iteration: the files take a small part of their text, and nothing of it is lost."""
    rows = spark.range(3000).select(
        F.col("id").alias("pos"), F.concat(F.lit("c"), F.col("id") % 50).alias("case_id"), F.lit("png").alias("format"), F.when(F.col("id") % 7 == 0, "boom").alias("error"),
        F.struct((F.col("id") % 11).cast("double").alias("wall_ms"), F.lit(1.0).alias("children_user_ms"), F.lit(0.0).alias("children_sys_ms")).alias("measurement"),
    )
    runs.write_run(rows, {"commit": "c", "timestamp": "t"}, f"{tmp_path}/run", 500)
    files = list((tmp_path / "run").glob("part-*"))
    sizes = [(f.stat().st_size, len(gzip.decompress(f.read_bytes()))) for f in files]
    assert len(files) == 6 and all(small * 5 < large for small, large in sizes)
    found = runs.scan_runs(spark, f"{tmp_path}/run")
    assert sorted(r["pos"] for r in runs.iterations(found).collect()) == list(range(3000))
    got = {r["case_id"]: (r["iterations"], r["p50_ms"]) for r in runs.case_rows(found).collect()}
    want = {f"c{k}": [i % 11 for i in range(k, 3000, 50) if i % 7] for k in range(50)}
    assert got == {k: (len(v), float(np.median(v))) for k, v in want.items()}


def test_many_small_files_are_read_by_few_tasks(spark, tmp_path):
    """Of 4,000 files Spark plans 125 partitions; scans and a stream's batch put them together."""
    for i in range(4000):
        (tmp_path / f"{i}.bin").write_bytes(b"x" * (i % 3 + 1))
    enough = spark.sparkContext.defaultParallelism * 8
    kept, refused = assets.scan_assets(spark, str(tmp_path), 2), assets.rejected_assets(spark, str(tmp_path), 2)
    assert max(kept.rdd.getNumPartitions(), refused.rdd.getNumPartitions()) <= enough
    assert (kept.count(), refused.count()) == (2667, 1333) and kept.agg(F.sum(F.length("content"))).first()[0] == 4000


def test_a_stream_lists_its_files_once(spark, tmp_path):
    """Small and large files come from one source, and a batch writes no more files than there are cores."""
    (tmp_path / "in").mkdir()
    for i in range(600):
        (tmp_path / "in" / f"{i}.png").write_bytes(b"\x89PNG" + b"x" * (i % 2 * 100))
    run = estimate_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", files_per_trigger=1000, max_file_bytes=50).trigger(availableNow=True).start()
    run.awaitTermination()
    assert [len(p["sources"]) for p in run.recentProgress if p["numInputRows"]] == [1]
    assert len(list((tmp_path / "out").glob("*.parquet"))) <= spark.sparkContext.defaultParallelism
    rows = spark.read.parquet(f"{tmp_path}/out").groupBy("error_code").count().collect()
    assert {r["error_code"]: r["count"] for r in rows}["file_too_large"] == 300 and sum(r["count"] for r in rows) == 600


def test_a_scorecard_computes_its_cases_once(spark):
    """All measures of a card come from one reading of the cases, be the first rows at hand, apart or left out."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    fields = "case_id string, format string, preset string, bucket string, pos long, p95_ms double, reduction_pct double, ssim double, size_rel_error_pct double"
    rows = [(f"c{i}", ("png", "jpeg", None)[i % 3], "high", ("tiny", "large", None)[i % 7 % 3], i, 40.0 + i, i % 11.0, 0.9 + i % 10 / 100, i % 5 - 2.0) for i in range(60)]
    cases = spark.createDataFrame(rows, fields)
    only = spark.createDataFrame([("x", "webp", "low", "tiny", 1, 1.0, 1.0, 0.5, -50.0)], fields)
    for first in (True, False, None):
        read.value, seen = 0, cases.mapInArrow(counted, cases.schema)
        card = SC.scorecard(seen, first=seen) if first else SC.scorecard(seen, None if first is None else cases.unionByName(only))
        got = {r["format"]: r for r in card.collect()}
        assert read.value == len(rows)
        assert set(got) == {"png", "jpeg", None} | ({"webp"} if first is False else set())
        for fmt in ("png", "jpeg", None):
            mine = [r for r in rows if r[1] == fmt]
            speed = {b: round(float(np.percentile([r[5] for r in mine if r[3] == b], 95)), 1) for b in {r[3] for r in mine}}
            assert got[fmt]["n_cases"] == 20 and {s["bucket"]: s["p95_ms"] for s in got[fmt]["speed_by_bucket"]} == speed
            assert got[fmt]["median_reduction_pct"] == round(float(np.median([r[6] for r in mine])), 1)
            assert got[fmt]["size_rel_error_p95"] == (None if first is None else 2.0)
        assert got["jpeg"]["ssim_worst"] == (None if first is None else min(r[7] for r in rows if r[1] == "jpeg")) and got["png"]["ssim_worst"] is None
        assert got["jpeg"]["n_below"] == (None if first is None else sum(r[7] < got["jpeg"]["ssim_threshold"] for r in rows if r[1] == "jpeg"))
        if first is False:
            assert (got["webp"]["n_cases"], got["webp"]["speed_by_bucket"], got["webp"]["overall_status"]) == (0, None, "fail")


def logged(checkpoint):
    """What a stream's file source has noted as seen, and so holds in the driver."""
    return [line for f in (checkpoint / "sources" / "0").glob("[0-9]*") for line in f.read_text().splitlines()[1:]]


def test_the_asset_query_keeps_no_list_of_its_files(spark, tmp_path, monkeypatch):
    """Of 200 documents in as many files the stream sees 40 tables, five names each."""
    monkeypatch.setattr(scale, "scratch_path", lambda spark, label: f"{tmp_path}/{label}")
    rows = entry.queries()["asset_stream"](spark, "/root/testdata/sf0.001")
    assert rows.count() == 200 == rows.select("name").distinct().count()
    assert len(logged(tmp_path / "assets" / "checkpoint")) == 40


def test_announced_files_are_read_once(spark, tmp_path):
    """Two lots with a restart between, large and empty files, and a lot that fails, which announces nothing."""
    k, folder = F.col("id"), f"{tmp_path}/in"
    size = F.when(k == 7, 0).when(k % 3 == 0, 100).otherwise(10)
    rows = spark.range(0, 600, 1, 3).select(k, F.concat(F.lit("a/"), k, F.lit(".png")).alias("name"), F.rpad(F.lit(""), size.cast("int"), F.lit("x")).cast("binary").alias("content"))
    for lot in (0, 1):
        append_files(rows.where(k % 2 == lot), folder, announce=30)
        estimate_stream(spark, folder, f"{tmp_path}/out", f"{tmp_path}/check", max_file_bytes=50, announced=4).trigger(availableNow=True).start().awaitTermination()
    with pytest.raises(Exception, match="midway"):
        append_files(rows.select(F.concat(F.lit("b/"), "name").alias("name"), F.when(k < 590, F.col("content")).otherwise(F.raise_error(F.lit("midway")).cast("binary")).alias("content")), folder, announce=30)
    assert len(logged(tmp_path / "check")) == 24 == len(list((tmp_path / "in" / ANNOUNCED).glob("[!.]*.parquet")))
    got = {r["asset"]: (r["original_size"], r["error_code"] == "file_too_large") for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {f"{folder}/a/{i}.png": (10, False) if i % 3 else (100, True) for i in range(600) if i != 7}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 599
    assert spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/a").count() == assets.scan_assets(spark, f"{folder}/a").count()
