"""Benchmark run documents (schema version 2) as tables.

A document holds an envelope, ``iterations`` and ``stats``. Small runs are one document. A large
run is written as several documents with the same envelope, each carrying a bounded slice and its
``first_position``; reading concatenates them, so no task ever holds a whole large run.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelyard.operators.cases import summarize_cases

SCHEMA_VERSION = 2

_MEASUREMENT = """wall_ms DOUBLE, parent_user_ms DOUBLE, parent_sys_ms DOUBLE, children_user_ms DOUBLE,
 children_sys_ms DOUBLE, total_cpu_ms DOUBLE, parallelism DOUBLE, parent_peak_rss_kb BIGINT,
 children_peak_rss_kb BIGINT, peak_rss_kb BIGINT, py_peak_alloc_kb BIGINT, phases MAP<STRING,DOUBLE>,
 rss_samples ARRAY<ARRAY<DOUBLE>>"""
_LATENCY = "p50: DOUBLE, p95: DOUBLE, p99: DOUBLE, max: DOUBLE"
_ITERATION = f"""case_id STRING, name STRING, bucket STRING, format STRING, preset STRING,
 input_size BIGINT, optimized_size BIGINT, iteration INT, measurement STRUCT<{_MEASUREMENT}>,
 tool_invocations ARRAY<STRUCT<tool: STRING, wall_ms: DOUBLE, exit_code: INT>>,
 reduction_pct DOUBLE, method STRING, error STRING,
 estimate STRUCT<predicted_size: BIGINT, predicted_reduction_pct: DOUBLE, method: STRING, confidence: STRING,
   already_optimized: BOOLEAN, path: STRING>,
 optimize STRUCT<actual_size: BIGINT, actual_reduction_pct: DOUBLE, method: STRING>,
 accuracy STRUCT<size_abs_error_bytes: BIGINT, size_rel_error_pct: DOUBLE, reduction_abs_error_pct: DOUBLE,
   reduction_abs_error_pct_abs: DOUBLE>,
 quality STRUCT<ssim: DOUBLE, psnr_db: DOUBLE, ssimulacra2: DOUBLE, butteraugli_max: DOUBLE,
   butteraugli_3norm: DOUBLE, wall_ms: DOUBLE, perfect_match: BOOLEAN>,
 load STRUCT<n_concurrent: INT, n_success: INT, n_503: INT, n_503_queue: INT, n_503_memory: INT, n_error: INT,
   wall_ms: DOUBLE, throughput_per_sec: DOUBLE, ok_rate: DOUBLE, request_latency_ms: STRUCT<{_LATENCY}>,
   queue_wait_ms: STRUCT<{_LATENCY}>, gate_observed: STRUCT<max_active_jobs: INT, max_queued_jobs: INT>>"""
_STATS = """case_id STRING, bucket STRING, format STRING, preset STRING, iterations BIGINT, p50_ms DOUBLE,
 p95_ms DOUBLE, p99_ms DOUBLE, median_ms DOUBLE, mad_ms DOUBLE, mean_ms DOUBLE, stdev_ms DOUBLE, min_ms DOUBLE,
 max_ms DOUBLE, children_cpu_p50_ms DOUBLE, children_cpu_p95_ms DOUBLE, children_peak_rss_p95_kb BIGINT,
 parent_peak_rss_p95_kb BIGINT, parallelism_p50 DOUBLE, reduction_pct DOUBLE, method STRING,
 py_peak_alloc_p95_kb BIGINT, raw_wall_ms ARRAY<DOUBLE>, rss_samples ARRAY<ARRAY<DOUBLE>>"""


_ENVELOPE = """schema_version INT, timestamp STRING, mode STRING, config MAP<STRING,STRING>,
 git STRUCT<commit: STRING, branch: STRING, dirty: BOOLEAN>,
 host STRUCT<platform: STRING, cpu_count: INT, rss_unit: STRING>, library_versions MAP<STRING,STRING>,
 manifest STRUCT<name: STRING, sha256: STRING>, annotations MAP<STRING,STRING>, first_position BIGINT"""
#: the document schema as DDL; schemas are always explicit because optional blocks vary by mode
RUN = f"{_ENVELOPE}, iterations ARRAY<STRUCT<{_ITERATION}>>, stats ARRAY<STRUCT<{_STATS}>>"


@cache
def iteration_schema() -> T.StructType:
    return T.StructType.fromDDL(_ITERATION)


@cache
def stats_schema() -> T.StructType:
    return T.StructType.fromDDL(_STATS)


def _read(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.schema(f"{RUN}, _corrupt STRING").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt")
    return reader.option("recursiveFileLookup", "true").json(path).select("*", F.col("_metadata.file_path").alias("file"))


def _accepted() -> Column:
    return F.coalesce(F.col("_corrupt").isNull() & (F.col("schema_version") == SCHEMA_VERSION), F.lit(False))


def scan_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run documents of the supported version, with a ``run_id``."""
    run_id = F.coalesce(
        F.try_element_at("annotations", F.lit("run_id")),
        F.concat_ws("@", F.coalesce("git.commit", F.lit("")), F.coalesce("timestamp", F.lit(""))),
    )
    return _read(spark, path).where(_accepted()).drop("_corrupt").withColumn("run_id", run_id)


def rejected_runs(spark: SparkSession, path: str) -> DataFrame:
    reason = F.when(F.col("_corrupt").isNotNull(), "parse_error").otherwise("unsupported_version")
    return _read(spark, path).where(~_accepted()).select("file", "schema_version", reason.alias("reason"))


_RUN_COLUMNS = ("run_id", "mode", "timestamp")


def iterations(runs: DataFrame) -> DataFrame:
    """One row per iteration; ``pos`` keeps the document order that "first" depends on."""
    exploded = runs.select(
        *_RUN_COLUMNS, F.col("git.commit").alias("commit"), F.coalesce("first_position", F.lit(0)).alias("__base"),
        F.posexplode("iterations").alias("__pos", "it"),
    )
    return exploded.select(*_RUN_COLUMNS, "commit", (F.col("__base") + F.col("__pos")).alias("pos"), "it.*")


def case_rows(runs: DataFrame) -> DataFrame:
    return runs.select(*_RUN_COLUMNS, F.col("git.commit").alias("commit"), F.inline("stats"))


def conditions(runs: DataFrame) -> DataFrame:
    """One row per run: what must agree for two runs to be comparable."""
    return runs.select(
        "run_id",
        "mode",
        F.col("host.cpu_count").alias("cpu_count"),
        F.coalesce(F.try_element_at("config", F.lit("isolate")).cast("boolean"), F.lit(False)).alias("isolate"),
        F.col("host.platform").alias("platform"),
    ).dropDuplicates(["run_id"])


def flatten(iters: DataFrame) -> DataFrame:
    """Measurement, quality and accuracy blocks as plain columns; a missing block gives NULLs."""
    present, full = iters.schema["measurement"].dataType.names, iteration_schema()["measurement"].dataType
    m = {f.name: F.col("measurement")[f.name] if f.name in present else F.lit(None).cast(f.dataType) for f in full.fields}
    flat = {
        f: m[f]
        for f in ("wall_ms", "parallelism", "parent_peak_rss_kb", "children_peak_rss_kb", "py_peak_alloc_kb", "rss_samples")
    }
    flat["children_cpu_ms"] = m["children_user_ms"] + m["children_sys_ms"]
    flat["ssim"], flat["psnr_db"] = F.col("quality.ssim"), F.col("quality.psnr_db")
    for f in ("size_rel_error_pct", "reduction_abs_error_pct_abs"):
        flat[f] = F.col("accuracy")[f]
    flat["path"] = F.col("estimate.path")
    flat["already_optimized"] = F.col("estimate.already_optimized")
    flat["actual_reduction_pct"] = F.col("optimize.actual_reduction_pct")
    return iters.withColumns(flat)


def write_run(iters: DataFrame, meta: Mapping, path: str, rows_per_document: int = 10_000) -> None:
    """Iterations (columns of the iteration schema plus ``pos``) and their statistics as documents that
    ``scan_runs`` reads back.

    A slice holds at most ``rows_per_document`` iterations and, because a case goes to the slice of
    its first iteration, at most as many statistics; one slice is one row and one file. Documents are
    compressed: their field names repeat in every row. ``iters`` is read several times.
    """
    fields = [f for f in iteration_schema().names if f in iters.columns]
    slim = iters.select("pos", *fields)
    slice_of = lambda c: F.floor(c / rows_per_document).cast("bigint")
    body = (
        # Dealt as rows: partial lists would be sorted and copied before the shuffle and be no smaller.
        slim.withColumn("slice", slice_of(F.col("pos"))).repartition("slice").groupBy("slice")
        .agg(F.min("pos").alias("first_position"), F.array_sort(F.collect_list(F.struct("pos", *fields)), _by_pos).alias("rows"))
        .select("slice", "first_position", F.transform("rows", lambda r: F.struct(*[r[f].alias(f) for f in fields])).alias("iterations"))
    )
    flat = flatten(_with_all_blocks(slim))
    cases = summarize_cases(flat, error="error", position="pos", reread=True)
    starts = flat.groupBy("case_id").agg(F.min("pos").alias("__first"))
    kept = [f for f in stats_schema().names if f in cases.columns]
    stats = (
        cases.join(starts, "case_id")
        .groupBy(slice_of(F.col("__first")).alias("slice"))
        .agg(F.collect_list(F.struct(*kept)).alias("stats"))
    )
    document = body.join(stats, "slice", "left").select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.lit(meta.get("timestamp")).cast("string").alias("timestamp"),
        F.lit(meta.get("mode", "quick")).alias("mode"),
        _string_map(meta.get("config", {})).alias("config"),
        F.struct(
            F.lit(meta.get("commit", "")).alias("commit"), F.lit(meta.get("branch", "")).alias("branch"),
            F.lit(bool(meta.get("dirty", False))).alias("dirty"),
        ).alias("git"),
        F.struct(
            F.lit(meta.get("platform", "linux")).alias("platform"), F.lit(int(meta.get("cpu_count", 0))).alias("cpu_count"),
            F.lit("kb").alias("rss_unit"),
        ).alias("host"),
        _string_map(meta.get("library_versions", {})).alias("library_versions"),
        F.struct(F.lit(meta.get("manifest", "")).alias("name"), F.lit(meta.get("manifest_sha256", "")).alias("sha256")).alias("manifest"),
        _string_map({**meta.get("annotations", {}), **({"run_id": meta["run_id"]} if "run_id" in meta else {})}).alias("annotations"),
        "first_position",
        "iterations",
        F.coalesce("stats", F.array().cast(T.ArrayType(T.StructType([stats_schema()[f] for f in kept])))).alias("stats"),
    )
    document.write.mode("errorifexists").option("maxRecordsPerFile", 1).option("ignoreNullFields", True).option("compression", "gzip").json(path)


def _by_pos(a: Column, b: Column) -> Column:
    return F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)


def _string_map(values: Mapping) -> Column:
    if not values:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(str(x)) for pair in values.items() for x in pair])


def _with_all_blocks(iters: DataFrame) -> DataFrame:
    missing = {f.name: F.lit(None).cast(f.dataType) for f in iteration_schema().fields if f.name not in iters.columns}
    return iters.withColumns(missing) if missing else iters
