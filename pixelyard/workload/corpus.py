"""Manifest, case, digest and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelyard.functions.formats import detect_format
from pixelyard.operators import corpus as C
from pixelyard.plans.scale import scratch_path
from pixelyard.sources import assets, files, manifests, runs, tables
from pixelyard.sources.publish import sweep
from pixelyard.sources.tables import read_table
from pixelyard.workload import frames as W
from pixelyard.workload.registry import query
from pixelyard.workload.statistics import CASES

# --- entries: part ------------------------------------------------------------------------------

_LISTS = [["png", "jpeg"], ["svg", "svgz"], ["webp"], ["png", "svg"], ["avif", "heic", "jxl"]]
_SQL_LISTS = "[" + ",".join("['" + "','".join(x) + "']" for x in _LISTS) + "]"


def _entries(spark, folder):
    p = read_table(spark, folder, "part")
    formats = F.get(F.array(*[F.array(*[F.lit(f) for f in x]) for x in _LISTS]), (F.col("p_partkey") % 5).cast("int"))
    return p.select(
        F.concat(F.lit("e"), F.col("p_partkey")).alias("name"),
        W.pick(["tiny", "small", "medium", "large", "xlarge"], F.col("p_size") % 5).alias("bucket"),
        F.lower("p_brand").alias("content_kind"), F.col("p_partkey").alias("seed"), F.col("p_size").cast("bigint").alias("width"),
        F.col("p_size").cast("bigint").alias("height"), formats.alias("output_formats"),
        F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("core"), F.lit("fat_input"))).otherwise(F.array(F.lit("core"))).alias("tags"),
        F.when(F.col("p_partkey") % 4 != 0, F.sha2(F.col("p_name"), 256)).alias("expected_pixel_sha256"),
        F.when(F.col("p_partkey") % 4 != 1, F.create_map(F.lit("source"), F.sha2(F.col("p_type"), 256))).alias("expected_byte_sha256"),
    )


ENTRIES = f"""SELECT p_partkey, 'e' || p_partkey AS name, (['tiny','small','medium','large','xlarge'])[p_size % 5 + 1] AS bucket,
 ({_SQL_LISTS})[p_partkey % 5 + 1] AS output_formats, p_partkey % 3 = 0 AS fat,
 CASE WHEN p_partkey % 4 <> 0 THEN sha256(p_name) END AS pixel, CASE WHEN p_partkey % 4 <> 1 THEN sha256(p_type) END AS byte,
 p_partkey % 5 = 1 AS is_vector, p_name, p_type, p_size FROM part"""


@query(
    "expand_cases",
    f"""SELECT name || '.' || format || '@' || preset AS case_id, name, bucket, format, preset, CASE preset WHEN 'high' THEN 40 WHEN 'medium' THEN 60 ELSE 75 END AS quality
 FROM (SELECT *, unnest(['high','medium','low']) AS preset FROM (SELECT name, bucket, fat, unnest(output_formats) AS format FROM ({ENTRIES}))) WHERE NOT fat AND format <> 'jxl'""",
)
def _(spark, folder):
    formats = ["png", "jpeg", "svg", "svgz", "webp", "avif", "heic"]
    return C.expand_cases(_entries(spark, folder), exclude_tag="fat_input", formats=formats)


@query(
    "expand_cases_on_disk",
    f"""SELECT name || '.' || format || '@high' AS case_id, name, bucket, format, 'high' AS preset, 40 AS quality, CAST(p_partkey * 9 AS BIGINT) AS input_size
 FROM (SELECT *, unnest(output_formats) AS format FROM ({ENTRIES})) WHERE bucket = 'small' AND p_partkey % 7 <> 0""",
)
def _(spark, folder):
    e = _entries(spark, folder)
    files = e.where(F.col("seed") % 7 != 0).select("name", F.explode("output_formats").alias("format"), (F.col("seed") * 9).alias("size"))
    return C.expand_cases(e, ["high"], bucket="small", tag="core", files=files)


_VERDICTS = f"""SELECT name, is_vector, CASE WHEN is_vector THEN byte ELSE pixel END AS expected,
 CASE WHEN is_vector THEN actual_byte ELSE actual_pixel END AS actual FROM (SELECT *, sha256(CASE WHEN p_partkey % 10 = 6 THEN 'x' ELSE p_type END) AS actual_byte,
 CASE WHEN p_partkey % 11 <> 0 THEN sha256(CASE WHEN p_partkey % 13 = 0 THEN 'x' ELSE p_name END) END AS actual_pixel FROM ({ENTRIES}))"""
_VERDICTS = f"""SELECT *, CASE WHEN expected IS NULL THEN 'missing' WHEN actual IS NULL THEN 'schema_error' WHEN actual <> expected THEN 'mismatch' ELSE 'ok' END AS verdict FROM ({_VERDICTS})"""


def _verdicts(spark, folder):
    k = F.col("p_partkey")
    actual = read_table(spark, folder, "part").select(
        F.concat(F.lit("e"), k).alias("name"),
        F.sha2(F.when(k % 10 == 6, "x").otherwise(F.col("p_type")), 256).alias("byte_sha256"),
        F.when(k % 11 != 0, F.sha2(F.when(k % 13 == 0, "x").otherwise(F.col("p_name")), 256)).alias("pixel_sha256"),
    )
    return C.verify_manifest(_entries(spark, folder), actual)


@query("verify_manifest", _VERDICTS)
def _(spark, folder):
    return _verdicts(spark, folder)


@query(
    "manifest_exit",
    f"""SELECT count(*) FILTER (WHERE verdict = 'ok') AS n_ok, count(*) FILTER (WHERE verdict = 'mismatch') AS n_mismatch,
 count(*) FILTER (WHERE verdict = 'missing') AS n_missing, count(*) FILTER (WHERE verdict = 'schema_error') AS n_schema_error, 3 AS exit_code FROM ({_VERDICTS})""",
)
def _(spark, folder):
    return C.manifest_exit(_verdicts(spark, folder))


@query(
    "bucket_violations",
    f"""SELECT * FROM (SELECT name, format, size, bucket, CASE WHEN size < 10240 THEN 'tiny' WHEN size < 102400 THEN 'small' WHEN size < 1048576 THEN 'medium' WHEN size < 5242880 THEN 'large' ELSE 'xlarge' END AS actual_bucket
 FROM (SELECT name, bucket, unnest(output_formats) AS format, CAST(p_partkey AS BIGINT) * p_size * 40 AS size FROM ({ENTRIES}))) WHERE bucket <> actual_bucket""",
)
def _(spark, folder):
    e = _entries(spark, folder)
    files = e.select("name", F.explode("output_formats").alias("format"), (F.col("seed") * F.col("width") * 40).alias("size"))
    return C.bucket_violations(e, files)


@query("mixed_entries", f"SELECT name FROM ({ENTRIES}) WHERE p_partkey % 5 = 3")
def _(spark, folder):
    return C.mixed_entries(_entries(spark, folder)).select("name")


@query(
    "duplicates",
    """SELECT sha256(text) AS digest, count(*) AS n_copies, min(doc_id) AS first_key, (count(*) - 1) * max(octet_length(encode(text))) AS wasted_bytes
 FROM documents GROUP BY 1 HAVING count(*) > 1""",
)
def _(spark, folder):
    d = read_table(spark, folder, "documents")
    return C.duplicates(d, "doc_id", C.content_digest("text"), F.octet_length("text").cast("bigint"))


@query(
    "stale_files",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'build' WHEN p_partkey % 5 = 0 THEN 'refetch' ELSE 'skip' END AS action FROM part""",
)
def _(spark, folder):
    p = read_table(spark, folder, "part")
    wanted = p.select("p_partkey", F.sha2("p_name", 256).alias("sha256"))
    present = p.where(F.col("p_partkey") % 3 != 0).select("p_partkey", F.sha2(F.when(F.col("p_partkey") % 5 == 0, "old").otherwise(F.col("p_name")), 256).alias("sha256"))
    return C.stale_files(wanted, present, ["p_partkey"]).select("p_partkey", "action")


# --- sources and sinks ------------------------------------------------------------------------------


#: What stands before the text of a document made a file (hex), and the format that it makes of it.
_HEADS = [("FFD8FFE0", "jpeg"), ("474946383961", "gif"), ("524946460000000057454250", "webp"), ("424D", "bmp"), ("49492A00", "tiff"), ("FF0A", "jxl"), ("25504446", None)]
_HEX = "([" + ",".join(f"'{h}'" for h, _ in _HEADS) + f"])[doc_id % {len(_HEADS)} + 1]"
_FILES = f"SELECT doc_id, doc_id % 10 || '/doc-' || doc_id || '.bin' AS name, unhex({_HEX}) || encode(coalesce(text, '')) AS content FROM documents"


def _document_files(spark, folder):
    """Every document written as a file of its own, in ten folders."""
    d = read_table(spark, folder, "documents")
    head = F.unhex(W.pick([h for h, _ in _HEADS], F.col("doc_id") % len(_HEADS)))
    name = F.concat((F.col("doc_id") % 10).cast("string"), F.lit("/doc-"), F.col("doc_id"), F.lit(".bin"))
    rows = d.select(name.alias("name"), F.concat(head, F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("content"))
    return files.write_files(rows, scratch_path(spark, "files"))


def _named(df, *columns):
    return df.select(F.regexp_extract("path", r"(\d/doc-\d+\.bin)$", 1).alias("name"), *columns)


@query("scan_assets", f"SELECT name, octet_length(content) AS length, sha256(content) AS sha256 FROM ({_FILES}) WHERE octet_length(content) <= 3000")
def _(spark, folder):
    """Documents as files, scanned with a limit of 3000 bytes: names, sizes and digests."""
    return _named(assets.scan_assets(spark, _document_files(spark, folder), max_bytes=3000), "length", F.sha2("content", 256).alias("sha256"))


@query("rejected_assets", f"SELECT name, octet_length(content) AS length, 'file_too_large' AS error_code, 413 AS status FROM ({_FILES}) WHERE octet_length(content) > 3000")
def _(spark, folder):
    """The larger ones, which are listed and never opened."""
    return _named(assets.rejected_assets(spark, _document_files(spark, folder), max_bytes=3000), "length", "error_code", "status")


_FORMATS = "([" + ",".join(f"'{f}'" if f else "NULL" for _, f in _HEADS) + f"])[doc_id % {len(_HEADS)} + 1]"


@query("asset_heads", f"SELECT name, octet_length(content) AS total_size, sha256(content[1:100]) AS sha256, {_FORMATS} AS format FROM ({_FILES})")
def _(spark, folder):
    """The first hundred bytes and the format they tell."""
    heads = assets.asset_heads(assets.scan_assets(spark, _document_files(spark, folder)), 100)
    return _named(heads, "total_size", F.sha2("head", 256).alias("sha256"), detect_format("head", deep=False).alias("format"))


def _written(spark, folder):
    """The iterations written as one run of several documents, and scanned back."""
    rows = W.iterations(spark, folder).select(
        "pos", "case_id", "bucket", "format", "preset", "input_size", "optimized_size", "reduction_pct", "method", "error",
        F.struct(
            "wall_ms", F.col("children_cpu_ms").alias("children_user_ms"), F.lit(0.0).alias("children_sys_ms"), "parallelism",
            F.col("parent_peak_rss_kb").cast("bigint").alias("parent_peak_rss_kb"), F.col("children_peak_rss_kb").cast("bigint").alias("children_peak_rss_kb"),
        ).alias("measurement"),
    )
    path = scratch_path(spark, "runs")
    meta = {"mode": "timing", "commit": "abc1234", "timestamp": "2024-01-01T00:00:00Z", "cpu_count": 8}
    runs.write_run(rows, meta, path, 20_000)
    return runs.scan_runs(spark, path)


@query(
    "run_documents",
    f"SELECT 'abc1234@2024-01-01T00:00:00Z' AS run_id, case_id, wall_ms, error, optimized_size FROM ({W.ITERATIONS})",
    rounded="wall_ms",
)
def _(spark, folder):
    it = runs.flatten(runs.iterations(_written(spark, folder)))
    return it.select("run_id", "case_id", "wall_ms", "error", "optimized_size")


@query("run_case_rows", f"SELECT case_id, iterations, p50_ms, p95_ms FROM ({CASES})", rounded="p50_ms p95_ms", digits=8)
def _(spark, folder):
    return runs.case_rows(_written(spark, folder)).select("case_id", "iterations", "p50_ms", "p95_ms")


def _manifests(spark, folder):
    """Entries as manifest documents of at most a thousand entries each; the supported versions alternate
    with an unsupported one."""
    e = _entries(spark, folder).withColumn("name", F.when(F.col("seed") % 17 != 0, F.col("name")))
    doc = F.floor(F.col("seed") / 500).cast("bigint")
    path = scratch_path(spark, "manifests")
    (
        e.groupBy(doc.alias("doc")).agg(F.collect_list(F.struct(*e.columns)).alias("entries"))
        .select((F.col("doc") % 3 + 1).cast("int").alias("manifest_version"), F.concat(F.lit("m"), "doc").alias("manifest_name"), "entries")
        .write.option("maxRecordsPerFile", 1).json(path)
    )
    return path


@query(
    "manifest_entries",
    f"""SELECT name, bucket, 'm' || p_partkey // 500 AS manifest_name, len(output_formats) AS n_formats, 1 + CAST(fat AS INTEGER) AS n_tags FROM ({ENTRIES}) WHERE p_partkey % 17 <> 0 AND p_partkey // 500 % 3 <> 2""",
)
def _(spark, folder):
    found = manifests.scan_manifest(spark, _manifests(spark, folder))
    return found.select("name", "bucket", "manifest_name", F.size("output_formats").alias("n_formats"), F.size("tags").alias("n_tags"))


@query(
    "manifest_rejects",
    f"""SELECT problem, count(*) AS n FROM (SELECT 'missing name' AS problem FROM ({ENTRIES}) WHERE p_partkey % 17 = 0 AND p_partkey // 500 % 3 <> 2
 UNION ALL SELECT 'unsupported_version' FROM (SELECT DISTINCT p_partkey // 500 FROM part WHERE p_partkey // 500 % 3 = 2)) GROUP BY 1""",
)
def _(spark, folder):
    return manifests.rejected_entries(spark, _manifests(spark, folder)).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query(
    "partitioned_table",
    f"SELECT bucket, format, count(*) AS n, CAST(sum(optimized_size) AS BIGINT) AS bytes FROM ({W.ITERATIONS}) GROUP BY ALL",
)
def _(spark, folder):
    """Published by bucket and format: first another table, then one whose write fails midway, then this one again.
    Readers see the whole of the last write that was finished."""
    path = scratch_path(spark, "table")
    rows = W.iterations(spark, folder).select("case_id", "optimized_size", "bucket", "format")
    tables.publish_table(rows.where("bucket = 'tiny'"), path)
    broken = rows.withColumn("optimized_size", F.when(F.col("bucket") == "xlarge", F.raise_error(F.lit("stopped midway")).cast("bigint")).otherwise(F.col("optimized_size")))
    try:
        tables.publish_table(broken, path)
    except Exception as problem:  # the failure is part of what is shown
        if "stopped midway" not in str(problem):
            raise
    else:
        raise AssertionError("the broken write was published")
    tables.publish_table(rows, path)
    sweep(spark, path)
    back = tables.read_published(spark, path)
    return back.groupBy("bucket", "format").agg(F.count(F.lit(1)).alias("n"), F.sum("optimized_size").alias("bytes"))
