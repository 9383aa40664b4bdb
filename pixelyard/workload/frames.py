"""Frames of the library's kind derived from the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelyard import constants as K
from pixelyard.plans.scale import epoch_micros
from pixelyard.sources.tables import read_table

FORMATS = list(K.MIME_TYPES)  # png apng jpeg webp gif svg svgz avif heic tiff bmp jxl
PRESETS = [p for p, _, _ in K.PRESETS]
SQL_FORMATS = "['" + "','".join(FORMATS) + "']"
SQL_PRESETS = "['" + "','".join(PRESETS) + "']"


def pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


# --- iterations: lineitem -----------------------------------------------------------------


def iterations(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem rows as benchmark iterations of part x supplier cases."""
    li = read_table(spark, folder, "lineitem")
    fmt = pick(FORMATS, F.col("l_partkey") % 12)
    preset = pick(PRESETS, F.col("l_partkey") % 3)
    return li.select(
        F.concat(F.lit("p"), F.col("l_partkey"), F.lit("."), fmt, F.lit("@"), preset).alias("case_id"),
        fmt.alias("format"),
        preset.alias("preset"),
        pick([b for b, _, _ in K.BUCKETS], F.col("l_partkey") % 5).alias("bucket"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        (F.col("l_extendedprice") / 10).alias("wall_ms"),
        (F.col("l_quantity") * 3).alias("children_cpu_ms"),
        (F.col("l_quantity") * 1000 + F.col("l_linenumber") * 7).alias("children_peak_rss_kb"),
        (F.col("l_quantity") * 500 + 13).alias("parent_peak_rss_kb"),
        (F.col("l_discount") * 40).alias("parallelism"),
        (F.col("l_discount") * 500 + F.col("l_tax") * 100).alias("reduction_pct"),
        pick(["none", "pngquant", "oxipng", "jpegli"], F.col("l_linenumber") % 4).alias("method"),
        F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("bigint").alias("optimized_size"),
        F.floor(F.col("l_extendedprice")).cast("bigint").alias("input_size"),
        (1 - F.col("l_tax") * 0.8).alias("ssim"),
        (30 + F.col("l_quantity") / 4).alias("psnr_db"),
        ((F.col("l_discount") - F.col("l_tax")) * 200).alias("size_rel_error_pct"),
        F.when(F.col("l_linenumber") == 7, F.concat(F.lit('{"phase":"'), F.col("l_returnflag"), F.lit('","message":"line '), F.col("l_orderkey"), F.lit('"}'))).alias("error"),
        pick(["exact", "direct_encode_sample", "generic_fallback_sample"], F.col("l_orderkey") % 3).alias("path"),
        (F.col("l_orderkey") % 2).alias("side"),
    )


ITERATIONS = f"""SELECT 'p' || l_partkey || '.' || fmt || '@' || preset AS case_id, fmt AS format, preset,
 (['tiny','small','medium','large','xlarge'])[l_partkey % 5 + 1] AS bucket,
 l_orderkey * 10 + l_linenumber AS pos, l_extendedprice / 10 AS wall_ms, l_quantity * 3 AS children_cpu_ms,
 l_quantity * 1000 + l_linenumber * 7 AS children_peak_rss_kb, l_quantity * 500 + 13 AS parent_peak_rss_kb,
 l_discount * 40 AS parallelism, l_discount * 500 + l_tax * 100 AS reduction_pct,
 (['none','pngquant','oxipng','jpegli'])[l_linenumber % 4 + 1] AS method,
 CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT) AS optimized_size,
 CAST(floor(l_extendedprice) AS BIGINT) AS input_size, 1 - l_tax * 0.8 AS ssim, 30 + l_quantity / 4 AS psnr_db,
 (l_discount - l_tax) * 200 AS size_rel_error_pct,
 CASE WHEN l_linenumber = 7 THEN '{{"phase":"' || l_returnflag || '","message":"line ' || l_orderkey || '"}}' END AS error,
 (['exact','direct_encode_sample','generic_fallback_sample'])[l_orderkey % 3 + 1] AS path, l_orderkey % 2 AS side
 FROM (SELECT *, ({SQL_FORMATS})[l_partkey % 12 + 1] AS fmt, ({SQL_PRESETS})[l_partkey % 3 + 1] AS preset FROM lineitem)"""


# --- two runs: orders -----------------------------------------------------------------------


def run_side(spark: SparkSession, folder: str, side: int) -> DataFrame:
    """orders of even (baseline, 0) or odd (head, 1) customers; a case is priority x status x month."""
    o = read_table(spark, folder, "orders").where(F.col("o_custkey") % 2 == side)
    month = F.date_format("o_orderdate", "yyyy-MM")
    return o.select(
        F.concat_ws("|", "o_orderpriority", "o_orderstatus", month).alias("case_id"),
        F.substring("o_orderpriority", 1, 1).alias("format"),
        F.col("o_orderkey").alias("pos"),
        (F.col("o_totalprice") / 1000).alias("wall_ms"),
        pick(["none", "jpegli", "jpegtran"], F.col("o_orderkey") % 3).alias("method"),
        ((F.col("o_orderkey") % 97) / 2).alias("reduction_pct"),
        F.floor("o_totalprice").cast("bigint").alias("optimized_size"),
        pick(["exact", "direct_encode_sample"], F.col("o_orderkey") % 2).alias("path"),
        ((F.col("o_orderkey") % 61 - 30) / 2).alias("size_rel_error_pct"),
        F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit('{"phase":"estimate","message":"order '), F.col("o_orderkey"), F.lit('"}')))
        .when(F.col("o_orderkey") % 13 == 0, F.concat(F.lit("ValueError: "), F.col("o_orderkey")))
        .alias("error"),
    )


def run_sql(side: int) -> str:
    return f"""SELECT o_orderpriority || '|' || o_orderstatus || '|' || strftime(o_orderdate, '%Y-%m') AS case_id,
 substr(o_orderpriority, 1, 1) AS format, o_orderkey AS pos, o_totalprice / 1000 AS wall_ms,
 (['none','jpegli','jpegtran'])[o_orderkey % 3 + 1] AS method, (o_orderkey % 97) / 2 AS reduction_pct,
 CAST(floor(o_totalprice) AS BIGINT) AS optimized_size,
 (['exact','direct_encode_sample'])[o_orderkey % 2 + 1] AS path, (o_orderkey % 61 - 30) / 2 AS size_rel_error_pct,
 CASE WHEN o_orderkey % 11 = 0 THEN '{{"phase":"estimate","message":"order ' || o_orderkey || '"}}'
      WHEN o_orderkey % 13 = 0 THEN 'ValueError: ' || o_orderkey END AS error
 FROM orders WHERE o_custkey % 2 = {side}"""


# --- requests and events -------------------------------------------------------------------


def events(spark: SparkSession, folder: str) -> DataFrame:
    e = read_table(spark, folder, "events")
    return e.withColumn("us", epoch_micros("ts"))


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """events as gated requests: start, grant (unless refused) and release on a nanosecond clock."""
    kind = F.col("event_type")
    start = F.col("us") * 1000
    wait = F.floor(F.col("value") * 1_000_000).cast("bigint")
    status = F.when(kind == "error", "error").when(kind == "signup", "503_queue").otherwise("success")
    granted = ~kind.isin("error", "signup")
    return events(spark, folder).select(
        F.concat(F.lit("u"), F.col("user_id")).alias("case_id"),
        pick(FORMATS, F.col("user_id") % 12).alias("format"),
        F.col("event_id").alias("pos"),
        status.alias("status"),
        start.alias("start_ns"),
        F.when(granted, start + wait).alias("grant_ns"),
        (start + wait * 3).alias("release_ns"),
        (F.col("event_id") % 101).cast("double").alias("reduction"),
        (F.col("event_id") % 5003).alias("size"),
        kind.alias("method"),
    )


REQUESTS = f"""SELECT 'u' || user_id AS case_id, ({SQL_FORMATS})[user_id % 12 + 1] AS format, event_id AS pos,
 CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' THEN '503_queue' ELSE 'success' END AS status,
 epoch_us(ts) * 1000 AS start_ns,
 CASE WHEN event_type NOT IN ('error', 'signup') THEN epoch_us(ts) * 1000 + wait END AS grant_ns,
 epoch_us(ts) * 1000 + wait * 3 AS release_ns, CAST(event_id % 101 AS DOUBLE) AS reduction, event_id % 5003 AS size,
 event_type AS method
 FROM (SELECT *, CAST(floor(value * 1000000) AS BIGINT) AS wait FROM events)"""


# --- header bytes: part and orders -----------------------------------------------------------


def hex_be(value: Column, width: int) -> Column:
    return F.lpad(F.hex(value.cast("bigint")), width * 2, "0")


COLOR_TYPES = [0, 2, 3, 4, 6, 1]


def png_assets(spark: SparkSession, folder: str) -> DataFrame:
    """33-byte PNG heads whose fields follow from the part row; every sixth colour type is invalid."""
    p = read_table(spark, folder, "part")
    width, height = F.col("p_partkey") % 5000 + 1, F.col("p_size") * 60
    color = pick(COLOR_TYPES, F.col("p_partkey") % 6)
    body = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hex_be(width, 4), hex_be(height, 4), F.lit("08"), hex_be(color, 1), F.lit("00000000000000"))
    return p.select(
        F.concat(F.lit("part/"), F.col("p_partkey")).alias("path"),
        "p_partkey",
        F.floor(F.col("p_retailprice") * (F.col("p_partkey") % 4000 + 10)).cast("bigint").alias("length"),
        F.unhex(body).alias("content"),
        pick([40, 60, 75], F.col("p_partkey") % 3).alias("quality"),
    )


PNG = """SELECT 'part/' || p_partkey AS path, p_partkey,
 CAST(floor(p_retailprice * (p_partkey % 4000 + 10)) AS BIGINT) AS length, ([40,60,75])[p_partkey % 3 + 1] AS quality,
 p_partkey % 5000 + 1 AS width, CAST(p_size AS BIGINT) * 60 AS height,
 ([0,2,3,4,6,1])[p_partkey % 6 + 1] AS color_type, p_partkey % 6 <> 5 AS valid FROM part"""


def _scaled(base: tuple, q: Column) -> Column:
    scale = F.when(q < 50, F.floor(F.lit(5000) / q)).otherwise(200 - 2 * q).cast("bigint")
    values = F.array(*[F.lit(v) for v in base])
    return F.transform(values, lambda v: F.least(F.greatest(F.floor((v * scale + 50) / 100), F.lit(1)), F.lit(255)))


def _table_hex(table: str) -> Column:
    return F.array_join(F.transform(table, lambda v: F.lpad(F.hex(v.cast("bigint")), 2, "0")), "")


def with_quality_tables(orders: DataFrame) -> DataFrame:
    """orders beside the standard tables at quality o_orderkey % 100 + 1; the tables are one broadcast
    frame of a hundred rows."""
    q = orders.sparkSession.range(1, 101).select(
        F.col("id").alias("q"), _scaled(K.ANNEX_K_LUMA, F.col("id")).cast("array<int>").alias("luma"), _scaled(K.ANNEX_K_CHROMA, F.col("id")).cast("array<int>").alias("chroma")
    )
    q = q.withColumns({"luma_hex": _table_hex("luma"), "chroma_hex": _table_hex("chroma")})
    return orders.withColumn("q", F.col("o_orderkey") % 100 + 1).join(F.broadcast(q), "q")


def jpeg_assets(spark: SparkSession, folder: str) -> DataFrame:
    """JPEG marker streams (tables, frame header, scan start) built from order keys. o_orderkey % 8
    selects: 4:2:0, progressive 4:4:4, 4:2:2, grayscale, lossless, four components, no chroma table,
    Adobe transform 2; the tables are the standard ones at quality o_orderkey % 100 + 1."""
    o = with_quality_tables(read_table(spark, folder, "orders"))
    k = F.col("o_orderkey")
    variant = k % 8
    width, height = k % 3000 + 100, k % 2000 + 100
    luma = F.concat(F.lit("FFDB004300"), F.col("luma_hex"))
    chroma = F.when(variant.isin(3, 6), "").otherwise(F.concat(F.lit("FFDB004301"), F.col("chroma_hex")))
    adobe = F.when(variant == 7, "FFEE000E41646F626500640000000002").otherwise("")
    marker = F.when(variant == 1, "C2").when(variant == 4, "C3").otherwise("C0")
    size = F.concat(hex_be(height, 2), hex_be(width, 2))
    first = F.when(variant == 1, "11").when(variant == 2, "21").otherwise("22")
    three = F.concat(F.lit("001108"), size, F.lit("0301"), first, F.lit("00021101031101"))
    frame = (
        F.when(variant == 3, F.concat(F.lit("000B08"), size, F.lit("01011100")))
        .when(variant == 5, F.concat(F.lit("001408"), size, F.lit("0401"), first, F.lit("00021101031101041100")))
        .otherwise(three)
    )
    body = F.concat(F.lit("FFD8"), adobe, luma, chroma, F.lit("FF"), marker, frame, F.lit("FFDA"))
    return o.select(
        F.concat(F.lit("order/"), k).alias("path"),
        "o_orderkey",
        F.floor(F.col("o_totalprice") * 4).cast("bigint").alias("length"),
        F.unhex(body).alias("content"),
        pick([40, 60, 75], k % 3).alias("quality"),
    )


_SCALE = "CASE WHEN q < 50 THEN 5000 // q ELSE 200 - 2 * q END"


def table_sql(base: tuple) -> str:
    return f"list_transform({list(base)}, lambda v: least(greatest((v * s + 50) // 100, 1), 255))"


JPEG = f"""SELECT *, {table_sql(K.ANNEX_K_LUMA)} AS luma,
 CASE WHEN variant NOT IN (3, 6) THEN {table_sql(K.ANNEX_K_CHROMA)} END AS chroma
 FROM (SELECT *, {_SCALE} AS s FROM (
 SELECT 'order/' || o_orderkey AS path, o_orderkey, CAST(floor(o_totalprice * 4) AS BIGINT) AS length,
 ([40,60,75])[o_orderkey % 3 + 1] AS quality, o_orderkey % 8 AS variant, o_orderkey % 100 + 1 AS q,
 o_orderkey % 3000 + 100 AS width, o_orderkey % 2000 + 100 AS height FROM orders))"""
