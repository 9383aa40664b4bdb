"""Case statistics, accuracy, quality, load and scorecard queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelyard.functions import stats as S
from pixelyard.operators import cases as C
from pixelyard.operators import load as L
from pixelyard.operators import quality as Q
from pixelyard.operators import scorecard as SC
from pixelyard.plans import quantiles
from pixelyard.plans.runs import case_report
from pixelyard.plans.scale import epoch_micros
from pixelyard.sources.tables import read_table
from pixelyard.workload import frames as W
from pixelyard.workload.registry import query

_LINE = """SELECT *, l_orderkey * 10 + l_linenumber AS pos FROM lineitem"""


def _line_iterations(spark, folder) -> DataFrame:
    return read_table(spark, folder, "lineitem").select(
        "l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("wall_ms"),
        F.col("l_quantity").alias("children_cpu_ms"), F.col("l_partkey").alias("children_peak_rss_kb"),
        F.col("l_suppkey").alias("parent_peak_rss_kb"), F.col("l_discount").alias("parallelism"),
        F.when(F.col("l_linenumber") > 3, F.col("l_orderkey")).alias("py_peak_alloc_kb"),
        F.col("l_tax").alias("reduction_pct"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
    )


_STATS = """SELECT l_returnflag, l_linestatus, count(*) AS iterations, avg(l_extendedprice) AS mean_ms,
 CASE WHEN count(*) < 2 THEN 0 ELSE stddev_samp(l_extendedprice) END AS stdev_ms,
 min(l_extendedprice) AS min_ms, max(l_extendedprice) AS max_ms,
 quantile_cont(l_extendedprice, 0.5) AS p50_ms, quantile_cont(l_extendedprice, 0.95) AS p95_ms,
 quantile_cont(l_extendedprice, 0.99) AS p99_ms, mad(l_extendedprice) AS mad_ms,
 quantile_cont(l_extendedprice, 0.5) AS median_ms"""


@query(
    "case_statistics",
    f"""{_STATS}, quantile_cont(l_quantity, 0.5) AS children_cpu_p50_ms, quantile_cont(l_quantity, 0.95) AS children_cpu_p95_ms,
 CAST(trunc(quantile_cont(CAST(l_partkey AS DOUBLE), 0.95)) AS BIGINT) AS children_peak_rss_p95_kb,
 CAST(trunc(quantile_cont(CAST(l_suppkey AS DOUBLE), 0.95)) AS BIGINT) AS parent_peak_rss_p95_kb,
 quantile_cont(l_discount, 0.5) AS parallelism_p50,
 CAST(trunc(quantile_cont(CAST(CASE WHEN l_linenumber > 3 THEN l_orderkey END AS DOUBLE), 0.95)) AS BIGINT) AS py_peak_alloc_p95_kb,
 arg_min(l_tax, pos) AS reduction_pct FROM ({_LINE}) GROUP BY ALL""",
    rounded="mean_ms stdev_ms p50_ms p95_ms p99_ms mad_ms median_ms children_cpu_p50_ms children_cpu_p95_ms parallelism_p50",
    digits=4,
)
def _(spark, folder):
    return C.summarize_cases(_line_iterations(spark, folder), ["l_returnflag", "l_linestatus"], position="pos", few=True, reread=True)


REPORT = f"""SELECT *, CASE WHEN p95_ms <= 70000 THEN 'ok' WHEN p95_ms <= 87500 THEN 'warn' ELSE 'fail' END AS status
 FROM ({_STATS} FROM lineitem GROUP BY ALL)"""


@query("case_report", REPORT, rounded="mean_ms stdev_ms p50_ms p95_ms p99_ms mad_ms median_ms", digits=4)
def report(spark, folder):
    """Flagship: iteration rows to robust case statistics, status and order."""
    li = read_table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("wall_ms"))
    return case_report(li, ["l_returnflag", "l_linestatus"], "wall_ms", 70_000, few=True, reread=True)


@query("case_statistics_ranged", f"{_STATS} FROM lineitem GROUP BY ALL", rounded="mean_ms stdev_ms p50_ms p95_ms p99_ms mad_ms median_ms", digits=4)
def _(spark, folder):
    """The same numbers by the plan for large or skewed inputs."""
    li = read_table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("wall_ms"))
    return C.summarize_cases(li, ["l_returnflag", "l_linestatus"])


_POINTS = (0, 5, 50, 95, 99, 100)


@query(
    "percentiles",
    "SELECT o_orderpriority, " + ", ".join(f"quantile_cont(o_totalprice, {p / 100}) AS p{p}" for p in _POINTS) + " FROM orders GROUP BY 1",
    rounded=" ".join(f"p{p}" for p in _POINTS), digits=4,
)
def _(spark, folder):
    orders = read_table(spark, folder, "orders").select("o_orderpriority", "o_totalprice")
    return quantiles.aggregate(orders, ["o_orderpriority"], [(f"p{p}", "o_totalprice", p) for p in _POINTS], few=True)


@query(
    "percentiles_global_ranged",
    "SELECT " + ", ".join(f"quantile_cont(o_totalprice, {p / 100}) AS p{p}" for p in _POINTS) + ", count(*) AS n FROM orders",
    rounded=" ".join(f"p{p}" for p in _POINTS), digits=4,
)
def _(spark, folder):
    orders = read_table(spark, folder, "orders").select("o_totalprice")
    return quantiles.aggregate(orders, [], [(f"p{p}", "o_totalprice", p) for p in _POINTS], [F.count(F.lit(1)).alias("n")])


@query("percentiles_approx", f"SELECT o_orderpriority, p, count(*) AS n, TRUE AS within FROM orders, (SELECT unnest({list(_POINTS)}) AS p) GROUP BY ALL")
def _(spark, folder):
    """The opt-in sketch: of every percentile whether its exact rank is within the stated error."""
    size = 2048
    orders = read_table(spark, folder, "orders").select("o_orderpriority", "o_totalprice")
    found = quantiles.aggregate(orders, ["o_orderpriority"], [(f"p{p}", "o_totalprice", p) for p in _POINTS], [F.count(F.lit(1)).alias("n")], approx=size)
    points = found.select("o_orderpriority", "n", F.inline(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"p{p}").alias("at")) for p in _POINTS])))
    x, at, bound = F.col("o_totalprice"), F.col("at"), quantiles.rank_error(size)
    ranks = orders.join(points, "o_orderpriority").groupBy("o_orderpriority", "p", "n").agg(F.avg((x < at).cast("double")).alias("below"), F.avg((x <= at).cast("double")).alias("upto"))
    return ranks.select("o_orderpriority", "p", "n", ((F.col("below") - bound <= F.col("p") / 100) & (F.col("upto") + bound >= F.col("p") / 100)).alias("within"))


@query("median_abs_deviation", "SELECT o_custkey, mad(o_totalprice) AS mad FROM orders GROUP BY 1", rounded="mad", digits=6)
def _(spark, folder):
    return quantiles.median_abs_deviation(read_table(spark, folder, "orders"), ["o_custkey"], "o_totalprice")


@query(
    "mean_std",
    """SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS mean,
 CASE WHEN count(*) < 2 THEN 0 ELSE stddev_samp(o_totalprice) END AS std FROM orders GROUP BY 1""",
    rounded={"mean": 7, "std": 6},
)
def _(spark, folder):
    orders = read_table(spark, folder, "orders")
    return orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean"), S.sample_std("o_totalprice").alias("std")
    )


@query(
    "effect_and_significance",
    """WITH g AS (SELECT l_suppkey, l_orderkey % 2 AS side, count(*) AS n, avg(l_quantity) AS m,
  CASE WHEN count(*) < 2 THEN 0 ELSE stddev_samp(l_quantity) END AS s FROM lineitem GROUP BY ALL),
 p AS (SELECT a.l_suppkey, a.n AS na, a.m AS ma, a.s AS sa, b.n AS nb, b.m AS mb, b.s AS sb,
  a.s * a.s / a.n AS ua, b.s * b.s / b.n AS ub,
  CASE WHEN a.n + b.n > 2 THEN ((a.n - 1) * a.s * a.s + (b.n - 1) * b.s * b.s) / (a.n + b.n - 2) END AS pooled
  FROM g a JOIN g b ON a.l_suppkey = b.l_suppkey AND a.side = 0 AND b.side = 1),
 t AS (SELECT *, na >= 2 AND nb >= 2 AS ok FROM p)
 SELECT l_suppkey, CASE WHEN ok AND pooled > 0 THEN (ma - mb) / sqrt(pooled) ELSE 0 END AS d,
 CASE WHEN ok AND ua + ub > 0 THEN (ma - mb) / sqrt(ua + ub) ELSE 0 END AS t,
 CASE WHEN ok AND ua + ub > 0 THEN (ua + ub) * (ua + ub) / (ua * ua / (na - 1) + ub * ub / (nb - 1)) ELSE 0 END AS df,
 coalesce(ok AND ua + ub > 0 AND abs((ma - mb) / sqrt(ua + ub)) > 1.959963984540054
  AND abs((ma - mb) / sqrt(pooled)) >= 0.1, FALSE) AS differs FROM t""",
    rounded="d t df", digits=5,
)
def _(spark, folder):
    li = read_table(spark, folder, "lineitem").withColumn("side", F.col("l_orderkey") % 2)
    side = lambda s, tag: li.where(F.col("side") == s).groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias(f"n{tag}"), F.avg("l_quantity").alias(f"m{tag}"), S.sample_std("l_quantity").alias(f"s{tag}")
    )
    both = side(0, "a").join(side(1, "b"), "l_suppkey")
    args = ("na", "ma", "sa", "nb", "mb", "sb")
    return both.select(
        "l_suppkey", S.cohens_d(*args).alias("d"), S.welch_t(*args).alias("t"), S.welch_df("na", "sa", "nb", "sb").alias("df"),
        S.differs(*args, min_effect=0.1).alias("differs"),
    )


@query(
    "derived_measures",
    """SELECT pos, u + s + cu + cs AS total_cpu_ms, cu + cs AS children_cpu_ms,
 CASE WHEN w > 0 THEN (u + s + cu + cs) / w ELSE 0 END AS parallelism, greatest(p, c) AS peak_rss_kb
 FROM (SELECT l_orderkey * 10 + l_linenumber AS pos, l_extendedprice AS w, l_quantity AS u, l_tax AS s, l_discount AS cu,
  CAST(l_linenumber AS DOUBLE) AS cs, l_partkey AS p, l_suppkey AS c FROM lineitem)""",
    rounded="total_cpu_ms children_cpu_ms parallelism",
)
def _(spark, folder):
    li = read_table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_extendedprice").alias("wall_ms"),
        F.col("l_quantity").alias("parent_user_ms"), F.col("l_tax").alias("parent_sys_ms"), F.col("l_discount").alias("children_user_ms"),
        F.col("l_linenumber").cast("double").alias("children_sys_ms"), F.col("l_partkey").alias("parent_peak_rss_kb"),
        F.col("l_suppkey").alias("children_peak_rss_kb"),
    )
    return C.derived_measures(li).select("pos", "total_cpu_ms", "children_cpu_ms", "parallelism", "peak_rss_kb")


@query(
    "tool_attribution",
    """SELECT event_type AS tool, count(*) AS invocations, sum(CAST(value AS DECIMAL(18,2))) AS total_wall_ms,
 count(*) FILTER (WHERE event_id % 7 = 0) AS failures FROM events GROUP BY 1""",
    rounded="total_wall_ms", digits=2,
)
def _(spark, folder):
    e = read_table(spark, folder, "events").select(
        "event_id",
        F.array(F.struct(F.col("event_type").alias("tool"), F.col("value").alias("wall_ms"), (F.col("event_id") % 7 == 0).cast("int").alias("exit"))).alias("calls"),
    )
    calls = F.transform("calls", lambda c: F.struct(c["tool"].alias("tool"), c["wall_ms"].alias("wall_ms"), c["exit"].alias("exit_code")))
    flipped = e.withColumn("calls", calls)
    return C.tool_attribution(flipped, invocations="calls")


_ACC = """SELECT l_orderkey * 10 + l_linenumber AS pos, l_returnflag AS format,
 CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT) AS p, CAST(floor(l_extendedprice * (1 - l_tax)) AS BIGINT) AS a,
 l_discount * 100 AS pr, l_tax * 100 AS ar FROM lineitem"""
_ACC_ERR = f"""SELECT *, p - a AS size_abs_error_bytes, CASE WHEN a > 0 THEN 100.0 * (p - a) / a ELSE 0 END AS size_rel_error_pct,
 pr - ar AS reduction_abs_error_pct, abs(pr - ar) AS reduction_abs_error_pct_abs FROM ({_ACC})"""


def _accuracy(spark, folder):
    li = read_table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_returnflag").alias("format"),
        F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("bigint").alias("predicted_size"),
        F.floor(F.col("l_extendedprice") * (1 - F.col("l_tax"))).cast("bigint").alias("actual_size"),
        (F.col("l_discount") * 100).alias("predicted_reduction_pct"), (F.col("l_tax") * 100).alias("actual_reduction_pct"),
        (F.col("l_discount") == 0).alias("already_optimized"),
    )
    return C.accuracy_errors(li, digits=None)


@query(
    "accuracy_errors",
    f"SELECT pos, size_abs_error_bytes, size_rel_error_pct, reduction_abs_error_pct, reduction_abs_error_pct_abs FROM ({_ACC_ERR})",
    rounded="size_rel_error_pct reduction_abs_error_pct reduction_abs_error_pct_abs",
)
def _(spark, folder):
    cols = ("pos", "size_abs_error_bytes", "size_rel_error_pct", "reduction_abs_error_pct", "reduction_abs_error_pct_abs")
    return _accuracy(spark, folder).select(*cols)


@query(
    "accuracy_summary",
    f"""SELECT coalesce(format, '(all)') AS format, count(*) AS n, count(*) FILTER (WHERE pr = 0) AS noop_predicted,
 count(*) FILTER (WHERE pr = 0 AND ar < 1.0) AS noop_correct,
 quantile_cont(abs(size_rel_error_pct), 0.5) AS size_rel_error_p50, quantile_cont(abs(size_rel_error_pct), 0.95) AS size_rel_error_p95,
 quantile_cont(reduction_abs_error_pct_abs, 0.5) AS reduction_error_p50, quantile_cont(reduction_abs_error_pct_abs, 0.95) AS reduction_error_p95
 FROM ({_ACC_ERR}) GROUP BY GROUPING SETS ((format), ())""",
    rounded="size_rel_error_p50 size_rel_error_p95 reduction_error_p50 reduction_error_p95",
)
def _(spark, folder):
    return C.accuracy_summary(_accuracy(spark, folder))


# --- pixel quality ---------------------------------------------------------------------------


def _patches(spark, folder) -> DataFrame:
    """Every embedding as an 8x8 patch in [0, 1], paired with the next one."""
    e = read_table(spark, folder, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: (x.cast("double") + 8.0) / 16.0).alias("patch")
    )
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("patch").alias("dist"))
    return e.withColumnRenamed("patch", "ref").join(nxt, "vec_id")


@query(
    "psnr_pairs",
    """SELECT vec_id, mse, 10 * log10(1 / mse) AS psnr_db, mse = 0 AS perfect_match FROM (
 SELECT a.vec_id, list_sum(list_transform(range(1, 65), lambda i: pow((CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) / 16.0, 2))) / 64 AS mse
 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)""",
    rounded={"mse": 10, "psnr_db": 6},
)
def _(spark, folder):
    return Q.psnr_pairs(_patches(spark, folder), digits=None).select("vec_id", "mse", "psnr_db", "perfect_match")


@query(
    "psnr_pixels",
    """SELECT label, avg(pow((CAST(x AS DOUBLE) - CAST(y AS DOUBLE)) / 16.0, 2)) AS mse,
 10 * log10(1 / avg(pow((CAST(x AS DOUBLE) - CAST(y AS DOUBLE)) / 16.0, 2))) AS psnr_db, FALSE AS perfect_match
 FROM (SELECT a.label, unnest(a.embedding) AS x, unnest(b.embedding) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
 GROUP BY label""",
    rounded={"mse": 10, "psnr_db": 6},
)
def _(spark, folder):
    labels = read_table(spark, folder, "embeddings").select("vec_id", "label")
    pairs = _patches(spark, folder).join(labels, "vec_id")
    pixels = pairs.select("label", F.inline(F.arrays_zip("ref", "dist")))
    return Q.psnr_pixels(pixels, ["label"], digits=None)


_GOOD = f"SELECT * FROM ({W.ITERATIONS}) WHERE error IS NULL"
_FLOOR = "CASE preset WHEN 'high' THEN 0.95 WHEN 'medium' THEN 0.97 WHEN 'low' THEN 0.99 ELSE 0.97 END"
_FIRST = f"SELECT * FROM ({_GOOD}) QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY pos) = 1"


def good_iterations(spark, folder) -> DataFrame:
    return W.iterations(spark, folder).where(F.col("error").isNull())


@query(
    "quality_summary",
    f"""SELECT format, count(*) AS total, count(*) FILTER (WHERE ssim < {_FLOOR}) AS below_threshold,
 quantile_cont(ssim, 0.5) AS ssim_p50, quantile_cont(ssim, 0.05) AS ssim_p05, quantile_cont(psnr_db, 0.5) AS psnr_p50
 FROM ({_FIRST}) GROUP BY 1""",
    rounded="ssim_p50 ssim_p05 psnr_p50",
)
def _(spark, folder):
    return Q.quality_summary(good_iterations(spark, folder))


@query(
    "quality_metrics",
    f"""SELECT metric, coalesce(format, '(all)') AS format, count(*) AS n, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.95) AS p95
 FROM (SELECT format, unnest(['ssim', 'psnr_db']) AS metric, unnest([ssim, psnr_db]) AS score FROM ({_GOOD}))
 GROUP BY GROUPING SETS ((metric, format), (metric))""",
    rounded="median p95",
)
def _(spark, folder):
    return Q.metric_summary(good_iterations(spark, folder))


# --- load ------------------------------------------------------------------------------------

LOAD_CASES = f"""SELECT case_id, any_value(format) AS format, count(*) AS n_requests,
 count(*) FILTER (WHERE status = 'success') AS n_success, count(*) FILTER (WHERE status = '503_queue') AS n_503_queue,
 count(*) FILTER (WHERE status = '503_memory') AS n_503_memory, count(*) FILTER (WHERE status LIKE '503%') AS n_503,
 count(*) FILTER (WHERE status = 'error') AS n_error,
 coalesce(quantile_cont((release_ns - start_ns) / 1e6, 0.5) FILTER (WHERE status = 'success'), 0) AS latency_p50_ms,
 coalesce(quantile_cont((release_ns - start_ns) / 1e6, 0.95) FILTER (WHERE status = 'success'), 0) AS latency_p95_ms,
 coalesce(quantile_cont((release_ns - start_ns) / 1e6, 0.99) FILTER (WHERE status = 'success'), 0) AS latency_p99_ms,
 coalesce(max((release_ns - start_ns) / 1e6) FILTER (WHERE status = 'success'), 0) AS latency_max_ms,
 coalesce(quantile_cont((grant_ns - start_ns) / 1e6, 0.5) FILTER (WHERE status = 'success'), 0) AS queue_wait_p50_ms,
 coalesce(quantile_cont((grant_ns - start_ns) / 1e6, 0.95) FILTER (WHERE status = 'success'), 0) AS queue_wait_p95_ms,
 coalesce(quantile_cont((grant_ns - start_ns) / 1e6, 0.99) FILTER (WHERE status = 'success'), 0) AS queue_wait_p99_ms,
 coalesce(max((grant_ns - start_ns) / 1e6) FILTER (WHERE status = 'success'), 0) AS queue_wait_max_ms,
 (max(release_ns) - min(start_ns)) / 1e6 AS wall_ms,
 count(*) FILTER (WHERE status = 'success') / ((max(release_ns) - min(start_ns)) / 1e9) AS throughput_per_sec,
 count(*) FILTER (WHERE status = 'success') / count(*) AS ok_rate,
 coalesce(avg(reduction) FILTER (WHERE status = 'success'), 0) AS mean_reduction,
 coalesce(CAST(trunc(avg(size) FILTER (WHERE status = 'success')) AS BIGINT), 0) AS mean_optimized_size
 FROM ({W.REQUESTS}) GROUP BY case_id"""
_MODE = f"""SELECT case_id, method FROM (SELECT case_id, method, count(*) AS n, min(pos) AS first FROM ({W.REQUESTS})
 WHERE status = 'success' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY n DESC, first) = 1"""
_LOAD_ROUND = {c: 9 for c in (
    "latency_p50_ms latency_p95_ms latency_p99_ms latency_max_ms queue_wait_p50_ms queue_wait_p95_ms queue_wait_p99_ms "
    "queue_wait_max_ms ok_rate mean_reduction").split()} | {"wall_ms": 4, "throughput_per_sec": 9}


@query(
    "load_case",
    f"SELECT l.* EXCLUDE (format), coalesce(m.method, '') AS method FROM ({LOAD_CASES}) l LEFT JOIN ({_MODE}) m USING (case_id)",
    rounded=_LOAD_ROUND,
)
def _(spark, folder):
    return L.load_case(W.requests(spark, folder))


@query(
    "load_rollup",
    f"""SELECT coalesce(format, '(all)') AS format, count(*) AS n_cases, sum(n_requests) AS n_requests, sum(n_success) AS n_success,
 sum(n_503) AS n_503, sum(n_error) AS n_error, quantile_cont(throughput_per_sec, 0.5) AS median_throughput,
 quantile_cont(latency_p95_ms, 0.5) AS median_latency_p95_ms, quantile_cont(ok_rate, 0.5) AS median_ok_rate,
 sum(n_success) / sum(n_requests) AS ok_rate FROM ({LOAD_CASES}) GROUP BY GROUPING SETS ((format), ())""",
    rounded={"median_throughput": 9, "median_latency_p95_ms": 9, "median_ok_rate": 6, "ok_rate": 6},
)
def _(spark, folder):
    cases = L.load_case(W.requests(spark, folder), ["case_id", "format"])
    return L.load_rollup(cases)


_SWEEP = """SELECT {keys} greatest(max(level), 0) AS peak FROM (SELECT {keys} sum(d) OVER ({part} ORDER BY t) AS level FROM (
 SELECT {keys} t, sum(d) AS d FROM (SELECT *, us AS t, 1 AS d FROM e UNION ALL SELECT *, us + dur AS t, -1 AS d FROM e) GROUP BY {keys} t))"""
_INTERVALS = "WITH e AS (SELECT event_type, epoch_us(ts) AS us, CAST(floor(value * 1000000) AS BIGINT) AS dur FROM events) "


def _intervals(spark, folder):
    return W.events(spark, folder).select(
        "event_type", F.col("us").alias("start_us"), (F.col("us") + F.floor(F.col("value") * 1_000_000).cast("bigint")).alias("end_us")
    )


@query("peak_concurrency", _INTERVALS + "SELECT event_type, CAST(peak AS BIGINT) AS peak FROM (" + _SWEEP.format(keys="event_type,", part="PARTITION BY event_type") + " GROUP BY event_type)")
def _(spark, folder):
    return L.peak_concurrency(_intervals(spark, folder), ["event_type"], "start_us", "end_us")


@query("peak_concurrency_global", _INTERVALS + "SELECT CAST(peak AS BIGINT) AS peak FROM (" + _SWEEP.format(keys="", part="") + ")")
def _(spark, folder):
    return L.peak_concurrency(_intervals(spark, folder), [], "start_us", "end_us")


def _peaks(start: str, end: str, name: str) -> str:
    return f"""SELECT format, greatest(max(level), 0) AS {name} FROM (SELECT format, sum(d) OVER (PARTITION BY format ORDER BY t) AS level FROM (
 SELECT format, t, sum(d) AS d FROM (SELECT format, {start} AS t, 1 AS d FROM r UNION ALL SELECT format, {end} AS t, -1 AS d FROM r) GROUP BY ALL)) GROUP BY format"""


@query(
    "gate_peaks",
    f"""WITH r AS (SELECT * FROM ({W.REQUESTS}) WHERE grant_ns IS NOT NULL) SELECT format, CAST(max_active AS BIGINT) AS max_active,
 CAST(max_queued AS BIGINT) AS max_queued FROM ({_peaks('grant_ns', 'release_ns', 'max_active')}) JOIN ({_peaks('start_ns', 'grant_ns', 'max_queued')}) USING (format)""",
)
def _(spark, folder):
    return L.gate_peaks(W.requests(spark, folder), ["format"])


# --- scorecard --------------------------------------------------------------------------------

CASES = f"""SELECT case_id, any_value(format) AS format, any_value(preset) AS preset, any_value(bucket) AS bucket, count(*) AS iterations,
 quantile_cont(wall_ms, 0.5) AS p50_ms, quantile_cont(wall_ms, 0.95) AS p95_ms, arg_min(reduction_pct, pos) AS reduction_pct,
 CAST(trunc(quantile_cont(children_peak_rss_kb, 0.95)) AS BIGINT) AS children_peak_rss_p95_kb,
 CAST(trunc(quantile_cont(parent_peak_rss_kb, 0.95)) AS BIGINT) AS parent_peak_rss_p95_kb
 FROM ({_GOOD}) GROUP BY case_id"""
_SLO = """SELECT format, bucket, count(*) AS n_cases, quantile_cont(p95_ms, 0.95) AS p95_ms,
 CAST(any_value(CASE bucket WHEN 'tiny' THEN 100 WHEN 'small' THEN 500 WHEN 'medium' THEN 2000 WHEN 'large' THEN 8000 ELSE 20000 END
  * CASE WHEN format IN ('heic', 'jxl') AND bucket IN ('large', 'xlarge') THEN 1.5 ELSE 1 END) AS BIGINT) AS slo_ms
 FROM cases GROUP BY format, bucket"""
_SLO_STATUS = f"SELECT *, CASE WHEN p95_ms <= slo_ms THEN 'ok' WHEN p95_ms <= slo_ms * 1.25 THEN 'warn' ELSE 'fail' END AS status FROM ({_SLO})"


def cases_of(spark, folder, *wanted: str, first: tuple[str, ...] = ()) -> DataFrame:
    """The cases with the statistics and metadata that a query reads."""
    return C.summarize_cases(good_iterations(spark, folder), position="pos", wanted=wanted, first=first, reread=True)


def _card(spark, folder) -> DataFrame:
    cases = cases_of(spark, folder, "format", "bucket", "preset", "p95_ms", "reduction_pct", first=("ssim", "size_rel_error_pct"))
    return SC.scorecard(cases, first=cases, digits=False)


@query("slo_status", f"WITH cases AS ({CASES}) {_SLO_STATUS}", rounded="p95_ms", digits=8)
def _(spark, folder):
    return SC.slo_status(cases_of(spark, folder, "format", "bucket", "p95_ms"), digits=None)


_CARD = f"""WITH cases AS ({CASES}), first AS ({_FIRST}), slo AS ({_SLO_STATUS}),
 speed AS (SELECT format, max(CASE status WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) AS speed,
  count(*) AS speed_total, count(*) FILTER (WHERE status = 'ok') AS speed_green FROM slo GROUP BY 1),
 base AS (SELECT format, count(*) AS n_cases, quantile_cont(reduction_pct, 0.5) AS median_reduction_pct FROM cases GROUP BY 1),
 q AS (SELECT format, quantile_cont(ssim, 0.5) AS ssim_p50, min(ssim) AS ssim_worst, min({_FLOOR}) AS ssim_threshold,
  count(*) FILTER (WHERE ssim < {_FLOOR}) AS n_below FROM first WHERE format IN ('jpeg','webp','avif','heic','jxl') GROUP BY 1),
 a AS (SELECT format, quantile_cont(abs(size_rel_error_pct), 0.95) AS size_rel_error_p95 FROM first GROUP BY 1),
 card AS (SELECT format, n_cases, median_reduction_pct, ssim_p50, ssim_worst, ssim_threshold, n_below,
  CASE WHEN ssim_worst IS NULL THEN NULL WHEN ssim_worst >= ssim_threshold THEN 0 WHEN ssim_worst >= ssim_threshold * 0.98 THEN 1 ELSE 2 END AS quality,
  size_rel_error_p95, CASE WHEN size_rel_error_p95 <= 15 THEN 0 WHEN size_rel_error_p95 <= 22.5 THEN 1 ELSE 2 END AS accuracy,
  speed, speed_total, speed_green FROM base JOIN speed USING (format) LEFT JOIN q USING (format) LEFT JOIN a USING (format))"""


@query(
    "scorecard",
    _CARD + """ SELECT format, n_cases, median_reduction_pct, ssim_p50, ssim_worst, ssim_threshold, n_below,
 (['ok','warn','fail'])[quality + 1] AS quality_status, size_rel_error_p95, (['ok','warn','fail'])[accuracy + 1] AS accuracy_status,
 (['ok','warn','fail'])[greatest(coalesce(quality, 0), accuracy, speed) + 1] AS overall_status FROM card""",
    rounded="median_reduction_pct ssim_p50 ssim_worst ssim_threshold size_rel_error_p95",
)
def _(spark, folder):
    return SC.ordered_scorecard(_card(spark, folder)).drop("speed_by_bucket")


@query(
    "kpis",
    _CARD + """ SELECT avg(median_reduction_pct) AS avg_reduction_pct, count(*) FILTER (WHERE quality = 0) AS quality_green,
 count(quality) AS quality_total, CAST(sum(speed_green) AS BIGINT) AS speed_green, CAST(sum(speed_total) AS BIGINT) AS speed_total,
 count(*) FILTER (WHERE accuracy = 0) AS accuracy_green, count(accuracy) AS accuracy_total FROM card""",
    rounded="avg_reduction_pct",
)
def _(spark, folder):
    return SC.kpis(_card(spark, folder), digits=None)


@query(
    "format_timing",
    f"""SELECT format, count(*) AS n, quantile_cont(p50_ms, 0.5) AS p50_ms, quantile_cont(p95_ms, 0.95) AS p95_ms,
 quantile_cont(reduction_pct, 0.5) AS median_reduction_pct FROM ({CASES}) GROUP BY 1""",
    rounded="p50_ms p95_ms median_reduction_pct", digits=8,
)
def _(spark, folder):
    return C.format_timing(cases_of(spark, folder, "format", "p50_ms", "p95_ms", "reduction_pct"))


@query(
    "curve_maxpool",
    """WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position,
  count(*) OVER (PARTITION BY user_id) AS n_points, max(value) OVER (PARTITION BY user_id) AS peak FROM events),
 b AS (SELECT *, CASE WHEN n_points > 24 THEN len(list_filter(range(24), lambda i: floor(i * (n_points / 24)) <= position)) - 1 ELSE position END AS bucket FROM p)
 SELECT user_id, CAST(bucket AS INTEGER) AS bucket, max(value) AS bucket_max, any_value(n_points) AS n_points, any_value(peak) AS peak FROM b GROUP BY ALL""",
)
def _(spark, folder):
    points = C.numbered(W.events(spark, folder).select("user_id", "event_id", "us", "value"), ["user_id"], "us", ["event_id"], L.US_SLOT)
    return C.curve_maxpool(points, ["user_id"])


@query("memory_table", f"""SELECT case_id, children_peak_rss_p95_kb, parent_peak_rss_p95_kb FROM ({CASES})
 ORDER BY greatest(children_peak_rss_p95_kb, parent_peak_rss_p95_kb) DESC, case_id LIMIT 20""")
def _(spark, folder):
    return C.memory_table(cases_of(spark, folder, "children_peak_rss_p95_kb", "parent_peak_rss_p95_kb"), 20).select("case_id", "children_peak_rss_p95_kb", "parent_peak_rss_p95_kb")


_RUN_ITERS = "SELECT *, strftime(o_orderdate, '%Y-%m') AS run_id FROM orders"


@query(
    "trend",
    f"""WITH o AS ({_RUN_ITERS}), runs AS (SELECT run_id, min(epoch_us(date_trunc('month', o_orderdate)) // 1000000) AS unix_ts,
  'commit' || run_id AS commit FROM o GROUP BY 1 ORDER BY unix_ts DESC LIMIT 24),
 cases AS (SELECT run_id, o_orderstatus AS format, o_custkey, quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.95) AS p95,
  max(o_orderkey) AS pr, min(o_orderkey) AS cr FROM o GROUP BY ALL),
 f AS (SELECT run_id, format, quantile_cont(p50, 0.5) AS p50_ms, quantile_cont(p95, 0.5) AS p95_ms, quantile_cont(CAST(pr + cr AS DOUBLE), 0.5) AS rss, count(*) AS n FROM cases GROUP BY ALL),
 e AS (SELECT run_id, count(*) AS n_errors FROM o WHERE o_orderkey % 9 = 0 GROUP BY 1)
 SELECT run_id, unix_ts, run_id || '-01' AS iso_date, substr(commit, 1, 7) AS short_sha, 'timing' AS mode, format, p50_ms, p95_ms,
 CAST(floor(rss) AS BIGINT) AS peak_rss_kb, n, coalesce(n_errors, 0) AS n_errors,
 p50_ms - lag(p50_ms) OVER (PARTITION BY format ORDER BY unix_ts) AS p50_delta_ms
 FROM runs LEFT JOIN f USING (run_id) LEFT JOIN e USING (run_id)""",
    rounded="p50_ms p95_ms p50_delta_ms", digits=7,
)
def _(spark, folder):
    o = read_table(spark, folder, "orders").withColumn("run_id", F.date_format("o_orderdate", "yyyy-MM"))
    start = F.floor(epoch_micros(F.date_trunc("month", F.col("o_orderdate")).cast("timestamp_ntz")) / 1_000_000).cast("bigint")
    runs = o.groupBy("run_id").agg(F.min(start).alias("unix_ts")).select(
        "run_id", "unix_ts", F.concat(F.lit("commit"), "run_id").alias("commit"), F.lit("timing").alias("mode")
    )
    keyed = o.select("run_id", F.col("o_orderstatus").alias("format"), "o_custkey", "o_totalprice", "o_orderkey")
    cases = quantiles.aggregate(
        keyed, ["run_id", "format", "o_custkey"], [("p50_ms", "o_totalprice", 50), ("p95_ms", "o_totalprice", 95)],
        [F.max("o_orderkey").alias("parent_peak_rss_p95_kb"), F.min("o_orderkey").alias("children_peak_rss_p95_kb")], reread=True,
    )
    errors = o.where(F.col("o_orderkey") % 9 == 0).select("run_id")
    return C.trend(cases, errors, runs, 24, digits=None)


@query(
    "case_detail",
    f"""SELECT f.case_id, f.format, f.preset, f.pos, f.method, f.reduction_pct, f.ssim, f.psnr_db, f.size_rel_error_pct, f.error, c.iterations, c.p50_ms, c.p95_ms
 FROM (SELECT * FROM ({W.ITERATIONS}) 
 QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY pos, reduction_pct NULLS FIRST, ssim NULLS FIRST, psnr_db NULLS FIRST, size_rel_error_pct NULLS FIRST, error NULLS FIRST) = 1) f LEFT JOIN ({CASES}) c USING (case_id)""",
    rounded="reduction_pct ssim psnr_db size_rel_error_pct p50_ms p95_ms", digits=8,
)
def _(spark, folder):
    iters = W.iterations(spark, folder).select(
        "case_id", "format", "preset", "pos", "method", "reduction_pct", "ssim", "psnr_db", "size_rel_error_pct", "error"
    )
    return C.case_detail(iters, cases_of(spark, folder, "p50_ms", "p95_ms"))


#: Errors of five kinds by the order's number: an object, a string, an array, JSON that is cut, plain text.
_KINDS = """CASE pos // 10 % 5 WHEN 0 THEN '[' || json_extract_string(error, '$.phase') || '] ' || json_extract_string(error, '$.message') WHEN 1 THEN 'said "' || pos || '"'
 WHEN 2 THEN '["a",' || pos || ']' WHEN 3 THEN '{"phase":"x","message":"' || pos ELSE 'ValueError: ' || pos END"""


@query(
    "failure_summary",
    f"""WITH bad AS (SELECT format, pos, case_id, {_KINDS} AS failure FROM ({W.ITERATIONS}) WHERE error IS NOT NULL)
 SELECT format, row_number() OVER w AS rank, case_id, failure, count(*) OVER (PARTITION BY format) AS n_failures FROM bad
 WINDOW w AS (PARTITION BY format ORDER BY pos, case_id) QUALIFY rank <= 10""",
)
def _(spark, folder):
    """Objects, strings, arrays, broken JSON and plain text as errors."""
    pos, kind = F.col("pos"), F.floor(F.col("pos") / 10) % 5
    text = F.when(kind == 0, F.col("error")).when(kind == 1, F.concat(F.lit('"said \\"'), pos, F.lit('\\""'))).when(kind == 2, F.concat(F.lit('["a",'), pos, F.lit("]")))
    text = text.when(kind == 3, F.concat(F.lit('{"phase":"x","message":"'), pos)).otherwise(F.concat(F.lit("ValueError: "), pos))
    iters = W.iterations(spark, folder).withColumn("error", F.when(F.col("error").isNotNull(), text))
    return C.failure_summary(iters, ["format"])
