"""Two-run comparison, ranking and ordering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelyard.operators import compare as C
from pixelyard.operators import ranking as R
from pixelyard.sources.tables import read_table
from pixelyard.workload import frames as W
from pixelyard.workload.registry import query

_AB = f"WITH a AS ({W.run_sql(0)}), b AS ({W.run_sql(1)})"


def _runs(spark, folder):
    return W.run_side(spark, folder, 0), W.run_side(spark, folder, 1)


@query(
    "pair_cases",
    _AB + """ SELECT coalesce(x.case_id, y.case_id) AS case_id,
 CASE WHEN y.case_id IS NULL THEN 'only_in_a' WHEN x.case_id IS NULL THEN 'only_in_b' ELSE 'common' END AS side
 FROM (SELECT DISTINCT case_id FROM a) x FULL JOIN (SELECT DISTINCT case_id FROM b WHERE error IS NULL) y ON x.case_id = y.case_id""",
)
def _(spark, folder):
    a, b = _runs(spark, folder)
    return C.pair_cases(a, b.where(F.col("error").isNull()))


@query("common_cases", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def _(spark, folder):
    o = read_table(spark, folder, "orders")
    return C.common_cases(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), ["o_custkey"])


@query("only_in_baseline", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def _(spark, folder):
    o = read_table(spark, folder, "orders")
    return C.only_in(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), ["o_custkey"])


_SIDE = """SELECT case_id, count(*) AS n, avg(wall_ms) AS m, CASE WHEN count(*) < 2 THEN 0 ELSE stddev_samp(wall_ms) END AS s,
 quantile_cont(wall_ms, 0.5) AS med FROM {run} WHERE error IS NULL GROUP BY 1"""
_DIFF = f"""{_AB}, sa AS ({_SIDE.format(run='a')}), sb AS ({_SIDE.format(run='b')}),
 j AS (SELECT sa.case_id, sa.med AS baseline_median, sb.med AS head_median, sa.n AS baseline_n, sb.n AS head_n, sa.m AS ma, sb.m AS mb, sa.s AS s1, sb.s AS s2,
  sa.s * sa.s / sa.n + sb.s * sb.s / sb.n AS se, least(sa.n, sb.n) < 2 AS iters_low_power,
  CASE WHEN sa.n + sb.n > 2 THEN ((sa.n - 1) * sa.s * sa.s + (sb.n - 1) * sb.s * sb.s) / (sa.n + sb.n - 2) END AS pooled,
  CASE WHEN sa.med > 0 THEN (sb.med - sa.med) / sa.med * 100 ELSE 0 END AS delta_pct FROM sa JOIN sb USING (case_id)),
 k AS (SELECT *, CASE WHEN NOT iters_low_power AND pooled > 0 THEN (ma - mb) / sqrt(pooled) ELSE 0 END AS cohens_d,
  CASE WHEN NOT iters_low_power AND se > 0 THEN (ma - mb) / sqrt(se) ELSE 0 END AS t FROM j),
 d AS (SELECT *, CASE WHEN NOT iters_low_power AND se > 0 THEN se * se / (pow(s1 * s1 / baseline_n, 2) / (baseline_n - 1) + pow(s2 * s2 / head_n, 2) / (head_n - 1)) ELSE 0 END AS df,
  NOT iters_low_power AND abs(t) > 1.959963984540054 AND abs(cohens_d) >= 0.5 AS significant,
  CASE WHEN iters_low_power THEN baseline_median >= 5 AND abs(delta_pct) >= 25 ELSE abs(delta_pct) >= 10 END AS threshold_breach FROM k),
 diff AS (SELECT *, CASE WHEN iters_low_power THEN CASE WHEN NOT threshold_breach THEN 'noise_floor_ok' WHEN delta_pct > 0 THEN 'noise_floor_regression' ELSE 'improvement' END
  WHEN significant AND threshold_breach THEN CASE WHEN delta_pct > 0 THEN 'significant' ELSE 'improvement' END
  WHEN threshold_breach THEN 'below_threshold' ELSE 'ok' END AS label FROM d)"""


def _timing(spark, folder, **kw):
    a, b = _runs(spark, folder)
    return C.timing_diff(a, b, error="error", **kw)


@query(
    "timing_diff",
    _DIFF + """ SELECT case_id, baseline_median, head_median, baseline_n, head_n, delta_pct, t, df, cohens_d, significant, threshold_breach,
 iters_low_power, label FROM diff""",
    rounded={"baseline_median": 8, "head_median": 8, "delta_pct": 6, "t": 6, "df": 5, "cohens_d": 6},
)
def _(spark, folder):
    return _timing(spark, folder)


#: The Gaussian integral by its series, beyond 2.5 by its continued fraction.
_P = """CASE WHEN x < 2.5 THEN 1 - 2 * x * exp(-x * x) / sqrt(pi()) * list_reduce(range(60, 0, -1), lambda s, k: 1 + 2 * x * x / (2 * k + 1) * s, 1.0::DOUBLE)
 ELSE exp(-x * x) / sqrt(pi()) / list_reduce(range(60, 0, -1), lambda f, k: x + k / 2 / f, x) END"""


@query(
    "timing_diff_p_values",
    _DIFF + f" SELECT case_id, t, greatest(0, least(1, {_P})) AS p_value, cohens_d, delta_pct, label FROM (SELECT *, abs(t) / sqrt(2) AS x FROM diff)",
    rounded={"p_value": 10, "t": 6, "cohens_d": 6, "delta_pct": 6},
)
def _(spark, folder):
    """With the p-value."""
    return _timing(spark, folder, p_value=True).select("case_id", "t", "p_value", "cohens_d", "delta_pct", "label")


_FMT = "substr(case_id, 1, 1)"


@query(
    "timing_rollup",
    _DIFF + f""", r AS (SELECT {_FMT} AS format, *, CASE label WHEN 'significant' THEN 3 WHEN 'noise_floor_regression' THEN 2 WHEN 'improvement' THEN 0 ELSE 1 END AS sev FROM diff)
 SELECT format, count(*) AS n_cases, max(delta_pct) AS worst_delta_pct, count(*) FILTER (WHERE sev >= 2) AS n_regressions,
 count(*) FILTER (WHERE sev = 0) AS n_improvements, quantile_cont(delta_pct, 0.5) AS median_delta_pct,
 CASE max(sev) WHEN 3 THEN 'regression' WHEN 2 THEN 'noise' WHEN 0 THEN 'improvement' ELSE 'neutral' END AS status FROM r GROUP BY 1""",
    rounded="worst_delta_pct median_delta_pct", digits=4,
)
def _(spark, folder):
    rollup = C.timing_rollup(_timing(spark, folder), F.substring("case_id", 1, 1))
    return R.by_status_then_worst(rollup, "status", "worst_delta_pct")


_FIRST = """SELECT * FROM {run} WHERE error IS NULL QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY pos) = 1"""
_COMP = f"""{_AB}, fa AS ({_FIRST.format(run='a')}), fb AS ({_FIRST.format(run='b')}),
 c AS (SELECT fa.case_id, fa.method AS baseline_method, fb.method AS head_method, fa.reduction_pct AS baseline_reduction_pct,
  fb.reduction_pct AS head_reduction_pct, fa.optimized_size AS baseline_optimized_size, fb.optimized_size AS head_optimized_size,
  fb.reduction_pct - fa.reduction_pct AS reduction_delta_pp,
  CASE WHEN fa.optimized_size > 0 THEN (fb.optimized_size - fa.optimized_size) / fa.optimized_size * 100 ELSE 0 END AS size_delta_pct,
  fa.method <> 'none' AND fb.method = 'none' AS downgraded_to_none FROM fa JOIN fb USING (case_id)),
 comp AS (SELECT *, reduction_delta_pp <= -3 AS reduction_regressed, size_delta_pct >= 5 AS size_regressed,
  downgraded_to_none OR reduction_delta_pp <= -3 OR size_delta_pct >= 5 AS threshold_breach FROM c)"""


@query("compression_diff", _COMP + " SELECT * FROM comp", rounded="size_delta_pct reduction_delta_pp baseline_reduction_pct head_reduction_pct")
def _(spark, folder):
    a, b = _runs(spark, folder)
    return C.compression_diff(a, b, error="error")


@query(
    "compression_rollup",
    _COMP + f""" SELECT {_FMT} AS format, count(*) AS n_cases, count(*) FILTER (WHERE baseline_method <> head_method) AS method_changes,
 min(reduction_delta_pp) AS worst_delta_pp, count(*) FILTER (WHERE size_regressed) AS size_regressions,
 quantile_cont(reduction_delta_pp, 0.5) AS median_delta_pp,
 CASE WHEN bool_or(downgraded_to_none) THEN 'regression' WHEN bool_or(threshold_breach) THEN 'noise' ELSE 'neutral' END AS status FROM comp GROUP BY 1""",
    rounded="worst_delta_pp median_delta_pp",
)
def _(spark, folder):
    a, b = _runs(spark, folder)
    return C.compression_rollup(C.compression_diff(a, b, error="error"), F.substring("case_id", 1, 1))


_EST = f"""{_AB}, fa AS ({_FIRST.format(run='a')}), fb AS ({_FIRST.format(run='b')}),
 est AS (SELECT fa.case_id, fa.path AS baseline_path, fb.path AS head_path, fa.size_rel_error_pct AS baseline_size_rel_error_pct,
  fb.size_rel_error_pct AS head_size_rel_error_pct, abs(fb.size_rel_error_pct) - abs(fa.size_rel_error_pct) AS error_delta_pp,
  fa.path <> fb.path AS path_shifted, abs(fb.size_rel_error_pct) - abs(fa.size_rel_error_pct) >= 10 AS error_regressed FROM fa JOIN fb USING (case_id))"""


@query("estimation_diff", _EST + " SELECT * FROM est", rounded="error_delta_pp baseline_size_rel_error_pct head_size_rel_error_pct")
def _(spark, folder):
    a, b = _runs(spark, folder)
    return C.estimation_diff(a, b, error="error")


@query(
    "estimation_rollup",
    _EST + f""" SELECT {_FMT} AS format, baseline_path, count(*) AS n_cases, max(error_delta_pp) AS worst_delta_pp,
 count(*) FILTER (WHERE path_shifted) AS path_shifts, quantile_cont(error_delta_pp, 0.5) AS median_delta_pp,
 CASE WHEN bool_or(error_regressed) THEN 'noise' ELSE 'neutral' END AS status FROM est GROUP BY ALL""",
    rounded="worst_delta_pp median_delta_pp",
)
def _(spark, folder):
    a, b = _runs(spark, folder)
    return C.estimation_rollup(C.estimation_diff(a, b, error="error"), F.substring("case_id", 1, 1))


@query(
    "estimation_symmetry",
    f"""WITH a AS ({W.run_sql(0)}) SELECT count(*) FILTER (WHERE path IS NOT NULL AND size_rel_error_pct IS NOT NULL AND error IS NULL) > 0 AS baseline_has_accuracy,
 FALSE AS head_has_accuracy, TRUE AS asymmetric FROM a""",
)
def _(spark, folder):
    a, b = _runs(spark, folder)
    return C.estimation_symmetry(a, b.withColumn("path", F.lit(None).cast("string")), error="error")


_ERR_TEXT = "CASE WHEN error LIKE '{%' THEN '[' || json_extract_string(error, '$.phase') || '] ' || json_extract_string(error, '$.message') ELSE error END"


@query(
    "head_only_errors",
    _AB + f""" SELECT case_id, arg_min({_ERR_TEXT}, pos) AS message FROM b WHERE error IS NOT NULL
 AND case_id NOT IN (SELECT case_id FROM a WHERE error IS NOT NULL) GROUP BY 1""",
)
def _(spark, folder):
    return C.head_only_errors(*_runs(spark, folder))


def _conditions(spark, folder, side):
    o = read_table(spark, folder, "orders").where(F.col("o_custkey") % 2 == side)
    return o.agg(
        F.lit("timing").alias("mode"), (F.count(F.lit(1)) * side).alias("cpu_count"), F.lit(bool(side)).alias("isolate"),
        F.concat(F.lit("linux"), F.min("o_orderstatus")).alias("platform"),
    )


@query("comparable", """SELECT FALSE AS mode_mismatch, FALSE AS cpu_mismatch, TRUE AS isolate_warning,
 min(o_orderstatus) FILTER (WHERE o_custkey % 2 = 0) <> min(o_orderstatus) FILTER (WHERE o_custkey % 2 = 1) AS platform_warning, TRUE AS comparable FROM orders""")
def _(spark, folder):
    return C.comparable(_conditions(spark, folder, 0), _conditions(spark, folder, 1))


@query(
    "verdict",
    _DIFF + f""", v AS (SELECT bool_or(label IN ('significant', 'noise_floor_regression')) AS timing_regressed FROM diff),
 fa AS ({_FIRST.format(run='a')}), fb AS ({_FIRST.format(run='b')}),
 w AS (SELECT bool_or((fa.method <> 'none' AND fb.method = 'none') OR fb.reduction_pct - fa.reduction_pct <= -3
  OR (fb.optimized_size - fa.optimized_size) / fa.optimized_size * 100 >= 5) AS compression_regressed,
  bool_or(abs(fb.size_rel_error_pct) - abs(fa.size_rel_error_pct) >= 10) AS estimation_regressed FROM fa JOIN fb USING (case_id)),
 x AS (SELECT count(*) > 0 AS new_errors FROM b WHERE error IS NOT NULL AND case_id NOT IN (SELECT case_id FROM a WHERE error IS NOT NULL))
 SELECT timing_regressed, compression_regressed, estimation_regressed, new_errors, FALSE AS not_comparable,
 CAST(timing_regressed OR compression_regressed OR estimation_regressed OR new_errors AS INTEGER) AS exit_code FROM v, w, x""",
)
def _(spark, folder):
    from pixelyard.plans.runs import compare_runs

    a, b = _runs(spark, folder)
    conditions = (_conditions(spark, folder, 0), _conditions(spark, folder, 1))
    return compare_runs(a, b, conditions=conditions)["verdict"]


@query("self_verdict", "SELECT FALSE AS timing_regressed, FALSE AS compression_regressed, FALSE AS estimation_regressed, FALSE AS new_errors, FALSE AS not_comparable, 0 AS exit_code")
def _(spark, folder):
    """A run against itself never regresses."""
    from pixelyard.plans.runs import compare_runs

    a, _b = _runs(spark, folder)
    return compare_runs(a, a)["verdict"]


# --- ranking ------------------------------------------------------------------------------------


@query(
    "first_per_case",
    """SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P'
 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""",
)
def _(spark, folder):
    o = read_table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return R.first_per_case(o, ["o_custkey"], "o_orderkey", F.col("o_orderstatus") != "P")


_IT = f"SELECT * FROM ({W.ITERATIONS}) WHERE error IS NULL"


@query(
    "worst_per_format",
    f"""WITH first AS (SELECT * FROM ({_IT}) QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY pos) = 1),
 worst AS (SELECT * FROM first WHERE format IN ('avif','heic','jpeg','jxl','webp') QUALIFY row_number() OVER (PARTITION BY format ORDER BY ssim, pos) = 1),
 known AS (SELECT unnest(['avif','heic','jpeg','jxl','webp','apng','bmp','gif','png','svg','svgz','tiff']) AS format),
 j AS (SELECT known.format, w.*  EXCLUDE (format), CASE preset WHEN 'high' THEN 0.95 WHEN 'medium' THEN 0.97 WHEN 'low' THEN 0.99 END AS floor
  FROM known LEFT JOIN worst w ON w.format = known.format)
 SELECT format, case_id, preset, ssim, psnr_db, floor AS ssim_threshold,
 CASE WHEN ssim IS NULL OR ssim >= floor THEN 'ok' WHEN ssim >= floor * 0.98 THEN 'warn' ELSE 'fail' END AS status,
 coalesce(input_size / 1024, 0) AS size_orig_kb, coalesce(optimized_size / 1024, 0) AS size_opt_kb, coalesce(reduction_pct, 0) AS reduction_pct,
 format IN ('apng','bmp','gif','png','svg','svgz','tiff') AS lossless,
 format NOT IN ('apng','bmp','gif','png','svg','svgz','tiff') AND case_id IS NULL AS no_data FROM j""",
    rounded="ssim psnr_db ssim_threshold size_orig_kb size_opt_kb reduction_pct",
)
def _(spark, folder):
    good = W.iterations(spark, folder).where(F.col("error").isNull())
    return R.worst_per_format(good, digits=None)


@query("last_runs", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def _(spark, folder):
    return R.last_n(read_table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), 50, "o_orderdate", "o_orderkey")


@query("top_cases", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY greatest(l_extendedprice, l_quantity * 1000) DESC, l_orderkey, l_linenumber LIMIT 25")
def _(spark, folder):
    li = read_table(spark, folder, "lineitem")
    top = R.top_k(li, 25, F.greatest(F.col("l_extendedprice"), F.col("l_quantity") * 1000), "l_orderkey", "l_linenumber")
    return top.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("largest_changes", _DIFF + " SELECT case_id, delta_pct, label FROM diff", rounded="delta_pct", digits=4)
def _(spark, folder):
    return R.by_magnitude(_timing(spark, folder).select("case_id", "delta_pct", "label"), "delta_pct", "case_id")
