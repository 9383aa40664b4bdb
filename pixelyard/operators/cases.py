"""Iteration rows to case statistics, error summaries, timing, trends and detail tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelyard.functions.stats import sample_std
from pixelyard.operators.ranking import first_per_case, first_row, last_n, top_k
from pixelyard.plans import quantiles
from pixelyard.plans.running import with_running_sum
from pixelyard.plans.scale import join_on


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- measures -----------------------------------------------------------------------


def derived_measures(df: DataFrame) -> DataFrame:
    """Total and children CPU, parallelism (0 without wall time) and peak memory."""
    total = F.col("parent_user_ms") + F.col("parent_sys_ms") + F.col("children_user_ms") + F.col("children_sys_ms")
    return df.withColumns(
        {
            "total_cpu_ms": total,
            "children_cpu_ms": F.col("children_user_ms") + F.col("children_sys_ms"),
            "parallelism": F.when(F.col("wall_ms") > 0, total / F.col("wall_ms")).otherwise(0.0),
            "peak_rss_kb": F.greatest("parent_peak_rss_kb", "children_peak_rss_kb"),
        }
    )


def failed(error="error") -> Column:
    """A row failed iff its error is present: a string or an object."""
    return _c(error).isNotNull()


#: measure -> [(output, percentile, truncated to an integer)]
_CASE_PERCENTILES = {
    "wall_ms": [("p50_ms", 50, False), ("p95_ms", 95, False), ("p99_ms", 99, False)],
    "children_cpu_ms": [("children_cpu_p50_ms", 50, False), ("children_cpu_p95_ms", 95, False)],
    "children_peak_rss_kb": [("children_peak_rss_p95_kb", 95, True)],
    "parent_peak_rss_kb": [("parent_peak_rss_p95_kb", 95, True)],
    "parallelism": [("parallelism_p50", 50, False)],
    "py_peak_alloc_kb": [("py_peak_alloc_p95_kb", 95, True)],
}
_FIRST_FIELDS = ("name", "bucket", "format", "preset", "reduction_pct", "method", "rss_samples")


def summarize_cases(
    iters: DataFrame, keys: Sequence[str] = ("case_id",), wall: str = "wall_ms", error: str | None = None,
    position: str | None = None, wanted: Sequence[str] | None = None, first: Sequence[str] = (), few: bool = False, reread: bool = False,
) -> DataFrame:
    """Robust statistics per case; failed rows do not count.

    Measures that are not in the input are left out. Metadata and the memory curve come from the
    first row by ``position``, as do further columns named by ``first``. The ordered raw values of a
    case stay rows (``case_values``): a list per case would put an unbounded group into one row.

    ``wanted`` names the statistics and metadata to compute beside ``iterations`` (default all); ``few`` and
    ``reread`` are those of ``quantiles.aggregate``.
    """
    rows = iters if error is None else iters.where(~failed(error))
    asked = lambda name: wanted is None or name in wanted
    specs, integers = [], []
    for column, percentiles in _CASE_PERCENTILES.items():
        source = wall if column == "wall_ms" else column
        if source in rows.columns:
            specs += [(name, source, p) for name, p, _ in percentiles if asked(name) or (name == "p50_ms" and asked("median_ms"))]
            integers += [name for name, _, truncated in percentiles if truncated and asked(name)]
    plain = {"mean_ms": F.avg(wall), "stdev_ms": sample_std(wall), "min_ms": F.min(wall), "max_ms": F.max(wall)}
    aggs = [F.count(F.lit(1)).alias("iterations"), *[c.alias(name) for name, c in plain.items() if asked(name)]]
    deviations = [("mad_ms", wall)] if asked("mad_ms") else []
    carried = [c for c in _FIRST_FIELDS if c in rows.columns and c not in keys and asked(c)] if position else []
    carried += [c for c in first if c not in carried and c not in keys]
    measures = [*([wall] if deviations or any(asked(name) for name in plain) else []), *[c for _, c, _ in specs]]
    slim = rows.select(*dict.fromkeys([*keys, *measures, *([position] if carried else []), *carried]))
    if carried and not few:
        aggs.append(first_row(slim, carried, position).alias("__first"))
    out = quantiles.aggregate(slim, keys, specs, aggs, deviations, few=few, reread=reread)
    if carried and few:
        # Apart from the values: a row of strings as an aggregate would make Spark sort what it counts.
        apart = first_per_case(slim.select(*keys, *carried, position), keys, position).select(*keys, *carried)
        out = join_on(out, apart, keys, "left")
    elif carried:
        out = out.select(*[c for c in out.columns if c != "__first"], *[F.col(f"__first.{c}").alias(c) for c in carried])
    if asked("median_ms"):
        out = out.withColumn("median_ms", F.col("p50_ms"))
    return out.withColumns({c: F.col(c).cast("bigint") for c in integers})


def case_values(iters: DataFrame, wall: str = "wall_ms", position: str = "pos", error: str | None = None) -> DataFrame:
    rows = iters if error is None else iters.where(~failed(error))
    return rows.select("case_id", position, wall)


def tool_attribution(iters: DataFrame, keys: Sequence[str] = (), invocations: str = "tool_invocations") -> DataFrame:
    calls = iters.select(*keys, F.inline(invocations))
    return calls.groupBy(*keys, "tool").agg(
        F.count(F.lit(1)).alias("invocations"),
        F.sum("wall_ms").alias("total_wall_ms"),
        F.count_if(F.col("exit_code") != 0).alias("failures"),
    )


# --- estimation accuracy ----------------------------------------------------------------


def accuracy_errors(
    df: DataFrame, predicted="predicted_size", actual="actual_size", predicted_pct="predicted_reduction_pct",
    actual_pct="actual_reduction_pct", digits: int | None = 3,
) -> DataFrame:
    rnd = (lambda c: c) if digits is None else (lambda c: F.bround(c, digits))
    gap = _c(predicted) - _c(actual)
    relative = F.when(_c(actual) > 0, 100.0 * gap / _c(actual)).otherwise(0.0)
    points = _c(predicted_pct) - _c(actual_pct)
    return df.withColumns(
        {
            "size_abs_error_bytes": gap,
            "size_rel_error_pct": rnd(relative),
            "reduction_abs_error_pct": rnd(points),
            "reduction_abs_error_pct_abs": rnd(F.abs(points)),
        }
    )


def with_total(df: DataFrame, column: str, total: str = "(all)") -> DataFrame:
    """Every row twice: under its own group and under the total, for one-pass grouping sets."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.explode(F.array(F.lit(total), F.col(column))).alias(column))


def accuracy_summary(df: DataFrame, fmt: str = "format") -> DataFrame:
    """Per format and overall: percentiles of absolute errors and the no-op hit rate.

    Expects size_rel_error_pct and reduction_abs_error_pct_abs, and for the hit rate
    already_optimized and actual_reduction_pct. Rows lacking an error measure are skipped.
    """
    rows = df.where(F.col("size_rel_error_pct").isNotNull() & F.col("reduction_abs_error_pct_abs").isNotNull())
    aggs = [F.count(F.lit(1)).alias("n")]
    extra = []
    if {"already_optimized", "actual_reduction_pct"} <= set(df.columns):
        extra = ["already_optimized", "actual_reduction_pct"]
        claimed = F.coalesce(F.col("already_optimized"), F.lit(False))
        aggs += [
            F.count_if(claimed).alias("noop_predicted"),
            F.count_if(claimed & (F.coalesce(F.col("actual_reduction_pct"), F.lit(0.0)) < 1.0)).alias("noop_correct"),
        ]
    slim = with_total(
        rows.select(
            F.col(fmt).alias("format"), F.abs("size_rel_error_pct").alias("__size"),
            F.col("reduction_abs_error_pct_abs").alias("__red"), *extra,
        ),
        "format",
    )
    specs = [
        ("size_rel_error_p50", "__size", 50), ("size_rel_error_p95", "__size", 95),
        ("reduction_error_p50", "__red", 50), ("reduction_error_p95", "__red", 95),
    ]
    return quantiles.aggregate(slim, ["format"], specs, aggs, few=True)


# --- timing, trend, detail ------------------------------------------------------------------


def format_timing(cases: DataFrame) -> DataFrame:
    specs = [("p50_ms", "p50_ms", 50), ("p95_ms", "p95_ms", 95), ("median_reduction_pct", "reduction_pct", 50)]
    return quantiles.aggregate(cases, ["format"], specs, [F.count(F.lit(1)).alias("n")], few=True)


def trend(
    cases: DataFrame, errors: DataFrame, runs: DataFrame, limit: int = 100, digits: int | None = 3
) -> DataFrame:
    """Per run and format medians of the newest ``limit`` runs, oldest first, with the change from
    the run before. ``cases`` has run_id, format, p50_ms, p95_ms and peak memory; ``errors`` has
    one row per failed iteration; ``runs`` has run_id, unix_ts, commit, mode."""
    from pyspark.sql import Window as W

    newest = last_n(runs, limit, "unix_ts", "run_id")
    memory = cases.withColumn("__rss", F.col("parent_peak_rss_p95_kb") + F.col("children_peak_rss_p95_kb"))
    kept = memory.join(F.broadcast(newest.select("run_id")), "run_id", "left_semi")  # at most ``limit`` rows
    specs = [("p50_ms", "p50_ms", 50), ("p95_ms", "p95_ms", 50), ("peak_rss_kb", "__rss", 50)]
    per_format = quantiles.aggregate(kept, ["run_id", "format"], specs, [F.count(F.lit(1)).alias("n")], few=True)
    n_errors = errors.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_errors"))
    joined = newest.join(per_format, "run_id", "left").join(n_errors, "run_id", "left")
    rnd = (lambda c: c) if digits is None else (lambda c: F.bround(c, digits))
    order = W.partitionBy("format").orderBy("unix_ts", "run_id")
    out = joined.select(
        "run_id",
        "unix_ts",
        F.date_format(F.timestamp_seconds("unix_ts"), "yyyy-MM-dd").alias("iso_date"),
        F.substring("commit", 1, 7).alias("short_sha"),
        "mode",
        "format",
        rnd(F.col("p50_ms")).alias("p50_ms"),
        rnd(F.col("p95_ms")).alias("p95_ms"),
        F.floor("peak_rss_kb").cast("bigint").alias("peak_rss_kb"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("n_errors", F.lit(0)).alias("n_errors"),
    )
    # One row per (run, format) remains: at most ``limit`` rows per format in this window.
    out = out.withColumn("p50_delta_ms", F.col("p50_ms") - F.lag("p50_ms").over(order))
    return out.orderBy("unix_ts", "run_id", "format")


def curve_points(cases: DataFrame, samples: str = "rss_samples") -> DataFrame:
    """(case_id, position, value) from arrays of [offset, value]."""
    return cases.select("case_id", F.posexplode(samples).alias("position", "__s")).select(
        "case_id", F.col("position").cast("bigint").alias("position"), F.get("__s", F.lit(1)).alias("value")
    )


def curve_maxpool(points: DataFrame, keys: Sequence[str] = ("case_id",), n: int = 24, position="position", value="value") -> DataFrame:
    """Fold each series to at most ``n`` buckets by maximum; adds the series' length and peak.

    ``n_points`` is taken from the input where it is there (``numbered`` adds it), else counted."""
    from pyspark.sql import Window as W

    keys = list(keys)
    joined = points
    if "n_points" not in points.columns:
        joined = join_on(points, points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points")), keys)
    width = F.col("n_points").cast("double") / n
    starts = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * width) <= F.col(position))
    bucket = F.when(F.col("n_points") > n, F.size(starts) - 1).otherwise(F.col(position).cast("int"))
    folded = joined.groupBy(*keys, bucket.alias("bucket")).agg(
        F.max(value).alias("bucket_max"), F.max("n_points").alias("n_points")
    )
    return folded.withColumn("peak", F.max("bucket_max").over(W.partitionBy(*keys)))  # at most n rows per key


def numbered(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], width: int) -> DataFrame:
    """0-based ``position`` within a key by (order, ties) and the key's ``n_points``; a hot key is cut
    into slots of ``width``."""
    out = with_running_sum(df, keys, order, ties, F.lit(1), width, "__at", "n_points")
    return out.withColumn("position", F.col("__at") - 1).drop("__at")


def memory_table(cases: DataFrame, k: int) -> DataFrame:
    """The ``k`` cases with the highest parent or children memory."""
    peak = F.greatest("parent_peak_rss_p95_kb", "children_peak_rss_p95_kb")
    return top_k(cases, k, peak, "case_id")


def case_detail(iters: DataFrame, cases: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """First row of every case beside its statistics, quality and accuracy (NULL where absent). Rows of one
    position go by their other columns in order, NULL first."""
    first = first_per_case(iters, keys)
    stats = cases.select(*keys, "iterations", "p50_ms", "p95_ms")
    return join_on(first, stats, keys, "left")


# --- failures ---------------------------------------------------------------------------


def error_text(error="error") -> Column:
    """Readable text of a polymorphic error given as JSON or plain text: the string itself, or
    ``[phase] message`` of an object. Anything else (arrays, numbers, broken JSON) stays as it is."""
    e = _c(error)
    value = F.try_parse_json(e)
    kind = F.schema_of_variant(value)
    phase = F.coalesce(F.try_variant_get(value, "$.phase", "string"), F.lit("?"))
    message = F.coalesce(F.try_variant_get(value, "$.message", "string"), F.lit("unknown error"))
    return F.when(F.startswith(kind, F.lit("OBJECT")), F.concat(F.lit("["), phase, F.lit("] "), message)).when(
        kind == "STRING", F.try_variant_get(value, "$", "string")
    ).otherwise(e)


def failures(iters: DataFrame, error: str = "error") -> DataFrame:
    return iters.where(failed(error)).withColumn("failure", error_text(error))


def failure_summary(iters: DataFrame, keys: Sequence[str] = ("run_id",), error: str = "error", position="pos", k: int = 10) -> DataFrame:
    """Per run: number of failures and the first ``k`` by position, as (rank, case, text).

    The count is a plain aggregate; the list is a top-k report."""
    from pyspark.sql import Window as W

    keys = list(keys)
    bad = failures(iters, error).select(*keys, position, "case_id", "failure")
    counts = bad.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_failures"))
    # rank <= k lets Spark prune each partition to k rows per run before the shuffle.
    ranked = bad.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(position, "case_id")))
    return join_on(ranked.where(F.col("rank") <= k), counts, keys).select(*keys, "rank", "case_id", "failure", "n_failures")
