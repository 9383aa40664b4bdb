"""Comparison of a baseline run with a head run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelyard import constants as K
from pixelyard.functions import stats as S
from pixelyard.functions.text import extract_format
from pixelyard.operators.cases import error_text, failed
from pixelyard.operators.ranking import first_per_case
from pixelyard.plans import quantiles
from pixelyard.plans.scale import join_on, lookup

CASE = ("case_id",)


def pair_cases(a: DataFrame, b: DataFrame, keys: Sequence[str] = CASE) -> DataFrame:
    """Every case id once, with ``side`` = common, only_in_a or only_in_b. Ids are made distinct
    before they meet, so the join is on pre-aggregated rows."""
    keys = list(keys)
    left = a.select(*keys).distinct().withColumn("__a", F.lit(True))
    right = b.select(*keys).distinct().withColumn("__b", F.lit(True))
    side = F.when(F.col("__a") & F.col("__b"), "common").when(F.col("__a"), "only_in_a").otherwise("only_in_b")
    return join_on(left, right, keys, "full", nulls=False).select(*keys, side.alias("side"))


def common_cases(a: DataFrame, b: DataFrame, keys: Sequence[str] = CASE) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def only_in(a: DataFrame, b: DataFrame, keys: Sequence[str] = CASE) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_anti")


def _sample(df: DataFrame, keys: Sequence[str], wall: str, error: str | None, tag: str) -> DataFrame:
    rows = (df if error is None else df.where(~failed(error))).select(*keys, wall)
    return quantiles.aggregate(
        rows, keys, [(f"{tag}_median", wall, 50)],
        [
            F.count(F.lit(1)).alias(f"{tag}_n"),
            F.avg(wall).alias(f"{tag}_mean"),
            S.sample_std(wall).alias(f"{tag}_std"),
        ],
    )


def timing_diff(
    a: DataFrame, b: DataFrame, keys: Sequence[str] = CASE, wall: str = "wall_ms", error: str | None = None,
    threshold_pct: float = 10.0, noise_pct: float = 25.0, noise_min_ms: float = 5.0, alpha: float = 0.05,
    min_effect: float = 0.5, p_value: bool = False,
) -> DataFrame:
    """Median change per common case. Two or more iterations on both sides are tested (Welch and
    Cohen); otherwise only a large change above the noise floor counts. Bounds are inclusive.

    Each run is reduced to one row per case before the join. The significance gate needs no p;
    ``p_value`` adds it.
    """
    keys = list(keys)
    both = join_on(_sample(a, keys, wall, error, "baseline"), _sample(b, keys, wall, error, "head"), keys, nulls=False)
    base, head = F.col("baseline_median"), F.col("head_median")
    low_power = F.least("baseline_n", "head_n") < 2
    stats = ("baseline_n", "baseline_mean", "baseline_std", "head_n", "head_mean", "head_std")
    both = both.withColumns(
        {
            "delta_pct": F.when(base > 0, (head - base) / base * 100.0).otherwise(0.0),
            "iters_low_power": low_power,
            "cohens_d": F.when(low_power, 0.0).otherwise(S.cohens_d(*stats)),
            "t": F.when(low_power, 0.0).otherwise(S.welch_t(*stats)),
            "df": F.when(low_power, 0.0).otherwise(S.welch_df("baseline_n", "baseline_std", "head_n", "head_std")),
            "significant": ~low_power & S.differs(*stats, alpha=alpha, min_effect=min_effect),
        }
    )
    change = F.abs("delta_pct")
    breach = F.when(low_power, (base >= noise_min_ms) & (change >= noise_pct)).otherwise(change >= threshold_pct)
    both = both.withColumn("threshold_breach", breach)
    out = both.select(
        *keys, "baseline_median", "head_median", "baseline_n", "head_n", "delta_pct", "t", "df", "cohens_d",
        "significant", "threshold_breach", "iters_low_power", diff_label().alias("label"),
    )
    return out.withColumn("p_value", S.two_sided_p("t")) if p_value else out


def diff_label() -> Column:
    breach, slower = F.col("threshold_breach"), F.col("delta_pct") > 0
    low = F.when(~breach, "noise_floor_ok").when(slower, "noise_floor_regression").otherwise("improvement")
    tested = (
        F.when(F.col("significant") & breach & slower, "significant")
        .when(F.col("significant") & breach, "improvement")
        .when(breach, "below_threshold")
        .otherwise("ok")
    )
    return F.when(F.col("iters_low_power"), low).otherwise(tested)


def _first_complete(df: DataFrame, keys: Sequence[str], columns: Sequence[str], error: str | None, position: str) -> DataFrame:
    complete = F.lit(True) if error is None else ~failed(error)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    return first_per_case(df.select(*keys, *columns, position, *([error] if error else [])), keys, position, complete).select(*keys, *columns)


def _sides(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], error: str | None, position: str) -> DataFrame:
    def side(df: DataFrame, tag: str) -> DataFrame:
        first = _first_complete(df, keys, columns, error, position)
        return first.select(*keys, *[F.col(c).alias(f"{tag}_{c}") for c in columns])

    return join_on(side(a, "baseline"), side(b, "head"), list(keys), nulls=False)


def compression_diff(
    a: DataFrame, b: DataFrame, keys: Sequence[str] = CASE, error: str | None = None, position: str = "pos",
    reduction_pp: float = 3.0, size_pct: float = 5.0,
) -> DataFrame:
    """Change of reduction and size between the first complete rows of each common case."""
    both = _sides(a, b, keys, ("method", "reduction_pct", "optimized_size"), error, position)
    old, new = F.col("baseline_optimized_size"), F.col("head_optimized_size")
    both = both.withColumns(
        {
            "reduction_delta_pp": F.col("head_reduction_pct") - F.col("baseline_reduction_pct"),
            "size_delta_pct": F.when(old > 0, (new - old) / old * 100.0).otherwise(0.0),
            "downgraded_to_none": (F.col("baseline_method") != "none") & (F.col("head_method") == "none"),
        }
    ).withColumns(
        {
            "reduction_regressed": F.col("reduction_delta_pp") <= -reduction_pp,
            "size_regressed": F.col("size_delta_pct") >= size_pct,
        }
    )
    return both.withColumn(
        "threshold_breach", F.col("downgraded_to_none") | F.col("reduction_regressed") | F.col("size_regressed")
    )


def estimation_diff(
    a: DataFrame, b: DataFrame, keys: Sequence[str] = CASE, error: str | None = None, position: str = "pos",
    threshold_pp: float = 10.0,
) -> DataFrame:
    """Change of absolute estimation error; columns ``path`` and ``size_rel_error_pct``. Runs where
    only one side has accuracy data share no complete case, so the result is empty."""
    both = _sides(a, b, keys, ("path", "size_rel_error_pct"), error, position)
    delta = F.abs("head_size_rel_error_pct") - F.abs("baseline_size_rel_error_pct")
    return both.withColumns(
        {
            "error_delta_pp": delta,
            "path_shifted": F.col("baseline_path") != F.col("head_path"),
            "error_regressed": delta >= threshold_pp,
        }
    )


def estimation_symmetry(a: DataFrame, b: DataFrame, error: str | None = None) -> DataFrame:
    """One row: which side has accuracy data, and whether just one of them has."""

    def has(df: DataFrame, name: str) -> DataFrame:
        ok = F.col("path").isNotNull() & F.col("size_rel_error_pct").isNotNull()
        ok = ok if error is None else ok & ~failed(error)
        return df.agg(F.coalesce(F.bool_or(ok), F.lit(False)).alias(name))

    both = join_on(has(a, "baseline_has_accuracy"), has(b, "head_has_accuracy"), [])
    return both.withColumn("asymmetric", F.col("baseline_has_accuracy") != F.col("head_has_accuracy"))


def head_only_errors(
    a: DataFrame, b: DataFrame, keys: Sequence[str] = CASE, error: str = "error", position: str = "pos"
) -> DataFrame:
    """Cases that failed in head but never in the baseline, with the first message."""
    keys = list(keys)
    old = a.where(failed(error)).select(*keys).distinct()
    new = b.where(failed(error)).groupBy(*keys).agg(F.min_by(error, position).alias("__error"))
    return new.join(old, keys, "left_anti").select(*keys, error_text("__error").alias("message"))


def comparable(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two one-row condition frames (mode, cpu_count, isolate, platform) to one verdict row."""
    cols = ("mode", "cpu_count", "isolate", "platform")
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in cols])
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in cols])
    both = join_on(left, right, [])
    known = (F.coalesce("a_cpu_count", F.lit(0)) != 0) & (F.coalesce("b_cpu_count", F.lit(0)) != 0)
    return both.select(
        (~F.col("a_mode").eqNullSafe(F.col("b_mode"))).alias("mode_mismatch"),
        (known & (F.col("a_cpu_count") != F.col("b_cpu_count"))).alias("cpu_mismatch"),
        (F.coalesce("a_isolate", F.lit(False)) != F.coalesce("b_isolate", F.lit(False))).alias("isolate_warning"),
        (~F.col("a_platform").eqNullSafe(F.col("b_platform"))).alias("platform_warning"),
    ).withColumn("comparable", ~F.col("mode_mismatch") & ~F.col("cpu_mismatch"))


# --- roll-ups and verdict -------------------------------------------------------------------


def _with_format(diffs: DataFrame, fmt: Column | None) -> DataFrame:
    if fmt is not None:
        return diffs.withColumn("format", fmt)
    return diffs if "format" in diffs.columns else diffs.withColumn("format", extract_format("case_id"))


def timing_rollup(diffs: DataFrame, fmt: Column | None = None) -> DataFrame:
    """Per format: median and worst change, regressions, improvements and the worst label."""
    rank = lookup(K.LABEL_SEVERITY, F.col("label"), 0)
    rows = _with_format(diffs, fmt).select("format", "delta_pct", "label", rank.alias("__rank"))
    out = quantiles.aggregate(
        rows, ["format"], [("median_delta_pct", "delta_pct", 50)],
        [
            F.count(F.lit(1)).alias("n_cases"),
            F.max("delta_pct").alias("worst_delta_pct"),
            F.count_if(F.col("label").isin("significant", "noise_floor_regression")).alias("n_regressions"),
            F.count_if(F.col("label") == "improvement").alias("n_improvements"),
            F.max("__rank").alias("__worst"),
        ],
        few=True,
    )
    status = F.when(F.col("__worst") == 3, "regression").when(F.col("__worst") == 2, "noise").when(
        F.col("__worst") == 0, "improvement").otherwise("neutral")
    return out.withColumn("status", status).drop("__worst")


def compression_rollup(diffs: DataFrame, fmt: Column | None = None) -> DataFrame:
    out = quantiles.aggregate(
        _with_format(diffs, fmt), ["format"], [("median_delta_pp", "reduction_delta_pp", 50)],
        [
            F.count(F.lit(1)).alias("n_cases"),
            F.count_if(F.col("baseline_method") != F.col("head_method")).alias("method_changes"),
            F.min("reduction_delta_pp").alias("worst_delta_pp"),
            F.count_if(F.col("size_regressed")).alias("size_regressions"),
            F.bool_or("downgraded_to_none").alias("__broken"),
            F.bool_or("threshold_breach").alias("__breach"),
        ],
        few=True,
    )
    status = F.when(F.col("__broken"), "regression").when(F.col("__breach"), "noise").otherwise("neutral")
    return out.withColumn("status", status).drop("__broken", "__breach")


def estimation_rollup(diffs: DataFrame, fmt: Column | None = None) -> DataFrame:
    out = quantiles.aggregate(
        _with_format(diffs, fmt), ["format", "baseline_path"], [("median_delta_pp", "error_delta_pp", 50)],
        [
            F.count(F.lit(1)).alias("n_cases"),
            F.max("error_delta_pp").alias("worst_delta_pp"),
            F.count_if("path_shifted").alias("path_shifts"),
            F.bool_or("error_regressed").alias("__bad"),
        ],
        few=True,
    )
    return out.withColumn("status", F.when(F.col("__bad"), "noise").otherwise("neutral")).drop("__bad")


def verdict(
    timing: DataFrame, compression: DataFrame | None = None, estimation: DataFrame | None = None,
    new_errors: DataFrame | None = None, conditions: DataFrame | None = None,
) -> DataFrame:
    """One row with ``exit_code``: 2 not comparable, 1 any regression, else 0. Every input is
    reduced to one row by an aggregate before they are put side by side."""

    def flag(df: DataFrame | None, cond: Column, name: str) -> DataFrame | None:
        return None if df is None else df.agg(F.coalesce(F.bool_or(cond), F.lit(False)).alias(name))

    parts = [
        flag(timing, F.col("label").isin("significant", "noise_floor_regression"), "timing_regressed"),
        flag(compression, F.col("threshold_breach") if compression is not None else F.lit(False), "compression_regressed"),
        flag(estimation, F.col("error_regressed") if estimation is not None else F.lit(False), "estimation_regressed"),
        flag(new_errors, F.lit(True), "new_errors"),
        flag(conditions, ~F.col("comparable") if conditions is not None else F.lit(False), "not_comparable"),
    ]
    names = ("timing_regressed", "compression_regressed", "estimation_regressed", "new_errors", "not_comparable")
    row = None
    for part in parts:
        if part is not None:
            row = part if row is None else join_on(row, part, [])
    row = row.withColumns({n: F.lit(False) for n in names if n not in row.columns})
    bad = F.col(names[0]) | F.col(names[1]) | F.col(names[2]) | F.col(names[3])
    return row.select(*names, F.when(F.col("not_comparable"), 2).when(bad, 1).otherwise(0).alias("exit_code"))
