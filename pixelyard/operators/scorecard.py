"""Per-format scorecard of a run, and its headline numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelyard import constants as K
from pixelyard.functions.stats import ceiling_status, floor_status, worst
from pixelyard.operators.ranking import first_per_case, severity_order, ssim_floor
from pixelyard.plans import quantiles
from pixelyard.plans.scale import lookup


def latency_slo(fmt: str = "format", bucket: str = "bucket") -> Column:
    base = lookup(K.LATENCY_SLO_MS, F.col(bucket), K.LATENCY_SLO_DEFAULT_MS)
    relaxed = F.col(fmt).isin(*K.LATENCY_RELAXED_FORMATS) & F.col(bucket).isin(*K.LATENCY_RELAXED_BUCKETS)
    return (base * F.when(relaxed, K.LATENCY_RELAX).otherwise(1.0)).cast("bigint")


_STATUS = {0: "ok", 1: "warn", 2: "fail"}


def _status_name(ordinal: Column) -> Column:
    return lookup(_STATUS, ordinal)


def slo_status(cases: DataFrame, digits: int | None = 1) -> DataFrame:
    """Per (format, bucket): p95 of the cases' p95 latencies against the objective."""
    grouped = quantiles.aggregate(cases, ["format", "bucket"], [("p95_ms", "p95_ms", 95)], [F.count(F.lit(1)).alias("n_cases")], few=True)
    return _judged(grouped, digits).select("format", "bucket", "n_cases", "p95_ms", "slo_ms", "status")


def _judged(grouped: DataFrame, digits: int | None) -> DataFrame:
    if digits is not None:
        grouped = grouped.withColumn("p95_ms", F.bround("p95_ms", digits))
    slo = latency_slo()
    return grouped.withColumns({"slo_ms": slo, "status": _status_name(ceiling_status(F.col("p95_ms"), slo, 1.25))})


def _scores() -> dict[str, Column]:
    """Of a case's first row: SSIM and its floor, of lossy formats, and the error of the predicted size."""
    ssim = F.when(~F.col("format").isin(*K.LOSSLESS_FORMATS), F.col("ssim"))
    return {"__ssim": ssim, "__floor": F.when(ssim.isNotNull(), ssim_floor("preset")), "__e": F.abs("size_rel_error_pct")}


def _by_format(cases: DataFrame, first: DataFrame | None, digits: int | None) -> DataFrame:
    """Per format all that the card shows. Each case counts under its bucket and under its format in one
    aggregate, so that whatever the cases come from is computed once."""
    scores = {} if first is None else _scores()
    rows = cases.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("__all"))
    measures = {"reduction_pct": F.col("reduction_pct"), **(scores if first is cases else {})}
    rows = rows.select(
        "format", "__all", F.when(~F.col("__all"), F.col("bucket")).alias("bucket"), F.lit(1).alias("__case"), F.when(~F.col("__all"), F.col("p95_ms")).alias("p95_ms"),
        *[F.when(F.col("__all"), c).alias(name) for name, c in measures.items()],
    )
    if first is not None and first is not cases:
        rows = rows.unionByName(first.select("format", F.lit(True).alias("__all"), *[c.alias(name) for name, c in scores.items()]), allowMissingColumns=True)
    specs, aggs = [("p95_ms", "p95_ms", 95), ("median_reduction_pct", "reduction_pct", 50)], [F.count("__case").alias("n_cases")]
    if first is not None:
        specs += [("ssim_p50", "__ssim", 50), ("size_rel_error_p95", "__e", 95)]
        aggs += [
            F.min("__ssim").alias("ssim_worst"),
            F.min("__floor").alias("ssim_threshold"),
            F.when(F.count("__ssim") > 0, F.count_if(F.col("__ssim") < F.col("__floor"))).alias("n_below"),
        ]
    grouped = _judged(quantiles.aggregate(rows, ["format", "__all", "bucket"], specs, aggs, few=True), digits)
    speed = F.when(~F.col("__all"), F.struct("bucket", "p95_ms", "slo_ms", "status"))
    whole = [c for c in ("n_cases", "median_reduction_pct", "ssim_p50", "ssim_worst", "ssim_threshold", "n_below", "size_rel_error_p95") if c in grouped.columns]
    return grouped.groupBy("format").agg(
        F.when(F.count(speed) > 0, F.array_sort(F.collect_list(speed))).alias("speed_by_bucket"),
        F.max(F.when(~F.col("__all"), lookup({"ok": 0, "warn": 1, "fail": 2}, F.col("status")))).alias("__speed"),
        *[F.max(F.when(F.col("__all"), F.col(c))).alias(c) for c in whole],
    )


def scorecard(cases: DataFrame, iters: DataFrame | None = None, digits: bool = True, first: DataFrame | None = None) -> DataFrame:
    """One row per format. ``cases`` has format, bucket, p95_ms, reduction_pct; ``iters`` (optional:
    without it quality and accuracy stay NULL) has case_id, format, preset, pos, ssim and
    size_rel_error_pct of rows that did not fail. ``first`` stands for ``iters`` where the first row of each case is
    at hand, as in the cases themselves (``summarize_cases(..., first=...)``)."""
    rnd = (lambda c, d: F.bround(c, d)) if digits else (lambda c, d: F.col(c) if isinstance(c, str) else c)
    if first is None and iters is not None:
        first = first_per_case(iters.select("case_id", "format", "preset", "pos", "ssim", "size_rel_error_pct"))
    out = _by_format(cases, first, 1 if digits else None)
    if first is None:
        out = out.withColumns({c: F.lit(None).cast("double") for c in ("ssim_p50", "ssim_worst", "ssim_threshold", "size_rel_error_p95")})
        out = out.withColumn("n_below", F.lit(None).cast("bigint"))
    elif digits:
        out = out.withColumn("size_rel_error_p95", F.bround("size_rel_error_p95", 2))
    out = out.withColumns(
        {
            "__quality": floor_status(F.col("ssim_worst"), F.col("ssim_threshold"), K.WARN_SSIM_FACTOR),
            "__accuracy": ceiling_status(F.col("size_rel_error_p95"), F.lit(K.SIZE_ERROR_P95_PCT), 1.5),
        }
    )
    return out.select(
        "format",
        F.coalesce("n_cases", F.lit(0)).alias("n_cases"),
        rnd(F.coalesce("median_reduction_pct", F.lit(0.0)), 1).alias("median_reduction_pct"),
        "speed_by_bucket",
        rnd("ssim_p50", 4).alias("ssim_p50"),
        rnd("ssim_worst", 4).alias("ssim_worst"),
        "ssim_threshold",
        "n_below",
        _status_name(F.col("__quality")).alias("quality_status"),
        "size_rel_error_p95",
        _status_name(F.col("__accuracy")).alias("accuracy_status"),
        worst(F.coalesce("__speed", F.lit(0)), F.coalesce("__quality", F.lit(0)), F.coalesce("__accuracy", F.lit(0))).alias("overall_status"),
    )


def ordered_scorecard(card: DataFrame) -> DataFrame:
    return severity_order(card)


def kpis(card: DataFrame, digits: int | None = 1) -> DataFrame:
    """One row: mean of the formats' median reductions and green/total per axis."""
    green = F.size(F.filter("speed_by_bucket", lambda b: b["status"] == "ok"))
    avg = F.coalesce(F.avg(F.when(F.col("n_cases") > 0, F.col("median_reduction_pct"))), F.lit(0.0))
    present = F.col("speed_by_bucket").isNotNull()
    return card.agg(
        (avg if digits is None else F.bround(avg, digits)).alias("avg_reduction_pct"),
        F.count_if(F.col("quality_status") == "ok").alias("quality_green"),
        F.count("quality_status").alias("quality_total"),
        F.coalesce(F.sum(F.when(present, green)), F.lit(0)).alias("speed_green"),
        F.coalesce(F.sum(F.when(present, F.size("speed_by_bucket"))), F.lit(0)).alias("speed_total"),
        F.count_if(F.col("accuracy_status") == "ok").alias("accuracy_green"),
        F.count("accuracy_status").alias("accuracy_total"),
    )
