"""Run tables end to end: case report, comparison of two runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelyard.functions.stats import ceiling_status
from pixelyard.operators import compare as C
from pixelyard.operators.cases import summarize_cases
from pixelyard.operators.ranking import severity
from pixelyard.plans.scale import lookup


def case_report(iters: DataFrame, keys: Sequence[str], wall: str, slo_ms: float, few: bool = False, reread: bool = False) -> DataFrame:
    """Robust statistics per case, status of the p95 against an objective, worst first."""
    cases = summarize_cases(iters, keys, wall, few=few, reread=reread)
    status = lookup({0: "ok", 1: "warn", 2: "fail"}, ceiling_status(F.col("p95_ms"), F.lit(float(slo_ms)), 1.25))
    return cases.withColumn("status", status).orderBy(severity("status"), *keys)


def compare_runs(
    a: DataFrame, b: DataFrame, keys: Sequence[str] = C.CASE, error: str | None = "error", conditions: tuple | None = None, **thresholds,
) -> dict[str, DataFrame]:
    """All axes of a two-run comparison over flattened iteration rows, and the verdict row."""
    timing = C.timing_diff(a, b, keys, error=error, **thresholds)
    compression = C.compression_diff(a, b, keys, error)
    out = {"timing": timing, "compression": compression, "pairs": C.pair_cases(a, b, keys)}
    if {"path", "size_rel_error_pct"} <= set(a.columns) & set(b.columns):
        out["estimation"] = C.estimation_diff(a, b, keys, error)
    if error:
        out["new_errors"] = C.head_only_errors(a, b, keys, error)
    if conditions:
        out["conditions"] = C.comparable(*conditions)
    out["verdict"] = C.verdict(timing, compression, out.get("estimation"), out.get("new_errors"), out.get("conditions"))
    return out
