"""Concurrent-request outcomes: per-case load statistics, roll-ups and peak concurrency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelyard.operators.cases import with_total
from pixelyard.plans import quantiles
from pixelyard.plans.running import with_running_sum
from pixelyard.plans.scale import join_on

#: one-minute slots of a microsecond and of a nanosecond clock
US_SLOT = 60_000_000
NS_SLOT = 60_000_000_000


def load_case(requests: DataFrame, keys: Sequence[str] = ("case_id",), position: str = "pos") -> DataFrame:
    """Counts, throughput, latency and queue-wait percentiles (successes only; 0 without any),
    mean reduction and size, and the most common method (the first seen on ties).

    Expects status, start_ns, grant_ns, release_ns, reduction, size, method and a position.
    """
    keys = list(keys)
    ok = F.col("status") == "success"
    rows = requests.withColumns(
        {
            "__latency": F.when(ok, (F.col("release_ns") - F.col("start_ns")) / 1e6),
            "__wait": F.when(ok, (F.col("grant_ns") - F.col("start_ns")) / 1e6),
        }
    )
    specs = []
    for name, column in (("latency", "__latency"), ("queue_wait", "__wait")):
        specs += [(f"{name}_p{p}_ms", column, p) for p in (50, 95, 99)]
    aggs = [
        F.count(F.lit(1)).alias("n_requests"),
        F.count_if(ok).alias("n_success"),
        F.count_if(F.col("status") == "503_queue").alias("n_503_queue"),
        F.count_if(F.col("status") == "503_memory").alias("n_503_memory"),
        F.max("__latency").alias("latency_max_ms"),
        F.max("__wait").alias("queue_wait_max_ms"),
        ((F.max("release_ns") - F.min("start_ns")) / 1e6).alias("wall_ms"),
        F.avg(F.when(ok, F.col("reduction"))).alias("mean_reduction"),
        F.avg(F.when(ok, F.col("size"))).alias("__size"),
    ]
    needed = dict.fromkeys([*keys, "__latency", "__wait", "status", "start_ns", "release_ns", "reduction", "size"])
    base = quantiles.aggregate(rows.select(*needed), keys, specs, aggs)
    methods = (
        requests.where(ok)
        .groupBy(*keys, F.coalesce("method", F.lit("")).alias("method"))
        .agg(F.count(F.lit(1)).alias("__n"), F.min(position).alias("__first"))
        .groupBy(*keys)
        .agg(F.max_by("method", F.struct("__n", -F.col("__first"))).alias("method"))
    )
    out = join_on(base, methods, keys, "left")
    zero = [c for c in out.columns if c.startswith(("latency_", "queue_wait_"))] + ["mean_reduction"]
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in zero}).withColumns(
        {
            "n_503": F.col("n_503_queue") + F.col("n_503_memory"),
            "n_error": F.col("n_requests") - F.col("n_success") - F.col("n_503_queue") - F.col("n_503_memory"),
            "throughput_per_sec": F.when(F.col("wall_ms") > 0, F.col("n_success") / (F.col("wall_ms") / 1000.0)).otherwise(0.0),
            "ok_rate": F.col("n_success") / F.col("n_requests"),
            "mean_optimized_size": F.coalesce(F.col("__size").cast("bigint"), F.lit(0)),
            "method": F.coalesce("method", F.lit("")),
        }
    ).drop("__size")


def load_rollup(cases: DataFrame) -> DataFrame:
    """Totals and medians per format and over all formats."""
    slim = cases.select(
        "format", "n_requests", "n_success", "n_503", "n_error", "throughput_per_sec", "latency_p95_ms", "ok_rate"
    )
    specs = [
        ("median_throughput", "throughput_per_sec", 50), ("median_latency_p95_ms", "latency_p95_ms", 50),
        ("median_ok_rate", "ok_rate", 50),
    ]
    sums = [F.sum(c).alias(c) for c in ("n_requests", "n_success", "n_503", "n_error")]
    out = quantiles.aggregate(with_total(slim, "format"), ["format"], specs, [F.count(F.lit(1)).alias("n_cases"), *sums], few=True)
    return out.withColumn("ok_rate", F.coalesce(F.try_divide("n_success", "n_requests"), F.lit(0.0)))


def peak_concurrency(
    intervals: DataFrame, keys: Sequence[str], start: str, end: str, slot: int = US_SLOT, out: str = "peak"
) -> DataFrame:
    """Largest number of half-open intervals [start, end) that overlap, per key; exact.

    Starts and ends are netted per instant first (an end at t precedes a start at t), then a
    running sum is taken slot by slot, so a single global group still runs in parallel.
    """
    keys = list(keys)
    steps = F.array(
        F.struct(F.col(start).alias("__t"), F.lit(1).alias("__d")),
        F.struct(F.col(end).alias("__t"), F.lit(-1).alias("__d")),
    )
    complete = intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    net = complete.select(*keys, F.inline(steps)).groupBy(*keys, "__t").agg(F.sum("__d").alias("__d"))
    level = with_running_sum(net, keys, "__t", [], F.col("__d"), slot, "__level")
    return level.groupBy(*keys).agg(F.greatest(F.max("__level"), F.lit(0)).cast("bigint").alias(out))


def gate_peaks(requests: DataFrame, keys: Sequence[str], slot: int = NS_SLOT) -> DataFrame:
    """Peak active (grant to release) and queued (start to grant) requests per key."""
    active = peak_concurrency(requests, keys, "grant_ns", "release_ns", slot, "max_active")
    queued = peak_concurrency(requests, keys, "start_ns", "grant_ns", slot, "max_queued")
    both = join_on(active, queued, list(keys), "full")
    return both.select(*keys, F.coalesce("max_active", F.lit(0)).alias("max_active"), F.coalesce("max_queued", F.lit(0)).alias("max_queued"))
