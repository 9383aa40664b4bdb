"""Rate-limit audit of request events.

The sliding limit weighs the previous window's total by the part of it still in view and adds the
running count of this window. Rejected requests still count. Running counts are taken inside parts of
a window, so that one client holding a third of all events is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelyard.plans.running import with_running_sum

_US = 1_000_000
#: Slots of a window.
SLOTS = 20


def _floor_div(value: Column, width: int) -> Column:
    return F.floor(value / F.lit(width)).cast("bigint")


def _counted(df: DataFrame, client: str, tie: str, flag: Column, window_us: int, slot_us: int, out: str, carried: DataFrame | None, previous: bool = False) -> DataFrame:
    """Adds ``out``, the running number of flagged events of the client in the window, and, if asked,
    ``__previous``, all flagged events of the window before."""
    df = df.withColumn("__window", _floor_div(F.col("__us"), window_us))
    amount = flag.cast("bigint")
    counted = with_running_sum(df, [client, "__window"], "__us", [tie], amount, slot_us, out)
    keys = [client, "__window"]
    if previous:
        totals = df.groupBy(*keys).agg(F.sum(amount).alias("__previous"))
        if carried is not None:
            old = carried.select(F.col("client").alias(client), F.col("window").alias("__window"), F.col("n").alias("__previous"))
            totals = totals.unionByName(old).groupBy(*keys).agg(F.sum("__previous").alias("__previous"))
        counted = counted.join(totals.withColumn("__window", F.col("__window") + 1), keys, "left")
        counted = counted.withColumn("__previous", F.coalesce("__previous", F.lit(0)))
    if carried is not None:
        old = carried.groupBy(F.col("client").alias(client), F.col("window").alias("__window")).agg(F.sum("n").alias("__carried"))
        counted = counted.join(old, keys, "left").withColumn(out, F.col(out) + F.coalesce("__carried", F.lit(0))).drop("__carried")
    return counted.drop("__window")


def rate_limit_audit(
    events: DataFrame,
    client: str,
    time_us: str,
    tie: str,
    limit: int = 60,
    window_s: int = 60,
    burst_limit: int = 10,
    burst_s: int = 10,
    authenticated: Column | None = None,
    auth_enabled: bool = False,
    auth_limit: int = 0,
    burst_public_only: bool = False,
    carried_window: DataFrame | None = None,
    carried_burst: DataFrame | None = None,
) -> DataFrame:
    """Every event with ``window_count``, ``weighted``, ``burst_count``, ``reason`` and
    ``retry_after``. The sliding limit is checked first; an event it rejects never reaches the
    burst counter. A limit of 0 switches a check off. Clients must not be NULL.

    ``carried_window`` / ``carried_burst`` (client, window, n) are counts of earlier
    micro-batches. Counts run over slots of a ``SLOTS``-th of each window, and crowded slots are cut
    further (``plans/running.py``), so a client's busiest second is many tasks' work.
    """
    window_us, burst_us = window_s * _US, burst_s * _US
    public = F.lit(True) if authenticated is None else ~authenticated
    own_limit = F.when(public, F.lit(limit)).otherwise(F.lit(auth_limit if auth_enabled else 0))
    names = list(events.columns)
    df = events.withColumns({"__us": F.col(time_us), "__limit": own_limit, "__public": public})
    df = df.withColumn("__counted", F.col("__limit") > 0)

    df = _counted(df, client, tie, F.col("__counted"), window_us, max(1, window_us // SLOTS), "__count", carried_window, previous=True)
    df = df.withColumn("window_count", F.when(F.col("__counted"), F.col("__count")))
    elapsed = F.pmod(F.col("__us"), F.lit(window_us)) / F.lit(float(window_us))
    df = df.withColumn("weighted", F.col("__previous") * (1.0 - elapsed) + F.col("window_count"))
    df = df.withColumn("__rejected", F.coalesce(F.col("weighted") > F.col("__limit"), F.lit(False))).drop("__count", "__previous")

    in_burst = ~F.col("__rejected") & F.lit(burst_limit > 0)
    if burst_public_only:
        in_burst = in_burst & F.col("__public")
    df = df.withColumn("__in_burst", in_burst)
    if burst_limit > 0:
        df = _counted(df, client, tie, F.col("__in_burst"), burst_us, max(1, burst_us // SLOTS), "__count", carried_burst)
    else:
        df = df.withColumn("__count", F.lit(0).cast("bigint"))
    df = df.withColumn("burst_count", F.when(F.col("__in_burst"), F.col("__count")))
    burst_rejected = F.coalesce(F.col("burst_count") > burst_limit, F.lit(False))

    def wait(width_us: int) -> Column:
        return F.floor((F.lit(width_us) - F.pmod(F.col("__us"), F.lit(width_us))) / F.lit(_US)).cast("bigint")

    reason = F.when(F.col("__rejected"), "rate").when(burst_rejected, "burst")
    retry = F.when(F.col("__rejected"), wait(window_us)).when(burst_rejected, wait(burst_us))
    return df.select(*names, "window_count", "weighted", "burst_count", reason.alias("reason"), retry.alias("retry_after"))


def minute_limit(events: DataFrame, client: str, time_us: str, tie: str, limit: int = 60, window_s: int = 60, **kw) -> DataFrame:
    """The sliding limit alone."""
    out = rate_limit_audit(events, client, time_us, tie, limit, window_s, 0, window_s, **kw)
    return out.drop("burst_count")


def burst_limit(events: DataFrame, client: str, time_us: str, tie: str, limit: int = 10, window_s: int = 10) -> DataFrame:
    """The tumbling burst limit alone."""
    return rate_limit_audit(events, client, time_us, tie, 0, window_s, limit, window_s).drop("window_count", "weighted")


def client_totals(verdicts: DataFrame, client: str) -> DataFrame:
    return verdicts.groupBy(client).agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.count_if(F.col("reason").isNull()).alias("n_allowed"),
        F.count_if(F.col("reason") == "rate").alias("n_rate"),
        F.count_if(F.col("reason") == "burst").alias("n_burst"),
    )
