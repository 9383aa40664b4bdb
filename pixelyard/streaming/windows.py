"""Windowed counts and load statistics; the same functions serve batch frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelyard.plans.quantiles import from_sketch, sketch


def window_counts(
    events: DataFrame, time: str, size: str, slide: str | None = None, keys: Sequence[str] = (), delay: str = "2 minutes"
) -> DataFrame:
    """Tumbling or sliding counts per key; on a stream, rows later than ``delay`` are dropped."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    source = events.withWatermark(time, delay) if events.isStreaming else events
    out = source.groupBy(window.alias("window"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n")


def load_windows(requests: DataFrame, time: str, size: str, keys: Sequence[str] = (), delay: str = "2 minutes", accuracy: int = 4096) -> DataFrame:
    """Success, refusal and error counts, ok rate and p95 latency per time window, in batch or on a stream.

    The latency comes from a mergeable sketch of ``accuracy``, which is all that a stream keeps of a
    window's values (``quantiles.rank_error`` states how far its rank can be off).
    """
    source = requests.withWatermark(time, delay) if requests.isStreaming else requests
    ok = F.col("status") == "success"
    out = source.groupBy(F.window(time, size).alias("window"), *keys).agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.count_if(ok).alias("n_success"),
        F.count_if(F.startswith("status", F.lit("503"))).alias("n_503"),
        sketch(F.when(ok, F.col("latency_ms")), accuracy).alias("__latency"),
    )
    return out.select(
        F.col("window.start").alias("window_start"), *keys, "n_requests", "n_success", "n_503",
        (F.col("n_requests") - F.col("n_success") - F.col("n_503")).alias("n_error"),
        (F.col("n_success") / F.col("n_requests")).alias("ok_rate"),
        from_sketch("__latency", 95).alias("latency_p95_ms"),
    )


def end_marker(rows: DataFrame, time: str, size: str, delay: str = "2 minutes") -> DataFrame:
    """One row of ``rows``' columns, later than all of them by a window and the delay, NULL but for ``time``.

    Append mode writes a window once the watermark has passed it, so the last windows of a finished
    source stay open. Sent after all rows, the marker closes them; the window it falls into itself stays open.
    """
    late = rows.agg(F.max(time).alias("__last")).where(F.col("__last").isNotNull())
    at = F.col("__last") + 2 * F.expr(f"INTERVAL '{size}'") + 2 * F.expr(f"INTERVAL '{delay}'")
    return late.select(*[at.cast(f.dataType).alias(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
