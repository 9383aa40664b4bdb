"""The rate-limit audit on a stream.

Each micro-batch runs the batch audit with the counters carried from earlier batches, so verdicts
equal those of one batch over the same events in arrival order, and a hot client is split into
time slots instead of being bound to one state-store task. Counters are a small table per batch
(client x live windows), written after the verdicts; a replayed batch overwrites its own output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from pixelyard.operators.limits import _US, rate_limit_audit


def _previous(spark, state: str, batch_id: int, first_id: int) -> DataFrame | None:
    """Counters of the batch before. Only the stream's first batch starts without; a missing table
    further on would let clients through, so it is an error."""
    return None if batch_id == first_id else spark.read.parquet(f"{state}/batch={batch_id - 1}")


def _forget(spark, state: str, batch_id: int) -> None:
    """Removes counters that no replay can need: Spark repeats the last batch at most."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/batch={batch_id - 2}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _counts(verdicts: DataFrame, client: str, time_us: str, kind: str, column: str, width_us: int) -> DataFrame:
    window = F.floor(F.col(time_us) / F.lit(width_us)).cast("bigint")
    return (
        verdicts.where(F.col(column).isNotNull())
        .groupBy(F.col(client).alias("client"), window.alias("window"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(kind).alias("kind"), "client", "window", "n")
    )


def audit_batch(
    batch: DataFrame, batch_id: int, client: str, time_us: str, tie: str, verdicts: str, state: str,
    window_s: int, burst_s: int, first_id: int = 0, **limits,
) -> None:
    """Verdicts of one micro-batch to ``verdicts/batch=N`` and its counters to ``state/batch=N``.

    Events older than the window before the latest one seen have lost their counters; they are
    written with reason ``late`` and are not counted. ``first_id`` is the batch that starts without counters.
    """
    spark = batch.sparkSession
    old = _previous(spark, state, batch_id, first_id)
    window_us, burst_us = window_s * _US, burst_s * _US
    clock = None
    if old is not None:
        row = old.where("kind = 'clock'").select(F.max("n").alias("n")).first()
        clock = row["n"]
    alive = F.lit(True) if clock is None else F.col(time_us) >= (clock // window_us - 1) * window_us

    carried = lambda kind: None if old is None else old.where(F.col("kind") == kind).select("client", "window", "n")
    audited = rate_limit_audit(
        batch.where(alive), client, time_us, tie, window_s=window_s, burst_s=burst_s,
        carried_window=carried("window"), carried_burst=carried("burst"), **limits,
    )
    late = batch.where(~alive).withColumn("reason", F.lit("late"))
    audited.unionByName(late, allowMissingColumns=True).write.mode("overwrite").parquet(f"{verdicts}/batch={batch_id}")

    done = spark.read.schema(audited.schema).parquet(f"{verdicts}/batch={batch_id}")
    fresh = done.where(F.col("reason").isNull() | (F.col("reason") != "late"))
    newest = fresh.agg(F.max(time_us).alias("n")).first()["n"]
    newest = max(x for x in (newest, clock, 0) if x is not None)
    counts = _counts(fresh, client, time_us, "window", "window_count", window_us).unionByName(
        _counts(fresh, client, time_us, "burst", "burst_count", burst_us)
    )
    if old is not None:
        counts = counts.unionByName(old.where(F.col("kind") != "clock"))
    width = F.when(F.col("kind") == "window", window_us).otherwise(burst_us)
    # A window's counter is needed until the window after it has passed.
    live = counts.where(F.col("window") >= F.floor(F.lit(newest) / width) - 1)
    total = live.groupBy("kind", "client", "window").agg(F.sum("n").alias("n"))
    client_type = batch.schema[client].dataType
    now = spark.range(1).select(
        F.lit("clock").alias("kind"), F.lit(None).cast(client_type).alias("client"),
        F.lit(None).cast("bigint").alias("window"), F.lit(newest).cast("bigint").alias("n"),
    )
    total.unionByName(now).write.mode("overwrite").parquet(f"{state}/batch={batch_id}")
    _forget(spark, state, batch_id)


def rate_limit_stream(
    events: DataFrame, client: str, time_us: str, tie: str, verdicts: str, state: str, checkpoint: str,
    window_s: int = 60, burst_s: int = 10, **limits,
) -> DataStreamWriter:
    """A writer to ``start()``; all three paths must be on storage every executor reaches."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        audit_batch(batch, batch_id, client, time_us, tie, verdicts, state, window_s, burst_s, **limits)

    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)


def as_event_time(time_us: str | Column) -> Column:
    return F.timestamp_micros(F.col(time_us) if isinstance(time_us, str) else time_us)
