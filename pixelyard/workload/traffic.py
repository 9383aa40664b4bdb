"""Rate-limit and windowed-count queries, in batch and on a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelyard.operators import limits as L
from pixelyard.plans.quantiles import rank_error
from pixelyard.plans.scale import scratch_path
from pixelyard.sources.tables import read_table
from pixelyard.streaming.limits import rate_limit_stream
from pixelyard.streaming.windows import end_marker, load_windows, window_counts
from pixelyard.workload import frames as W
from pixelyard.workload.registry import query

DAY, HOUR = 86_400, 3_600


def audit_sql(window_s: int, limit: int, burst_s: int, burst: int, exempt: str = "FALSE") -> str:
    """Verdicts by window functions over whole clients. ``exempt`` rows skip the sliding limit."""
    w, b = window_s * 1_000_000, burst_s * 1_000_000
    return f"""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us, epoch_us(ts) // {w} AS win, epoch_us(ts) // {b} AS bwin, NOT ({exempt}) AS counted FROM events),
 c AS (SELECT *, CASE WHEN counted THEN count(*) FILTER (WHERE counted) OVER (PARTITION BY user_id, win ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) END AS window_count FROM e),
 t AS (SELECT user_id, win, count(*) AS total FROM e WHERE counted GROUP BY ALL),
 v AS (SELECT c.*, coalesce(t.total, 0) * (1 - (us % {w}) / {float(w)}) + window_count AS weighted FROM c LEFT JOIN t ON t.user_id = c.user_id AND t.win = c.win - 1),
 r AS (SELECT *, coalesce(weighted > {limit}, FALSE) AND {limit} > 0 AS rated FROM v),
 q AS (SELECT *, CASE WHEN NOT rated AND {burst} > 0 THEN count(*) FILTER (WHERE NOT rated) OVER (PARTITION BY user_id, bwin ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) END AS burst_count FROM r),
 verdicts AS (SELECT event_id, user_id, window_count, weighted, burst_count,
  CASE WHEN rated THEN 'rate' WHEN burst_count > {burst} AND {burst} > 0 THEN 'burst' END AS reason,
  CASE WHEN rated THEN ({w} - us % {w}) // 1000000 WHEN burst_count > {burst} AND {burst} > 0 THEN ({b} - us % {b}) // 1000000 END AS retry_after FROM q)"""


_COLUMNS = ("event_id", "user_id", "window_count", "weighted", "burst_count", "reason", "retry_after")


def _events(spark, folder):
    return W.events(spark, folder).select("event_id", "user_id", "us", "event_type")


def _in_lots(spark, rows, base, start, lots=4):
    """Writes ``rows`` (with ``us``) to a folder in lots of equal time, one after the other. After each lot
    ``start`` gets the stream of the folder, runs until it has read all, and is stopped: counters go
    on from batch to batch and from run to run. Returns the schema that the stream has."""
    first, last = rows.agg(F.min("us"), F.max("us")).first()
    if first is None:
        first = last = 0
    lot = F.floor((F.col("us") - first) * lots / (last - first + 1))
    for i in range(lots):
        rows.where(lot == i).write.mode("append").parquet(f"{base}/in")
        start(spark.readStream.schema(rows.schema).parquet(f"{base}/in")).trigger(availableNow=True).start().awaitTermination()


def _audit(spark, folder, window_s, limit, burst_s, burst, **kw):
    return L.rate_limit_audit(_events(spark, folder), "user_id", "us", "event_id", limit, window_s, burst, burst_s, **kw)


@query("minute_limit", audit_sql(DAY, 4, DAY, 0) + " SELECT event_id, user_id, window_count, weighted, reason, retry_after FROM verdicts", rounded="weighted")
def _(spark, folder):
    out = L.minute_limit(_events(spark, folder), "user_id", "us", "event_id", 4, DAY)
    return out.select(*[c for c in _COLUMNS if c != "burst_count"])


@query(
    "burst_limit",
    """SELECT event_id, user_id, n AS burst_count, CASE WHEN n > 1 THEN 'burst' END AS reason,
 CASE WHEN n > 1 THEN (3600000000 - epoch_us(ts) % 3600000000) // 1000000 END AS retry_after
 FROM (SELECT *, count(*) OVER (PARTITION BY user_id, epoch_us(ts) // 3600000000 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events)""",
)
def _(spark, folder):
    out = L.burst_limit(_events(spark, folder), "user_id", "us", "event_id", 1, HOUR)
    return out.select("event_id", "user_id", "burst_count", "reason", "retry_after")


@query("rate_limit_audit", audit_sql(DAY, 4, HOUR, 1) + f" SELECT {', '.join(_COLUMNS)} FROM verdicts", rounded="weighted")
def _(spark, folder):
    return _audit(spark, folder, DAY, 4, HOUR, 1).select(*_COLUMNS)


@query("rate_limit_defaults", audit_sql(60, 60, 10, 10) + f" SELECT {', '.join(_COLUMNS)} FROM verdicts", rounded="weighted")
def _(spark, folder):
    return _audit(spark, folder, 60, 60, 10, 10).select(*_COLUMNS)


@query("rate_limit_uneven_windows", audit_sql(12 * HOUR, 2, 5 * HOUR, 1) + f" SELECT {', '.join(_COLUMNS)} FROM verdicts", rounded="weighted")
def _(spark, folder):
    """Burst windows that do not divide the sliding window share slots of the common divisor."""
    return _audit(spark, folder, 12 * HOUR, 2, 5 * HOUR, 1).select(*_COLUMNS)


@query("rate_limit_authenticated", audit_sql(DAY, 4, HOUR, 1, "event_type = 'purchase'") + f" SELECT {', '.join(_COLUMNS)} FROM verdicts", rounded="weighted")
def _(spark, folder):
    """Authenticated requests are exempt from the sliding limit, not from the burst limit."""
    e = _events(spark, folder)
    out = L.rate_limit_audit(e, "user_id", "us", "event_id", 4, DAY, 1, HOUR, authenticated=F.col("event_type") == "purchase")
    return out.select(*_COLUMNS)


@query(
    "client_totals",
    audit_sql(DAY, 4, HOUR, 1) + """ SELECT user_id, count(*) AS n_requests, count(*) FILTER (WHERE reason IS NULL) AS n_allowed,
 count(*) FILTER (WHERE reason = 'rate') AS n_rate, count(*) FILTER (WHERE reason = 'burst') AS n_burst FROM verdicts GROUP BY 1""",
)
def _(spark, folder):
    return L.client_totals(_audit(spark, folder, DAY, 4, HOUR, 1), "user_id")


@query("rate_limit_stream", audit_sql(DAY, 4, HOUR, 1) + f" SELECT {', '.join(_COLUMNS)} FROM verdicts", rounded="weighted")
def _(spark, folder):
    """The audit on a stream of the events in four lots, with a restart after each; the verdict table equals the batch result."""
    base = scratch_path(spark, "limits")

    def start(stream):
        return rate_limit_stream(stream, "user_id", "us", "event_id", f"{base}/verdicts", f"{base}/state", f"{base}/checkpoint", DAY, HOUR, limit=4, burst_limit=1)

    _in_lots(spark, _events(spark, folder).select("event_id", "user_id", "us"), base, start)
    return spark.read.parquet(f"{base}/verdicts").select(*_COLUMNS)


_TUMBLING = "SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) // 1000000 AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL"
_SLIDING = """SELECT epoch_us(w) // 1000000 AS window_start, event_type, count(*) AS n FROM (SELECT event_type,
 unnest([time_bucket(INTERVAL '6 hours', ts), time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours']) AS w FROM events) GROUP BY ALL"""


def _timed(spark, folder):
    return W.events(spark, folder).select("event_type", F.timestamp_micros("us").alias("ts"))


def _seconds(df):
    return df.select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n")


@query("window_counts_tumbling", _TUMBLING)
def _(spark, folder):
    return _seconds(window_counts(_timed(spark, folder), "ts", "1 hour", keys=["event_type"]))


@query("window_counts_sliding", _SLIDING)
def _(spark, folder):
    return _seconds(window_counts(_timed(spark, folder), "ts", "12 hours", "6 hours", ["event_type"]))


def _closed(spark, rows, base, window, size):
    """Runs ``window`` on a stream of ``rows`` in four lots, sends the end marker, and reads what was written."""

    def start(stream):
        return window(stream).writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")

    _in_lots(spark, rows, base, start)
    end_marker(rows, "ts", size).write.mode("append").parquet(f"{base}/in")
    start(spark.readStream.schema(rows.schema).parquet(f"{base}/in")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("window_counts_stream", _TUMBLING)
def _(spark, folder):
    """Append mode in four lots with restarts; the end marker closes the last windows."""
    rows = _events(spark, folder).select("us", "event_type", F.timestamp_micros("us").alias("ts"))
    out = _closed(spark, rows, scratch_path(spark, "windows"), lambda s: window_counts(s, "ts", "1 hour", keys=["event_type"], delay="2 minutes"), "1 hour")
    return _seconds(out)


_LOAD = f"""SELECT epoch_us(time_bucket(INTERVAL '1 day', make_timestamp(start_ns // 1000))) // 1000000 AS window_start, count(*) AS n_requests,
 count(*) FILTER (WHERE status = 'success') AS n_success, count(*) FILTER (WHERE status = '503_queue') AS n_503, count(*) FILTER (WHERE status = 'error') AS n_error,
 count(*) FILTER (WHERE status = 'success') / count(*) AS ok_rate, TRUE AS p95_within FROM ({W.REQUESTS}) GROUP BY 1"""
_SKETCH = 4096


def _load_rows(spark, folder):
    return W.requests(spark, folder).select(
        F.floor(F.col("start_ns") / 1000).cast("bigint").alias("us"), F.timestamp_micros(F.floor(F.col("start_ns") / 1000).cast("bigint")).alias("ts"),
        "status", ((F.col("release_ns") - F.col("start_ns")) / 1e6).alias("latency_ms"),
    )


def _within(rows, windows):
    """Whether each window's p95 has a rank that is off by no more than its sketch allows."""
    at = windows.select("window_start", "latency_p95_ms")
    ok = rows.where("status = 'success'").select(F.window("ts", "1 day")["start"].alias("window_start"), "latency_ms").join(at, "window_start")
    below, upto = F.avg((F.col("latency_ms") < F.col("latency_p95_ms")).cast("double")), F.avg((F.col("latency_ms") <= F.col("latency_p95_ms")).cast("double"))
    bound = rank_error(_SKETCH)
    ranks = ok.groupBy("window_start").agg(((below - bound <= 0.95) & (upto + bound >= 0.95)).alias("p95_within"))
    out = windows.join(ranks, "window_start", "left").drop("latency_p95_ms")
    return out.withColumn("p95_within", F.coalesce("p95_within", F.col("n_success") == 0)).withColumn("window_start", F.unix_seconds("window_start"))


@query("load_windows", _LOAD, rounded="ok_rate")
def _(spark, folder):
    """Load statistics per day; the sketched p95 is held against exact ranks."""
    rows = _load_rows(spark, folder)
    return _within(rows, load_windows(rows, "ts", "1 day", accuracy=_SKETCH))


@query("load_stream", _LOAD, rounded="ok_rate")
def _(spark, folder):
    """The same on a stream in four lots with restarts, closed by an end marker."""
    rows = _load_rows(spark, folder)
    return _within(rows, _closed(spark, rows, scratch_path(spark, "load"), lambda s: load_windows(s, "ts", "1 day", accuracy=_SKETCH), "1 day"))
