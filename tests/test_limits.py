"""Rate limits against a literal simulation, in batch and over several micro-batches."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from pixelyard.operators import limits as L
from pixelyard.streaming.limits import audit_batch, rate_limit_stream

US = 1_000_000


def simulate(events, limit, window_s, burst, burst_s, auth_limit=None):
    minute, bursts, out = {}, {}, {}
    for client, us, eid, auth in sorted(events, key=lambda e: (e[1], e[2])):
        reason = wait = None
        own = (auth_limit or 0) if auth else limit
        if own > 0:
            w = us // (window_s * US)
            minute[client, w] = minute.get((client, w), 0) + 1
            part = us % (window_s * US) / (window_s * US)
            if minute.get((client, w - 1), 0) * (1 - part) + minute[client, w] > own:
                reason, wait = "rate", int(window_s - us / US % window_s)
        if reason is None and burst > 0:
            b = us // (burst_s * US)
            bursts[client, b] = bursts.get((client, b), 0) + 1
            if bursts[client, b] > burst:
                reason, wait = "burst", int(burst_s - us / US % burst_s)
        out[eid] = (reason, wait)
    return out


def make(n=1500, seconds=400, seed=3):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.4 else f"c{rng.randrange(8)}", rng.randrange(seconds * US), i, rng.random() < 0.2) for i in range(n)]


def frame(spark, events):
    return spark.createDataFrame(events, "client string, us bigint, id bigint, auth boolean")


@pytest.mark.parametrize("cfg", [(60, 60, 10, 10), (20, 60, 3, 10), (5, 30, 2, 20), (0, 60, 2, 10), (10, 60, 0, 10), (8, 60, 2, 7)])
def test_audit_matches_simulation(spark, cfg):
    limit, window, burst, burst_s = cfg
    events = make()
    out = L.rate_limit_audit(frame(spark, events).drop("auth"), "client", "us", "id", limit, window, burst, burst_s).collect()
    want = simulate([(c, u, i, False) for c, u, i, _ in events], limit, window, burst, burst_s)
    assert {r["id"]: (r["reason"], r["retry_after"]) for r in out} == want


@pytest.mark.parametrize("enabled", [False, True])
def test_authenticated_clients(spark, enabled):
    events = make(800)
    out = L.rate_limit_audit(frame(spark, events), "client", "us", "id", 10, 60, 3, 10, authenticated=F.col("auth"), auth_enabled=enabled, auth_limit=25)
    want = simulate(events, 10, 60, 3, 10, 25 if enabled else None)
    assert {r["id"]: (r["reason"], r["retry_after"]) for r in out.collect()} == want


def test_burst_for_public_requests_only(spark):
    events = [("a", 1000 + i, i, i % 2 == 0) for i in range(20)]
    out = L.rate_limit_audit(frame(spark, events), "client", "us", "id", 0, 60, 3, 10, authenticated=F.col("auth"), burst_public_only=True).collect()
    assert sum(r["reason"] == "burst" for r in out) == 7 and all(r["reason"] is None for r in out if r["auth"])


def test_rate_rejections_never_reach_the_burst_counter(spark):
    events = [("a", i * 1000, i, False) for i in range(30)]
    out = L.rate_limit_audit(frame(spark, events), "client", "us", "id", 5, 60, 10, 10).collect()
    assert sum(r["reason"] == "rate" for r in out) == 25 and sum(r["burst_count"] is not None for r in out) == 5


def test_micro_batches_equal_one_batch(spark):
    events = sorted(make(1200), key=lambda e: (e[1], e[2]))
    base = tempfile.mkdtemp(prefix="spark-")
    for n in range(6):
        batch = frame(spark, events[n * 200 : (n + 1) * 200]).drop("auth")
        audit_batch(batch, n, "client", "us", "id", f"{base}/v", f"{base}/s", 60, 10, limit=12, burst_limit=3)
        if n == 3:  # a replayed batch replaces its own output
            audit_batch(batch, n, "client", "us", "id", f"{base}/v", f"{base}/s", 60, 10, limit=12, burst_limit=3)
    out = {r["id"]: (r["reason"], r["retry_after"]) for r in spark.read.parquet(f"{base}/v").collect()}
    assert out == simulate([(c, u, i, False) for c, u, i, _ in events], 12, 60, 3, 10)
    live = spark.read.parquet(f"{base}/s/batch=5").where("kind = 'window'").agg(F.min("window"), F.max("window")).first()
    assert live[1] - live[0] <= 1  # only the last two windows are kept


def test_late_events_are_kept_apart(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    first = [("a", 600 * US + i, i, False) for i in range(5)]
    late = [("a", 10 * US, 100, False), ("a", 601 * US, 101, False)]
    for n, part in enumerate((first, late)):
        audit_batch(frame(spark, part).drop("auth"), n, "client", "us", "id", f"{base}/v", f"{base}/s", 60, 10, limit=3, burst_limit=0)
    out = {r["id"]: r["reason"] for r in spark.read.parquet(f"{base}/v").collect()}
    assert out[100] == "late" and out[101] == "rate" and out[2] is None


def test_stream_over_files(spark):
    events = sorted(make(600, 200), key=lambda e: (e[1], e[2]))
    base = tempfile.mkdtemp(prefix="spark-")
    for n in range(3):
        frame(spark, events[n * 200 : (n + 1) * 200]).drop("auth").coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema("client string, us bigint, id bigint").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    run = rate_limit_stream(stream, "client", "us", "id", f"{base}/v", f"{base}/s", f"{base}/c", limit=12, burst_limit=3).trigger(availableNow=True).start()
    run.awaitTermination()
    out = {r["id"]: (r["reason"], r["retry_after"]) for r in spark.read.parquet(f"{base}/v").collect()}
    assert out == simulate([(c, u, i, False) for c, u, i, _ in events], 12, 60, 3, 10)


def test_client_totals(spark):
    out = L.rate_limit_audit(frame(spark, make(500)).drop("auth"), "client", "us", "id", 8, 60, 2, 10)
    totals = L.client_totals(out, "client").collect()
    assert sum(r["n_requests"] for r in totals) == 500
    assert all(r["n_requests"] == r["n_allowed"] + r["n_rate"] + r["n_burst"] for r in totals)
