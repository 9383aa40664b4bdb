"""Null-safe joins, pinned columns and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", nulls: bool = True) -> DataFrame:
    """Equi-join that also matches NULL keys; the result keeps one copy of each key.

    With ``nulls=False`` it is a plain equi-join, which can reuse the partitioning that a grouping
    by the same keys has left.
    """
    if not keys:
        # Without keys ``right`` is a global aggregate: exactly one row.
        return left.join(F.broadcast(right))
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    cond = None
    for k in keys:
        part = left[k].eqNullSafe(renamed[f"__r_{k}"]) if nulls else left[k] == renamed[f"__r_{k}"]
        cond = part if cond is None else cond & part
    joined = left.join(renamed, cond, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how == "full":
        for k in keys:
            joined = joined.withColumn(k, F.coalesce(F.col(k), F.col(f"__r_{k}")))
    return joined.drop(*[f"__r_{k}" for k in keys])


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """Fixed dictionary as a literal map lookup; ``default`` fills unknown keys."""
    pairs: list[Column] = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once per row.

    The optimizer copies a projected expression into every place that reads it (and below filters)
    when Python functions or struct fields are involved. The output of a generator is never
    copied, so expensive columns with many readers go through a one-element ``inline``.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def whole(df: DataFrame) -> DataFrame:
    """The same rows; whatever reads them needs all of their columns, so that several readers share a shuffle below."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the cluster's shared checkpoint folder.

    Reads ``spark.checkpoint.dir``; where it is unset (tests, laptops) and the master is
    local, a temporary folder serves. On a cluster without the setting this raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        checkpoint = spark.sparkContext.getCheckpointDir()
        if checkpoint:
            base = checkpoint
        elif spark.sparkContext.master.startswith("local"):
            base = tempfile.mkdtemp(prefix="spark-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def epoch_micros(column: str | Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ column, independent of the session zone."""
    gap = F.col(column) if isinstance(column, str) else column
    gap = gap - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    seconds = (
        F.extract(F.lit("DAY"), gap).cast("bigint") * 86_400
        + F.extract(F.lit("HOUR"), gap).cast("bigint") * 3_600
        + F.extract(F.lit("MINUTE"), gap).cast("bigint") * 60
    )
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), gap) * 1_000_000).cast("bigint")
