"""Registration of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 6, rounded: Mapping[str, int] | str = ""):
    """Register ``fn(spark, folder)``.

    ``rounded`` names the floating-point outputs (a space-separated list, or name -> digits). They
    are rounded alike on both sides, because a distributed sum adds in another order than a
    single-node one; adding 0.0 turns a negative zero into zero.
    """
    places = {c: digits for c in rounded.split()} if isinstance(rounded, str) else dict(rounded)

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = fn(spark, folder)
            known = {f.name: f.dataType for f in df.schema.fields}
            fixes = {c: F.round(F.col(c).cast("double"), d) + F.lit(0.0) for c, d in places.items() if c in known}
            return df.withColumns(fixes) if fixes else df

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            swaps = ", ".join(f"round(CAST({c} AS DOUBLE), {d}) + 0.0 AS {c}" for c, d in places.items())
            ORACLES[name] = f"SELECT * REPLACE ({swaps}) FROM ({sql}) AS result" if swaps else sql
        return run

    return register


def floats(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
