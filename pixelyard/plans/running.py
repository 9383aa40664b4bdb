"""Running sums over an order, without pulling a group, a busy slot or all slots into one task.

A group is cut into slots of the ordering value. Slot totals are aggregated first (partial
aggregation) and summed up in two levels: blocks of ``SPAN`` slots, then the slots of each block. A
slot that holds more than ``rows`` rows is cut again by its own density: between its own first and
last ordering value, or, where all of it falls on one, between its own smallest and largest tie. Only
the rows of such a part are sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Slots of one block in the upper level of the prefix sums.
SPAN = 4096
#: Rows that a slot may hold before it is cut by its own density.
ROWS = 50_000


def slot_totals(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], amount: Column, width: int, total: str | None = None) -> DataFrame:
    """One row per slot: ``__slot`` (keys and number), rows, first and last ordering value and tie,
    and ``__before``, the sum of all earlier slots of the group; optionally the group's ``total``."""
    tie = _numeric_tie(df, ties)
    edges = [F.min(tie).alias("__tie_low"), F.max(tie).alias("__tie_high")]
    sums = keyed(df, keys, order, width).groupBy("__slot").agg(
        F.sum(amount).alias("__sum"), F.count(F.lit(1)).alias("__rows"), F.min(order).alias("__low"), F.max(order).alias("__high"), *edges
    )
    group = [F.col("__slot")[k] for k in keys]
    block = F.floor(F.col("__slot")["__n"] / SPAN).cast("bigint")
    sums = sums.withColumn("__block", F.struct(*[g.alias(f"k{i}") for i, g in enumerate(group)], block.alias("__b")))
    blocks = sums.groupBy("__block").agg(F.sum("__sum").alias("__in_block"))
    whole = W.partitionBy(*[F.col("__block")[f"k{i}"] for i in range(len(keys))])
    earlier = whole.orderBy(F.col("__block")["__b"]).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        "__block", F.coalesce(F.sum("__in_block").over(earlier), F.lit(0)).alias("__blocks_before"),
        *([F.sum("__in_block").over(whole).alias(total)] if total else []),
    )
    inside = W.partitionBy("__block").orderBy(F.col("__slot")["__n"]).rowsBetween(W.unboundedPreceding, -1)
    joined = sums.join(blocks, "__block")
    return joined.withColumn("__before", F.col("__blocks_before") + F.coalesce(F.sum("__sum").over(inside), F.lit(0))).drop("__block", "__blocks_before", "__sum")


def keyed(df: DataFrame, keys: Sequence[str], order: str, width: int) -> DataFrame:
    """``df`` with ``__slot``: one struct, in which NULL keys compare equal and which an ordinary equi-join can use."""
    return df.withColumn("__slot", F.struct(*keys, F.floor(F.col(order) / F.lit(width)).cast("bigint").alias("__n")))


def _numeric_tie(df: DataFrame, ties: Sequence[str]) -> Column:
    numeric = ties and isinstance(df.schema[ties[0]].dataType, T.IntegralType)
    return F.col(ties[0]).cast("bigint") if numeric else F.lit(None).cast("bigint")


def _part(order: str, tie: Column, rows: int) -> Column:
    """The number of a row's part of its slot, in the order of (order, tie)."""
    parts = F.ceil(F.col("__rows") / F.lit(rows)).cast("double")

    def place(value: Column, low: Column, high: Column) -> Column:
        return F.floor((value - low) / (high - low + 1) * parts).cast("bigint")

    by_order = place(F.col(order), F.col("__low"), F.col("__high"))
    by_tie = place(tie, F.col("__tie_low"), F.col("__tie_high"))
    return F.when(F.col("__rows") <= rows, F.lit(0)).when(F.col("__high") > F.col("__low"), by_order).otherwise(F.coalesce(by_tie, F.lit(0)))


def with_running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    ties: Sequence[str],
    amount: Column,
    width: int,
    out: str = "running",
    total: str | None = None,
    rows: int = ROWS,
) -> DataFrame:
    """``df`` plus the inclusive running sum of ``amount`` within ``keys`` by (order, ties), and
    optionally the group's ``total``. ``width`` is the slot width of the integer column ``order``.

    A task sorts about ``rows`` rows of a group together as long as the values of a crowded slot
    spread over it; a slot that holds a single ordering value is cut by the first tie, if that is a
    whole number. One value that holds most of a wider slot stays one part: choose a narrower ``width``.
    """
    tie = _numeric_tie(df, ties)
    slots = slot_totals(df, keys, order, ties, amount, width, total)
    data = keyed(df, keys, order, width)
    crowded = data.join(slots.where(F.col("__rows") > rows), "__slot").withColumn("__part", _part(order, tie, rows))
    parts = crowded.groupBy("__slot", "__part").agg(F.sum(amount).alias("__sum"))
    earlier = W.partitionBy("__slot").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("__slot", "__part", F.sum("__sum").over(earlier).alias("__parts_before"))
    joined = data.join(slots, "__slot").withColumn("__part", _part(order, tie, rows)).join(parts, ["__slot", "__part"], "left")
    inside = W.partitionBy("__slot", "__part").orderBy(order, *ties).rowsBetween(W.unboundedPreceding, W.currentRow)
    running = F.col("__before") + F.coalesce("__parts_before", F.lit(0)) + F.sum(amount).over(inside)
    return joined.withColumn(out, running).drop("__slot", "__part", "__before", "__parts_before", "__rows", "__low", "__high", "__tie_low", "__tie_high")
