"""Mixing sources to target weights by Pfair scheduling of their blocks."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelyard.llm.common import without

#: Slots of a period of ``quantized``.
PERIOD = 1000
OUTPUT = ("mix_block", "mix_phase", "mix_slot", "mix_release", "mix_deadline", "mix_place")


def exact(weights: Mapping[str | None, float]) -> dict[str | None, int]:
    """Whole numbers in exactly the proportion of ``weights``."""
    if any(not 0 < w < float("inf") for w in weights.values()):
        raise ValueError("target weights must be positive")
    parts = {n: Fraction(w) for n, w in weights.items()}
    unit = lcm(*(p.denominator for p in parts.values()))
    return {n: int(p * unit) for n, p in parts.items()}


def quantized(weights: Mapping[str | None, float], period: int = PERIOD) -> dict[str | None, int]:
    """Whole parts of ``period`` in proportion to ``weights`` (largest remainders), at least one each."""
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources need a period of as many slots; it is {period}")
    if any(not w > 0 for w in weights.values()):
        raise ValueError("target weights must be positive")
    names, total = sorted(weights, key=lambda n: (n is not None, n)), float(sum(weights.values()))
    exact = np.array([weights[n] / total for n in names]) * (period - len(names))
    parts = np.floor(exact).astype(int)
    for i in np.argsort(-(exact - parts), kind="stable")[: period - len(names) - parts.sum()]:
        parts[i] += 1
    return {n: int(p) + 1 for n, p in zip(names, parts, strict=True)}


def turns(parts: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(slot, source, block, release, deadline) of slot after slot, without end.

    Block ``j`` of a source with weight ``w = parts / sum(parts)`` is released at ``floor(j / w)`` and due
    at ``ceil((j + 1) / w)``; in each slot the released block with the earliest deadline goes. With
    weights that add up to one, every block meets its window, so no source is ever a block ahead or
    behind.
    """
    period = sum(parts)
    due = [(-(-period // p), s, 0, 0) for s, p in enumerate(parts)]
    waiting: list[tuple[int, int, int]] = []
    heapq.heapify(due)
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            release, s, j = heapq.heappop(waiting)
            heapq.heappush(due, (-(-(j + 1) * period // parts[s]), s, j, release))
        deadline, s, j, release = heapq.heappop(due)
        if t >= deadline:
            raise AssertionError("a block misses its deadline")
        yield t, s, j, release, deadline
        heapq.heappush(waiting, ((j + 1) * period // parts[s], s, j + 1))
        t += 1


def edf(parts: list[int]) -> list[np.ndarray]:
    """Slots of one period that each source gets; the parts add up to the period."""
    slots: list[list[int]] = [[] for _ in parts]
    for t, s, *_ in islice(turns(parts), sum(parts)):
        slots[s].append(t)
    return [np.array(x, np.int64) for x in slots]


def schedule(blocks: Mapping[str | None, int], weights: Mapping[str | None, float], period: int | None = None, until: str = "all") -> Iterator[tuple]:
    """(source, block, phase, slot, release, deadline) of every block, in the order of slots.

    In each phase the sources that still have blocks follow ``turns``; it ends before the first slot of
    a source that has run out, whose weight then goes to the others in proportion. The weights are taken
    exactly, or as parts of a ``period`` if there is one.
    """
    left, used, begin, phase = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0, 0
    whole = None if period else exact({s: weights[s] for s in left})
    while left and (until == "all" or phase == 0):
        parts = quantized({s: weights[s] for s in left}, period) if period else {s: whole[s] for s in left}
        names, taken, length = list(parts), [0] * len(parts), 0
        for t, s, j, release, deadline in turns(list(parts.values())):
            name = names[s]
            if j == left[name]:
                break
            # A slow source's window can end far beyond the last block of all.
            yield name, used[name] + j, phase, begin + t, begin + release, min(begin + deadline, 2**63 - 1)
            taken[s] = j + 1
            length = t + 1
        for s, name in enumerate(names):
            used[name] += taken[s]
            left[name] -= taken[s]
            if not left[name]:
                del left[name]
        begin, phase = begin + length, phase + 1


def _rows(number: Mapping[str | None, int], *args):
    """Batches of ``schedule``, with sources as numbers; what is held does not grow with the blocks."""
    names = ["__s", "mix_block", "mix_phase", "mix_slot", "mix_release", "mix_deadline"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((number[s], *rest) for s, *rest in schedule(*args))
        while some := list(islice(rows, 16_384)):
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*some), kinds, strict=True)], names=names)

    return run


def _order(id_col: str, columns: list[str], df: DataFrame) -> tuple[Column, list[Column]]:
    """A pseudo-random key of the row's id, and what settles ties."""
    comparable = [F.col(c) for c in columns if not df.schema[c].dataType.simpleString().startswith(("map", "variant"))]
    return F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), [F.col(id_col).asc_nulls_first(), F.xxhash64(*comparable)]


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, exponent: float = 0.9, block: int = 8, id_col: str = "doc_id", source_col: str = "source", period: int | None = None, until: str = "all", bucket_rows: int = 2_000) -> DataFrame:
    """``docs`` with their place in the mix.

    A source's documents, in a pseudo-random but fixed order, form blocks of ``block``; the last one
    may be shorter. ``weights`` maps sources to target weights; by default a source of ``n`` documents
    weighs ``n ** exponent``, which favours small sources. Added columns: ``mix_block`` (of the source),
    ``mix_phase``, ``mix_slot`` (of the whole mix), ``mix_release`` and ``mix_deadline`` (the slots between
    which the block belongs) and ``mix_place`` (in its block).

    As long as all sources last (phase 0) each is within one block of its share of every prefix, by the
    target weights themselves; once a slot falls to a source that has run out, the others share its weight
    in a further phase. ``until="all"`` places every row, ``until="first"`` returns phase 0 only. With a
    ``period``, weights are rounded to so many parts first, at least one for each source (``quantized``).

    A null source is a source of its own; a source without a weight is an error. Repeated rows take
    places of their own. An empty input gives no rows. Columns named ``mix_*`` above are replaced.

    Only counts by source reach the driver. One task makes the schedule, a row for each block, and holds a
    few numbers for each source; its time grows with the blocks and with phases times sources.
    Positions in a source come from counts of hash buckets of about ``bucket_rows`` rows, so a source with
    a third of all rows is spread over many tasks; the slots of a bucket's blocks are joined to it.
    """
    docs = without(docs, *OUTPUT)
    spark = docs.sparkSession
    counts = {r[0]: r[1] for r in docs.groupBy(F.col(source_col).cast("string")).count().collect()}
    if weights is None:
        weights = {s: n**exponent for s, n in counts.items()}
    if missing := [s for s in counts if s not in weights]:
        raise ValueError(f"no target weight for {missing[:5]}")
    number = {s: i for i, s in enumerate(sorted(counts, key=lambda s: (s is not None, s)))}
    blocks, weights = {s: -(-counts[s] // block) for s in number}, {s: weights[s] for s in number}
    if counts:
        quantized(weights, period) if period else exact(weights)  # what is wrong with them shows here
    fields = "__s int, mix_block long, mix_phase int, mix_slot long, mix_release long, mix_deadline long"
    slots = spark.range(0, 1, 1, 1).mapInArrow(_rows(number, blocks, weights, period, until), fields)
    buckets = spark.createDataFrame([(s, number[s], max(1, min(65_536, -(-n // bucket_rows)))) for s, n in counts.items()], "__source string, __s int, __buckets int")

    key, ties = _order(id_col, docs.columns, docs)
    rows = docs.withColumns({"__source": F.col(source_col).cast("string"), "__key": key})
    # A row for each source, as on the driver.
    rows = rows.join(F.broadcast(buckets), rows["__source"].eqNullSafe(buckets["__source"])).drop("__source")
    rows = rows.withColumn("__bucket", F.floor(F.conv(F.substring("__key", 1, 4), 16, 10).cast("long") * F.col("__buckets") / 65_536).cast("int"))
    sizes = rows.groupBy("__s", "__bucket").count()
    before = sizes.withColumn("__before", F.expr("sum(count) OVER (PARTITION BY __s ORDER BY __bucket)") - F.col("count"))
    held = before.select("__s", "__bucket", "__before", F.explode(F.expr(f"sequence(__before div {block}, (__before + count - 1) div {block})")).alias("mix_block"))
    # A row for each block: Spark takes what comes from a one-row range for tiny, so the join is told not to broadcast it.
    held = held.join(slots.hint("merge"), ["__s", "mix_block"], "left" if until == "all" else "inner")
    held = held.groupBy("__s", "__bucket").agg(F.first("__before").alias("__before"), F.collect_list(F.struct("mix_block", "mix_phase", "mix_slot", "mix_release", "mix_deadline")).alias("__slots"))
    held = held.select("__s", "__bucket", "__before", F.array_sort("__slots").alias("__slots"))
    # Dealt and sorted by bucket for the window, the rows stay where they are for the join.
    ranked = rows.withColumn("__in", F.row_number().over(Window.partitionBy("__s", "__bucket").orderBy("__key", *ties)) - 1)
    ranked = ranked.join(held, ["__s", "__bucket"])
    rank = F.col("__before") + F.col("__in")
    nth = F.floor(rank / block) - F.floor(F.col("__before") / block)
    placed = ranked.withColumns({"__at": F.get("__slots", nth.cast("int")), "mix_place": F.pmod(rank, F.lit(block)).cast("int")})
    placed = placed.where("__at IS NOT NULL")
    return placed.select(*docs.columns, *[F.col(f"__at.{n}").alias(n) for n in OUTPUT[:-1]], "mix_place")
