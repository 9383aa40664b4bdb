"""Exact grouped percentiles with linear interpolation: one lazy plan for every size and any skew.

Groups are told apart by the rows of their slot, one of ``SLOTS`` hashes of the keys. Where a slot holds
at most ``CROWDED`` rows, so does each of its groups: all values of such a group come together in one
shuffle by the keys, as a list for each measure that is sorted in its row. All groups of a crowded slot,
and of keys that are said to have ``few`` values, are dealt as values: equal ones are counted first
(partial aggregation), and everything else is derived from those counts. Values fall into narrow buckets
that keep their order, counts of buckets give the one that holds a wanted rank, and only that bucket's
values are sorted. Deviations from a median come from the same counts. So no task sees the rows of a large
group: they are dealt by group and value, or by group and bucket, and what is dealt by group alone are the
counts of its buckets, whose number does not grow with its rows. Nothing runs before an action.

The input is read once, and dealt to the tasks at random before its slots are counted. Where it is cheap to
read again (``reread``: a table), it is read for the counts and for each kind of group instead, without that shuffle.

Two readers of one result share its shuffle only if both ask for the same rows and columns. ``whole``
puts all columns through a generator, which the optimizer prunes and filters nothing through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelyard.plans.scale import join_on, pinned, whole

#: Buckets to a factor of e, for values above 1 / SMALL; below it they are as wide as there.
FINE, SMALL = 2048, 1e6
#: Hashes of keys whose rows are counted, and the rows beyond which one is crowded.
SLOTS, CROWDED = 1 << 18, 20_000

#: (output name, value column, percentile in 0..100)
Spec = tuple[str, str, float]


def percentile(column: Column | str, p: float) -> Column:
    """Aggregate expression: linear-interpolation percentile; p in [0, 100]."""
    if not 0 <= p <= 100:
        raise ValueError(f"percentile {p} is outside [0, 100]")
    return F.percentile(F.col(column) if isinstance(column, str) else column, p / 100.0)


def _by_column(specs: Sequence[Spec]) -> dict[str, list[tuple[str, float]]]:
    grouped: dict[str, list[tuple[str, float]]] = {}
    for name, column, p in specs:
        if not 0 <= p <= 100:
            raise ValueError(f"percentile {p} is outside [0, 100]")
        grouped.setdefault(column, []).append((name, p))
    return grouped


def aggregate(
    df: DataFrame, keys: Sequence[str], specs: Sequence[Spec], aggs: Sequence[Column] = (), deviations: Sequence[tuple[str, str]] = (),
    approx: int | None = None, few: bool = False, reread: bool = False,
) -> DataFrame:
    """``groupBy(keys)`` with ordinary aggregates plus exact percentiles.

    With ``approx`` (a sketch size of 8 to 65535) percentiles come from mergeable sketches instead:
    one pass, one small row per group and task, and values whose rank is off by at most
    ``rank_error(approx)`` of the group with 99 % confidence. They are values of the input, not interpolated.

    ``deviations`` are (output name, value column): the median of absolute deviations from the
    group's median. NULLs are ignored, an all-NULL group yields NULL; NaN-free double measures are
    expected. The whole result is one branch of a plan however many columns and readers it has.

    ``few`` and ``reread`` change the cost, not the result. ``few`` says that the keys have few values whatever the
    size (formats, presets), so that a row per group fits a broadcast; ``reread`` that ``df`` is cheap to
    read again. Without either, all columns of ``df`` are shuffled: select those that are needed.
    """
    keys, by_column = list(keys), _by_column(specs)
    if approx is not None:
        return _sketched(df, keys, specs, aggs, deviations, approx)
    names = [name for name, _, _ in specs] + [out for out, _ in deviations]
    for out, column in deviations:
        by_column.setdefault(column, []).append((f"__median_{out}", 50))
    if few or not keys:
        return whole(_by_buckets(df, keys, by_column, names, aggs, deviations, few=True, apart=reread))
    dealt = df.withColumn("__slot", F.pmod(F.xxhash64(*keys), F.lit(SLOTS)))
    if not reread:
        dealt = whole(dealt.repartition(F.monotonically_increasing_id()))
    crowded = dealt.groupBy("__slot").agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > CROWDED)
    # At most SLOTS numbers, whatever the input.
    crowded = F.broadcast(crowded.select(F.col("__slot").alias("__crowded")))
    dealt = dealt.join(crowded, F.col("__slot") == F.col("__crowded"), "left")
    small, large = dealt.where(F.col("__crowded").isNull()), dealt.where(F.col("__crowded").isNotNull())
    lists = _by_lists(small.drop("__slot", "__crowded"), keys, by_column, names, aggs, deviations)
    return whole(lists.unionByName(_by_buckets(large.drop("__slot", "__crowded"), keys, by_column, names, aggs, deviations, few=False, apart=True)))


def _at(values: str, p: float) -> Column:
    """The percentile of a sorted array; NULL of an empty one."""
    rank = F.lit(p / 100.0) * (F.size(values) - 1)
    low, weight = F.floor(rank).cast("int"), rank - F.floor(rank)
    upper = F.when(weight > 0, F.get(values, F.ceil(rank).cast("int")) * weight).otherwise(0.0)
    return F.get(values, low) * (1 - weight) + upper


def _by_lists(df: DataFrame, keys: list[str], by_column: dict, names: list[str], aggs: Sequence[Column], deviations: Sequence[tuple[str, str]]) -> DataFrame:
    """Groups of a bounded number of rows: each measure's values as one sorted array."""
    held = {c: f"__list_{i}" for i, c in enumerate(by_column)}
    lists = [F.collect_list(F.col(c).cast("double")).alias(h) for c, h in held.items()]
    # Dealt as rows: lists of one or two values, made before the shuffle, would only take more space.
    grouped = df.repartition(*keys).groupBy(*keys).agg(*aggs, *lists)
    plain = [c for c in grouped.columns if c not in keys and c not in held.values()]
    out = pinned(grouped, **{f"{h}_s": F.sort_array(h) for h in held.values()}) if held else grouped
    found = {name: _at(f"{held[c]}_s", p) for c, wanted in by_column.items() for name, p in wanted}
    out = out.select(*keys, *plain, *[f"{h}_s" for h in held.values()], *[v.alias(name) for name, v in found.items()])
    if deviations:
        apart = {f"__apart_{i}": _apart(f"{held[c]}_s", f"__median_{out_name}") for i, (out_name, c) in enumerate(deviations)}
        out = pinned(pinned(out, **{f"{a}_m": F.col(f"__median_{d[0]}") for a, d in zip(apart, deviations, strict=True)}), **apart)
        out = out.withColumns({d[0]: _at(a, 50) for a, d in zip(apart, deviations, strict=True)})
    return out.select(*keys, *plain, *names)


def _apart(values: str, centre: str) -> Column:
    return F.sort_array(F.transform(values, lambda v: F.abs(v - F.col(centre))))


def _by_buckets(
    df: DataFrame, keys: list[str], by_column: dict, names: list[str], aggs: Sequence[Column], deviations: Sequence[tuple[str, str]], few: bool, apart: bool,
) -> DataFrame:
    """Groups of any size. Plain aggregates take a reading of their own (``apart``) or go along with the values."""
    measures = list(by_column)
    entries = [F.struct(F.lit(i + 1).alias("__measure"), F.col(c).cast("double").alias("__value")) for i, c in enumerate(measures)]
    rest = [] if apart else [c for c in df.columns if c not in keys]
    if not apart:
        # Number 0 carries the plain aggregates of a group, the others one value of a measure each.
        entries = [F.struct(F.lit(0).alias("__measure"), F.lit(None).cast("double").alias("__value")), *entries]
    rows = df.select(*keys, *rest, F.inline(F.array(*entries)))
    rows = rows.where((F.col("__measure") == 0) | F.col("__value").isNotNull())
    rows = rows.select(*keys, "__measure", "__value", *[F.when(F.col("__measure") == 0, F.col(c)).alias(c) for c in rest])
    group = F.struct(*[F.col(k) for k in keys], F.col("__measure")).alias("__group")
    counted = whole(rows.groupBy(group, "__value").agg(F.count(F.lit(1)).alias("__n"), *([] if apart else aggs)))

    # Filters on a sum that the generator hides stay where they are written.
    values = counted.select("__group", "__value", "__n").where(F.col("__group.__measure") > 0)
    found = _ranked(values, {i + 1: by_column[c] for i, c in enumerate(measures)}, few)
    if apart:
        # Without aggregates the count keeps groups whose values are all NULL.
        base = df.groupBy(*keys).agg(*aggs) if aggs else df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).drop("__rows")
    else:
        plain = [c for c in counted.columns if c not in ("__group", "__value", "__n")]
        base = counted.where(F.col("__group.__measure") == 0).select(*[F.col(f"__group.{k}").alias(k) for k in keys], *plain)
    plain = [c for c in base.columns if c not in keys]
    parts = [base, _by_name(found, keys)]
    if deviations:
        found = whole(found)
        parts[1] = _by_name(found, keys)
        medians = {c: f"__median_{out}" for out, c in deviations}
        by_number = {measures.index(c) + 1: [(out, 50.0)] for out, c in deviations}
        centre = found.where(F.col("__name").isin(*medians.values())).groupBy("__group").agg(F.sum("__part").alias("__median"))
        gaps = values.join(F.broadcast(centre) if few else centre, "__group").select("__group", F.abs(F.col("__value") - F.col("__median")).alias("__value"), "__n")
        parts.append(_by_name(_ranked(gaps, by_number, few), keys))
    united = parts[0].withColumns({"__name": F.lit(None).cast("string"), "__part": F.lit(None).cast("double")})
    for part in parts[1:]:
        united = united.unionByName(part, allowMissingColumns=True)
    # A group has one row of plain aggregates, and a percentile at most two parts.
    merged = united.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in plain], *[F.sum(F.when(F.col("__name") == name, F.col("__part"))).alias(name) for name in names])
    if not keys and aggs:
        # Over no rows a global aggregate still has its row, with counts of zero.
        empty = df.agg(*aggs)
        merged = merged.crossJoin(F.broadcast(empty.select(*[F.col(c).alias(f"__empty_{c}") for c in plain])))
        merged = merged.select(*[F.coalesce(F.col(c), F.col(f"__empty_{c}")).alias(c) for c in plain], *names)
    return merged.select(*keys, *plain, *names)


def rank_error(size: int) -> float:
    """Share of a group by which the rank of a sketch's percentile can be off (99 % confidence)."""
    return 2.296 / size**0.9021


def sketch(column: Column | str, size: int) -> Column:
    """Aggregate: a mergeable sketch of a column's values (NULLs ignored; NULL without any)."""
    value = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.when(F.count(value) > 0, F.kll_sketch_agg_double(value, size))


def from_sketch(column: Column | str, p: float) -> Column:
    return F.kll_sketch_get_quantile_double(column, F.lit(p / 100.0))


def _sketched(df: DataFrame, keys: list[str], specs: Sequence[Spec], aggs: Sequence[Column], deviations: Sequence[tuple[str, str]], size: int) -> DataFrame:
    columns = list(dict.fromkeys([c for _, c, _ in specs] + [c for _, c in deviations]))
    held = {c: f"__sketch_{i}" for i, c in enumerate(columns)}
    base = df.groupBy(*keys).agg(*aggs, *[sketch(c, size).alias(h) for c, h in held.items()])
    plain = [c for c in base.columns if c not in keys and c not in held.values()]
    out = base.select(*keys, *plain, *[from_sketch(held[c], p).alias(name) for name, c, p in specs], *[from_sketch(held[c], 50).alias(f"__median_{name}") for name, c in deviations])
    if deviations:
        centre = out.select(*keys, *[f"__median_{name}" for name, _ in deviations])
        apart = join_on(df.select(*keys, *{c for _, c in deviations}), centre, keys)
        apart = apart.select(*keys, *[F.abs(F.col(c).cast("double") - F.col(f"__median_{name}")).alias(name) for name, c in deviations])
        spread = apart.groupBy(*keys).agg(*[sketch(name, size).alias(name) for name, _ in deviations]).select(*keys, *[from_sketch(name, 50).alias(name) for name, _ in deviations])
        out = join_on(out.drop(*[f"__median_{name}" for name, _ in deviations]), spread, keys, "left")
    return out


def _by_name(found: DataFrame, keys: list[str]) -> DataFrame:
    return found.select(*[F.col(f"__group.{k}").alias(k) for k in keys], "__name", "__part")


def _wanted(by_number: dict[int, list[tuple[str, float]]], total: Column) -> Column:
    """The one or two ranks that each percentile of a measure interpolates between, with their shares."""
    case = None
    for number, names in by_number.items():
        ranks = []
        for name, p in names:
            rank = F.lit(p / 100.0) * (total - 1)
            low, weight = F.floor(rank), rank - F.floor(rank)
            ranks += [F.struct(F.lit(name).alias("__name"), low.alias("__rank"), (1 - weight).alias("__share")), F.struct(F.lit(name).alias("__name"), F.ceil(rank).alias("__rank"), weight.alias("__share"))]
        array = F.filter(F.array(*ranks), lambda r: r["__share"] > 0)
        here = F.col("__group.__measure") == number
        case = F.when(here, array) if case is None else case.when(here, array)
    return case


def _holding(buckets: DataFrame, within: list[str], bucket: str) -> DataFrame:
    """Buckets that hold wanted ranks, with those ranks counted from the bucket's start."""
    so_far = F.sum("__n").over(W.partitionBy(*within).orderBy(bucket).rowsBetween(W.unboundedPreceding, W.currentRow))
    start = F.col("__upto") - F.col("__n")
    here = F.filter("__ranks", lambda r: (r["__rank"] >= start) & (r["__rank"] < F.col("__upto")))
    moved = F.transform(here, lambda r: F.struct(r["__name"].alias("__name"), (r["__rank"] - start).alias("__rank"), r["__share"].alias("__share")))
    return buckets.withColumn("__upto", so_far).withColumn("__ranks", moved).where(F.size("__ranks") > 0)


def _ranked(values: DataFrame, by_number: dict[int, list[tuple[str, float]]], few: bool) -> DataFrame:
    """(group, name, part) of the wanted percentiles of counted values: parts of a name add up to it."""
    # Logarithms keep the order of values on both sides of zero.
    bucket = F.floor(F.signum("__value") * F.log1p(F.abs("__value") * SMALL) * FINE).cast("bigint")
    values = values.withColumn("__bucket", F.coalesce(bucket, F.lit(0)))
    buckets = values.groupBy("__group", "__bucket").agg(F.sum("__n").alias("__n"))
    total = F.sum("__n").over(W.partitionBy("__group"))
    buckets = buckets.withColumn("__total", total).withColumn("__ranks", _wanted(by_number, F.col("__total")))
    buckets = _holding(buckets, ["__group"], "__bucket").select("__group", "__bucket", "__ranks")
    inside = values.join(F.broadcast(buckets) if few else buckets, ["__group", "__bucket"])
    found = _holding(inside, ["__group", "__bucket"], "__value").select("__group", "__value", F.inline("__ranks"))
    return found.select("__group", "__name", (F.col("__value") * F.col("__share")).alias("__part"))


def median_abs_deviation(df: DataFrame, keys: Sequence[str], column: str, out: str = "mad") -> DataFrame:
    """Median of absolute deviations from each group's median; one row per group."""
    return aggregate(df.select(*keys, column), keys, [], deviations=[(out, column)])
