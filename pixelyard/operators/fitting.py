"""Fitting and evaluating linear savings models.

Every pass over the data is a distributed aggregate; only moments of the design matrix (at most a
few hundred numbers, whatever the row count) reach the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelyard import constants as K
from pixelyard.plans import quantiles
from pixelyard.plans.scale import join_on

#: knot coefficient name -> (feature, position)
Knots = Mapping[str, tuple[str, float]]


@dataclass(frozen=True)
class LinearModel:
    features: list[str]
    mean: list[float]
    scale: list[float]
    intercept: float
    betas: list[float]
    knots: dict[str, tuple[str, float]] = field(default_factory=dict)
    knot_betas: dict[str, float] = field(default_factory=dict)
    envelope: dict[str, list[float]] = field(default_factory=dict)

    @classmethod
    def from_artifact(cls, artifact: Mapping) -> LinearModel:
        coefficients = artifact["coefficients"]
        knots = {name: tuple(at) for name, at in artifact.get("knots", {}).items()}
        return cls(
            list(artifact["features"]),
            list(artifact["scaler"]["mean"]),
            list(artifact["scaler"]["scale"]),
            float(coefficients["intercept"]),
            [float(b) for b in coefficients["betas"]],
            knots,
            {name: float(coefficients[name]) for name in knots},
            dict(artifact.get("training_envelope", {})),
        )

    def predict(self, columns: Mapping[str, Column] | None = None) -> Column:
        """Prediction as one arithmetic expression; constants are folded into the plan."""
        columns = columns or {name: F.col(name) for name in self.features}
        terms = [
            F.lit(beta) * ((columns[name].cast("double") - mean) / scale)
            for name, mean, scale, beta in zip(self.features, self.mean, self.scale, self.betas)
        ]
        terms += [
            F.lit(self.knot_betas[knot]) * F.greatest(columns[name].cast("double") - at, F.lit(0.0))
            for knot, (name, at) in self.knots.items()
        ]
        return reduce(lambda a, b: a + b, terms, F.lit(self.intercept))


def training_rows(
    features: DataFrame, outcomes: DataFrame, keys: Sequence[str], names: Sequence[str],
    pixels="pixels", size="optimized_size",
) -> DataFrame:
    """Feature rows joined to the bits per pixel each preset actually achieved; rows with a NULL
    feature or no pixels are left out."""
    joined = join_on(features, outcomes, list(keys))
    complete = F.col(pixels) > 0
    for name in names:
        complete = complete & F.col(name).isNotNull()
    return joined.where(complete).withColumn(
        "actual_bpp", F.col(size).cast("double") * 8.0 / F.col(pixels).cast("double")
    )


def require_rows(df: DataFrame, n_min: int = K.MIN_TRAINING_ROWS) -> DataFrame:
    """Raises when fewer than ``n_min`` rows exist; reads no more rows than needed."""
    if df.limit(n_min).count() < n_min:
        raise ValueError(f"training needs at least {n_min} rows")
    return df


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per feature: mean and population standard deviation (1 for constants), envelope."""
    row = df.agg(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.avg(F.col(c).cast("double")).alias("mean"),
                F.stddev_pop(F.col(c).cast("double")).alias("std"),
                F.min(F.col(c).cast("double")).alias("low"),
                F.max(F.col(c).cast("double")).alias("high"),
            ).alias(f"f{i}")
            for i, c in enumerate(columns)
        ]
    )
    stacked = row.select(F.inline(F.array(*[F.col(f"f{i}") for i in range(len(columns))])))
    return stacked.select(
        "feature", "mean", F.when(F.col("std") > 1e-9, F.col("std")).otherwise(1.0).alias("scale"), "low", "high"
    )


def training_envelope(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return fit_scaler(df, columns).select("feature", "low", "high")


def outside_envelope(envelope: Mapping[str, Sequence[float]]) -> Column:
    """How many features of a row lie outside the range seen in training."""
    flags = [
        F.coalesce((~F.col(name).between(low, high)).cast("int"), F.lit(0)) for name, (low, high) in envelope.items()
    ]
    return reduce(lambda a, b: a + b, flags, F.lit(0))


def add_knots(df: DataFrame, knots: Knots) -> DataFrame:
    return df.select(
        "*",
        *[
            F.when(F.col(name).isNotNull(), F.greatest(F.col(name).cast("double") - at, F.lit(0.0))).alias(knot)
            for knot, (name, at) in knots.items()
        ],
    )


def gram(df: DataFrame, columns: Sequence[Column], target: Column) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y with a leading intercept, as one distributed sum of products."""
    design = [F.lit(1.0), *columns]
    width = len(design)
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    named = df.select(*[c.alias(f"x{i}") for i, c in enumerate(design)], target.cast("double").alias("y"))
    row = named.agg(
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in pairs],
        *[F.sum(F.col(f"x{i}") * F.col("y")).alias(f"t{i}") for i in range(width)],
    ).first()
    xx = np.zeros((width, width))
    for i, j in pairs:
        xx[i, j] = xx[j, i] = row[f"s{i}_{j}"] or 0.0
    return xx, np.array([row[f"t{i}"] or 0.0 for i in range(width)])


def fit_ols(
    df: DataFrame, features: Sequence[str], target: str, knots: Knots | None = None, tolerance: float = 1e-12
) -> LinearModel:
    """Least squares on standardized features and raw knots; minimum-norm when rank deficient.

    Two passes: scaler, then the Gram matrix. Standardizing first keeps it well conditioned.
    """
    features, knots = list(features), dict(knots or {})
    stats = {r["feature"]: r for r in fit_scaler(df, features).collect()}  # one row per feature
    scaled = [(F.col(f).cast("double") - stats[f]["mean"]) / stats[f]["scale"] for f in features]
    bends = [F.greatest(F.col(f).cast("double") - at, F.lit(0.0)) for f, at in knots.values()]
    xx, xy = gram(df, [*scaled, *bends], F.col(target))
    solution = np.linalg.pinv(xx, rcond=tolerance, hermitian=True) @ xy
    p = len(features)
    return LinearModel(
        features,
        [stats[f]["mean"] for f in features],
        [stats[f]["scale"] for f in features],
        float(solution[0]),
        [float(b) for b in solution[1 : p + 1]],
        {k: tuple(v) for k, v in knots.items()},
        {k: float(b) for k, b in zip(knots, solution[p + 1 :])},
        {f: [stats[f]["low"], stats[f]["high"]] for f in features},
    )


def residuals(df: DataFrame, model: LinearModel, target: str, digits: int | None = 6) -> DataFrame:
    """Median, 95th percentile and maximum of the relative error."""
    y = F.col(target).cast("double")
    scored = df.select(F.abs((model.predict() - y) / F.greatest(y, F.lit(1e-9))).alias("rel_err"))
    out = quantiles.aggregate(
        scored, [], [("median_rel_err", "rel_err", 50), ("p95_rel_err", "rel_err", 95)],
        [F.max("rel_err").alias("max_rel_err")],
    )
    names = ("median_rel_err", "p95_rel_err", "max_rel_err")
    return out.select(*[(F.col(c) if digits is None else F.bround(c, digits)).alias(c) for c in names])


def pii_scan(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str], pattern: str = K.PII_PATTERN, context: int = 20
) -> DataFrame:
    """One row per (key, column) that matches, with the first match and its surroundings."""
    around = f"(?s)(.{{0,{context}}}?(?:{pattern}).{{0,{context}}})"
    fields = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("__text")) for c in columns])
    return (
        df.select(*keys, F.inline(fields))
        .where(F.regexp_like("__text", F.lit(pattern)))
        .select(
            *keys,
            "column",
            F.regexp_count("__text", F.lit(pattern)).alias("n_matches"),
            F.regexp_extract("__text", f"({pattern})", 1).alias("matched"),
            F.regexp_extract("__text", around, 1).alias("context"),
        )
    )
