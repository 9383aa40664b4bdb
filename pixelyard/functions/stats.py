"""Statistics as Column expressions over per-group (n, mean, variance) values."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sample_std(column: str | Column) -> Column:
    """Aggregate: sample standard deviation, 0 below two values."""
    return F.when(F.count(_c(column)) < 2, F.lit(0.0)).otherwise(F.stddev_samp(_c(column)))


def cohens_d(n_a, mean_a, std_a, n_b, mean_b, std_b) -> Column:
    """Effect size with pooled sample variance; sign follows a - b."""
    n_a, mean_a, std_a, n_b, mean_b, std_b = map(_c, (n_a, mean_a, std_a, n_b, mean_b, std_b))
    freedom = n_a + n_b - 2
    pooled = F.try_divide((n_a - 1) * std_a * std_a + (n_b - 1) * std_b * std_b, freedom)
    usable = (n_a >= 2) & (n_b >= 2) & (pooled > 0)
    return F.when(usable, F.try_divide(mean_a - mean_b, F.sqrt(pooled))).otherwise(F.lit(0.0))


def welch_t(n_a, mean_a, std_a, n_b, mean_b, std_b) -> Column:
    n_a, mean_a, std_a, n_b, mean_b, std_b = map(_c, (n_a, mean_a, std_a, n_b, mean_b, std_b))
    error = F.try_divide(std_a * std_a, n_a) + F.try_divide(std_b * std_b, n_b)
    usable = (n_a >= 2) & (n_b >= 2) & (error > 0)
    return F.when(usable, F.try_divide(mean_a - mean_b, F.sqrt(error))).otherwise(F.lit(0.0))


def welch_df(n_a, std_a, n_b, std_b) -> Column:
    """Satterthwaite degrees of freedom; 0 where the test does not apply."""
    n_a, std_a, n_b, std_b = map(_c, (n_a, std_a, n_b, std_b))
    share_a, share_b = F.try_divide(std_a * std_a, n_a), F.try_divide(std_b * std_b, n_b)
    error = share_a + share_b
    spread = F.try_divide(share_a * share_a, n_a - 1) + F.try_divide(share_b * share_b, n_b - 1)
    usable = (n_a >= 2) & (n_b >= 2) & (error > 0)
    exact = F.when(spread > 0, F.try_divide(error * error, spread)).otherwise(
        F.greatest(n_a + n_b - 2, F.lit(1)).cast("double")
    )
    return F.when(usable, exact).otherwise(F.lit(0.0))


#: Terms of the series and depth of the continued fraction; both are exact to about 1e-15 at the seam.
ERFC_TERMS, ERFC_SEAM = 60, 2.5


def erfc(x: str | Column) -> Column:
    """Complementary error function of a value from 0 on, with an absolute error below 1e-14.

    Up to the seam 1 - 2x exp(-x²)/sqrt(pi) (1 + 2x²/3 (1 + 2x²/5 (1 + ...))), whose terms are all positive; beyond it
    exp(-x²)/sqrt(pi) over the continued fraction x + (1/2)/(x + 1/(x + (3/2)/(x + ...))).
    """

    def of(v: Column) -> Column:
        steps, square = F.sequence(F.lit(ERFC_TERMS), F.lit(1), F.lit(-1)), v * v
        series = F.aggregate(steps, F.lit(1.0), lambda s, k: 1.0 + 2.0 * square / (2.0 * k + 1.0) * s)
        fraction = F.aggregate(steps, v, lambda f, k: v + k / 2.0 / f)
        scale = F.exp(-square) / math.sqrt(math.pi)
        return F.when(v < ERFC_SEAM, 1.0 - 2.0 * v * scale * series).otherwise(scale / fraction)

    # Through a lambda, so that the argument is computed once.
    return F.get(F.transform(F.array(_c(x).cast("double")), of), F.lit(0))


def two_sided_p(t: str | Column) -> Column:
    """Two-sided p of a standard normal statistic, in [0, 1]."""
    p = erfc(F.abs(_c(t)) / math.sqrt(2.0))
    return F.when(_c(t).isNotNull(), F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0)))


def welch_p(n_a, mean_a, std_a, n_b, mean_b, std_b) -> Column:
    t = welch_t(n_a, mean_a, std_a, n_b, mean_b, std_b)
    return two_sided_p(t)


def critical_z(alpha: float) -> float:
    return NormalDist().inv_cdf(1.0 - alpha / 2.0)


def differs(n_a, mean_a, std_a, n_b, mean_b, std_b, alpha: float = 0.05, min_effect: float = 0.5) -> Column:
    """p < alpha and |d| >= min_effect. The p gate is |t| > z, so no Python is needed."""
    args = (n_a, mean_a, std_a, n_b, mean_b, std_b)
    enough = (_c(n_a) >= 2) & (_c(n_b) >= 2)
    return (
        enough
        & (F.abs(welch_t(*args)) > F.lit(critical_z(alpha)))
        & (F.abs(cohens_d(*args)) >= F.lit(min_effect))
    )


def potential(reduction: str | Column) -> Column:
    r = _c(reduction)
    return F.when(r >= 30, "high").when(r >= 10, "medium").otherwise("low")


def worst(*ordinals: Column) -> Column:
    """ok/warn/fail from ordinals 0/1/2, the worst of several (NULLs ignored)."""
    top = F.greatest(*ordinals) if len(ordinals) > 1 else ordinals[0]
    return F.when(top == 2, "fail").when(top == 1, "warn").otherwise("ok")


def ceiling_status(value: Column, limit: Column, slack: float) -> Column:
    """0 within the limit, 1 within limit*slack, else 2; NULL without a value."""
    return F.when(value.isNull(), None).when(value <= limit, 0).when(value <= limit * slack, 1).otherwise(2)


def floor_status(value: Column, floor: Column, slack: float) -> Column:
    """0 at or above the floor, 1 at or above floor*slack, else 2; NULL without a value."""
    return F.when(value.isNull(), None).when(value >= floor, 0).when(value >= floor * slack, 1).otherwise(2)
