"""Numeric column expressions shared by the feature and scoring jobs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def share(condition: Column) -> Column:
    """Aggregate: share of rows meeting the condition; unknown counts as no."""
    return F.avg(flag(condition).cast("double"))


def ratio0(num: Column, den: Column) -> Column:
    """num/den, 0 where the denominator is not positive."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def clamp(x: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))


def logistic100(x: Column, k: float = 1.0) -> Column:
    """Logistic curve scaled to 0..100."""
    return F.lit(100.0) / (F.lit(1.0) + F.exp(x * F.lit(-float(k))))


def round_half_up(x: Column, dp: int = 2) -> Column:
    """Round with ties toward +infinity.

    The scaled value is first freed of floating-point noise (six places), so that a
    tie does not depend on the order in which a sum was formed.
    """
    scale = float(10**dp)
    return F.floor(F.round(x * F.lit(scale), 6) + F.lit(0.5)).cast("double") / F.lit(scale)


def round_half_even(x: Column, dp: int) -> Column:
    """Round like numpy: scale, take the nearest integer (ties to even), unscale."""
    scale = float(10**dp)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def gaussian_match(diff: Column, sigma: float | Column) -> Column:
    """Unnormalised Gaussian kernel: 1 at diff 0."""
    width = sigma if isinstance(sigma, Column) else F.lit(float(sigma))
    return F.exp(-(diff * diff) / (F.lit(2.0) * width * width))


def finite_or(x: Column, default: float = 0.0) -> Column:
    """Value as double; NULL, NaN, infinities and non-numbers become default."""
    v = x.try_cast("double")
    bad = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.coalesce(F.when(~bad, v), F.lit(float(default)))


def entropy_from_sums(total: Column, n_log_n: Column, distinct: Column, base: float = math.e) -> Column:
    """Shannon entropy out of mergeable sums: N, sum(n ln n) and the class count.

    H = ln N - sum(n ln n)/N needs no second pass over the classes. One class is
    exactly 0, so that rounding noise never reaches a z-score.
    """
    h = (F.ln(total) - n_log_n / total) / F.lit(math.log(base))
    return F.when(distinct <= 1, F.lit(0.0)).otherwise(h)


def nice_ceiling(x: Column, steps: list[float]) -> Column:
    """First step above x; the last step where none is."""
    ladder = F.array(*[F.lit(float(s)) for s in steps])
    above = F.filter(ladder, lambda s: s > x)
    return F.coalesce(F.try_element_at(above, F.lit(1)), F.lit(float(steps[-1])))


def any_within(x: Column, ceilings: list[float], lower_share: float) -> Column:
    """True where x lies in [lower_share*c, c) of any ceiling c."""
    hit = F.lit(False)
    for c in ceilings:
        hit = hit | ((x >= F.lit(c * lower_share)) & (x < F.lit(float(c))))
    return hit
