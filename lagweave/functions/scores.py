"""Scores of rules, as columns over their statistics (x1_mean, x1_sigma, x2_mean, ..., support_count, support_rate)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(c: Column, steps: list[tuple[float, float]], otherwise: float, down: bool = False) -> Column:
    """The value of the first step that c reaches (>=), or with down stays under (<=)."""
    out = None
    for limit, value in steps:
        test = c <= limit if down else c >= limit
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(otherwise)


def mean_strength(*means: Column) -> Column:
    return reduce(lambda a, b: a + b, (F.abs(m) for m in means)) / len(means)


def per_sigma(numerator: Column, sigma: Column) -> Column:
    """0 where sigma is not positive."""
    return F.when(sigma > 0, numerator / sigma).otherwise(0.0)


def score_2d(support_rate, mean1, mean2, sigma1, sigma2, concentration) -> Column:
    return per_sigma(support_rate * mean_strength(mean1, mean2) * concentration, (sigma1 + sigma2) / 2)


def score_one(support_rate, mean, sigma) -> Column:
    return per_sigma(support_rate * F.abs(mean), sigma)


def score_temporal(support_rate, mean, sigma, positive, negative, n) -> Column:
    return per_sigma(support_rate * 1000 * F.abs(mean) * F.greatest(positive, negative) / n, sigma)


#: Points for tightness (mean sigma at most), direction (mean strength at least) and reliability (support at least).
TIGHTNESS, DIRECTION, RELIABILITY = [(0.30, 40), (0.35, 35), (0.40, 25)], [(0.35, 40), (0.30, 35), (0.25, 25), (0.20, 15)], [(15, 20), (12, 15), (10, 10)]


def cluster_quality(mean1, mean2, sigma1, sigma2, support) -> dict[str, Column]:
    parts = {
        "tightness": ladder((sigma1 + sigma2) / 2, TIGHTNESS, 10, down=True),
        "direction": ladder(mean_strength(mean1, mean2), DIRECTION, 5),
        "reliability": ladder(support, RELIABILITY, 5),
    }
    return parts | {"quality": reduce(lambda a, b: a + b, parts.values())}


def estimated_concentration(sigma1, sigma2) -> Column:
    wide = (sigma1 + sigma2) / 2
    return F.when(wide < 0.01, 0.9).otherwise(1 / (1 + 2 * wide))


def mean_quadrant(mean1, mean2) -> Column:
    """By the signs of the means, zero counting as positive."""
    return F.when(mean1 >= 0, F.when(mean2 >= 0, "Q1(++)").otherwise("Q4(+-)")).otherwise(F.when(mean2 >= 0, "Q2(-+)").otherwise("Q3(--)"))


def rule_score(support_rate, concentration, deviation) -> Column:
    return support_rate * concentration / F.greatest(deviation, F.lit(0.1))


def isotropic(support, sigmas: list[Column]) -> Column:
    """Support over the mean sigma, the less the sigmas differ the more."""
    mean = reduce(lambda a, b: a + b, sigmas) / len(sigmas)
    var = reduce(lambda a, b: a + b, ((s - mean) * (s - mean) for s in sigmas)) / len(sigmas)
    return F.when(mean > 1e-10, support / (mean * (1 + var))).otherwise(0.0)


def product_score(support_rate, sigmas: list[Column]) -> Column:
    product = reduce(lambda a, b: a * b, sigmas)
    return F.when(product > 1e-10, support_rate / product).otherwise(0.0)


def directional_bias(mean, sigma, win_rate, profit_factor) -> Column:
    loud = sigma > 0.5
    up = loud & (mean > 0.1) & (win_rate >= 0.52) & (profit_factor >= 1.1)
    down = loud & (mean < -0.1) & (win_rate <= 0.48) & (profit_factor <= 0.9)
    return F.when(up, "positive").when(down, "negative").otherwise("neutral")


def composite(t, n) -> Column:
    return F.abs(t) * F.log1p(n)


def expected_value(mean, n, t) -> Column:
    return F.abs(mean) * n * F.least(F.abs(t) / 2, F.lit(1.0))


def chi_bonus(support_rate, n, chi2) -> Column:
    return support_rate * n * (1 + chi2 / 10)


def quality(mean, sigma) -> Column:
    return F.try_divide(F.abs(mean), sigma)


def localization(reduction, n, p) -> Column:
    """At most 50 points for the variance reduction in percent, 20 for size, 30 for significance; -infinity under 5 matches."""
    size = F.when(n < 10, 2.0 * n).when(n <= 100, 20.0).otherwise(F.greatest(F.lit(0.0), 20 - (n - 100) * 0.1))
    significance = F.when(p < 0.01, 30.0).when(p < 0.05, 20.0).when(p < 0.1, 10.0).otherwise(0.0)
    return F.when(n < 5, F.lit(float("-inf"))).otherwise(F.least(reduction, F.lit(50.0)) + size + significance)
