"""Quadrants of two future values, in the conventions in use.

Each convention is a pair of tests per quadrant and a denominator. Labels: Q1 (++), Q2 (-+), Q3 (--), Q4 (+-); convention e
counts (+, not +) as Q2. The dominant quadrant is the first greatest in label order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUADRANTS = ("Q1", "Q2", "Q3", "Q4")


def tests(kind: str, a: Column, b: Column, threshold: float = 0.001) -> list[Column]:
    """Membership in Q1..Q4. a, a_total: zeros in none; b: zeros count as positive; c: beyond a threshold; e: above zero or not."""
    if kind in ("a", "a_total"):
        up, down = (lambda c: c > 0), (lambda c: c < 0)
    elif kind == "b":
        up, down = (lambda c: c >= 0), (lambda c: c < 0)
    elif kind == "c":
        up, down = (lambda c: c >= threshold), (lambda c: c < -threshold)
    elif kind == "e":
        up, down = (lambda c: c > 0), (lambda c: ~(c > 0))
        return [up(a) & up(b), up(a) & down(b), down(a) & down(b), down(a) & up(b)]
    else:
        raise ValueError(f"unknown convention {kind}")
    return [up(a) & up(b), down(a) & up(b), down(a) & down(b), up(a) & down(b)]


def concentration(matched: DataFrame, by: list[str], kind: str = "b", x: str = "x1", y: str = "x2", threshold: float = 0.001) -> DataFrame:
    """by, q1..q4, n, concentration (0 without points), dominant quadrant (Q0 without points)."""
    known = matched.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    counts = [F.count_if(t).alias(q.lower()) for t, q in zip(tests(kind, F.col(x), F.col(y), threshold), QUADRANTS)]
    got = known.groupBy(*by).agg(*counts, F.count(F.lit(1)).alias("n"))
    q = [F.col(c.lower()) for c in QUADRANTS]
    total = F.col("n") if kind in ("a_total", "b", "e") else q[0] + q[1] + q[2] + q[3]
    top = F.greatest(*q)
    label = F.lit("Q0")
    for c, name in reversed(list(zip(q, QUADRANTS))):
        label = F.when((c == top) & (top > 0), name).otherwise(label)
    return got.withColumn("concentration", F.coalesce(F.try_divide(top, total), F.lit(0.0))).withColumn("quadrant", label)


def centre_quadrant(x_min: Column, x_max: Column, y_min: Column, y_max: Column, limit: float = 0.5) -> Column:
    """Convention d, by the centre of the range: 0 if a range reaches beyond the limit on the side away from its centre, or a centre is 0."""
    cx, cy = (x_min + x_max) / 2, (y_min + y_max) / 2
    right, left = (cx > 0) & (x_min >= -limit), (cx < 0) & (x_max <= limit)
    top, low = (cy > 0) & (y_min >= -limit), (cy < 0) & (y_max <= limit)
    return F.when(right & top, 1).when(left & top, 2).when(left & low, 3).when(right & low, 4).otherwise(0)


def deviation_ok(quadrant: Column, x_min: Column, x_max: Column, y_min: Column, y_max: Column, limit: float) -> Column:
    """No point lies further than limit on a side away from the quadrant."""
    right, left, top, low = x_min >= -limit, x_max <= limit, y_min >= -limit, y_max <= limit
    return F.when(quadrant == "Q1", right & top).when(quadrant == "Q2", left & top).when(quadrant == "Q3", left & low).when(quadrant == "Q4", right & low).otherwise(False)
