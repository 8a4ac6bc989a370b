"""Distribution functions without scipy, as pandas UDFs over whole columns of few rows (one per rule or group)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_LOG_GAMMA = np.frompyfunc(lambda v: math.lgamma(v) if v > 0 else math.nan, 1, 1)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, by the modified Lentz method, for all rows at once."""
    away = lambda v: np.where(np.abs(v) > 1e-300, v, 1e-300)
    c, d = np.ones_like(x), 1 / away(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / away(1 + num * d), away(1 + num / c)
            h = h * c * d
        if (np.abs(c * d - 1) < 1e-14).all():
            break
    return h


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularized I_x(a, b); a and b are positive."""
    a, b, x = (v.astype(float) for v in np.broadcast_arrays(a, b, x))
    inside = (x > 0) & (x < 1)
    y = np.where(inside, x, 0.5)
    front = np.exp((_LOG_GAMMA(a + b) - _LOG_GAMMA(a) - _LOG_GAMMA(b)).astype(float) + a * np.log(y) + b * np.log1p(-y))
    low = y < (a + 1) / (a + b + 2)
    p, q, z = np.where(low, a, b), np.where(low, b, a), np.where(low, y, 1 - y)
    part = front * _beta_fraction(p, q, z) / p
    return np.where(inside, np.where(low, part, 1 - part), np.where(x >= 1, 1.0, 0.0))


def _over_known(f, *columns) -> np.ndarray:
    """f of the rows without NaN and with positive degrees of freedom (all columns but the first), NaN elsewhere."""
    cols = np.broadcast_arrays(*(np.asarray(c, float) for c in columns))
    ok = ~np.isnan(cols).any(0) & np.all([d > 0 for d in cols[1:]], 0)
    out = np.full(ok.shape, np.nan)
    if ok.any():
        out[ok] = f(*(c[ok] for c in cols))
    return out


def t_two_sided(t, df) -> np.ndarray:
    """P(|T| >= |t|) of Student's t."""
    return _over_known(lambda t, df: np.where(np.isinf(t), 0.0, incomplete_beta(df / 2, 0.5, df / (df + np.where(np.isinf(t), 0, t) ** 2))), t, df)


def f_upper(f, d1, d2) -> np.ndarray:
    """P(F >= f)."""

    def upper(f, d1, d2):
        g = np.where(np.isinf(f), 0, np.maximum(f, 0))
        return np.where(f <= 0, 1.0, np.where(np.isinf(f), 0.0, incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * g))))

    return _over_known(upper, f, d1, d2)


def _vector(f):
    return lambda *cols: pd.Series(f(*(c.astype(float).to_numpy() for c in cols)))


def t_p_value(t, df):
    """Column of two-sided p-values; NULL where undefined."""
    udf = F.pandas_udf(_vector(t_two_sided), "double")
    p = udf(t.cast("double"), df.cast("double"))
    return F.when(~F.isnan(p), p)


def f_p_value(f, d1, d2):
    """Column of upper-tail p-values; NULL where undefined."""
    udf = F.pandas_udf(_vector(f_upper), "double")
    p = udf(f.cast("double"), d1.cast("double"), d2.cast("double"))
    return F.when(~F.isnan(p), p)


def normal_cdf(z):
    """Standard normal distribution function by built-in functions alone: erf as its alternating Taylor or continued-fraction value is
    not built in, so a rational approximation with error below 1.5e-7 is used.
    """
    # Coefficients of a published rational approximation of erf.
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = F.lit(0.0)
    for c in reversed(a):
        poly = (poly + c) * t
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)
