"""Tail probability of the chi-square distribution, for one row per feature."""

from __future__ import annotations

import math
import sys
from itertools import count

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# executors need no installed copy of this package to run the function below
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TINY = 1e-300
#: From this shape on the normal-like expansion is exact to about 1e-9.
_LARGE_SHAPE = 20_000.0


def _large_shape_tail(a: float, x: float) -> float:
    """Uniform asymptotic form: an error function and its first two corrections.

    Nothing large is subtracted, so it holds for any number of degrees.
    """
    mu = (x - a) / a
    eta = math.copysign(math.sqrt(2.0 * max(mu - math.log1p(mu), 0.0)), mu)
    if abs(mu) < 1e-3:
        first = -1.0 / 3.0 + eta / 12.0 - 2.0 * eta * eta / 135.0
    else:
        first = 1.0 / mu - 1.0 / eta
    rest = math.exp(-0.5 * a * eta * eta) / math.sqrt(2.0 * math.pi * a) * (first - 1.0 / (540.0 * a))
    return min(1.0, max(0.0, 0.5 * math.erfc(eta * math.sqrt(0.5 * a)) + rest))


def chi_square_tail(statistic: float, degrees: float) -> float:
    """P(X > statistic): the regularised upper incomplete gamma function."""
    if degrees <= 0 or statistic <= 0:
        return 1.0
    a, x = degrees / 2.0, statistic / 2.0
    if a > _LARGE_SHAPE:
        return _large_shape_tail(a, x)
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        # lower tail as a power series in x
        term = total = 1.0 / a
        for k in count(1):
            term *= x / (a + k)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1.0 - scale * total)
    # upper tail as a continued fraction, evaluated front to back
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    value = d
    for k in count(1):
        num = k * (a - k)
        b += 2.0
        d = num * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + num / c
        c = c if abs(c) > _TINY else _TINY
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return scale * value


@F.pandas_udf(DoubleType())
def chi_square_p_value(statistic: pd.Series, degrees: pd.Series) -> pd.Series:
    return pd.Series([chi_square_tail(s, d) for s, d in zip(statistic, degrees)], dtype=float)
