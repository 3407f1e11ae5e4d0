"""Tail probability of Student's t, for whole columns of summary rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Steps of the continued fraction; it settles in some sqrt(dof) of them.
STEPS = 10_000


def _make_tail(steps: int):
    def two_sided(t, dof):
        import math

        import numpy as np
        import pandas as pd

        def off_zero(v):
            return np.where(np.abs(v) > 1e-300, v, 1e-300)

        def fraction(a, b, x):
            """Modified Lentz evaluation of the incomplete beta fraction, all entries a step."""
            c = np.ones_like(x)
            d = 1.0 / off_zero(1.0 - (a + b) * x / (a + 1.0))
            value = d.copy()
            live = np.arange(len(x))
            for m in range(1, steps):
                if not len(live):
                    break
                al, bl, xl = a[live], b[live], x[live]
                for num in (
                    m * (bl - m) * xl / ((al + 2 * m - 1) * (al + 2 * m)),
                    -(al + m) * (al + bl + m) * xl / ((al + 2 * m) * (al + 2 * m + 1)),
                ):
                    d[live] = 1.0 / off_zero(1.0 + num * d[live])
                    c[live] = off_zero(1.0 + num / c[live])
                    value[live] *= d[live] * c[live]
                live = live[np.abs(d[live] * c[live] - 1.0) >= 1e-15]
            return value

        tv, n = t.to_numpy(dtype=float), dof.to_numpy(dtype=float)
        out = np.full(len(tv), np.nan)
        out[(n > 0) & np.isinf(tv)] = 0.0
        out[(n > 0) & (tv == 0)] = 1.0
        rows = np.flatnonzero((n > 0) & np.isfinite(tv) & (tv != 0))
        if len(rows):
            a, b = n[rows] / 2.0, np.full(len(rows), 0.5)
            square = tv[rows] * tv[rows]
            x, rest = n[rows] / (n[rows] + square), square / (n[rows] + square)
            # one log-gamma for each number of rows that occurs
            values, place = np.unique(a, return_inverse=True)
            scale = np.array([math.lgamma(v + 0.5) - math.lgamma(v) - math.lgamma(0.5) for v in values])[place]
            with np.errstate(divide="ignore"):
                front = np.exp(scale + a * np.log1p(-rest) + b * np.log(rest))
            direct = x < (a + 1.0) / (a + b + 2.0)
            p = np.empty(len(rows))
            p[direct] = front[direct] * fraction(a[direct], b[direct], x[direct]) / a[direct]
            turned = ~direct
            p[turned] = 1.0 - front[turned] * fraction(b[turned], a[turned], rest[turned]) / b[turned]
            out[rows] = p
        return pd.Series(out).astype(object).where(~np.isnan(out), None).astype("float64")

    return two_sided


def t_two_sided(t: Column, dof: Column, steps: int = STEPS) -> Column:
    """Two-sided p value; null or NaN input gives null."""
    tail = F.pandas_udf(_make_tail(steps), "double")
    p = tail(t.cast("double"), dof.cast("double"))
    return F.when(t.isNotNull() & ~F.isnan(t), p)
