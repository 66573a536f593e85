"""Metric registry [X1]: names to aggregate columns, for one ``groupBy().agg()`` whatever the choice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def wrmse(p: Column, t: Column, c: Column, w: Column) -> Column:
    """[A2, A3] sqrt(mean(w (p - t)^2)); ``w`` has mean 1."""
    return F.sqrt(F.avg(w * (p - t) * (p - t)))


def wrmse_height(p: Column, t: Column, c: Column, w: Column) -> Column:
    """[A3] WRMSE of geopotential in metres."""
    return wrmse(p, t, c, w) / 9.80665


def bias(p: Column, t: Column, c: Column, w: Column) -> Column:
    """[A4]"""
    return F.avg(w * (p - t))


def mae(p: Column, t: Column, c: Column, w: Column) -> Column:
    """[A5] Unweighted."""
    return F.avg(F.abs(p - t))


def wmae(p: Column, t: Column, c: Column, w: Column) -> Column:
    """[A6] sum(w |p - t|) / sum(w)."""
    return _ratio(F.sum(w * F.abs(p - t)), F.sum(F.when((p - t).isNotNull(), w)))


def wbias(p: Column, t: Column, c: Column, w: Column) -> Column:
    """[A6]"""
    return _ratio(F.sum(w * (p - t)), F.sum(F.when((p - t).isNotNull(), w)))


def cos_rmse(p: Column, t: Column, c: Column, w: Column) -> Column:
    """[A6]"""
    return F.sqrt(_ratio(F.sum(w * (p - t) * (p - t)), F.sum(F.when((p - t).isNotNull(), w))))


def activity(p: Column, t: Column, c: Column, w: Column) -> Column:
    """[A7] Weighted spread of the anomaly around its weighted mean; null without climatology. One pass over partial sums."""
    x = p - c
    m, n = F.avg(w * x), F.nullif(F.count(x), F.lit(0).cast("long"))
    return F.when(n.isNotNull(), F.sqrt(F.greatest((F.sum(w * x * x) - 2 * m * F.sum(w * x) + m * m * F.sum(F.when(x.isNotNull(), w))) / n, F.lit(0.0))))


def acc(p: Column, t: Column, c: Column, w: Column) -> Column:
    """[A8] Uncentred anomaly correlation; null for a denominator below 1e-12."""
    f, o = p - c, t - c
    both = f.isNotNull() & o.isNotNull()
    d = F.sqrt(F.sum(F.when(both, w * f * f)) * F.sum(F.when(both, w * o * o)))
    return F.when(d >= 1e-12, F.sum(w * f * o) / d)


def rmse(p: Column, t: Column, c: Column, w: Column) -> Column:
    """[A12] Unweighted."""
    return F.sqrt(F.avg((p - t) * (p - t)))


REGISTRY: dict[str, Callable[[Column, Column, Column, Column], Column]] = {f.__name__: f for f in (wrmse, wrmse_height, bias, mae, wmae, wbias, cos_rmse, activity, acc, rmse)}


def metric(name: str, p: str = "pred", t: str = "truth", c: str = "clim", w: str = "w") -> Column:
    """Aggregate column of a registered metric; unknown names raise."""
    if name not in REGISTRY:
        raise KeyError(f"unknown metric {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](F.col(p), F.col(t), F.col(c), F.col(w)).alias(name)


def hits(p: Column, t: Column, thr: Column) -> Column:
    """[A14] Contingency table at ``>= thr``."""
    return F.count_if((p >= thr) & (t >= thr))


def misses(p: Column, t: Column, thr: Column) -> Column:
    return F.count_if((p < thr) & (t >= thr))


def false_alarms(p: Column, t: Column, thr: Column) -> Column:
    return F.count_if((p >= thr) & (t < thr))


def correct_negatives(p: Column, t: Column, thr: Column) -> Column:
    return F.count_if((p < thr) & (t < thr))


def csi(h: Column, m: Column, f: Column) -> Column:
    """[A15]"""
    return h / (h + m + f + EPS)


def sedi(h: Column, m: Column, f: Column, c: Column) -> Column:
    """[A16] From hit rate and false alarm rate; null where either is 0 or 1."""
    hr, fr = F.try_divide(h, h + m), F.try_divide(f, f + c)
    ok = (hr > 0) & (hr < 1) & (fr > 0) & (fr < 1)
    a, b, x, y = F.ln(fr), F.ln(hr), F.ln(1 - fr), F.ln(1 - hr)
    return F.when(ok, (a - b - x + y) / (a + b + x + y))
