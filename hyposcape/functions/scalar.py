"""Projections used all over the engine: clips, link functions, densities, local FDR."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normal import norm_ppf


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(x: Column | str, lo: float | None, hi: float | None) -> Column:
    """Clip that keeps NaN as NaN (greatest/least alone would turn it into a bound)."""
    x = _col(x)
    y = x
    if hi is not None:
        y = F.least(F.lit(float(hi)), y)
    if lo is not None:
        y = F.greatest(F.lit(float(lo)), y)
    return F.when(F.isnan(x), x).otherwise(y)


def nan_to_zero(x: Column | str) -> Column:
    return F.nanvl(_col(x), F.lit(0.0))


def valid_p(p: Column | str) -> Column:
    """Predicate: p is a number strictly between 0 and 1."""
    p = _col(p)
    return p.isNotNull() & ~F.isnan(p) & (p > 0) & (p < 1)


def z_left(p: Column | str, eps: float = 1e-15) -> Column:
    """Signal on the left: quantile of p."""
    return norm_ppf(F.greatest(F.lit(eps), F.least(F.lit(1 - eps), _col(p))))


def z_right(p: Column | str, eps: float = 1e-10) -> Column:
    """Signal on the right: quantile of 1 - p."""
    return norm_ppf(F.lit(1.0) - F.greatest(F.lit(eps), F.least(F.lit(1 - eps), _col(p))))


def expit(g: Column | str, bound: float = 500.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(g, -bound, bound)))


def logit(a: Column | str) -> Column:
    a = _col(a)
    return F.when(a >= 1, F.lit(float("inf"))).when(a <= 0, F.lit(float("-inf"))).otherwise(F.log(a / F.nullif(F.lit(1.0) - a, F.lit(0.0))))


def neg_log10(p: Column | str, eps: float = 1e-10) -> Column:
    return -F.log10(F.greatest(_col(p), F.lit(eps)))


def mixture(alpha: Column | str, f0: Column | str, f1: Column | str, floor: float | None = 1e-10) -> Column:
    alpha, f0, f1 = _col(alpha), _col(f0), _col(f1)
    m = alpha * f0 + (F.lit(1.0) - alpha) * f1
    return m if floor is None else F.greatest(m, F.lit(floor))


def local_fdr(alpha: Column | str, f0: Column | str, f1: Column | str, floor: float | None = 1e-10) -> Column:
    """Posterior probability of the null, in [0, 1] whenever alpha is; 0 where both parts of the mixture are 0."""
    top, m = _col(alpha) * _col(f0), mixture(alpha, f0, f1, floor)
    return F.when(m == 0, F.lit(0.0)).otherwise(top / F.nullif(m, F.lit(0.0)))


def gaussian_shift_density(z: Column | str, mu: Column, sigma: Column, cap: float | None = 5000.0) -> Column:
    """Alternative density in p-space: N(mu, sigma) over the standard normal.  A deviation of 0 (equal p-values) counts as 1e-3."""
    z, sigma = _col(z), F.when(sigma > 0, sigma).otherwise(F.lit(1e-3))
    exponent = (F.pow(z, F.lit(2.0)) - F.pow((z - mu) / sigma, F.lit(2.0))) * F.lit(0.5)
    ratio = F.exp(exponent) / sigma
    return ratio if cap is None else F.least(F.lit(float(cap)), ratio)


def confusion_code(rejected: Column | str, label: Column | str) -> Column:
    """0 = TN, 1 = FP, 2 = FN, 3 = TP (label 1 = null)."""
    rejected, label = _col(rejected), _col(label)
    return (
        F.when(~rejected & (label == 1), 0).when(rejected & (label == 1), 1).when(~rejected, 2).otherwise(3).cast("int")
    )


def in_top_right(x: Column | str, y: Column | str) -> Column:
    return (_col(x) > 0.5) & (_col(y) > 0.5)
