"""Normal quantile, distribution and log-gamma as Column expressions (Spark ships none of them)."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Wichura's algorithm AS 241 (PPND16), lowest power first.
PPF_CENTRE_NUM = [
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
    4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3,
]
PPF_CENTRE_DEN = [
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3,
]
PPF_MID_NUM = [
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
    1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4,
]
PPF_MID_DEN = [
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9,
]
PPF_TAIL_NUM = [
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
    2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7,
]
PPF_TAIL_DEN = [
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15,
]
# Hart's rational approximation of the normal tail (as printed by West, 2005), lowest power first.
CDF_NUM = [
    220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383,
    6.37396220353165, 0.700383064443688, 3.52624965998911e-02,
]
CDF_DEN = [
    440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674,
    86.7807322029461, 16.064177579207, 1.75566716318264, 8.83883476483184e-02,
]
CDF_SWITCH = 7.07106781186547
SQRT_2PI = math.sqrt(2.0 * math.pi)


def polynomial(x: Column, coefficients: list[float]) -> Column:
    """Horner evaluation, coefficients lowest power first."""
    return reduce(lambda acc, c: acc * x + F.lit(c), reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """Evaluate x once and use it many times: a let-binding by way of a one-element array.

    Without it the optimiser copies x into every use when it merges projections or pushes filters, and a
    rational approximation grows beyond what one generated method may hold.
    """
    return F.element_at(F.transform(F.array(x), f), 1)


def rational(x: Column, num: list[float], den: list[float]) -> Column:
    return bind(x, lambda r: polynomial(r, num) / polynomial(r, den))


def norm_ppf(p: Column | str) -> Column:
    """Standard normal quantile."""

    def quantile(p: Column) -> Column:
        q = p - F.lit(0.5)
        centre = q * rational(F.lit(0.180625) - q * q, PPF_CENTRE_NUM, PPF_CENTRE_DEN)
        outer = bind(
            F.sqrt(-F.log(F.least(p, F.lit(1.0) - p))),
            lambda r: F.when(r <= 5.0, rational(r - F.lit(1.6), PPF_MID_NUM, PPF_MID_DEN)).otherwise(
                rational(r - F.lit(5.0), PPF_TAIL_NUM, PPF_TAIL_DEN)
            ),
        )
        return F.when(F.abs(q) <= 0.425, centre).otherwise(F.signum(q) * outer)

    return bind(_col(p), quantile)


def norm_pdf(x: Column | str, loc: Column | float = 0.0, scale: Column | float = 1.0) -> Column:
    """Normal density."""
    x = _col(x)
    loc = loc if isinstance(loc, Column) else F.lit(float(loc))
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    return F.exp(F.pow((x - loc) / scale, F.lit(2.0)) * F.lit(-0.5)) / (scale * F.lit(SQRT_2PI))


def norm_sf(x: Column | str) -> Column:
    """Upper tail of the standard normal."""

    def tail(x: Column) -> Column:
        a = F.abs(x)
        e = F.exp(-a * a / F.lit(2.0))
        fraction = a + F.lit(0.65)
        for k in (4.0, 3.0, 2.0, 1.0):
            fraction = a + F.lit(k) / fraction
        upper = F.when(a < CDF_SWITCH, e * rational(a, CDF_NUM, CDF_DEN)).otherwise(e / fraction / F.lit(SQRT_2PI))
        return F.when(x > 0, upper).otherwise(F.lit(1.0) - upper)

    return bind(_col(x), tail)


def norm_cdf(x: Column | str) -> Column:
    return norm_sf(-_col(x))


def lgamma(x: Column | str) -> Column:
    """log Gamma for x >= 1: Stirling's series after shifting the argument up by eight."""

    def stirling(x: Column) -> Column:
        shift = reduce(lambda acc, i: acc * (x + F.lit(float(i))), range(1, 8), x)
        y = x + F.lit(8.0)
        # B_2k / (2k (2k-1)) of Stirling's series.
        series = polynomial(F.lit(1.0) / (y * y), [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188]) / y
        return (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series - F.log(shift)

    return bind(_col(x).cast("double"), stirling)
