"""Null share, null / alternative densities, kernel density estimates."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clip, gaussian_shift_density, norm_pdf, valid_p, z_left, z_right
from ..session import cut_lineage
from .ordered import GROUP, attach, quantile_row


def storey_pi0(df: DataFrame, p: str = "p", by: Sequence[str] = (), lam: float = 0.5, floor: float = 0.0) -> DataFrame:
    share = F.avg(F.when(F.col(p) > lam, 1.0).otherwise(0.0)) / F.lit(1.0 - lam)
    return df.groupBy(*by).agg(clip(share, floor, 1.0).alias("pi0"), F.count(F.lit(1)).alias("n"))


def gaussian_shift(
    df: DataFrame,
    p: str = "p",
    by: Sequence[str] = (),
    threshold: float = 0.2,
    default: tuple[float, float] = (2.5, 1.0),
    unit_sigma: bool = False,
    z_cap: float | None = None,
) -> DataFrame:
    """Fit of the shifted-normal alternative: mean and population deviation of z over p < threshold (more than ten
    rows needed, else the default)."""
    z = z_right(p)
    z = z if z_cap is None else clip(z, -z_cap, z_cap)
    low = F.col(p) < threshold
    fit = df.groupBy(*by).agg(
        F.count_if(low).alias("n_low"),
        F.avg(F.when(low, z)).alias("mu"),
        F.stddev_pop(F.when(low, z)).alias("sigma"),
        F.count(F.lit(1)).alias("n"),
    )
    enough = F.col("n_low") > 10
    sigma = F.lit(1.0) if unit_sigma else F.when(enough, F.col("sigma")).otherwise(F.lit(default[1]))
    return fit.select(
        *by, F.when(enough, F.col("mu")).otherwise(F.lit(default[0])).alias("mu"), sigma.alias("sigma"), "n_low", "n"
    )


def with_gaussian_shift(
    df: DataFrame, p: str = "p", by: Sequence[str] = (), cap: float | None = 5000.0, fit: DataFrame | None = None, **kw
) -> DataFrame:
    """Add ``f0`` = 1 and ``f1``; ``fit`` may come from other rows (training part)."""
    fit = gaussian_shift(df, p, by, **kw) if fit is None else fit
    z_cap = kw.get("z_cap")
    z = z_right(p) if z_cap is None else clip(z_right(p), -z_cap, z_cap)
    table = fit.select(*by, F.col("mu").alias("_mu"), F.col("sigma").alias("_sigma"))
    out = attach(df, table, by)
    out = out.withColumn("f0", F.lit(1.0)).withColumn("f1", gaussian_shift_density(z, F.col("_mu"), F.col("_sigma"), cap))
    return out.drop("_mu", "_sigma")


# Box width (in bandwidths), number of Taylor terms and reach (in bandwidths) of the KDE expansion; with these the
# truncation error of one kernel is below 1e-13 of its peak.
BOX, TERMS, REACH = 0.5, 14, 9


def kde_1d(
    df: DataFrame, value: str, bandwidth: DataFrame, by: Sequence[str] = (), out: str = "density", fit: str | None = None
) -> DataFrame:
    """Gaussian kernel density of a column at its own values, in linear time.

    Values fall into boxes half a bandwidth wide.  One aggregation gives each box its first moments; a join
    of boxes with their neighbours within nine bandwidths turns them into one local polynomial per box,
    which every row then evaluates.  No pair of rows is ever formed.  ``fit`` names a boolean column of the rows that
    carry mass (default all); ``n`` counts those.  ``bandwidth``: (group keys, ``h``, ``n``).
    """
    keys = list(by) or [GROUP]
    rows = attach(df, bandwidth.select(*by, F.col("h").alias("_h"), F.col("n").alias("_n")), by)
    rows = rows if by else rows.withColumn(GROUP, F.lit(0))
    rows = rows.withColumn("_box", F.floor(F.col(value) / (F.col("_h") * BOX)).cast("bigint"))
    rows = rows.withColumn("_t", F.col(value) / F.col("_h") - (F.col("_box") + 0.5) * BOX)
    mass = F.lit(True) if fit is None else F.col(fit)
    moments = rows.groupBy(*keys, "_box").agg(
        *[F.sum(F.when(mass, F.pow("_t", F.lit(float(k)))).otherwise(0.0)).alias(f"m{k}") for k in range(TERMS)]
    )
    boxes = moments.select(*keys, "_box")
    reach = int(REACH / BOX)
    targets = boxes.withColumn("_src", F.explode(F.sequence(F.col("_box") - reach, F.col("_box") + reach)))
    sources = moments.withColumnRenamed("_box", "_src")
    near = targets.join(sources, [*keys, "_src"])
    # offset of the box centres in bandwidths; Hermite functions he_k(x) exp(-x^2/2) by recurrence inside one array
    x = (F.col("_box") - F.col("_src")) * F.lit(BOX)
    start = F.array(F.exp(-x * x / 2), x * F.exp(-x * x / 2))
    herm = F.aggregate(
        F.sequence(F.lit(1), F.lit(2 * TERMS - 3)),
        start,
        lambda acc, k: F.concat(
            acc, F.array(x * F.element_at(acc, -1) - k.cast("double") * F.element_at(acc, -2))
        ),
    )
    near = near.withColumn("_he", herm)
    # local coefficient j = (-1)^j / j! * sum_k m_k / k! * he_{k+j}, as small array dot products
    scaled = F.array(*[F.col(f"m{k}") / F.lit(float(math.factorial(k))) for k in range(TERMS)])
    coef = F.transform(
        F.sequence(F.lit(1), F.lit(TERMS)),
        lambda j: F.aggregate(
            F.zip_with("_m", F.slice("_he", j, F.lit(TERMS)), lambda m, h: m * h), F.lit(0.0), lambda acc, x: acc + x
        ),
    )
    near = near.withColumn("_m", scaled).withColumn("_loc", coef)
    sign = [(-1.0) ** j / math.factorial(j) for j in range(TERMS)]
    poly = near.groupBy(*keys, "_box").agg(*[F.sum(F.col("_loc")[j] * F.lit(sign[j])).alias(f"l{j}") for j in range(TERMS)])
    out_rows = attach(rows, poly, [*keys, "_box"])
    value_col = F.col(f"l{TERMS - 1}")
    for j in range(TERMS - 2, -1, -1):
        value_col = value_col * F.col("_t") + F.col(f"l{j}")
    dens = value_col / (F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi)))
    drop = ["_h", "_n", "_box", "_t", GROUP, *[f"l{j}" for j in range(TERMS)]]
    return out_rows.withColumn(out, dens).drop(*drop)


def empirical_null(df: DataFrame, p: str = "p", by: Sequence[str] = (), z: str | None = None) -> DataFrame:
    """Right-tail anchored null: ``delta`` = median z, ``sigma`` = max(1, (q75 - median) / 0.6745), bandwidth ``h``,
    ``pi0`` and ``n`` per group, all from the valid p-values.  ``z`` names a column ``_z`` that is already there."""
    z = df if z else cut_lineage(df.where(valid_p(p)).select(*by, p, z_left(p).alias("_z")))
    q = quantile_row(z, "_z", {"delta": 0.5, "q75": 0.75}, by)
    s = z.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.stddev_samp("_z").alias("sd"),
        clip(F.avg(F.when(F.col(p) > 0.5, 1.0).otherwise(0.0)) / F.lit(0.5), 0.1, 1.0).alias("pi0"),
    )
    if by:
        both = q.join(s, list(by))
    else:
        both = q.withColumn(GROUP, F.lit(0)).join(s.withColumn(GROUP, F.lit(0)), GROUP).drop(GROUP)
    sigma = F.greatest(F.lit(1.0), (F.col("q75") - F.col("delta")) / F.lit(0.6745))
    h = F.lit(1.06) * F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    return both.select(*by, "n", "delta", sigma.alias("sigma"), h.alias("h"), "pi0")


def with_empirical_null(df: DataFrame, p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """Add ``f0``, ``f1``, ``pi0`` and ``pi0_temp`` of the robust mixture to every row.

    The null and the bandwidth come from the valid p-values; densities are evaluated at every number, clipped into the open
    unit interval.  Rows without a number get NULL.  Groups below 100 valid rows, and groups whose p-values are all equal, use
    f0 = 1, f1 = 2 (1 - p), pi0 = 0.9 (``pi0_temp`` 1).  The scale of f1 (``pi0_temp``) is the smallest ratio of the density to the
    null right of the median, over the same batch of rows the densities are evaluated on.
    """
    known = F.col(p).isNotNull() & ~F.isnan(p)
    rows = cut_lineage(df.where(known).withColumn("_z", z_left(p)).withColumn("_fit", valid_p(p)))
    params = cut_lineage(empirical_null(rows.where("_fit"), p, by, z="_z").where("n >= 100 and h > 0"))
    fitted = attach(rows, params.select(*by, "delta", "sigma", F.col("pi0").alias("_pi0"), F.lit(True).alias("_full")), by, "left")
    clipped = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(p)))
    small = fitted.where("_full is null").withColumn("f0", F.lit(1.0)).withColumn("f1", (F.lit(1.0) - clipped) * 2)
    small = small.withColumn("pi0", F.lit(0.9)).withColumn("pi0_temp", F.lit(1.0)).select(*df.columns, "f0", "f1", "pi0", "pi0_temp")
    rows = cut_lineage(kde_1d(fitted.where("_full"), "_z", params.select(*by, "h", "n"), by, "_kde", "_fit"))
    rows = rows.withColumn("_null", norm_pdf("_z", F.col("delta"), F.col("sigma")))
    ratio = F.col("_kde") / (F.col("_null") + F.lit(1e-10))
    temp = rows.groupBy(*by).agg(
        clip(F.coalesce(F.min(F.when(F.col("_z") > F.col("delta"), ratio)), F.lit(1.0)), 0.5, 1.0).alias("pi0_temp"),
    )
    rows = attach(rows, temp, by)
    phi = norm_pdf("_z")
    excess = F.when(F.col("_z") > F.col("delta"), 0.0).otherwise(
        F.greatest(F.lit(0.0), F.col("_kde") - F.col("pi0_temp") * F.col("_null"))
    )
    full = rows.withColumn("f0", F.col("_null") / phi).withColumn("f1", excess / phi / (F.lit(1.0) - F.col("pi0_temp") + 1e-6))
    full = full.withColumn("pi0", F.col("_pi0")).select(*df.columns, "f0", "f1", "pi0", "pi0_temp")
    return full.unionByName(small).unionByName(df.where(~known), allowMissingColumns=True)


def beta_mle(df: DataFrame, p: str = "p", threshold: float = 0.1) -> tuple[float, float]:
    """Maximum-likelihood Beta(a, b) for p < threshold, a in [0.1, 2], b in [1, 20].

    The likelihood depends on the data through three sums only; the two-parameter search runs on those.
    """
    low = df.where((F.col(p) > 0) & (F.col(p) < threshold))
    row = low.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.log(p)).alias("sl"), F.sum(F.log1p(-F.col(p))).alias("sm")
    ).first()
    if not row["n"]:
        raise ValueError("no p-values below the threshold")
    ml, mm = row["sl"] / row["n"], row["sm"] / row["n"]

    def loss(a: float, b: float) -> float:
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b) - (a - 1) * ml - (b - 1) * mm

    lo, hi = np.array([0.1, 1.0]), np.array([2.0, 20.0])
    best = np.array([0.5, 5.0])
    span = (hi - lo) / 2
    while span.max() > 1e-9:  # shrinking pattern search on a convex function of two variables
        grid = [np.clip(best + span * np.array([i, j]), lo, hi) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        nxt = min(grid, key=lambda ab: loss(*ab))
        if np.allclose(nxt, best, rtol=0, atol=1e-15):
            span = span / 2
        best = nxt
    return float(best[0]), float(best[1])


def exponential_alternative(p: str = "p"):
    """Fallback alternative when the Beta fit is not usable."""
    return F.lit(10.0) * F.exp(F.lit(-10.0) * F.col(p))


def density_ratio_grid(spark: SparkSession, params: DataFrame, points: int = 1000) -> DataFrame:
    """f1/f0 of fitted Gaussian-shift alternatives over a p-grid in [0.001, 0.999]: mean and deviation across datasets and
    the share of datasets in which the ratio exceeds 1.  ``params``: (``dataset``, ``mu``, ``sigma``)."""
    step = (0.999 - 0.001) / (points - 1)
    grid = params.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    grid = grid.withColumn("p", F.lit(0.001) + F.col("g") * F.lit(step))
    f1 = gaussian_shift_density(z_right("p"), F.col("mu"), F.col("sigma"), None)
    ratio = f1 / F.lit(1.0 + 1e-10)
    return grid.withColumn("ratio", ratio).groupBy("g").agg(
        F.avg("ratio").alias("mean_ratio"),
        F.stddev_pop("ratio").alias("std_ratio"),
        F.avg(F.when(F.col("ratio") > 1, 1.0).otherwise(0.0)).alias("share_above"),
    )


def density_ratio_flag(grid: DataFrame, limit: float = 0.6) -> DataFrame:
    """Fraction of the grid on which the mean ratio exceeds 1, flagged when above the limit."""
    out = grid.agg(F.avg(F.when(F.col("mean_ratio") > 1, 1.0).otherwise(0.0)).alias("fraction_above"))
    return out.withColumn("flagged", F.col("fraction_above") > limit)
