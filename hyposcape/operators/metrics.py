"""Confusion counts, error rates, summaries and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import exact_quantiles

METRICS = ["TPR", "power", "FDR", "FPR", "precision", "F1"]
COUNTS = ["n_discoveries", "n_true_signals", "TP", "FP", "TN", "FN"]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, by: Sequence[str] = (), rejected: str = "rejected", label: str = "label") -> DataFrame:
    r, h1 = F.col(rejected), F.col(label) == 0
    return df.groupBy(*by).agg(
        F.count_if(r & h1).alias("TP"),
        F.count_if(r & ~h1).alias("FP"),
        F.count_if(~r & ~h1).alias("TN"),
        F.count_if(~r & h1).alias("FN"),
        F.count_if(r).alias("n_discoveries"),
        F.count_if(h1).alias("n_true_signals"),
    )


def rates(df: DataFrame) -> DataFrame:
    """Error rates from confusion counts; zero denominators give 0.0."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("TP", "FP", "TN", "FN"))
    out = df.withColumn("TPR", _ratio(tp, tp + fn)).withColumn("power", F.col("TPR"))
    out = out.withColumn("FDR", _ratio(fp, tp + fp)).withColumn("FPR", _ratio(fp, fp + tn))
    out = out.withColumn("precision", _ratio(tp, tp + fp))
    pr, rc = F.col("precision"), F.col("TPR")
    return out.withColumn("F1", _ratio(pr * rc * 2, pr + rc))


def compute_metrics(df: DataFrame, by: Sequence[str] = (), rejected: str = "rejected", label: str = "label") -> DataFrame:
    out = rates(confusion(df, by, rejected, label))
    return out.select(*by, *METRICS, *COUNTS)


def power_at_fdr(df: DataFrame, target: float = 0.1) -> DataFrame:
    return df.withColumn("power_at_fdr", F.when(F.col("FDR") <= target, F.col("TPR")).otherwise(F.lit(0.0)))


def summarize(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long-form mean / std (population) / min / max / median of each metric column."""
    pairs = ", ".join(f"'{c}', cast({c} as double)" for c in columns)
    long = df.selectExpr(*by, f"stack({len(columns)}, {pairs}) as (metric, x)")
    keys = [*by, "metric"]
    stats = long.groupBy(*keys).agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")
    )
    # the log may hold very many runs, so the median goes through the bucketed quantiles
    median = exact_quantiles(long, "x", [0.5], keys).select(*keys, F.col("value").alias("median"))
    return stats.join(median, keys)


def compare_methods(df: DataFrame, metric: str, method: str = "method") -> DataFrame:
    return df.groupBy(method).agg(F.avg(metric).alias(f"mean_{metric}"))


def method_means(df: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    return df.groupBy(*by).agg(F.avg("power").alias("power"), F.avg("FDR").alias("FDR"))


def relative_gain(m: Column | str, b: Column | str, zero_base: float | None = None) -> Column:
    """(m - b) / b; for b = 0 infinity if m > 0 else 0, or ``zero_base`` (bar-chart form)."""
    m = F.col(m) if isinstance(m, str) else m
    b = F.col(b) if isinstance(b, str) else b
    on_zero = F.when(m > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)) if zero_base is None else F.lit(zero_base)
    return F.when(b == 0, on_zero).otherwise((m - b) / b)


def calibration(df: DataFrame, nominal: float = 0.1, by: Sequence[str] = ("condition", "method")) -> DataFrame:
    return df.groupBy(*by).agg(F.avg("FDR").alias("mean_fdr"), F.stddev_pop("FDR").alias("std_fdr")).withColumn(
        "nominal", F.lit(nominal)
    )


def separation(df: DataFrame, value: str, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Mean predicted value on signals and nulls and the signal-minus-null difference."""
    out = df.groupBy(*by).agg(
        F.avg(F.when(F.col(label) == 0, F.col(value))).alias("mean_h1"),
        F.avg(F.when(F.col(label) == 1, F.col(value))).alias("mean_h0"),
    )
    return out.withColumn("difference", F.col("mean_h1") - F.col("mean_h0"))


def histogram(df: DataFrame, value: str, bins: int, lo: float, hi: float, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width counts and densities over [lo, hi]; the last bin is closed on the right."""
    width = (hi - lo) / bins
    inside = df.where((F.col(value) >= lo) & (F.col(value) <= hi))
    b = F.least(F.floor((F.col(value) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    out = inside.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(*by) if by else W.partitionBy(F.lit(0)))
    return out.withColumn("density", F.col("n") / total / F.lit(width))


def violations(df: DataFrame, alpha: str = "alpha", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if((F.col(alpha) < 0) | (F.col(alpha) > 1)).alias("n_violations"))


def convergence(df: DataFrame, alpha: str = "alpha", by: Sequence[str] = ("iter",)) -> DataFrame:
    return df.groupBy(*by).agg(
        F.min(alpha).alias("alpha_min"), F.avg(alpha).alias("alpha_mean"), F.max(alpha).alias("alpha_max")
    )


def verdict(df: DataFrame, target: float = 0.1) -> DataFrame:
    """Compare a spatial run with its baseline (columns power, FDR, base_power, base_fdr)."""
    near, far = F.lit(target * 1.1), F.lit(target * 1.5)
    v = (
        F.when((F.col("FDR") <= near) & (F.col("power") > F.col("base_power")), "spatial")
        .when((F.col("base_fdr") <= near) & (F.col("base_power") > F.col("power")), "baseline")
        .when((F.col("FDR") > far) & (F.col("base_fdr") > far), "both fail")
        .otherwise("mixed")
    )
    return df.withColumn("verdict", v)
