"""Cross-validation and hyper-parameter search: every (dataset, setting, fold) is its own task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kernels import Kernel, distances
from .solver import PRESETS, SolverConfig, check_bounded, descend, median_of

GRID = ("lambda_reg", "lambda_bound", "learning_rate", "gradient_clip", "sigma_factor")

# The hyper-parameter search of 144 settings.
FULL_GRID = {
    "lambda_reg": [0.001, 0.004, 0.01, 0.05],
    "lambda_bound": [10.0, 50.0, 100.0, 500.0],
    "learning_rate": [0.005, 0.01, 0.02],
    "gradient_clip": [5.0, 10.0, 20.0],
}

# Kernel widths in median distances, penalties of the sensitivity run.
WIDTHS = (0.1, 0.2, 0.3, 0.5, 0.8, 1.0, 1.5, 2.0)
PENALTIES = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0)


def settings(spark, grid: dict[str, Sequence[float]]) -> DataFrame:
    """Cartesian product of the given value lists as a small relation with a setting number."""
    unknown = set(grid) - set(GRID)
    if unknown:
        raise ValueError(f"unknown hyper-parameters {sorted(unknown)}")
    names = list(grid)
    rows = [(i, *map(float, combo)) for i, combo in enumerate(product(*grid.values()))]
    return spark.createDataFrame(rows, "setting int, " + ", ".join(f"{n} double" for n in names))


def cross_validate(
    df: DataFrame,
    grid: dict[str, Sequence[float]],
    kernel: Kernel,
    cfg: SolverConfig = PRESETS["fold"],
    by: Sequence[str] = ("dataset",),
    limit: int = 5000,
) -> DataFrame:
    """Held-out scores per (dataset, setting, fold): ``loglik`` (alpha as it is, floor 1e-10), ``nll`` (alpha clipped to
    [0, 1], floor 1e-12) and ``violations``.  ``df``: (by, id, v, f0, f1, fold), a bounded training sample.

    With ``sigma_factor`` in the grid the length scale is that multiple of the dataset's median distance.
    """
    check_bounded(df, by, limit)
    spark = df.sparkSession
    grid_df = settings(spark, grid)
    names = list(grid)
    combos = grid_df.agg(F.array_sort(F.collect_list(F.struct("setting", *names))).alias("combos"))
    folds = df.groupBy(*by).agg(F.array_sort(F.collect_set("fold")).alias("folds"))
    tasks = folds.select(*by, F.explode("folds").alias("held")).withColumn("combos", combos.scalar())
    tasks = tasks.select(*by, "held", F.inline("combos"))
    # the bounded sample is copied once per task row
    rows = df.select(*by, "id", "v", "f0", "f1", "fold").join(tasks, list(by))
    keys = [*by, "setting", "held"]

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        first = pdf.iloc[0]
        x = np.stack([np.asarray(v, dtype=float) for v in pdf["v"]])
        d = distances(x, x, True)
        hp = {n: float(first[n]) for n in names}
        factor = hp.pop("sigma_factor", None)
        k = (kernel if factor is None else replace(kernel, length_scale=median_of(d) * factor)).of_distance(d)
        te = (pdf.fold == pdf.held).to_numpy()
        f0, f1 = pdf.f0.to_numpy(), pdf.f1.to_numpy()
        c, _ = descend(k[np.ix_(~te, ~te)], f0[~te], f1[~te], replace(cfg, **hp))
        a = k[np.ix_(te, ~te)] @ c
        cut = np.clip(a, 0, 1)
        loglik = np.log(np.maximum(a * f0[te] + (1 - a) * f1[te], 1e-10)).sum()
        nll = -np.log(np.maximum(cut * f0[te] + (1 - cut) * f1[te], 1e-12)).sum()
        row = {**{b: first[b] for b in by}, "setting": int(first.setting), **{n: float(first[n]) for n in names}}
        return pd.DataFrame([{**row, "fold": int(first.held), "loglik": loglik, "nll": nll, "violations": int(((a < 0) | (a > 1)).sum())}])

    kt = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by)
    schema = f"{kt}, setting int, " + ", ".join(f"{n} double" for n in names) + ", fold int, loglik double, nll double, violations int"
    return rows.groupBy(*keys).applyInPandas(score, schema)


def summarise_folds(scores: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Mean and population deviation over folds, one row per (dataset, setting)."""
    params = [c for c in scores.columns if c in GRID]
    return scores.groupBy(*by, "setting", *params).agg(
        F.avg("loglik").alias("mean_loglik"),
        F.stddev_pop("loglik").alias("std_loglik"),
        F.avg("nll").alias("mean_nll"),
        F.avg("violations").alias("mean_violations"),
    )


def best_setting(summary: DataFrame, by: Sequence[str] = ("dataset",), max_violations: float = 5.0) -> DataFrame:
    """Highest held-out likelihood among settings with few violations, else the highest overall; first setting on ties."""
    w = W.partitionBy(*by).orderBy(
        (F.col("mean_violations") <= max_violations).desc(), F.col("mean_loglik").desc(), F.col("setting")
    )
    return summary.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def best_by_nll(summary: DataFrame, by: Sequence[str] = ("dataset",), score: str = "mean_nll", order: str = "setting") -> DataFrame:
    """Lowest held-out negative log-likelihood; first in grid order on ties."""
    rest = [c for c in summary.columns if c not in by]
    best = summary.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(score, order)).alias("_s"))
    return best.select(*by, "_s.*")


def sensitivity(runs: DataFrame, parameter: str = "lambda_reg") -> DataFrame:
    """Mean and deviation of power and FDR over replicates for each value of a parameter."""
    return runs.groupBy(parameter).agg(
        *[
            f(c).alias(f"{n}_{c.lower()}")
            for c in ("power", "FDR")
            for n, f in (("mean", F.avg), ("std", F.stddev_pop))
        ]
    )
