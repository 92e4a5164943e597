"""Experiment flows: replicated evaluation, Euclidean cross-validated run, all-space prediction, sensitivity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clip, expit, hash_uniform, local_fdr
from ..operators import centred, clustering, density, features, kernels, metrics, sampling, testing, tuning
from ..operators.kernels import Kernel
from ..operators.ordered import attach, hash_take
from ..operators.solver import GLOBAL_PRESETS, GlobalConfig, SolverConfig, fit_pointwise
from ..session import cut_lineage


def replicates(
    points: DataFrame, strengths: Sequence[str], effect: str, reps: int, n_samples: int, group: str = "group_id"
) -> DataFrame:
    """Evaluation sets side by side: (condition, seed, id, v, label, p), each a fresh sample with fresh labels.

    One pass draws the row keys of all replicates; only the drawn rows (n_samples * reps of them) meet the features
    again, and the conditions are unfolded on those.
    """
    signal = sampling.signal_groups(points, group).withColumn("is_signal", F.lit(True))
    seeds = points.select("id").withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    seeds = seeds.withColumn("key", F.concat_ws("|", F.col("id").cast("string"), F.col("seed").cast("string")))
    drawn = hash_take(seeds, "key", "rep", n_samples, ["seed"])
    rows = points.select("id", "v", group).join(drawn, "id")
    rows = attach(rows, cut_lineage(signal), [group], "left").withColumn("is_signal", F.coalesce("is_signal", F.lit(False)))
    table = F.array(*[
        F.struct(F.lit(s).alias("condition"), *[F.lit(x).alias(n) for n, x in zip(("inside", "outside"), sampling.CLUSTER_STRENGTH[s])])
        for s in strengths
    ])
    rows = cut_lineage(rows).select("*", F.inline(table))
    null_prob = F.when(F.col("is_signal"), F.col("inside")).otherwise(F.col("outside"))
    cell = F.concat_ws("|", "key", "condition")
    rows = rows.withColumn("label", F.when(hash_uniform(cell, "label") < null_prob, 1).otherwise(0).cast("int"))
    return sampling.p_values(rows, effect, key="key").select("condition", "seed", "id", "v", "label", "p")


def evaluate_sets(sets: DataFrame, kernel: Kernel, cfg: SolverConfig, level: float = 0.1, by: Sequence[str] = ("condition", "seed"), sigma_factor: float | None = None) -> DataFrame:
    """Baseline and spatial method on every set; one metrics row per (set, method)."""
    by = list(by)
    base = cut_lineage(density.with_gaussian_shift(sets, by=by))
    bh = testing.benjamini_hochberg(base.drop("v"), by=by, level=level).select(*by, "id", "label", "rejected")
    alpha = fit_pointwise(base, kernel, cfg, by, sigma_factor).select(*by, "id", "alpha", "f0", "f1")
    scored = alpha.join(base.select(*by, "id", "label"), [*by, "id"]).withColumn("lfdr", local_fdr("alpha", "f0", "f1"))
    spatial = testing.local_fdr_rule(cut_lineage(scored), level=level).select(*by, "id", "label", "rejected")
    runs = bh.withColumn("method", F.lit("baseline")).unionByName(spatial.withColumn("method", F.lit("spatial")))
    return metrics.compute_metrics(runs, ["method", *by])


def lambda_sensitivity(sets: DataFrame, kernel: Kernel, cfg: SolverConfig, lambdas: Sequence[float]) -> DataFrame:
    """Power and FDR of the spatial method over replicates for each regularisation value."""


    grid = sets.withColumn("lambda_reg", F.explode(F.array(*[F.lit(float(x)) for x in lambdas])))
    runs = evaluate_sets(cut_lineage(grid), kernel, cfg, by=("lambda_reg", "condition", "seed"))
    return tuning.sensitivity(runs.where("method = 'spatial'"))


def structural_run(
    points: DataFrame, kernel: Kernel, cfg: SolverConfig, effects: Sequence[str] = ("weak", "medium", "strong"), n_total: int = 500,
    group: str = "group_id", level: float = 0.1,
) -> DataFrame:
    """Mixed cluster sample, one dataset an effect size, both methods on the same rows: a log row per (dataset, method) and,
    as dataset 'all', the means over the datasets."""
    rows = points.select("id", F.col(group).alias("cluster"))
    sample = clustering.mixed_cluster_sample(rows, n_total).select("id", "label").join(points.select("id", "v"), "id")
    sample = cut_lineage(sample)
    sets = None
    for effect in effects:
        one = sampling.p_values(sample, effect).withColumn("dataset", F.lit(effect))
        sets = one if sets is None else sets.unionByName(one)
    runs = cut_lineage(evaluate_sets(sets, kernel, cfg, level, ["dataset"]).select("dataset", "method", "power", "FDR"))
    return runs.unionByName(metrics.method_means(runs).withColumn("dataset", F.lit("all")))


def euclidean_design(points: DataFrame, targets: Sequence[int], min_size: int, effect: str = "medium", pool: int = 10000, seed: int = 42) -> DataFrame:
    """Standardise, draw the candidate pool, pick Ward clusters, assign labels and p-values: (dataset, id, v, group_id,
    label, p)."""
    std = features.standardize(points.select("id", "v"))
    drawn = cut_lineage(sampling.candidate_pool(std, pool).withColumn("dataset", F.lit("pool")))
    design = clustering.hierarchical_design(drawn, targets, min_size)
    rows = design.join(drawn, ["dataset", "id"])
    return sampling.p_values(rows, effect, "bench_cv", seed=seed).select("dataset", "id", "v", "group_id", "label", "p")


def euclidean_cv(design: DataFrame, sigmas: Sequence[float], cfg: SolverConfig, folds: int = 5, level: float = 0.1) -> DataFrame:
    """Cross-validate the kernel width, refit with the best, decide by the running-mean step-up."""
    data = cut_lineage(density.with_gaussian_shift(design, by=["dataset"], cap=2000.0, unit_sigma=True))
    data = cut_lineage(sampling.k_folds(data, folds, by=["dataset"]))
    scores = tuning.cross_validate(data, {"sigma_factor": sigmas}, Kernel("rbf"), cfg)
    best = tuning.best_by_nll(tuning.summarise_folds(scores)).select("dataset", "sigma_factor")
    out = fit_pointwise(data.join(best, "dataset"), Kernel("rbf"), cfg, by=("dataset", "sigma_factor"))
    scored = out.withColumn("lfdr", local_fdr("alpha", "f0", "f1", floor=None))
    rows = scored.join(data.select("dataset", "id", "group_id", "label", "p"), ["dataset", "id"])
    return testing.lfdr_step_up(cut_lineage(rows), by=["dataset"], level=level)


def allspace(
    train: DataFrame, everywhere: DataFrame, kernel: Kernel, cfg: SolverConfig, stage2: GlobalConfig = GLOBAL_PRESETS["allspace"],
    n_centres: int = 500, guard: int = 100,
) -> DataFrame:
    """Stage 1 and Stage 2 on all training rows (id, v, f0, f1) over ``n_centres`` of them, then the null probability at
    every location of ``everywhere``."""
    rows = cut_lineage(train.select("id", "v", "f0", "f1"))
    drawn = cut_lineage(sampling.subsample(rows.select("id", "v"), n_centres))
    first = centred.fit_stage1(rows, drawn, kernel, centred.by_newton(cfg, guard)).frame(train.sparkSession)
    at = kernels.cross_apply(rows.select("v", F.col("v").alias("x")), first.withColumnRenamed("v", "x"), kernel, ["c"], "x")
    at = cut_lineage(at.select("v", clip("k_c", 0.0, 1.0).alias("alpha")))
    coef = centred.fit_stage2(at, drawn, kernel, stage2, guard).frame(train.sparkSession)
    out = kernels.cross_apply(everywhere, coef, kernel, ["c"])
    return out.withColumn("alpha_null", expit("k_c")).drop("k_c")


def square_experiment(ids: DataFrame, n_centres: int = 400, steps: int = 100, length_scale: float = 0.2) -> DataFrame:
    """Unit-square check: noisy Stage-1 values at every row, Stage 2, prediction on a regular grid with the true value."""
    data = sampling.noisy_alpha(sampling.square_data(ids))
    width = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))  # a stored table of few row groups would keep most cores idle
    train = cut_lineage(data.select("id", F.array("x", "y").alias("v"), "alpha").repartition(width, "id"))
    kernel = Kernel("rbf", length_scale)
    drawn = cut_lineage(sampling.subsample(train.select("id", "v"), n_centres))
    coef = centred.fit_stage2(train.select("v", "alpha"), drawn, kernel, GLOBAL_PRESETS["allspace"]).frame(ids.sparkSession)
    grid = sampling.prediction_grid(ids.sparkSession, steps)
    truth = F.when((F.col("x") > 0.5) & (F.col("y") > 0.5), 0.1).otherwise(0.9)
    grid = grid.withColumn("alpha_true", truth).withColumn("v", F.array("x", "y"))
    return kernels.cross_apply(grid, coef, kernel, ["c"]).withColumn("alpha_null", expit("k_c")).drop("k_c")
