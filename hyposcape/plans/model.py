"""Estimator facade: fit a smooth null-probability model to all rows over a bounded set of centres, apply it to any rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clip, expit, local_fdr
from ..operators import centred, density, kernels, sampling, testing
from ..operators.kernels import Kernel, Points
from ..operators.solver import GLOBAL_PRESETS, PRESETS, GlobalConfig, SolverConfig
from ..session import cut_lineage


@dataclass(frozen=True)
class SpatialNullEstimator:
    """``fit`` learns alpha(x) from rows (id, v, p); ``density`` is 'gaussian_shift' or 'empirical_null'.

    ``n_centres`` rows in hash order are the kernel centres, a model parameter; every row enters the likelihood.  ``config``
    names the objective; it is minimised by Newton steps of two linear passes until the loss is within 1e-10 of its least value (more than
    ``guard`` steps raise), or with ``guard`` = None by the step method and iterations of ``config``.
    """

    kernel: Kernel = Kernel("matern", 1.0, 1.5)
    config: SolverConfig = PRESETS["facade"]
    n_centres: int = 500
    guard: int | None = 100
    sigma_factor: float | None = None
    density: str = "gaussian_shift"
    global_config: GlobalConfig = GLOBAL_PRESETS["facade"]

    def with_densities(self, df: DataFrame) -> DataFrame:
        if self.density == "gaussian_shift":
            return density.with_gaussian_shift(df, by=[])
        if self.density == "empirical_null":
            return density.with_empirical_null(df)
        raise ValueError(f"unknown density {self.density!r}")

    def fit(self, df: DataFrame, entire_domain: bool = False) -> SpatialNullModel:
        """Train on all rows that have features and densities; with ``entire_domain`` Stage 2 follows."""
        known = F.col("v").isNotNull() & ~F.isnan(F.coalesce("f0", F.lit(float("nan")))) & ~F.isnan(F.coalesce("f1", F.lit(float("nan"))))
        rows = cut_lineage(self.with_densities(df).where(known).select("id", "v", "f0", "f1"))
        drawn = cut_lineage(sampling.subsample(rows.select("id", "v"), self.n_centres))
        kernel = self.kernel
        if self.sigma_factor is not None:
            scale = kernels.median_length_scale(Points.pack(drawn)) * self.sigma_factor
            kernel = Kernel(kernel.kind, scale, kernel.nu)
        cfg = self.config if self.guard is None else centred.by_newton(self.config, self.guard)
        centres = centred.fit_stage1(rows, drawn, kernel, cfg).frame(df.sparkSession)
        stage2 = None
        if entire_domain:
            at = kernels.cross_apply(rows.select("v", F.col("v").alias("x")), centres.withColumnRenamed("v", "x"), kernel, ["c"], "x")
            at = cut_lineage(at.select("v", clip("k_c", 0.0, 1.0).alias("alpha")))
            stage2 = centred.fit_stage2(at, drawn, kernel, self.global_config).frame(df.sparkSession)
        return SpatialNullModel(self, kernel, centres, stage2)


@dataclass(frozen=True)
class SpatialNullModel:
    """Fitted model: kernel, training centres with coefficients, optional Stage-2 coefficients."""

    estimator: SpatialNullEstimator
    kernel: Kernel
    centres: DataFrame
    stage2: DataFrame | None = None

    def predict_alpha(self, df: DataFrame) -> DataFrame:
        """Null probability at any locations (id, v, ...): linear and clipped, or through the sigmoid after Stage 2."""
        source = self.centres if self.stage2 is None else self.stage2
        out = kernels.cross_apply(df, source, self.kernel, ["c"])
        alpha = clip("k_c", 0.0, 1.0) if self.stage2 is None else expit("k_c")
        return out.withColumn("alpha_null", alpha).drop("k_c")

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``alpha_null``, ``f0``, ``f1`` and ``lfdr`` to all rows."""
        rows = self.predict_alpha(self.estimator.with_densities(df))
        return rows.withColumn("lfdr", local_fdr("alpha_null", "f0", "f1"))

    def reject(self, df: DataFrame, fdr_level: float = 0.1, rule: str = "step_up") -> DataFrame:
        """Decisions for all rows by the running-mean step-up or the plain local-FDR threshold."""
        scored = cut_lineage(self.transform(df))
        if rule == "step_up":
            return testing.lfdr_step_up(scored, level=fdr_level)
        if rule == "threshold":
            return testing.local_fdr_rule(scored, level=fdr_level)
        raise ValueError(f"unknown rule {rule!r}")
