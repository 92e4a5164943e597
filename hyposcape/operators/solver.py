"""Stage 1 (point-wise null probability) and Stage 2 (kernel logistic regression).

Training sets come from a sampler and are bounded, so each (dataset, setting, fold) is one grouped task.  A
training set beyond ``dense_limit`` goes through the distributed kernel instead (``fit_blocks``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clip, expit, mixture
from ..session import cut_lineage
from .kernels import BlockKernel, Kernel, Points, distances

DENSE_LIMIT = 10000


@dataclass(frozen=True)
class SolverConfig:
    """Settings of the descent; ``method`` is 'constant', 'adaptive', 'adam' or 'lbfgs'."""

    lambda_reg: float = 10.0
    lambda_bound: float = 500.0
    learning_rate: float = 0.0005
    max_iter: int = 5000
    tol: float = 1e-6
    gradient_clip: float = 5.0
    c_init: str | float = "auto"
    log_interval: int = 50
    floor: float = 1e-12
    method: str = "constant"
    seed: int = 42

    def to_dict(self) -> dict:
        return asdict(self)


# Named settings.
PRESETS = {
    "default": SolverConfig(),
    "euclidean_cv": SolverConfig(),
    "graph_gsea": SolverConfig(learning_rate=0.05, max_iter=15000),
    "graph_allspace": SolverConfig(learning_rate=0.005, max_iter=10000),
    "fast_tuning": SolverConfig(learning_rate=0.001, max_iter=2000),
    "facade": SolverConfig(
        lambda_reg=0.05, learning_rate=0.01, gradient_clip=10.0, floor=1e-10, c_init="random", method="adaptive", max_iter=1000
    ),
    "single_run": SolverConfig(c_init=0.005, learning_rate=0.02, method="adam"),
    "synthetic": SolverConfig(lambda_reg=0.1, learning_rate=0.001, gradient_clip=10.0, max_iter=15000, c_init="random"),
    "fold": SolverConfig(c_init="zeros", floor=1e-10, tol=0.0),
}


def make_config(preset: str = "default", **overrides) -> SolverConfig:
    """Preset with overrides; unknown presets or fields are errors."""
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}; one of {sorted(PRESETS)}")
    return replace(PRESETS[preset], **overrides)


def loss_of(c, k, f0, f1, cfg: SolverConfig) -> float:
    a = k @ c
    fit = -np.log(np.maximum(a * f0 + (1 - a) * f1, cfg.floor)).sum()
    bound = (np.maximum(0, a - 1) ** 2 + np.maximum(0, -a) ** 2).sum()
    return float(fit + cfg.lambda_reg * (c @ a) + cfg.lambda_bound * bound)


def gradient_of(c, a, f0, f1, cfg: SolverConfig) -> np.ndarray:
    """Natural gradient: the kernel factor of the true gradient is left out."""
    mix = np.maximum(a * f0 + (1 - a) * f1, cfg.floor)
    edge = np.maximum(0, a - 1) - np.maximum(0, -a)
    return (f1 - f0) / mix + 2 * cfg.lambda_reg * c + 2 * cfg.lambda_bound * edge


def start_of(k, cfg: SolverConfig) -> np.ndarray:
    n = len(k)
    if cfg.c_init == "auto":
        return np.full(n, 1.0 / ((k @ np.ones(n)).mean() + 1e-10))
    if cfg.c_init == "zeros":
        return np.zeros(n)
    if cfg.c_init == "random":
        return np.random.default_rng(cfg.seed).uniform(-1, 1, n)
    if isinstance(cfg.c_init, (int, float)):
        return np.full(n, float(cfg.c_init))
    raise ValueError(f"unknown c_init {cfg.c_init!r}")


def descend(k, f0, f1, cfg: SolverConfig):
    """Minimise the Stage-1 objective; returns coefficients and logged (iter, loss, grad_norm, violations, alpha range)."""
    c, lr, log = start_of(k, cfg), cfg.learning_rate, []
    if cfg.method == "lbfgs":
        return lbfgs(lambda x: loss_of(x, k, f0, f1, cfg), lambda x: k @ gradient_of(x, k @ x, f0, f1, cfg), np.zeros(len(k)), cfg), log
    m1, m2 = np.zeros_like(c), np.zeros_like(c)
    for t in range(cfg.max_iter):
        a = k @ c
        if cfg.method == "adam":
            a = np.clip(a, -0.1, 1.1)
        g = gradient_of(c, a, f0, f1, cfg)
        norm = float(np.linalg.norm(g))
        if t % cfg.log_interval == 0:
            log.append((t, loss_of(c, k, f0, f1, cfg), norm, int(((a < 0) | (a > 1)).sum()), a.min(), a.mean(), a.max()))
        if norm < cfg.tol and t > 100:
            break
        if norm > cfg.gradient_clip:
            g = g * (cfg.gradient_clip / norm)
        if cfg.method == "adam":
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
            c = c - lr * (m1 / (1 - 0.9 ** (t + 1))) / (np.sqrt(m2 / (1 - 0.999 ** (t + 1))) + 1e-8)
        elif cfg.method == "adaptive":
            trial = c - lr * g
            better = loss_of(trial, k, f0, f1, cfg) < loss_of(c, k, f0, f1, cfg)
            c, lr = (trial, min(lr * 1.1, 0.1)) if better else (c, max(lr * 0.5, 1e-6))
        else:
            c = c - lr * g
    return c, log


def descend_grid(k, f0, f1, cfg: SolverConfig, lambdas: Sequence[float]) -> np.ndarray:
    """Coefficients for every ``lambda_reg`` side by side, one column each: the kernel is read once a step for all of them."""
    if cfg.method != "constant":
        return np.column_stack([descend(k, f0, f1, replace(cfg, lambda_reg=float(v)))[0] for v in lambdas])
    lam = np.asarray(lambdas, dtype=float)
    c = np.repeat(start_of(k, cfg)[:, None], len(lam), axis=1)
    f0, f1, live = f0[:, None], f1[:, None], np.arange(len(lam))
    for t in range(cfg.max_iter):
        now = c[:, live]
        a = k @ now
        edge = np.maximum(0, a - 1) - np.maximum(0, -a)
        g = (f1 - f0) / np.maximum(a * f0 + (1 - a) * f1, cfg.floor) + 2 * lam[live] * now + 2 * cfg.lambda_bound * edge
        norm = np.sqrt((g * g).sum(0))
        go = (norm >= cfg.tol) if t > 100 else np.ones(len(live), dtype=bool)
        step = cfg.learning_rate * np.where(norm > cfg.gradient_clip, cfg.gradient_clip / np.maximum(norm, 1e-300), 1.0)
        c[:, live[go]] = (now - step * g)[:, go]
        live = live[go]
        if not len(live):
            break
    return c


def lbfgs(loss, grad, x, cfg: SolverConfig, memory: int = 10):
    """Limited-memory quasi-Newton with backtracking."""
    s_list, y_list, g, f = [], [], grad(x), loss(x)
    for _ in range(cfg.max_iter):
        q, alphas = g.copy(), []
        for s, y in zip(reversed(s_list), reversed(y_list)):
            alphas.append((s @ q) / (s @ y))
            q = q - alphas[-1] * y
        if s_list:
            q = q * (s_list[-1] @ y_list[-1]) / (y_list[-1] @ y_list[-1])
        for s, y, al in zip(s_list, y_list, reversed(alphas)):
            q = q + s * (al - (y @ q) / (s @ y))
        slope, step = -(g @ q), 1.0 if s_list else min(1.0, 1.0 / (np.linalg.norm(g) + 1e-12))
        while step > 1e-14 and not loss(x - step * q) <= f + 1e-4 * step * slope:
            step *= 0.5
        new = x - step * q
        fn, gn = loss(new), grad(new)
        if step <= 1e-14 or abs(f - fn) <= cfg.tol * max(1.0, abs(f)):
            return new if fn < f else x
        if (gn - g) @ (new - x) > 1e-12:
            s_list, y_list = [*s_list, new - x][-memory:], [*y_list, gn - g][-memory:]
        x, g, f = new, gn, fn
    return x


@dataclass(frozen=True)
class GlobalConfig:
    """Stage-2 settings: ``premultiply`` uses K times the natural gradient, ``adaptive`` accepts only falling losses."""

    lambda_global: float = 0.1
    learning_rate: float = 0.005
    max_iter: int = 2000
    tol: float = 1e-5
    gradient_clip: float | None = 5.0
    clip_lo: float = 0.01
    clip_hi: float = 0.99
    ridge: float = 0.01
    premultiply: bool = False
    adaptive: bool = False
    clip_target: bool = True
    warm_start: bool = True


# Named Stage-2 settings.
GLOBAL_PRESETS = {
    "euclidean": GlobalConfig(),
    "graph": GlobalConfig(lambda_global=0.5),
    "facade": GlobalConfig(learning_rate=0.1, ridge=0.0, adaptive=True, gradient_clip=None),
    "allspace": GlobalConfig(ridge=1e-6, clip_target=False),
    "graph_allspace": GlobalConfig(lambda_global=0.5, ridge=1e-4, premultiply=True, gradient_clip=None),
}


def global_loss(c, k, target, lam) -> float:
    g = np.clip(k @ c, -500, 500)
    s = np.clip(1 / (1 + np.exp(-g)), 1e-12, 1 - 1e-12)
    return float(-(target * np.log(s) + (1 - target) * np.log(1 - s)).sum() + lam * (c @ (k @ c)))


def fit_global(k, alpha, cfg: GlobalConfig):
    """Kernel logistic regression on Stage-1 probabilities."""
    clipped = np.clip(alpha, cfg.clip_lo, cfg.clip_hi)
    target = clipped if cfg.clip_target else np.asarray(alpha, dtype=float)
    c = np.zeros(len(k))
    if cfg.warm_start:
        try:
            c = np.linalg.solve(k + cfg.ridge * np.eye(len(k)), np.log(clipped / (1 - clipped)))
        except np.linalg.LinAlgError:
            c = np.zeros(len(k))
    lr = cfg.learning_rate
    for _ in range(cfg.max_iter):
        s = 1 / (1 + np.exp(-np.clip(k @ c, -500, 500)))
        g = (s - target) + 2 * cfg.lambda_global * c
        g = k @ g if cfg.premultiply else g
        norm = float(np.linalg.norm(g))
        if norm < cfg.tol:
            break
        if cfg.gradient_clip and norm > cfg.gradient_clip:
            g = g * (cfg.gradient_clip / norm)
        trial = c - lr * g
        if not cfg.adaptive:
            c = trial
        elif global_loss(trial, k, target, cfg.lambda_global) < global_loss(c, k, target, cfg.lambda_global):
            c, lr = trial, min(lr * 1.1, 0.5)
        else:
            lr = max(lr * 0.5, 1e-6)
    return c


def median_of(d: np.ndarray) -> float:
    return float(np.median(d[np.triu_indices(len(d), 1)]))


def gram(pdf: pd.DataFrame, kernel: Kernel, sigma_factor: float | None, jitter: float = 0.0) -> np.ndarray:
    """Dense kernel of one bounded group; ``sigma_factor`` scales the group's median distance."""
    x = np.stack([np.asarray(v, dtype=float) for v in pdf["v"]])
    d = distances(x, x, True)
    k = kernel if sigma_factor is None else replace(kernel, length_scale=median_of(d) * sigma_factor)
    return k.of_distance(d) + jitter * np.eye(len(d))


def check_bounded(df: DataFrame, by: Sequence[str], limit: int) -> None:
    """Refuse to hand a group beyond the limit to one task."""
    big = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).limit(5).collect()
    if big:
        raise ValueError(f"groups above {limit} rows need the distributed fit or a sampler first: {big}")


def fit_pointwise(
    df: DataFrame,
    kernel: Kernel,
    cfg: SolverConfig = PRESETS["default"],
    by: Sequence[str] = ("dataset",),
    sigma_factor: float | None = None,
    jitter: float = 1e-6,
    dense_limit: int = DENSE_LIMIT,
) -> DataFrame:
    """Stage 1 per dataset: (by, id, v, f0, f1) -> adds ``c``, ``alpha`` (clipped to [0, 1]) and ``alpha_raw``.

    Group columns named like a solver setting (``lambda_reg`` ...) or ``sigma_factor`` override that setting for
    their group, so a whole grid runs side by side.
    """
    check_bounded(df, by, dense_limit)
    own = [b for b in by if b in {f.name for f in fields(SolverConfig)}]
    cols = [*by, "id", "v", "f0", "f1"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        first = pdf.iloc[0]
        k = gram(pdf, kernel, float(first.sigma_factor) if "sigma_factor" in by else sigma_factor, jitter)
        conf = replace(cfg, **{b: float(first[b]) for b in own})
        c, _ = descend(k, pdf.f0.to_numpy(), pdf.f1.to_numpy(), conf)
        a = k @ c
        return pdf.drop(columns="v").assign(c=c, alpha_raw=a, alpha=np.clip(a, 0, 1))

    sub = df.select(*cols)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sub.schema if f.name != "v")
    return sub.groupBy(*by).applyInPandas(fit, schema + ", c double, alpha_raw double, alpha double")


def fit_history(df: DataFrame, kernel: Kernel, cfg: SolverConfig, by: Sequence[str] = ("dataset",), sigma_factor: float | None = None) -> DataFrame:
    """Optimiser log per dataset: iteration, loss, gradient norm, violations, range of alpha."""
    check_bounded(df, by, DENSE_LIMIT)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        _, log = descend(gram(pdf, kernel, sigma_factor), pdf.f0.to_numpy(), pdf.f1.to_numpy(), cfg)
        out = pd.DataFrame(log, columns=["iter", "loss", "grad_norm", "violations", "alpha_min", "alpha_mean", "alpha_max"])
        for b in by:
            out[b] = pdf[b].iloc[0]
        return out

    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)
    schema = keys + ", iter int, loss double, grad_norm double, violations int, alpha_min double, alpha_mean double, alpha_max double"
    return df.select(*by, "id", "v", "f0", "f1").groupBy(*by).applyInPandas(fit, schema)


def fit_stage2(
    df: DataFrame, kernel: Kernel, cfg: GlobalConfig, by: Sequence[str] = ("dataset",), sigma_factor: float | None = None
) -> DataFrame:
    """Stage 2 per dataset: (by, id, v, alpha) -> coefficients ``c`` and fitted ``alpha_global``."""
    check_bounded(df, by, DENSE_LIMIT)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        k = gram(pdf, kernel, sigma_factor)
        c = fit_global(k, pdf.alpha.to_numpy(), cfg)
        return pdf.drop(columns="v").assign(c=c, alpha_global=1 / (1 + np.exp(-np.clip(k @ c, -500, 500))))

    sub = df.select(*by, "id", "v", "alpha")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sub.schema if f.name != "v")
    return sub.groupBy(*by).applyInPandas(fit, schema + ", c double, alpha_global double")


def predictive_std(df: DataFrame, train: DataFrame, kernel: Kernel, lam: float, max_train: int = 2000) -> DataFrame:
    """Laplace-style deviation of the Stage-2 prediction: sqrt of the diagonal of K** - K* (K + lam I)^-1 K*^T, carried
    through the sigmoid.  ``df``: (id, v, g); the bounded training set travels to the tasks."""
    t = train.select("id", "v").limit(max_train + 1).toPandas()
    if len(t) > max_train:
        raise ValueError("training set too large for the dense posterior; sample it first")
    x = np.stack([np.asarray(v, dtype=float) for v in t["v"]])
    chol = np.linalg.cholesky(kernel.of_distance(distances(x, x, True)) + lam * np.eye(len(x)))

    def run(batches):
        for pdf in batches:
            if len(pdf):
                xs = np.stack([np.asarray(v, dtype=float) for v in pdf["v"]])
                w = np.linalg.solve(chol, kernel.of_distance(distances(xs, x, False)).T)
                var = np.maximum(1.0 - (w * w).sum(axis=0), 1e-6)
                s = 1 / (1 + np.exp(-np.clip(pdf["g"].to_numpy(), -500, 500)))
                yield pd.DataFrame({"id": pdf["id"], "alpha": s, "alpha_std": s * (1 - s) * np.sqrt(var)})

    return df.select("id", "v", "g").mapInPandas(run, "id bigint, alpha double, alpha_std double")


# --- distributed form: the same formulas as Column expressions over (id, f0, f1, c) and K c ---


def gradient_column(cfg: SolverConfig, alpha: str = "alpha") -> Column:
    a = F.col(alpha)
    edge = F.greatest(F.lit(0.0), a - 1) - F.greatest(F.lit(0.0), -a)
    pull = (F.col("f1") - F.col("f0")) / mixture(a, "f0", "f1", cfg.floor)
    return pull + F.col("c") * (2 * cfg.lambda_reg) + edge * (2 * cfg.lambda_bound)


def stage1_loss(state: DataFrame, cfg: SolverConfig, alpha: str = "alpha") -> DataFrame:
    """Loss terms of Stage 1 for rows (f0, f1, c, alpha)."""
    a = F.col(alpha)
    over, under = F.greatest(F.lit(0.0), a - 1), F.greatest(F.lit(0.0), -a)
    out = state.agg(
        F.sum(-F.log(mixture(a, "f0", "f1", cfg.floor))).alias("fit"),
        (F.sum(F.col("c") * a) * cfg.lambda_reg).alias("penalty"),
        (F.sum(over * over + under * under) * cfg.lambda_bound).alias("bound"),
        F.count_if(a * F.col("f0") + (1 - a) * F.col("f1") <= cfg.floor).alias("n_floored"),
    )
    return out.withColumn("loss", F.col("fit") + F.col("penalty") + F.col("bound"))


def stage2_loss(state: DataFrame, lam: float) -> DataFrame:
    """Stage-2 loss and gradient norm for rows (target, c, g = K c)."""
    s = expit("g")
    safe = clip(s, 1e-12, 1 - 1e-12)
    t = F.col("target")
    grad = (s - t) + F.col("c") * (2 * lam)
    return state.agg(
        (F.sum(-(t * F.log(safe) + (1 - t) * F.log(1 - safe))) + F.sum(F.col("c") * F.col("g")) * lam).alias("loss"),
        F.sqrt(F.sum(grad * grad)).alias("grad_norm"),
    )


def fit_blocks(
    df: DataFrame, kernel: Kernel, cfg: SolverConfig, jitter: float = 0.0, points: Points | None = None
) -> DataFrame:
    """Stage 1 over a training set of any size: constant-step natural gradient with a distributed kernel.

    Coefficients stay in a relation; only the gradient norm reaches the driver.  Every step is checkpointed.
    """
    if cfg.method != "constant":
        raise ValueError("the distributed fit runs the constant-step method")
    pts = points or Points.pack(df.select("id", "v"))
    bk = BlockKernel.build(pts, kernel, jitter)
    base = df.select("id", "f0", "f1")
    if cfg.c_init == "auto":
        ones = bk.matvec(base.select("id", F.lit(1.0).alias("y")))
        start = 1.0 / (ones.agg(F.avg("y")).first()[0] + 1e-10)
    elif cfg.c_init == "zeros":
        start = 0.0
    elif isinstance(cfg.c_init, (int, float)):
        start = float(cfg.c_init)
    else:
        raise ValueError(f"c_init {cfg.c_init!r} is not available in the distributed fit")
    state = cut_lineage(base.withColumn("c", F.lit(start)))
    for t in range(cfg.max_iter):
        alpha = bk.matvec(state.select("id", F.col("c").alias("y"))).withColumnRenamed("y", "alpha")
        step = cut_lineage(state.join(alpha, "id").withColumn("g", gradient_column(cfg)))
        norm = math.sqrt(step.agg(F.sum(F.col("g") * F.col("g"))).first()[0])
        if norm < cfg.tol and t > 100:
            break
        rate = cfg.learning_rate * min(1.0, cfg.gradient_clip / norm if norm else 1.0)
        state = step.select("id", "f0", "f1", (F.col("c") - F.col("g") * rate).alias("c"))
    alpha = bk.matvec(state.select("id", F.col("c").alias("y"))).withColumnRenamed("y", "alpha_raw")
    out = cut_lineage(state.join(alpha, "id").withColumn("alpha", clip("alpha_raw", 0.0, 1.0)))
    bk.release()
    return out
