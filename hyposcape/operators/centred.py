"""Fits in which every row takes part, over a bounded set of kernel centres.

alpha(x) = sum_m c_m k(x, z_m) with m centres z, a parameter of the model.  Likelihood and bound terms are summed over all
rows, the penalty is c' K c with K the kernel among the centres.  A step is one linear pass: each task adds up the
pull of its rows on the m coefficients, the sums are combined by centre, and m numbers reach the driver.  With
the rows themselves as centres the steps are those of the exact fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Kernel, distances
from .solver import GlobalConfig, SolverConfig, lbfgs, start_of

STRIP_CELLS = 500_000  # distances a task holds at once; several arrays of this size live beside each other
MOST_CENTRES = 5000  # K and its factor lie on the driver: m * m doubles
NEWTON_CENTRES = 1500  # beyond it a task's m * m curvature sums are too much to send; quasi-Newton steps do without
LADDER = np.r_[1.0, np.arange(0.9, 0.05, -0.1), 2.0 ** -np.arange(4, 30)]  # step lengths tried in one pass
BOUND_PATH = (1 / 625, 1 / 125, 1 / 25, 1 / 5, 1.0)  # shares of the bound penalty: walls that rise keep Newton steps long

Terms = Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]]


def stage1_terms(cfg: SolverConfig) -> Terms:
    """(alpha, f0, f1) -> loss, slope and bound violation of each row; below the floor the loss goes on along its tangent."""

    def terms(a, f0, f1):
        raw = a * f0 + (1 - a) * f1
        mix = np.maximum(raw, cfg.floor)
        over, under = np.maximum(0, a - 1), np.maximum(0, -a)
        loss = -np.log(mix) + (mix - raw) / cfg.floor + cfg.lambda_bound * (over**2 + under**2)
        if cfg.method == "adam":  # this method takes its slope at a clipped alpha
            b = np.clip(a, -0.1, 1.1)
            mix, over, under = np.maximum(b * f0 + (1 - b) * f1, cfg.floor), np.maximum(0, b - 1), np.maximum(0, -b)
        return loss, (f1 - f0) / mix + 2 * cfg.lambda_bound * (over - under), (a < 0) | (a > 1)

    return terms


def stage1_curvature(cfg: SolverConfig):
    """Second derivative of each row's loss."""

    def curvature(a, f0, f1):
        raw = a * f0 + (1 - a) * f1
        return np.where(raw > cfg.floor, ((f1 - f0) / np.maximum(raw, cfg.floor)) ** 2, 0.0) + 2 * cfg.lambda_bound * ((a < 0) | (a > 1))

    return curvature


def stage2_curvature(g, target):
    s = 1 / (1 + np.exp(-np.clip(g, -500, 500)))
    return s * (1 - s)


def stage2_terms(g, target):
    """Logistic loss and slope of each row for a score g and a target in [0, 1]."""
    g = np.clip(g, -500, 500)
    return np.logaddexp(0, g) - target * g, 1 / (1 + np.exp(-g)) - target, np.zeros(len(g), bool)


def linear_pass(rows: DataFrame, columns: Sequence[str], z: np.ndarray, kernel: Kernel, terms: Terms):
    """c -> (sum of losses, pull on each coefficient, violations) over all rows (v, columns...)."""
    m, sent = len(z), rows.sparkSession.sparkContext.broadcast(z)  # centres: bounded by MOST_CENTRES

    def evaluate(c: np.ndarray) -> tuple[float, np.ndarray, int]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, outside, pull, z_ = 0.0, 0, np.zeros(m), sent.value
            for batch in batches:
                for at in range(0, batch.num_rows, max(1, STRIP_CELLS // m)):
                    part = batch.slice(at, max(1, STRIP_CELLS // m))
                    x = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
                    k = kernel.of_distance(distances(x, z_, False))
                    value, slope, off = terms(k @ c, *(part.column(n).to_numpy(zero_copy_only=False) for n in columns))
                    loss, outside, pull = loss + value.sum(), outside + int(off.sum()), pull + slope @ k
            yield pa.RecordBatch.from_arrays([pa.array([loss], pa.float64()), pa.array([outside], pa.int64()), pa.array([pull.tolist()], pa.list_(pa.float64()))], names=["loss", "outside", "pull"])

        parts = rows.select("v", *columns).mapInArrow(run, "loss double, outside long, pull array<double>")
        spread = parts.select("loss", "outside", F.posexplode("pull").alias("pos", "pull"))
        sums = spread.groupBy("pos").agg(F.sum("pull").alias("pull"), F.sum("loss").alias("loss"), F.sum("outside").alias("outside")).collect()  # m rows
        if not sums:
            return 0.0, np.zeros(m), 0
        pull = np.zeros(m)
        pull[[r["pos"] for r in sums]] = [r["pull"] for r in sums]
        return sums[0]["loss"], pull, sums[0]["outside"]

    return evaluate


def summed(parts: DataFrame, rounds: int = 2) -> np.ndarray:
    """Sum of equally long vectors (part binary), merged in rounds of ever fewer tasks; the last few meet on the driver."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(0):
                v = np.frombuffer(raw.as_py(), np.float64)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    width = max(1, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    for _ in range(rounds):
        parts, width = parts.repartition(width).mapInArrow(merge, "part binary"), max(1, int(width**0.5))
    return np.sum([np.frombuffer(r["part"], np.float64) for r in parts.collect()], axis=0)


def newton_passes(rows: DataFrame, columns: Sequence[str], z: np.ndarray, kernel: Kernel, terms: Terms, curvature):
    """Two passes over all rows (v, columns...): c -> (loss, violations, pull, curvature sums), and (c, d) -> losses at c - t d."""
    m, sent = len(z), rows.sparkSession.sparkContext.broadcast(z)  # centres: bounded by NEWTON_CENTRES
    upper = np.triu_indices(m)

    def strips(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, STRIP_CELLS // m)):
                part = batch.slice(at, max(1, STRIP_CELLS // m))
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
                yield kernel.of_distance(distances(x, sent.value, False)), [part.column(n).to_numpy(zero_copy_only=False) for n in columns]

    def total(add, width: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(width)
            for k, given in strips(batches):
                add(out, k, given)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["part"])

        return summed(rows.select("v", *columns).mapInArrow(run, "part binary"))

    def second_order(c: np.ndarray):
        def add(out, k, given):
            a = k @ c
            value, slope, off = terms(a, *given)
            out[:2] += value.sum(), off.sum()
            out[2 : 2 + m] += slope @ k
            out[2 + m :] += (k.T @ (curvature(a, *given)[:, None] * k))[upper]

        got = total(add, 2 + m + len(upper[0]))
        h = np.zeros((m, m))
        h[upper] = got[2 + m :]
        return got[0], int(got[1]), got[2 : 2 + m], h + h.T - np.diag(np.diag(h))

    def ladder(c: np.ndarray, d: np.ndarray) -> np.ndarray:
        def add(out, k, given):
            a, step = k @ c, k @ d
            out += [terms(a - t * step, *given)[0].sum() for t in LADDER]

        return total(add, len(LADDER))

    return second_order, ladder


def newton(second_order, ladder, k: np.ndarray, lam: float, start: np.ndarray, guard: int, jitter: float = 1e-8, tol: float = 1e-10):
    """Minimise losses + lam c'Kc by Newton steps in the variable where the penalty is round; two passes a step.

    Ends when the Newton decrement says that the loss is within ``tol`` (relative) of its least value; more than ``guard`` steps raise unless they have come within ten times that.
    The log holds the root of the decrement in place of the gradient norm.
    """
    low = np.linalg.cholesky(k + jitter * np.eye(len(k)))
    c, log = start, []
    for step in range(guard + 1):
        value, outside, pull, h = second_order(c)
        f = value + lam * (c @ (k @ c))
        g = np.linalg.solve(low, pull + 2 * lam * (k @ c))
        inner = np.linalg.solve(low, np.linalg.solve(low, h).T)
        inner = (inner + inner.T) / 2 + 2 * lam * np.eye(len(k))
        turn = np.linalg.solve(inner, g)
        decrement = float(g @ turn)
        log.append((step, float(f), float(np.sqrt(max(decrement, 0.0))), outside))
        if decrement <= tol * max(1.0, abs(f)):
            return c, log
        d = np.linalg.solve(low.T, turn)
        penalty = lam * (c @ (k @ c) - 2 * LADDER * (c @ (k @ d)) + LADDER**2 * (d @ (k @ d)))
        after = ladder(c, d) + penalty
        best = 0 if after[0] <= f - 1e-4 * decrement else int(after.argmin())
        if not after[best] < f:
            break
        c = c - LADDER[best] * d
    else:
        if decrement <= 10 * tol * max(1.0, abs(f)):  # the jitter keeps steps along the kernel's null directions short
            return c, log
    raise RuntimeError(f"the fit did not settle in {step} steps: decrement {decrement}, loss {f}")


@dataclass(frozen=True)
class CentredFit:
    """Centres with coefficients and the log (step, loss, gradient norm, violations)."""

    ids: list
    z: np.ndarray
    c: np.ndarray
    log: list[tuple[int, float, float, int]]

    def frame(self, spark) -> DataFrame:
        """(id, v, c), a row a centre."""
        rows = [(i, v.tolist(), float(c)) for i, v, c in zip(self.ids, self.z, self.c, strict=True)]
        return spark.createDataFrame(rows, "id bigint, v array<double>, c double")


def minimise(evaluate, k: np.ndarray, lam: float, start: np.ndarray, cfg: SolverConfig, natural: bool = True, jitter: float = 1e-8):
    """Minimise losses + lam c'Kc by the method of ``cfg``; a step costs one pass.

    'lbfgs' runs on u with c = L^-T u, K = L L', where the penalty is round.  The step methods use the natural gradient
    K^-1 pull + 2 lam c, or the plain one with ``natural`` = False.
    """
    firm = k + jitter * np.eye(len(k))
    log: list[tuple[int, float, float, int]] = []
    seen: dict[bytes, tuple[float, np.ndarray]] = {}

    def at(c):
        key = c.tobytes()
        if key not in seen:
            value, pull, outside = evaluate(c)
            kc = k @ c
            seen.clear()
            seen[key] = (value + lam * (c @ kc), pull + 2 * lam * kc)
            log.append((len(log), seen[key][0], float(np.linalg.norm(seen[key][1])), outside))
        return seen[key]

    if cfg.method == "lbfgs":
        low = np.linalg.cholesky(firm)
        back = lambda u: np.linalg.solve(low.T, u)
        u = lbfgs(lambda u: at(back(u))[0], lambda u: np.linalg.solve(low, at(back(u))[1]), low.T @ start, cfg)
        return back(u), log
    c, lr = start, cfg.learning_rate
    m1, m2 = np.zeros_like(c), np.zeros_like(c)
    for t in range(cfg.max_iter):
        value, g = at(c)
        g = np.linalg.solve(firm, g) if natural else g
        norm = float(np.linalg.norm(g))
        if norm < cfg.tol and t > 100:
            break
        if norm > cfg.gradient_clip:
            g = g * (cfg.gradient_clip / norm)
        if cfg.method == "adam":
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
            c = c - lr * (m1 / (1 - 0.9 ** (t + 1))) / (np.sqrt(m2 / (1 - 0.999 ** (t + 1))) + 1e-8)
        elif cfg.method == "adaptive":
            kept, trial = dict(seen), c - lr * g
            if at(trial)[0] < value:
                c, lr = trial, min(lr * 1.1, 0.1)
            else:
                lr = max(lr * 0.5, 1e-6)
                seen.clear()
                seen.update(kept)
        else:
            c = c - lr * g
    return c, log


def collected(centres: DataFrame) -> tuple[list, np.ndarray]:
    """Ids and features of the centres, in id order."""
    few = centres.select("id", "v").orderBy("id").limit(MOST_CENTRES + 1).collect()
    if not 0 < len(few) <= MOST_CENTRES:
        raise ValueError(f"a model needs 1 to {MOST_CENTRES} centres")
    return [r["id"] for r in few], np.array([r["v"] for r in few], dtype=float)


def fit_stage1(rows: DataFrame, centres: DataFrame, kernel: Kernel, cfg: SolverConfig, natural: bool = True, jitter: float = 1e-8) -> CentredFit:
    """Null probability from all rows (v, f0, f1); rows must be valid (no nulls).  centres: (id, v)."""
    ids, z = collected(centres)
    k = kernel.of_distance(distances(z, z, True))
    if cfg.method == "newton" and len(z) > NEWTON_CENTRES:
        cfg = replace(cfg, method="lbfgs", max_iter=10 * cfg.max_iter, tol=1e-12)
    if cfg.method == "newton":
        c, log = np.full(len(z), 0.5 / k.sum(1).max()), []
        for share in BOUND_PATH:
            wall = replace(cfg, lambda_bound=cfg.lambda_bound * share)
            passes = newton_passes(rows, ["f0", "f1"], z, kernel, stage1_terms(wall), stage1_curvature(wall))
            c, part = newton(*passes, k, cfg.lambda_reg, c, cfg.max_iter, jitter, 1e-10 if share == 1 else 1e-2)
            log += [(len(log) + i, *row[1:]) for i, row in enumerate(part)]
        return CentredFit(ids, z, c, log)
    evaluate = linear_pass(rows, ["f0", "f1"], z, kernel, stage1_terms(cfg))
    # L-BFGS starts where every alpha is between 0 and about a half: inside the bounds, where the loss is smooth
    start = np.full(len(z), 0.5 / k.sum(1).max()) if cfg.method == "lbfgs" else start_of(k, cfg)
    c, log = minimise(evaluate, k, cfg.lambda_reg, start, cfg, natural, jitter)
    return CentredFit(ids, z, c, log)


def fit_stage2(rows: DataFrame, centres: DataFrame, kernel: Kernel, cfg: GlobalConfig, passes: int = 200, tol: float = 1e-6) -> CentredFit:
    """Kernel logistic regression of all rows (v, alpha).  The objective is convex: Newton steps (L-BFGS for very many centres)
    find the optimum that the step methods of ``cfg`` approach."""
    ids, z = collected(centres)
    k = kernel.of_distance(distances(z, z, True))
    if cfg.clip_target:
        rows = rows.withColumn("alpha", F.greatest(F.lit(cfg.clip_lo), F.least(F.lit(cfg.clip_hi), "alpha")))
    if len(z) <= NEWTON_CENTRES:
        steps = newton_passes(rows, ["alpha"], z, kernel, stage2_terms, stage2_curvature)
        return CentredFit(ids, z, *newton(*steps, k, cfg.lambda_global, np.zeros(len(z)), passes))
    conf = SolverConfig(method="lbfgs", max_iter=passes, tol=tol)
    c, log = minimise(linear_pass(rows, ["alpha"], z, kernel, stage2_terms), k, cfg.lambda_global, np.zeros(len(z)), conf)
    return CentredFit(ids, z, c, log)


def by_newton(cfg: SolverConfig, guard: int = 100) -> SolverConfig:
    """The same objective, minimised by Newton steps until it has settled; more than ``guard`` steps raise."""
    return replace(cfg, method="newton", max_iter=guard)


def by_lbfgs(cfg: SolverConfig, passes: int) -> SolverConfig:
    """The same objective, minimised by L-BFGS until a step gains less than ``tol`` of the loss."""
    return replace(cfg, method="lbfgs", max_iter=passes)
