import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hyposcape.operators import density, solver, tuning
from hyposcape.operators.kernels import Kernel
from hyposcape.operators.solver import GLOBAL_PRESETS, SolverConfig, descend, fit_global, gradient_of, loss_of, make_config


@pytest.fixture(scope="module")
def problem():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    k = np.exp(-d)
    f1 = np.exp(rng.normal(size=60))
    return x, k, np.ones(60), f1


def test_natural_gradient_times_kernel_is_the_gradient(problem):
    _, k, f0, f1 = problem
    cfg = SolverConfig(lambda_reg=0.3, lambda_bound=20.0)
    c = np.full(60, 0.01)
    assert ((k @ c) * f0 + (1 - k @ c) * f1).min() > cfg.floor
    g = k @ gradient_of(c, k @ c, f0, f1, cfg)
    for i in (0, 7, 33):
        e = np.zeros(60)
        e[i] = 1e-6
        num = (loss_of(c + e, k, f0, f1, cfg) - loss_of(c - e, k, f0, f1, cfg)) / 2e-6
        assert np.isclose(g[i], num, rtol=1e-5)


@pytest.mark.parametrize("method", ["constant", "adaptive", "adam", "lbfgs"])
def test_descent_lowers_the_loss(problem, method):
    _, k, f0, f1 = problem
    cfg = make_config("default", method=method, max_iter=400, learning_rate=0.001, c_init="zeros", floor=1e-10, lambda_reg=1.0)
    c, _ = descend(k, f0, f1, cfg)
    assert loss_of(c, k, f0, f1, cfg) < loss_of(np.zeros(60), k, f0, f1, cfg)


def test_lbfgs_reaches_a_stationary_point(problem):
    _, k, f0, f1 = problem
    cfg = make_config("default", method="lbfgs", max_iter=500, tol=1e-12, lambda_reg=1.0)
    c, _ = descend(k, f0, f1, cfg)
    size = lambda c: np.linalg.norm(k @ gradient_of(c, k @ c, f0, f1, cfg))
    assert size(c) < 1e-3 * size(np.zeros(60))


def test_distributed_fit_equals_dense_fit(problem, spark):
    x, _, f0, f1 = problem
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(60), "v": list(x), "f0": f0, "f1": f1}), "id bigint, v array<double>, f0 double, f1 double")
    cfg = make_config("default", max_iter=4)
    got = solver.fit_blocks(df, Kernel("matern", 1.0, 0.5), cfg).toPandas().sort_values("id")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want, _ = descend(np.exp(-d), f0, f1, cfg)
    assert np.allclose(got.c, want, atol=1e-9)
    grouped = solver.fit_pointwise(df.withColumn("dataset", F.lit(1)), Kernel("matern", 1.0, 0.5), cfg, jitter=0.0)
    assert np.allclose(grouped.toPandas().sort_values("id").c, want, atol=1e-9)


@pytest.mark.parametrize("method", ["constant", "adaptive", "adam"])
def test_fit_over_all_points_as_centres_is_the_exact_fit(problem, spark, method):
    from hyposcape.operators import centred

    x, k, f0, f1 = problem
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(60), "v": list(x), "f0": f0, "f1": f1}), "id bigint, v array<double>, f0 double, f1 double")
    cfg = make_config("default", max_iter=6, method=method, learning_rate=0.003, lambda_reg=1.0)
    got = centred.fit_stage1(df, df, Kernel("matern", 1.0, 0.5), cfg, jitter=0.0)
    want, _ = descend(k, f0, f1, cfg)
    assert got.ids == list(range(60)) and np.allclose(got.c, want, atol=1e-8)


def test_centred_fits_settle_for_both_stages(problem, spark):
    from hyposcape.operators import centred

    x, k, f0, f1 = problem
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(60), "v": list(x), "f0": f0, "f1": f1}), "id bigint, v array<double>, f0 double, f1 double")
    cfg = centred.by_lbfgs(make_config("default", lambda_reg=1.0, floor=1e-10, tol=1e-9), 300)
    kernel = Kernel("matern", 1.0, 0.5)
    whole = centred.fit_stage1(df, df, kernel, cfg)
    dense, _ = descend(k, f0, f1, make_config("default", lambda_reg=1.0, floor=1e-10, c_init="zeros", learning_rate=1e-4, max_iter=20000, gradient_clip=1e9))
    assert loss_of(whole.c, k, f0, f1, cfg) <= loss_of(dense, k, f0, f1, cfg) + 1e-3
    few = centred.fit_stage1(df, df.where("id < 20"), kernel, cfg)
    assert len(few.c) == 20 and few.log[-1][1] >= whole.log[-1][1] - 1e-6  # fewer centres, no lower loss
    alpha = np.clip(k @ whole.c, 0, 1)
    rows = spark.createDataFrame(pd.DataFrame({"v": list(x), "alpha": alpha}), "v array<double>, alpha double")
    glob = GLOBAL_PRESETS["euclidean"]
    second = centred.fit_stage2(rows, df, kernel, glob, tol=1e-9)
    s = 1 / (1 + np.exp(-k @ second.c))
    assert np.linalg.norm(k @ (s - np.clip(alpha, glob.clip_lo, glob.clip_hi) + 2 * glob.lambda_global * second.c)) < 1e-2


def test_newton_fit_is_stationary(problem, spark):
    """The gradient vanishes whatever the penalty, a larger guard changes nothing, too small a guard raises."""
    from hyposcape.operators import centred

    x, k, f0, f1 = problem
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(60), "v": list(x), "f0": f0, "f1": f1}), "id bigint, v array<double>, f0 double, f1 double").repartition(3)
    for lam in (1.0, 0.05):
        cfg = make_config("facade", lambda_reg=lam)
        fits = [centred.fit_stage1(df, df, Kernel("matern", 1.0, 0.5), centred.by_newton(cfg, guard)) for guard in (100, 200)]
        assert np.array_equal(fits[0].c, fits[1].c) and fits[0].log[-1][2] < 1e-4
        c = fits[0].c
        assert np.abs(k @ gradient_of(c, k @ c, f0, f1, cfg)).max() < 1e-3 * np.abs(k @ gradient_of(0 * c + 1e-3, k @ (0 * c + 1e-3), f0, f1, cfg)).max()
        dense = lbfgs_optimum(k, f0, f1, cfg)
        assert loss_of(c, k, f0, f1, cfg) <= dense + 1e-6 * abs(dense)
    with pytest.raises(RuntimeError, match="settle"):
        centred.fit_stage1(df, df, Kernel("matern", 1.0, 0.5), centred.by_newton(make_config("facade"), 1))


def lbfgs_optimum(k, f0, f1, cfg):
    from dataclasses import replace

    c, _ = descend(k, f0, f1, replace(cfg, method="lbfgs", max_iter=3000, tol=1e-14))
    return loss_of(c, k, f0, f1, cfg)


def test_distances_keep_their_digits_far_from_the_origin():
    from hyposcape.operators.kernels import distances

    rng = np.random.default_rng(5)
    x = 1e6 + 1e-3 * rng.normal(size=(40, 3))
    want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.allclose(distances(x, x, True), want, atol=1e-9)


def test_groups_beyond_the_limit_are_refused(problem, spark):
    x, _, f0, f1 = problem
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(60), "v": list(x), "f0": f0, "f1": f1}), "id bigint, v array<double>, f0 double, f1 double")
    with pytest.raises(ValueError):
        solver.fit_pointwise(df.withColumn("dataset", F.lit(1)), Kernel(), dense_limit=50)


@pytest.mark.parametrize("preset", sorted(GLOBAL_PRESETS))
def test_stage_two_follows_its_targets(problem, preset):
    from dataclasses import replace

    _, k, _, _ = problem
    target = 1 / (1 + np.exp(-(k @ np.linspace(-0.2, 0.2, 60))))
    c = fit_global(k, target, replace(GLOBAL_PRESETS[preset], lambda_global=1e-3, max_iter=300))
    assert np.abs(1 / (1 + np.exp(-k @ c)) - target).mean() < 0.05


def test_unknown_names_are_errors():
    with pytest.raises(ValueError):
        make_config("nope")
    with pytest.raises(TypeError):
        make_config("default", speed=3)


def test_cross_validation_scores(problem, spark):
    x, k, f0, f1 = problem
    pdf = pd.DataFrame({"id": np.arange(60), "v": list(x), "f0": f0, "f1": f1, "fold": np.arange(60) % 3, "dataset": "a"})
    df = spark.createDataFrame(pdf, "id bigint, v array<double>, f0 double, f1 double, fold int, dataset string")
    cfg = make_config("fold", max_iter=50, learning_rate=0.01)
    got = tuning.cross_validate(df, {"lambda_reg": [1.0, 5.0]}, Kernel("matern", 1.0, 0.5), cfg).toPandas()
    assert len(got) == 6
    tr, te = pdf.fold != 1, pdf.fold == 1
    c, _ = descend(k[np.ix_(tr, tr)], f0[tr], f1[tr], make_config("fold", max_iter=50, learning_rate=0.01, lambda_reg=5.0))
    a = k[np.ix_(te, tr)] @ c
    want = np.log(np.maximum(a * f0[te] + (1 - a) * f1[te], 1e-10)).sum()
    row = got[(got.lambda_reg == 5.0) & (got.fold == 1)].iloc[0]
    assert np.isclose(row.loglik, want, rtol=1e-9)


def test_beta_alternative_recovers_parameters(spark):
    rng = np.random.default_rng(1)
    p = rng.beta(0.5, 8.0, size=20000)
    df = spark.createDataFrame(pd.DataFrame({"p": p}))
    a, b = density.beta_mle(df, threshold=1.0)
    assert abs(a - 0.5) < 0.03 and abs(b - 8.0) < 0.5


def test_kde_matches_direct_sum(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=300), np.full(150, 1.5), rng.normal(8, 0.1, size=50)])
    h = 0.13
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(500), "x": x}))
    bw = spark.createDataFrame([(h, 500)], "h double, n bigint")
    got = density.kde_1d(df, "x", bw).toPandas().sort_values("id").density
    want = np.exp(-((x[:, None] - x[None]) ** 2) / (2 * h * h)).sum(1) / (500 * h * np.sqrt(2 * np.pi))
    assert np.allclose(got, want, rtol=1e-9)


def test_small_groups_use_the_fallback_mixture(spark):
    df = spark.createDataFrame([(i, (i + 0.5) / 50) for i in range(50)], "id bigint, p double")
    out = density.with_empirical_null(df).toPandas()
    assert np.allclose(out.f0, 1.0) and np.allclose(out.f1, 2 * (1 - out.p)) and np.allclose(out.pi0, 0.9)


def test_facade_finds_the_signal_region(spark):
    from hyposcape.plans.model import SpatialNullEstimator

    rng = np.random.default_rng(11)
    x = rng.random((400, 2))
    inside = (x[:, 0] > 0.5) & (x[:, 1] > 0.5)
    lab = np.where(inside, rng.random(400) < 0.1, rng.random(400) < 0.95).astype(int)
    p = np.clip(np.where(lab == 1, rng.random(400), rng.beta(0.2, 3, 400)), 1e-10, 1)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(400), "v": list(x), "p": p, "label": lab}), "id bigint, v array<double>, p double, label int")
    est = SpatialNullEstimator(Kernel("rbf", 0.15), make_config("default", lambda_reg=0.5, learning_rate=0.001, max_iter=2000, gradient_clip=10.0), n_centres=300)
    model = est.fit(df, entire_domain=True)
    out = model.reject(df, 0.2).toPandas().sort_values("id")
    assert len(out) == 400 and out.alpha_null.between(0, 1).all() and out.lfdr.between(0, 1).all()
    assert out[inside].alpha_null.mean() < out[~inside].alpha_null.mean() - 0.2
    assert out[inside].rejected.mean() > 3 * out[~inside].rejected.mean()
    plain = model.reject(df, 0.2, rule="threshold").where("rejected").agg(F.max("lfdr")).first()[0]
    assert plain <= 0.2
    with pytest.raises(ValueError):
        model.reject(df, rule="other")


def test_replicates_are_bounded_and_repeatable(spark):
    from hyposcape.plans import experiments

    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5)], i % 10) for i in range(500)], "id bigint, v array<double>, group_id int")
    a = experiments.replicates(df, ["none", "strong"], "medium", 3, 40).toPandas()
    assert len(a) == 240 and a.groupby(["condition", "seed"]).id.nunique().eq(40).all()
    b = experiments.replicates(df.repartition(7), ["none", "strong"], "medium", 3, 40).toPandas()
    key = ["condition", "seed", "id"]
    assert np.allclose(a.sort_values(key).p, b.sort_values(key).p)


def test_grid_descent_equals_single_descents():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 2))
    k = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1))
    f0, f1 = np.ones(40), rng.gamma(1.0, 2.0, 40)
    lam = [1e-15, 0.5, 10.0, 1e20]
    # a step small enough to converge: beyond that the descent is chaotic and rounding alone sets two runs apart
    common = {"max_iter": 400, "learning_rate": 0.002, "lambda_bound": 10.0}
    cfg = solver.make_config("default", **common)
    got = solver.descend_grid(k, f0, f1, cfg, lam)
    for j, v in enumerate(lam):
        want = solver.descend(k, f0, f1, solver.make_config("default", lambda_reg=v, **common))[0]
        assert np.allclose(got[:, j], want, rtol=1e-7, atol=1e-9)


def test_passes_over_rows_hold_few_distances_at_once(spark):
    """One batch of 10,000 rows against 400 centres is four million distances, 32 MB an array with several beside each other."""
    from hyposcape.operators import centred
    from hyposcape.operators.kernels import Kernel, cross_apply

    class Watched(Kernel):
        def of_distance(self, d):
            if d.size > 1_000_000:
                raise MemoryError(f"{d.size} distances at once")
            return super().of_distance(d)

    rng = np.random.default_rng(8)
    x, z, kernel = rng.normal(size=(10_000, 2)), rng.normal(size=(400, 2)), Watched("matern", 1.0, 1.5)
    rows = spark.createDataFrame(pd.DataFrame({"id": np.arange(10_000), "v": x.tolist(), "alpha": rng.random(10_000)})).coalesce(1).cache()
    c, d = rng.normal(size=400) * 0.01, rng.normal(size=400) * 0.01
    k = Kernel("matern", 1.0, 1.5).of_distance(np.sqrt(((x[:, None] - z[None]) ** 2).sum(2)))
    want = centred.stage2_terms(k @ c, np.array([r["alpha"] for r in rows.orderBy("id").collect()]))
    loss, pull, _ = centred.linear_pass(rows, ["alpha"], z, kernel, centred.stage2_terms)(c)
    assert np.isclose(loss, want[0].sum()) and np.allclose(pull, want[1] @ k)
    second, ladder = centred.newton_passes(rows, ["alpha"], z, kernel, centred.stage2_terms, centred.stage2_curvature)
    value, _, pull, h = second(c)
    assert np.isclose(value, loss) and np.allclose(pull, want[1] @ k)
    assert np.allclose(h, k.T @ (centred.stage2_curvature(k @ c, 0)[:, None] * k))
    assert len(ladder(c, d)) == len(centred.LADDER)
    at = spark.createDataFrame(pd.DataFrame({"id": np.arange(400), "v": z.tolist(), "c": c}))
    got = cross_apply(rows.select("id", "v"), at, kernel, ["c"]).orderBy("id").toPandas()
    assert np.allclose(got.k_c, k @ c)
