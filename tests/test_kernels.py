import numpy as np
import pandas as pd
import pytest

from hyposcape.operators import kernels
from hyposcape.operators.kernels import BlockKernel, Kernel, Points


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 3))
    x[60:] = x[0]  # a third of the rows are copies of one point
    lab = (rng.random(90) < 0.6).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(90), "v": list(x), "label": lab}), "id bigint, v array<double>, label int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    return x, lab, d, df, Points.pack(df, extra=["label"], block_rows=25)


def test_row_sums_and_blocks(cloud):
    _, _, d, _, pts = cloud
    assert pts.n_blocks == 4
    out = kernels.row_sums(pts, {"a": Kernel("rbf", 0.8), "b": Kernel("matern", 1.2, 2.5)}).toPandas().sort_values("id")
    assert np.allclose(out.a, np.exp(-(d**2) / (2 * 0.64)).sum(1), atol=1e-6)
    t = np.sqrt(5) * d / 1.2
    assert np.allclose(out.b, ((1 + t + t * t / 3) * np.exp(-t)).sum(1), atol=1e-6)


@pytest.mark.parametrize("nu", [0.5, 1.5, 2.5])
def test_general_matern_agrees_with_closed_forms(nu):
    d = np.array([0.0, 1e-6, 0.01, 0.3, 1.0, 2.0, 5.0])
    near = Kernel("matern", 1.3, nu + 1e-10).of_distance(d)
    assert np.allclose(near, Kernel("matern", 1.3, nu).of_distance(d), atol=2e-7)


def test_unknown_kernel_is_an_error():
    with pytest.raises(ValueError):
        Kernel("cosine")


@pytest.mark.parametrize("diag", [False, True])
def test_distance_quantiles(cloud, diag):
    _, lab, d, _, pts = cloud
    iu = np.triu_indices(len(d), 1)
    full = d.ravel() if diag else d[iu]
    got = {r.prob: r.value for r in kernels.distance_quantiles(pts, [0.1, 0.5, 0.9], with_diagonal=diag).collect()}
    for q, v in got.items():
        assert np.isclose(v, np.quantile(full, q), atol=1e-6)


def test_distance_quantiles_by_type_and_refinement(cloud, monkeypatch):
    _, lab, d, _, pts = cloud
    monkeypatch.setattr(kernels, "MAX_KEPT", 3)
    iu = np.triu_indices(len(d), 1)
    code = (lab[:, None] + lab[None])[iu]
    got = {r.pair_type: r.value for r in kernels.distance_quantiles(pts, [0.5], label="label", bins=8).collect()}
    for t, name in kernels.TYPE_NAMES.items():
        assert np.isclose(got[name], np.median(d[iu][code == t]), atol=1e-6)


def test_pair_stats_and_group_similarity(cloud):
    _, lab, d, df, pts = cloud
    k = np.exp(-(d**2) / 2)
    iu = np.triu_indices(len(d), 1)
    code = (lab[:, None] + lab[None])[iu]
    got = {r.pair_type: r for r in kernels.pair_type_stats(pts, Kernel("rbf", 1.0)).collect()}
    for t, name in kernels.TYPE_NAMES.items():
        assert got[name].n == (code == t).sum()
        assert np.isclose(got[name].mean_kernel, k[iu][code == t].mean(), atol=1e-7)
    sim = kernels.group_similarity(pts, Kernel("rbf", 1.0), "label").toPandas()
    off = k - np.diag(np.diag(k))
    for g in (0, 1):
        s = sim[sim.other == g].set_index("id").sim_sum.sort_index()
        assert np.allclose(s, off[:, lab == g].sum(1), atol=1e-6)


def test_neighbours(cloud):
    _, _, d, _, pts = cloud
    out = kernels.neighbours(pts, 4).toPandas()
    dd = d + np.diag(np.full(len(d), np.inf))
    want = np.sort(dd, axis=1)[:, :4]
    got = out.sort_values(["id", "rank"]).d.to_numpy().reshape(-1, 4)
    assert np.allclose(got, want, atol=1e-6)


def test_matvec_bundle(cloud, spark):
    _, _, d, df, pts = cloud
    k = np.exp(-d) + 0.5 * np.eye(len(d))
    bk = BlockKernel.build(pts, Kernel("matern", 1.0, 0.5), jitter=0.5)
    rng = np.random.default_rng(1)
    y = rng.normal(size=(90, 2))
    vec = spark.createDataFrame(pd.DataFrame({"id": np.arange(90), "y": list(y)}), "id bigint, y array<double>")
    out = bk.matvec(vec, 2).toPandas().sort_values("id")
    assert np.allclose(np.stack(out.y), k @ y, atol=1e-6)
    bk.release()


def test_cross_apply_broadcast_and_block_paths_agree(cloud):
    x, _, d, df, _ = cloud
    centres = df.where("id < 40").selectExpr("id", "v", "cast(id as double) / 40 as w")
    k = np.exp(-(d[:, :40] ** 2) / 2) @ (np.arange(40) / 40)
    for limit in (100, 10):
        out = kernels.cross_apply(df, centres, Kernel("rbf", 1.0), ["w"], max_centres=limit).toPandas().sort_values("id")
        assert np.allclose(out.k_w, k, atol=1e-6)


def test_strips_inside_a_block_change_nothing(cloud, spark, monkeypatch):
    _, lab, d, df, _ = cloud
    monkeypatch.setattr(kernels, "STRIP_CELLS", 200)
    pts = Points.pack(df, extra=["label"], block_rows=50)
    k = np.exp(-(d**2) / 2)
    out = kernels.row_sums(pts, {"a": Kernel("rbf", 1.0)}).toPandas().sort_values("id")
    assert np.allclose(out.a, k.sum(1), atol=1e-6)
    iu = np.triu_indices(len(d), 1)
    n = {r.pair_type: r.n for r in kernels.pair_type_stats(pts, Kernel("rbf", 1.0)).collect()}
    assert sum(n.values()) == len(iu[0])
    sim = kernels.group_similarity(pts, Kernel("rbf", 1.0), "label").toPandas()
    assert np.isclose(sim.sim_sum.sum(), (k - np.eye(90)).sum(), atol=1e-6)
    nn = kernels.neighbours(pts, 3).toPandas()
    want = np.sort(d + np.diag(np.full(90, np.inf)), axis=1)[:, :3]
    assert np.allclose(nn.sort_values(["id", "rank"]).d.to_numpy().reshape(-1, 3), want, atol=1e-6)
    bk = BlockKernel.build(pts, Kernel("rbf", 1.0), jitter=0.1)
    y = spark.createDataFrame(pd.DataFrame({"id": np.arange(90), "y": np.arange(90.0)}))
    got = bk.matvec(y).toPandas().sort_values("id").y
    assert np.allclose(got, (k + 0.1 * np.eye(90)) @ np.arange(90.0), atol=1e-4)
    bk.release()


def test_block_kernel_keeps_points_not_entries(spark):
    n = 4000
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 3))
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "v": list(x)}), "id bigint, v array<double>")
    bk = BlockKernel.build(Points.pack(df, block_rows=500), Kernel("rbf", 1.0))
    y = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "y": np.arange(n) / n}))
    got = bk.matvec(y).toPandas().sort_values("id").y
    d2 = ((x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T).clip(0)
    assert np.allclose(got, np.exp(-d2 / 2) @ (np.arange(n) / n), atol=1e-6)
    kept = sum(r.memSize() + r.diskSize() for r in spark.sparkContext._jsc.sc().getRDDStorageInfo())
    bk.release()
    assert kept < n * n  # the entries alone would be 8 n^2 bytes


@pytest.mark.parametrize("nu", [0.5, 1.5, 2.5])
def test_general_matern_is_exact_from_copies_to_far_points(nu):
    d = np.concatenate([[0.0, 1e-14, 1e-11, 1e-9], np.geomspace(1e-8, 400, 5001)])
    want = Kernel("matern", 1.0, nu).of_distance(d)
    got = Kernel("matern", 1.0, nu + 1e-12).of_distance(d)
    assert np.allclose(got, want, rtol=1e-8, atol=1e-10)


def test_general_matern_costs_a_look_up_a_cell():
    import time

    d = np.random.default_rng(0).random((1000, 4000)) * 3
    k = Kernel("matern", 1.0, 1.5 + 1e-11)
    k.of_distance(d[:2])
    start = time.process_time()
    k.of_distance(d)
    assert time.process_time() - start < 5  # the integral a cell takes ten times that


def test_closest_holds_every_tie_and_little_else():
    rng = np.random.default_rng(3)
    d = rng.random((50, 1200))
    d[:5, 100:400] = 0.25  # copies
    d[7, :] = 1.0
    d[9, 5] = np.nan
    got = np.zeros(d.shape, dtype=bool)
    got.ravel()[kernels.closest(d, 10)] = True
    kth = np.sort(d, axis=1)[:, 9]
    assert got[d <= kth[:, None]].all()
    assert got[10:].sum() < 40 * 40


def test_in_bins_follows_the_edges():
    rng = np.random.default_rng(4)
    for lo, hi in [(0.0, 3.0), (0.7, 0.7 + 1e-13)]:
        edges = np.linspace(lo, hi, 4097)
        x = np.concatenate([rng.random(20000) * (hi - lo) + lo, edges, [hi, hi + 1, -1.0]])
        kept = x[(x >= edges[0]) & (x < edges[-1])]
        want = np.bincount(np.searchsorted(edges, kept, side="right") - 1, minlength=4096)
        got = kernels.in_bins(x, edges)
        assert got.sum() == len(kept)
        assert (got == want).all() or hi - lo < 1e-9


def test_what_a_pair_of_blocks_emits_does_not_grow_with_its_strips(cloud, monkeypatch):
    """One candidate list and one sum a point and partner block, however many strips a block has."""
    _, _, d, df, _ = cloud
    monkeypatch.setattr(kernels, "STRIP_CELLS", 100)
    pts, seen = Points.pack(df, block_rows=50), []
    real = Points.reduce

    def counted(self, *args, **kw):
        seen.append(real(self, *args, **kw))
        return seen[-1]

    monkeypatch.setattr(Points, "reduce", counted)
    nn = kernels.neighbours(pts, 3).toPandas()
    want = np.sort(d + np.diag(np.full(90, np.inf)), axis=1)[:, :3]
    assert np.allclose(nn.sort_values(["id", "rank"]).d.to_numpy().reshape(-1, 3), want, atol=1e-6)
    kernels.row_sums(pts, {"a": Kernel("rbf", 1.0)})
    assert pts.n_blocks == 2
    assert seen[0].count() == 90 * 2 * 3 and seen[1].count() == 90 * 2
