import json
import math
from fractions import Fraction
from math import comb

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hyposcape.operators import clustering, enrichment, features, graph, metrics, summaries
from hyposcape.operators.kernels import Kernel, Points
from hyposcape.sources import config


@pytest.fixture(scope="module")
def net(spark):
    """A hub joined to every node plus random edges and one isolated node."""
    rng = np.random.default_rng(4)
    n = 40
    w = np.triu((rng.random((n, n)) < 0.08) * rng.integers(1, 4, (n, n)), 1).astype(float)
    w[0, 1:] = 1.0
    w = w + w.T
    w[-1, :], w[:, -1] = 0, 0
    s, d = np.nonzero(w)
    edges = spark.createDataFrame(pd.DataFrame({"src": s, "dst": d, "w": w[s, d]}))
    nodes = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "p": rng.random(n)}))
    return w, edges, nodes


def norm_laplacian(w):
    d = w.sum(1)
    s = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0)
    return np.eye(len(w)) - s[:, None] * w * s[None]


def test_laplacian_and_diffusion_with_a_split_hub(net, monkeypatch, spark):
    w, edges, nodes = net
    monkeypatch.setattr(graph.hot_nodes, "__defaults__", (10,))
    lap = np.zeros(w.shape)
    for r in graph.laplacian(edges, nodes).collect():
        lap[r.src, r.dst] += r.l
    want = norm_laplacian(w)
    assert np.allclose(lap, want)
    assert graph.hot_nodes(edges).count() >= 1
    y = np.linspace(-1, 1, len(w))
    vec = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(w)), "y": y}))
    vals, vecs = np.linalg.eigh(want)
    for beta in (1.0, 2.0):
        op = graph.DiffusionOperator.build(edges, nodes, beta)
        got = op.apply(vec).toPandas().sort_values("id").y
        assert np.allclose(got, (vecs * np.exp(-beta * vals)) @ vecs.T @ y, atol=1e-10)
        op.release()


def test_alignment_score(net, spark):
    from statistics import NormalDist

    w, edges, nodes = net
    p = np.clip(nodes.toPandas().sort_values("id").p, 1e-10, 1 - 1e-10)
    z = np.array([NormalDist().inv_cdf(1 - x) for x in p])
    z -= z.mean()
    out = graph.signal_alignment(edges, nodes, n_perms=20).first()
    assert np.isclose(out.observed, z @ w @ z, rtol=1e-9)
    assert 0 <= out.p_spatial <= 1 and out.std_perm > 0


def test_symmetrize_and_induced(spark):
    e = spark.createDataFrame([(1, 2, 3.0), (2, 1, 1.0), (2, 3, 4.0), (3, 3, 9.0)], "src int, dst int, w double")
    got = {(r.src, r.dst): r.w for r in graph.symmetrize(e).collect()}
    assert got == {(1, 2): 2.0, (2, 1): 2.0, (2, 3): 2.0, (3, 2): 2.0}
    kept = graph.induced(graph.symmetrize(e), spark.createDataFrame([(1,), (2,)], "id int"))
    assert kept.count() == 2


def test_dense_graph_routines(net):
    w, edges, nodes = net
    k, vals = graph.dense_diffusion(nodes.toPandas(), edges.toPandas(), 2.0)
    v, u = np.linalg.eigh(norm_laplacian(w))
    assert np.allclose(k, (u * np.exp(-2 * v)) @ u.T) and np.allclose(vals, v)
    assert graph.structure_check(np.ones(10))[2] == "shattered"
    assert graph.structure_check(np.array([1.0, 1.0, 0.2, 0.1]))[2] == "clustered"
    assert graph.structure_check(np.array([1.0, 0.3, 0.2]))[2] == "hairball"
    assert graph.structure_check(np.array([1.0, 0.7, 0.2]))[2] == "moderate"


def test_hypergeometric_tail(spark):
    cases = [(k, M, n, N) for M, n, N in ((100, 20, 30), (50, 5, 45), (2000, 800, 900)) for k in (0, 1, 3, 9, 19, 20, 360, 400)]
    df = spark.createDataFrame(cases, "k long, m long, n long, nn long")
    out = df.withColumn("p", enrichment.hypergeom_sf(F.col("k"), F.col("m"), F.col("n"), F.col("nn"))).collect()
    for r in out:
        total = comb(r.m, r.nn)
        want = sum(Fraction(comb(r.n, x) * comb(r.m - r.n, r.nn - x), total) for x in range(max(r.k, 0), min(r.n, r.nn) + 1) if 0 <= r.nn - x <= r.m - r.n)
        assert np.isclose(r.p, float(want), rtol=1e-8, atol=1e-11), r


def test_hypergeometric_tail_of_large_sets(spark):
    """Against exact integer sums, and flat in memory for sets of a million."""
    cases = [(M, n, N, k) for M, n, N in ((400, 150, 120), (400, 300, 390), (3000, 900, 700)) for k in {max(0, n + N - M) + 1, n * N // M, n * N // M + 1, n * N // M + 25, min(n, N)} if k <= min(n, N)]
    big = [(2_000_000, 1_000_000, 1_000_000, k) for k in (499_000, 500_000, 501_500)]
    df = spark.createDataFrame(cases + big, "M long, n long, N long, k long")
    got = [r["s"] for r in df.select(enrichment.hypergeom_sf(F.col("k"), F.col("M"), F.col("n"), F.col("N")).alias("s")).collect()]
    for (M, n, N, k), s in zip(cases, got):
        exact = Fraction(sum(comb(n, x) * comb(M - n, N - x) for x in range(k, min(n, N) + 1)), comb(M, N))
        assert abs(s - float(exact)) <= 1e-9 * max(float(exact), 1e-3)
    sigma = (2_000_000 / 16) ** 0.5
    phi = [0.5 * math.erfc((k - 0.5 - 500_000) / sigma / 2**0.5) for *_, k in big]
    assert np.allclose(got[len(cases) :], phi, rtol=0.01)


def test_enrichment_rules(spark):
    members = spark.createDataFrame([("a", g) for g in range(5)] + [("b", 0), ("b", 1)] + [("c", 50)], "pathway string, gene int")
    universe = spark.createDataFrame([(g,) for g in range(20)], "gene int")
    chosen = spark.createDataFrame([(0,), (1,), (2,), (77,)], "gene int")
    got = {r.pathway: r for r in enrichment.enrichment(members, chosen, universe).collect()}
    assert got["a"].overlap == 3 and np.isclose(got["a"].pval, comb(5, 3) / comb(20, 3))
    assert got["b"].pval == 1.0 and got["b"].overlap == 0 and got["b"].size == 2
    assert got["c"].size == 0 and got["c"].pval == 1.0
    sets = spark.createDataFrame([({"x": [1, 2], "y": [3]},)], "pathways map<string,array<int>>")
    assert enrichment.explode_sets(sets).count() == 3


def test_ward_against_direct_search():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(25, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    heights = summaries.ward_merges(d)[:, 2]
    groups, want = [[i] for i in range(25)], []
    while len(groups) > 1:  # direct Ward: merge the pair with the smallest increase of within-variance
        best = min(
            (np.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(x[a].mean(0) - x[b].mean(0)), i, j)
            for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j
        )
        want.append(best[0])
        merged = groups[best[1]] + groups[best[2]]
        groups = [g for t, g in enumerate(groups) if t not in best[1:]] + [merged]
    assert np.allclose(heights, want)
    assert len(set(summaries.cut_tree(summaries.ward_merges(d), 25, 4))) == 4


def test_spectral_embedding_and_gap(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(m, 0.3, size=(30, 2)) for m in (0.0, 4.0, 8.0)])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(90), "v": list(x)}), "id bigint, v array<double>")
    k = np.exp(-(((x[:, None] - x[None]) ** 2).sum(-1)) / 2)
    deg = k.sum(1) + 1e-10
    want = np.sort(np.linalg.eigvalsh(k / np.sqrt(np.outer(deg, deg))))[::-1][:4]
    emb, eig = clustering.spectral_embedding(df, Kernel("rbf", 1.0), k=4, iterations=10)
    got = [r.value for r in eig.orderBy("rank").collect()]
    assert np.allclose(got, want, atol=1e-6)
    assert clustering.eigengap(eig).first().k == 3
    labels = clustering.kmeans(emb.withColumn("u", F.slice("u", 1, 3)), 3, "u").toPandas().sort_values("id").cluster.to_numpy()
    assert all(len(set(labels[i : i + 30])) == 1 for i in (0, 30, 60)) and len(set(labels)) == 3


def test_spectral_residuals_small_input(spark):
    """Fewer rows than the bundle is wide; equal points."""
    rows = [(i, [float(i // 2), 0.0]) for i in range(8)]
    emb, eig = clustering.spectral_embedding(spark.createDataFrame(rows, "id bigint, v array<double>"), Kernel("rbf", 1.0), k=3)
    got = eig.orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3] and abs(got[0].value - 1) < 1e-9 and max(r.residual for r in got) <= 1e-6
    u = np.array([r.u for r in emb.orderBy("id").collect()])
    assert np.allclose(u.T @ u, np.eye(3), atol=1e-8) and np.allclose(u[::2], u[1::2])


def test_anomaly_chain(spark):
    """Every score ranks the far point first, and equal scores share a p-value."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(60, 3)), [[9.0, 9.0, 9.0]]])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(61), "v": list(x)}), "id bigint, v array<double>")
    for method in ("knn", "lof", "isolation"):
        out = clustering.anomaly_p_values(df, method).toPandas().sort_values("p")
        assert len(out) == 61 and out.id.iloc[0] == 60 and out.p.iloc[0] == pytest.approx(1e-10) and out.p.between(0, 1).all()
    with pytest.raises(ValueError):
        clustering.anomaly_p_values(df, "none")


def test_designs(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(m, 0.4, size=(80, 2)) for m in (0.0, 5.0, 10.0)])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(240), "v": list(x), "dataset": "d"}), "id bigint, v array<double>, dataset string")
    out = clustering.hierarchical_design(df, [15, 20, 50], min_size=20).toPandas()
    assert out.groupby("group_id").size().to_dict() == {0: 15, 1: 20, 2: 50} and out.id.is_unique
    assert (out[out.group_id == 0].label == 1).sum() == 3 and (out[out.group_id == 1].label == 0).sum() == 4
    assert (out[out.group_id == 2].label == 1).all()
    mixed = clustering.mixed_cluster_sample(df.select("id", F.floor(F.col("id") / 80).cast("int").alias("cluster")), 100).toPandas()
    assert len(mixed) == 100 and mixed.id.is_unique and mixed.groupby("group_id").size().to_dict() == {0: 25, 1: 25, 2: 50}
    sel = summaries.similarity_selection(df, 30, 3).toPandas()
    assert len(sel) == 30 and set(sel.cluster) == {0, 1, 2}


def test_isolation_forest_ranks_an_outlier_first(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(size=(300, 3)), [[9.0, 9.0, 9.0]]])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(301), "v": list(x)}), "id bigint, v array<double>")
    s = clustering.isolation_scores(df, trees=30, sample=64).toPandas()
    assert s.sort_values("score").id.iloc[-1] == 300 and s.score.between(0, 1).all()


def test_metrics_and_reports(spark):
    rows = [(1, False), (1, True), (0, True), (0, True), (0, False)]
    m = metrics.compute_metrics(spark.createDataFrame(rows, "label int, rejected boolean")).first()
    assert (m.TP, m.FP, m.TN, m.FN) == (2, 1, 1, 1)
    assert np.isclose(m.FDR, 1 / 3) and np.isclose(m.TPR, 2 / 3) and np.isclose(m.F1, 2 / 3) and m.FPR == 0.5
    none = metrics.compute_metrics(spark.createDataFrame([(1, False)], "label int, rejected boolean")).first()
    assert none.FDR == 0.0 and none.TPR == 0.0 and none.F1 == 0.0
    g = spark.createDataFrame([(0.5, 0.25), (0.2, 0.0), (0.0, 0.0)], "m double, b double")
    got = [r[0] for r in g.select(metrics.relative_gain("m", "b")).collect()]
    assert got == [1.0, float("inf"), 0.0]


def test_features(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "id int, v array<double>")
    assert [r.v for r in features.standardize(df).orderBy("id").collect()] == [[-1.0, 0.0], [1.0, 0.0]]
    d = spark.createDataFrame([("g", 2, "b"), ("g", 1, "a"), ("h", 5, "c")], "k string, o int, x string")
    assert {r.k: r.x for r in features.keep_first(d, ["k"], "o").collect()} == {"g": "a", "h": "c"}
    both = features.concat_results(d, d)
    assert both.count() == 6


def test_settings_round_trip(tmp_path):
    for fmt, name in (("json", "a.json"), ("yaml", "b.yaml")):
        if fmt == "yaml" and config.yaml is None:
            continue
        for s in (config.from_preset("quick_test"), config.from_preset("quick_test", "gsea", n_folds=4)):
            config.save_settings(s, tmp_path / name, fmt)
            assert config.load_settings(tmp_path / name) == s
    assert config.from_preset("default").design_for("45_wine").min_cluster_size == 20
    assert len(config.GraphSettings().lambda_grid) == 15
    (tmp_path / "c.json").write_text(json.dumps({"type": "gsea", "speed": 1}))
    with pytest.raises(ValueError):
        config.load_settings(tmp_path / "c.json")
    with pytest.raises(ValueError):
        config.from_preset("nope")


def test_points_survive_checkpoint(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(10)], "id bigint, v array<double>")
    assert Points.pack(df).blocks.selectExpr("sum(size(ids)) s").first().s == 10


def test_bundle_logs_and_caches(spark, tmp_path):
    from hyposcape.sources import tables

    keys = [("A", "d1"), ("A", "d2"), ("B", "d3")]
    make = lambda cols, rows: spark.createDataFrame([(*k, *r) for k in keys for r in rows], f"benchmark string, dataset string, {cols}")
    tables.save_bundle(
        str(tmp_path / "b"),
        edges=make("src long, dst long, w double", [(1, 2, 1.0), (2, 1, 1.0)]),
        genes=make("id long, p double", [(1, 0.1), (2, 0.2)]),
        positives=make("pathway string", [("x",)]),
        pathways=make("pathway string, gene long", [("x", 1), ("x", 2)]),
    )
    got = tables.load_bundle(spark, str(tmp_path / "b"), ["A"], 1)
    assert got["genes"].count() == 2 and got["edges"].select("dataset").distinct().collect()[0][0] == "d1"
    log = metrics.compute_metrics(spark.createDataFrame([(0, True)], "label int, rejected boolean")).withColumn("dataset", F.lit("d"))
    tables.save_log(log, str(tmp_path / "log"))
    back = tables.load_log(spark, str(tmp_path / "log"), log.schema.simpleString()[7:-1].replace(":", " "))
    assert back.first().TP == 1
    tables.save_cache(log, str(tmp_path / "cache"), ["dataset"])
    assert tables.load_cache(spark, str(tmp_path / "cache")).count() == 1
    assert tables.list_datasets(spark, str(tmp_path / "cache" / "dataset=d")).count() == 1


def test_graph_bench_on_separate_communities(spark):
    from hyposcape.operators.solver import make_config
    from hyposcape.plans.graph_bench import GraphBench

    rng = np.random.default_rng(12)
    n, w = 90, np.zeros((90, 90))
    for c in range(3):
        at = np.arange(c * 30, c * 30 + 30)
        w[np.ix_(at, at)] = np.triu(rng.random((30, 30)) < 0.3, 1)
    s, d = np.nonzero(w)
    p = np.where(np.arange(n) < 30, rng.beta(0.2, 4, n), rng.random(n)).clip(1e-9, 1)
    frame = lambda **c: spark.createDataFrame(pd.DataFrame({"benchmark": "b", "dataset": "d", **c}))
    bundle = {
        "edges": frame(src=s, dst=d, w=np.ones(len(s))),
        "genes": frame(id=np.arange(n), p=p),
        "pathways": frame(pathway=[f"c{i // 30}" for i in range(n)], gene=np.arange(n)),
        "positives": frame(pathway=["c0"]),
    }
    bench = GraphBench(make_config("graph_gsea", max_iter=200, learning_rate=0.0005), lambdas=(0.1, 1.0))
    got = {r.method: r for r in bench.run(bundle).collect()}
    assert set(got) == {"baseline", "smooth"}
    assert got["smooth"].n_genes == got["baseline"].n_genes > 80
    assert got["smooth"].auc == 1.0 and got["smooth"].n_discoveries > 0


def sparse_case(n, degree, seed):
    rng = np.random.default_rng(seed)
    src, dst = rng.integers(0, n - 3, (2, n * degree // 2))  # the last nodes have no edge
    e = pd.DataFrame({"src": src, "dst": dst, "w": rng.random(len(src))})[src != dst]
    both = pd.concat([e, e.rename(columns={"src": "dst", "dst": "src"})]).groupby(["src", "dst"], as_index=False).w.sum()
    return pd.DataFrame({"id": np.arange(n)}), both


@pytest.mark.parametrize(("n", "degree", "seed"), [(300, 6, 0), (200, 1, 1), (40, 20, 2)])
def test_sparse_diffusion_is_the_dense_kernel(n, degree, seed):
    nodes, edges = sparse_case(n, degree, seed)
    for beta in (0.5, 2.0, 9.0):
        dense, vals = graph.dense_diffusion(nodes, edges, beta)
        sparse = graph.SparseDiffusion(nodes, edges, beta)
        x = np.random.default_rng(3).standard_normal(n)
        assert np.abs(sparse @ x - dense @ x).max() < 1e-11
        assert sparse.verdict() == graph.structure_check(np.exp(-beta * vals))[2]
    assert abs(sparse.second() - np.sort(1 - vals)[-2]) < 1e-9
    none = graph.SparseDiffusion(nodes, edges[:0], 2.0)
    assert none.verdict() == graph.structure_check(np.full(n, np.exp(-2.0)))[2]
    assert np.allclose(none @ x, np.exp(-2.0) * x)


def test_small_graphs_run_in_tasks_of_their_own(spark):
    from pyspark import TaskContext

    nodes = spark.range(40).select((F.col("id") % 4).alias("dataset"), "id")
    edges = nodes.select("dataset", F.col("id").alias("src"), (F.col("id") + 4).alias("dst"), F.lit(1.0).alias("w"))
    where = graph.per_graph(nodes, edges, ["dataset"], lambda n, e: pd.DataFrame({"part": [TaskContext.get().partitionId()]}), "part int")
    assert len({r.part for r in where.collect()}) == 4


def test_subgraph_of_drawn_nodes_is_that_of_the_whole_graph(spark):
    rng = np.random.default_rng(4)
    e = spark.createDataFrame(pd.DataFrame({"src": rng.integers(0, 60, 400), "dst": rng.integers(0, 60, 400), "w": rng.random(400)}))
    drawn = spark.range(0, 60, 3)
    got = graph.drawn_graph(e, drawn).select("src", "dst", "w").toPandas().sort_values(["src", "dst"]).reset_index(drop=True)
    want = graph.induced(graph.symmetrize(e), drawn).select("src", "dst", "w").toPandas().sort_values(["src", "dst"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)


def test_symmetrize_sums_a_pair_once(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 1, 2.0), (1, 2, 4.0), (3, 3, 9.0), (4, 1, 1.0)], "src long, dst long, w double")
    got = sorted(map(tuple, graph.symmetrize(e).select("src", "dst", "w").collect()))
    assert got == [(1, 2, 3.5), (1, 4, 0.5), (2, 1, 3.5), (4, 1, 0.5)]
    plan = graph.symmetrize(e)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.index("Generate") < plan.index("Aggregate")  # both directions only after the sum
