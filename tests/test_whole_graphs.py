"""Whole graphs: steps inside one task equal the distributed ones, and no query falls back to a sample of the nodes."""

import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402

from hyposcape.operators import graph, graph_fit
from hyposcape.operators.solver import make_config


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(3)
    edges, nodes = [], []
    for name, n in (("a", 40), ("b", 25)):
        s, d = rng.integers(0, n, (2, 4 * n))
        edges.append(pd.DataFrame({"dataset": name, "src": s, "dst": d, "w": rng.uniform(0.5, 2, 4 * n)}))
        nodes.append(pd.DataFrame({"dataset": name, "id": np.arange(n + 2), "f0": 1.0, "f1": rng.choice([0.05, 0.3, 3.0, 20.0], n + 2)}))  # the last have no edge
    both = graph.symmetrize(spark.createDataFrame(pd.concat(edges)).where("src <> dst"), ["dataset"]).cache()
    return both, spark.createDataFrame(pd.concat(nodes)).cache()


def test_steps_inside_a_task_are_the_distributed_ones(small, monkeypatch):
    edges, nodes = small
    folds = nodes.withColumn("fold", (F.col("id") % 2).cast("int"))
    cfg = make_config("graph_gsea", lambda_reg=5.0)

    def found():
        first = sorted(tuple(r) for r in graph_fit.whole_structure(nodes, edges, steps=5).select("dataset", "n_ones", "second", "residual").collect())
        second = graph_fit.whole_alpha(nodes, edges, cfg, most=4, must_settle=False).orderBy("dataset", "id").toPandas()[["c", "alpha"]].to_numpy()
        third = graph_fit.whole_tuning(folds, edges, cfg, [5.0, 50.0], most=3).orderBy("dataset", "lam", "fold").toPandas().nll.to_numpy()
        return first, second, third

    inside = found()
    monkeypatch.setattr(graph_fit, "TASK_EDGES", -1)
    outside = found()
    assert [r[:2] for r in inside[0]] == [r[:2] for r in outside[0]]
    assert np.allclose([r[2:] for r in inside[0]], [r[2:] for r in outside[0]], atol=1e-7)
    assert np.allclose(inside[1], outside[1], atol=1e-7) and np.allclose(inside[2], outside[2], atol=1e-7)


def test_repeated_ids_are_one_node(spark, small):
    edges, nodes = small
    folds = nodes.withColumn("fold", (F.col("id") % 2).cast("int"))
    twice = folds.unionByName(folds.where("id < 3").withColumn("fold", F.lit(0)))
    score = lambda df: {(r.dataset, r.fold): r.nll for r in graph_fit.whole_tuning(df, edges, make_config("graph_gsea"), [50.0]).collect()}
    one, more = score(folds.unionByName(folds.where("id < 3"))), score(twice)
    assert one.keys() == more.keys() and np.allclose([one[k] for k in one], [more[k] for k in one])


def test_bench_decides_every_gene(spark):
    """More genes than the samples of 1,000 and 5,000 the bench once drew."""
    from hyposcape.plans.graph_bench import GraphBench

    rng = np.random.default_rng(4)
    n = 6000
    group = np.arange(n) // 30 * 30
    s, d = np.repeat(np.arange(n), 4), (group[:, None] + rng.integers(0, 30, (n, 4))).ravel()
    p = np.where(group < n // 5, rng.beta(0.2, 4, n), rng.random(n)).clip(1e-9, 1)
    frame = lambda **c: spark.createDataFrame(pd.DataFrame({"benchmark": "b", "dataset": "d", **c}))
    bundle = {
        "edges": frame(src=s, dst=d, w=np.ones(len(s))),
        "genes": frame(id=np.arange(n), p=p),
        "pathways": frame(pathway=[f"c{i // 60}" for i in range(n)], gene=np.arange(n)),
        "positives": frame(pathway=[f"c{i}" for i in range(n // 300)]),
    }
    got = {r.method: r for r in GraphBench(lambdas=(1.0, 10.0)).run(bundle).collect()}
    assert {m: r.n_genes for m, r in got.items()} == {"baseline": n, "smooth": n}
    assert got["smooth"].n_discoveries > got["baseline"].n_discoveries > 0 and got["smooth"].auc == 1.0


def test_lambda_tuning_takes_all_nodes(spark, tmp_path, monkeypatch):
    n = 700
    spark.createDataFrame([(i, 1 + i % 50, "b") for i in range(n)], "p_partkey long, p_size int, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    lines = [(o, k, (o + 3 * k * k) % n) for o in range(n) for k in range(1, 5)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    seen, fit = [], graph_fit.fit
    monkeypatch.setattr(graph_fit, "fit", lambda nodes, *a, **kw: seen.append(nodes.count()) or fit(nodes, *a, **{**kw, "most": 3}))
    got = entry.queries()["graph_lambda_tuning"](spark, str(tmp_path)).collect()
    assert seen == [n] and len(got) == 15
