"""No stage of the pipeline lets Spark broadcast a table that grows with the corpus."""

import numpy as np
from pyspark.sql import functions as F

from hyposcape.llm import common, mixing, near_copies, simhash


def plans_of(monkeypatch, run) -> dict[str, str]:
    seen, scratch = {}, common.scratch

    def kept(df, name):
        seen[name] = seen.get(name, "") + df._jdf.queryExecution().executedPlan().toString()
        return scratch(df, name)

    monkeypatch.setattr(common, "scratch", kept)
    seen["result"] = run()._jdf.queryExecution().executedPlan().toString()
    return seen


def docs(spark, n=60):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 300, 40)) for _ in range(n)]
    texts[1::6] = [t + " more" for t in texts[0::6]]
    return spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, source string")


def test_grid_of_fingerprints_is_not_broadcast(spark, monkeypatch):
    """34 rows a fingerprint, which Spark counts as one."""
    for name, plan in plans_of(monkeypatch, lambda: simhash.components_of(docs(spark))).items():
        assert "BroadcastHashJoin" not in plan, name


def test_buckets_of_near_copies_are_not_broadcast(spark, monkeypatch):
    for name, plan in plans_of(monkeypatch, lambda: near_copies.components_of(docs(spark))).items():
        assert "BroadcastHashJoin" not in plan, name


def test_mixing_plan_is_not_broadcast(spark, monkeypatch):
    plan = plans_of(monkeypatch, lambda: mixing.mixed(docs(spark)))["result"]
    assert "BroadcastHashJoin" not in plan
