"""Rows in = rows out, and no division by zero, for p-values of 0, 1, NaN, NULL and constant groups."""

import math

import numpy as np
from pyspark.sql import functions as F

from hyposcape.functions import scalar
from hyposcape.operators import clustering, density, testing


def odd(spark, n=300):
    rng = np.random.default_rng(1)
    p = [float(x) for x in rng.uniform(size=n)] + [0.0, 1.0, float("nan"), None]
    return spark.createDataFrame(list(enumerate(p)), "id long, p double")


def test_ranked_outputs_keep_rows(spark):
    df = odd(spark)
    n = df.count()
    q = testing.bh_adjusted(df)
    assert q.count() == n and q.where("q is null and not rejected").count() == 2
    assert testing.running_mean_q(df, "p").count() == n == testing.rank_p_values(df.withColumnRenamed("p", "s"), "s").count()
    assert testing.rolling_by_rank(df.withColumn("y", F.lit(1.0)), "p", "y").count() == n


def test_empirical_null_keeps_rows_and_groups(spark):
    df = odd(spark).withColumn("g", F.lit("many"))
    other = [(1000, 0.3, "one"), *((2000 + i, 0.4, "constant") for i in range(200))]
    df = df.unionByName(spark.createDataFrame(other, "id long, p double, g string"))
    rows = density.with_empirical_null(df, by=["g"]).collect()
    assert len(rows) == df.count()
    for r in rows:
        known = r["p"] is not None and not math.isnan(r["p"])
        assert (r["f1"] is not None) == known
        if r["g"] != "many":
            assert r["f0"] == 1.0 and abs(r["f1"] - 2 * (1 - r["p"])) < 1e-12


def test_zero_divisors(spark):
    same = spark.createDataFrame([(i, 0.1) for i in range(20)], "id long, p double")
    assert all(r["f1"] >= 0 for r in density.with_gaussian_shift(same).collect())
    row = spark.createDataFrame([(0.0, 1.0, 0.0)], "a double, f0 double, f1 double")
    assert row.select(scalar.local_fdr("a", "f0", "f1", None).alias("x")).first()["x"] == 0.0
    ends = spark.createDataFrame([(0.0,), (1.0,), (0.5,)], "a double").select(scalar.logit("a").alias("x")).collect()
    assert [r["x"] for r in ends] == [float("-inf"), float("inf"), 0.0]


def test_isolation_scores_of_few_rows(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=3)]) for i in range(40)], "id long, v array<double>")
    scores = [r["score"] for r in clustering.isolation_scores(df, trees=40).collect()]
    assert len(scores) == 40 and 0.4 < np.mean(scores) < 0.55
