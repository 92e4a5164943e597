import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hyposcape.operators import ordered, testing


@pytest.fixture(scope="module")
def hot(spark):
    """Values where one number holds a third of all rows and one group holds most of them."""
    rng = np.random.default_rng(3)
    n = 6000
    v = np.where(rng.random(n) < 0.34, 0.25, np.round(rng.random(n), 3))
    g = np.where(rng.random(n) < 0.7, "a", np.where(rng.random(n) < 0.5, "b", "c"))
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "p": v, "y": rng.normal(size=n)})
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


def test_exact_quantiles(hot):
    pdf, df = hot
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {(r.g, r.prob): r.value for r in ordered.exact_quantiles(df, "p", probs, ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        for q in probs:
            assert np.isclose(got[g, q], np.quantile(part.p, q), rtol=0, atol=1e-12)


def test_hot_value_gets_its_own_bucket(hot):
    _, df = hot
    order = ordered.plan_order(df, "p")
    rows = ordered.with_spread(ordered.with_bucket(df, "p", order), order, "id")
    assert order.hot
    biggest = rows.groupBy(ordered.BUCKET, ordered.SUB).count().agg(F.max("count")).first()[0]
    assert biggest < 6000 * 0.1


def test_row_prefix_is_a_consistent_order(hot):
    pdf, df = hot
    out = ordered.row_prefix(df, "p", "id", ["g"], {"y": F.col("y")}).toPandas()
    for _, part in out.groupby("g"):
        part = part.sort_values("rk")
        assert (part.rk.to_numpy() == np.arange(1, len(part) + 1)).all()
        assert (np.diff(part.p.to_numpy()) >= 0).all()
        assert np.allclose(part.y_cum, np.cumsum(part.y), atol=1e-9)


def test_average_rank(hot):
    pdf, df = hot
    out = ordered.average_rank(df, "p", "id", ["g"]).toPandas().set_index("id")
    want = pdf.groupby("g").p.rank(method="average")
    assert np.allclose(out.rk.sort_index(), want.sort_index())


def test_hash_take_and_rank(hot):
    _, df = hot
    assert ordered.hash_take(df, "id", "s", 100, ["g"]).groupBy("g").count().collect()[0]["count"] == 100
    a = {r.id for r in ordered.hash_take(df, "id", "s", 500).collect()}
    b = {r.id for r in ordered.hash_rank(df, "id", "s").where("rank < 500").collect()}
    assert a == b and len(a) == 500
    assert ordered.hash_take(df, "id", "s", 10**6).count() == 6000


def numpy_bh(p, level):
    s = np.sort(p)
    ok = np.flatnonzero(s <= np.arange(1, len(s) + 1) / len(s) * level)
    return s[ok[-1]] if len(ok) else 0.0


@pytest.mark.parametrize("level", [0.01, 0.3, 0.6, 0.9])
def test_bh_with_ties(hot, level):
    pdf, df = hot
    got = {r.g: r.threshold for r in testing.bh_threshold(df, by=["g"], level=level).collect()}
    for g, part in pdf.groupby("g"):
        assert got[g] == numpy_bh(part.p.to_numpy(), level)
    rej = testing.benjamini_hochberg(df, by=["g"], level=level).toPandas()
    for g, part in rej.groupby("g"):
        t = numpy_bh(part.p.to_numpy(), level)
        assert (part.rejected == ((part.p <= t) & (t > 0))).all()


def test_bh_is_monotone_in_level(hot):
    _, df = hot
    n = [testing.benjamini_hochberg(df, level=a).where("rejected").count() for a in (0.2, 0.5, 0.8)]
    assert n == sorted(n)


def test_bh_adjusted(hot):
    pdf, df = hot
    out = testing.bh_adjusted(df, by=["g"], level=0.5).toPandas()
    for _, part in out.groupby("g"):
        p = part.sort_values("p")
        raw = p.p.to_numpy() * len(p) / np.arange(1, len(p) + 1)
        q = np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1])
        assert np.allclose(np.sort(p.q.to_numpy()), q)
        assert (p.rejected == (p.q <= 0.5)).all()


@pytest.mark.parametrize("level", [0.05, 0.2, 0.3, 0.45, 0.9])
def test_lfdr_step_up_with_ties(hot, level):
    pdf, df = hot
    out = testing.lfdr_step_up(df, "p", by=["g"], level=level).toPandas()
    assert len(out) == len(pdf)
    for _, part in out.groupby("g"):
        s = np.sort(part.p.to_numpy())
        ok = np.flatnonzero(np.cumsum(s) <= level * np.arange(1, len(s) + 1) + 1e-12)
        assert part.rejected.sum() == (ok[-1] + 1 if len(ok) else 0)
        if part.rejected.any():
            assert part[part.rejected].p.max() <= part[~part.rejected].p.min() if (~part.rejected).any() else True


def test_rolling_deviation_of_large_values(hot):
    """Values of 1e6 and more: squares would cancel, moments about the mean do not."""
    pdf, df = hot
    roll = testing.rolling_by_rank(df.withColumn("y", F.col("y") + F.when(F.col("g") == "a", 1e8).otherwise(-1e6)), "p", "y", by=["g"]).toPandas()
    near = testing.rolling_by_rank(df, "p", "y", by=["g"]).toPandas()
    both = roll.merge(near, on="id", suffixes=("", "_near"))
    assert len(both) == len(pdf)
    assert np.allclose(both.roll_std, both.roll_std_near, rtol=1e-6, equal_nan=True)
    assert np.allclose(both.roll_mean - np.where(both.g == "a", 1e8, -1e6), both.roll_mean_near, atol=1e-6, equal_nan=True)


def test_running_mean_q_and_rolling(hot):
    pdf, df = hot
    q = testing.running_mean_q(df, "p", by=["g"]).toPandas()
    for _, part in q.groupby("g"):
        s = np.sort(part.p.to_numpy())
        assert np.allclose(np.sort(part.q.to_numpy()), np.sort(np.cumsum(s) / np.arange(1, len(s) + 1)))
    roll = testing.rolling_by_rank(df, "p", "y", by=["g"]).toPandas()
    for _, part in roll.groupby("g"):
        part = part.sort_values("rk")
        w = max(5, len(part) // 5)
        want = pd.Series(part.y.to_numpy()).rolling(w, center=True)
        assert np.allclose(part.roll_mean.astype(float), want.mean(), equal_nan=True, atol=1e-9)
        assert np.allclose(part.roll_std.astype(float), want.std(), equal_nan=True, atol=1e-6)


def test_auc_with_ties_and_single_class(hot, spark):
    pdf, df = hot
    pos = (pdf.y > 0.3).to_numpy()
    r = pdf.p.rank().to_numpy()
    want = (r[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / pos.sum() / (~pos).sum()
    got = testing.auc(df.withColumn("pos", F.col("y") > 0.3), "p", "pos").first()
    assert np.isclose(got.auc, want)
    one = testing.auc(df.withColumn("pos", F.lit(True)), "p", "pos").first()
    assert one.auc is None and one.reason == "single class"


def test_stratified_subsample_takes_each_bin_evenly(hot):
    from hyposcape.operators.sampling import stratified_subsample

    pdf, df = hot
    out = stratified_subsample(df, n_target=500, n_bins=20).toPandas()
    bins = pd.qcut(pdf.p, 20, labels=False, duplicates="drop")
    per = bins.loc[out.id].value_counts()
    size = bins.value_counts()
    assert out.id.is_unique and all(per[b] == min(25, size[b]) for b in size.index)
    assert stratified_subsample(df, n_target=10_000).count() == len(pdf)
    grouped = stratified_subsample(df, n_target=500, n_bins=20, by=["g"]).toPandas()
    for g, part in pdf.groupby("g"):
        b = pd.qcut(part.p, 20, labels=False, duplicates="drop")
        got = b.loc[grouped[grouped.g == g].id].value_counts()
        assert all(got[k] == min(25, n) for k, n in b.value_counts().items())
