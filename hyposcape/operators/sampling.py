"""Sampling, splits and label / p-value generators.  Draws derive from row keys, so they do not depend on partitioning."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hash_uniform, norm_sf
from ..session import cut_lineage
from .ordered import BUCKET, Order, attach, exact_quantiles, hash_rank, hash_take, with_bucket

# Probability of a null inside / outside the signal clusters.
CLUSTER_STRENGTH = {"none": (0.7, 0.7), "weak": (0.6, 0.8), "medium": (0.4, 0.9), "strong": (0.2, 0.95)}
# First Beta parameter of signal p-values by effect strength, with the second parameter and the clip.
EFFECTS = {
    "library": {"weak": 0.2, "medium": 0.05, "strong": 0.01, "b": 1.0, "clip": 0.0},
    "structural": {"weak": 0.5, "medium": 0.1, "strong": 0.02, "b": 1.0, "clip": 1e-10},
    "notebook": {"weak": 0.5, "medium": 0.1, "strong": 0.01, "b": 1.0, "clip": 0.0},
    "bench": {"weak": 0.5, "medium": 0.05, "strong": 0.02, "b": 3.0, "clip": 1e-10},
    "bench_cv": {"weak": 0.5, "medium": 0.05, "strong": 0.02, "b": 3.0, "clip": 1e-5},
    "selection": {"weak": 0.5, "medium": 0.05, "strong": 0.02, "b": 5.0, "clip": 1e-10},
}


def subsample(df: DataFrame, n: int, key: str = "id", seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """n rows without replacement per group (all rows if the group is smaller)."""
    return hash_take(df, key, f"sub|{seed}", n, by)


def candidate_pool(df: DataFrame, pool: int = 10000, key: str = "id", seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """Random candidate pool of bounded size, drawn before any quadratic step."""
    return hash_take(df, key, f"pool|{seed}", pool, by)


def stratified_subsample(
    df: DataFrame, p: str = "p", key: str = "id", n_target: int = 5000, n_bins: int = 100, by: Sequence[str] = ()
) -> DataFrame:
    """Quantile-stratified draw: n_target // n_bins rows from each quantile bin of p; groups within the target stay whole.

    Bins are right-closed between exact quantile edges; repeated edges merge into one bin.
    """
    probs = [i / n_bins for i in range(n_bins + 1)]
    edges = exact_quantiles(df, p, probs, by).groupBy(*by).agg(
        F.array_sort(F.collect_set("value")).alias("_edges"), F.max("n").alias("_n")
    )
    if by:
        rows = attach(df, cut_lineage(edges), by)  # a row a group, read three times below
        # number of inner edges strictly below p = index of the right-closed bin
        inner = F.slice("_edges", F.lit(2), F.greatest(F.size("_edges") - 2, F.lit(0)))
        rows = rows.withColumn("bin", F.size(F.filter(inner, lambda e: e < F.col(p))))
    else:
        row = edges.first()  # at most n_bins + 1 numbers
        if row is None or row["_n"] <= n_target:
            return df
        order = Order(tuple(math.nextafter(e, math.inf) for e in row["_edges"][1:-1]), ())
        rows = with_bucket(df, p, order).withColumnRenamed(BUCKET, "bin").withColumn("_n", F.lit(row["_n"]))
    small = rows.where(F.col("_n") <= n_target).select(*df.columns)
    large = rows.where(F.col("_n") > n_target)
    drawn = hash_take(large, key, "strat|42", n_target // n_bins, [*by, "bin"])
    return small.unionByName(drawn.select(*df.columns))


def train_test_split(
    df: DataFrame, test_share: float = 0.2, key: str = "id", strata: Sequence[str] = (), by: Sequence[str] = ()
) -> DataFrame:
    """Add ``split``: exactly floor(share * n) rows of each stratum go to 'test'."""
    ranked = hash_rank(df, key, "split|42", [*by, *strata], "_r")
    test = F.col("_r") < F.floor(F.col("_r_n") * F.lit(test_share))
    return ranked.withColumn("split", F.when(test, "test").otherwise("train")).drop("_r", "_r_n")


def k_folds(df: DataFrame, k: int = 5, key: str = "id", seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """Add ``fold`` in 0..k-1 with sizes that differ by at most one."""
    ranked = hash_rank(df, key, f"fold|{seed}", by, "_r")
    return ranked.withColumn("fold", (F.col("_r") % k).cast("int")).drop("_r", "_r_n")


def prediction_grid(spark, steps: int = 100) -> DataFrame:
    """Regular grid on the unit square."""
    i = spark.range(steps * steps)
    axis = lambda c: c.cast("double") / F.lit(float(steps - 1))
    return i.select("id", axis(F.floor(F.col("id") / steps)).alias("y"), axis(F.col("id") % steps).alias("x"))


def signal_groups(df: DataFrame, group: str = "group_id", fraction: float = 0.4, seed: int = 42) -> DataFrame:
    """Cluster ids drawn as signal-rich: max(1, int(k * fraction)) of them, in hash order."""
    ids = df.select(group).distinct()
    k = ids.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(fraction)).cast("int")).alias("k"))
    ranked = hash_rank(ids, group, f"sig|{seed}", (), "_r")
    return ranked.where(F.col("_r") < k.scalar()).select(group)


def clustered_labels(
    df: DataFrame, strength: str = "medium", in_signal: Column | None = None, key: str = "id", seed: int = 42
) -> DataFrame:
    """Bernoulli labels: P(null) depends on whether the row's cluster is signal-rich."""
    if strength not in CLUSTER_STRENGTH:
        raise ValueError(f"unknown strength {strength!r}; one of {sorted(CLUSTER_STRENGTH)}")
    inside, outside = CLUSTER_STRENGTH[strength]
    prob = F.when(F.col("is_signal") if in_signal is None else in_signal, inside).otherwise(outside)
    return df.withColumn("label", F.when(hash_uniform(key, f"lab|{seed}") < prob, 1).otherwise(0).cast("int"))


def effect_size(effect: str, variant: str = "library") -> float:
    table = EFFECTS[variant]
    return table.get(effect, 0.1) if effect in ("weak", "medium", "strong") else 0.1


def p_values(
    df: DataFrame, effect: str = "medium", variant: str = "library", key: str = "id", seed: int = 43
) -> DataFrame:
    """p from labels: nulls uniform; signals Beta(a, b).  Beta(a, 1) has the closed inverse u^(1/a); for b > 1 the inverse
    is found by bisection, vectorised per Arrow batch."""
    spec, a = EFFECTS[variant], effect_size(effect, variant)
    u = hash_uniform(key, f"p|{seed}")
    signal = F.pow(u, F.lit(1.0 / a)) if spec["b"] == 1.0 else beta_quantile(u, a, int(spec["b"]))
    p = F.when(F.col("label") == 1, u).otherwise(signal)
    lo = spec["clip"]
    return df.withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(lo), p)) if lo else p)


def beta_quantile(u: Column, a: float, b: int) -> Column:
    """Inverse of the Beta(a, b) distribution for whole b, by bisection on log x."""
    # cdf(x) = x^a / B * sum_j (-1)^j C(b-1, j) x^j / (a+j): finite because b is a whole number
    const = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    coef = [const * (-1) ** j * math.comb(b - 1, j) / (a + j) for j in range(b)]

    @F.pandas_udf("double")
    def inverse(s: pd.Series) -> pd.Series:
        t = np.log(np.clip(s.to_numpy(), 1e-300, 1.0))
        lo, hi = np.full(t.shape, -700.0 / max(a, 0.01)), np.zeros(t.shape)
        for _ in range(80):
            mid = (lo + hi) / 2
            x = np.exp(mid)
            logc = a * mid + np.log(np.clip(sum(c * x**j for j, c in enumerate(coef)), 1e-300, None))
            low = logc < t
            lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
        return pd.Series(np.exp(hi))

    return inverse(u)


def evaluation_data(df: DataFrame, strength: str, effect: str, group: str = "group_id", seed: int = 42) -> DataFrame:
    """Labels from signal-rich clusters, then p-values under the next seed."""
    sig = signal_groups(df, group, seed=seed).withColumn("is_signal", F.lit(True))
    flags = df.select(group).distinct().join(sig, group, "left")
    rows = attach(df, flags.select(group, F.coalesce("is_signal", F.lit(False)).alias("is_signal")), [group])
    return p_values(clustered_labels(rows, strength, seed=seed), effect, seed=seed + 1)


def gaussian_draw(key: str, salt: str) -> Column:
    """Standard normal draw by the Box-Muller transform of two key-derived uniforms."""
    u1, u2 = hash_uniform(key, f"{salt}|a"), hash_uniform(key, f"{salt}|b")
    return F.sqrt(-2 * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def square_data(df: DataFrame, key: str = "id", effect: float = 2.0, seed: int = 42) -> DataFrame:
    """Unit-square hypotheses: exactly 90% signals in the top-right quadrant and 10% elsewhere, one-sided normal p."""
    out = df.select(F.col(key), hash_uniform(key, f"x|{seed}").alias("x"), hash_uniform(key, f"y|{seed}").alias("y"))
    out = out.withColumn("quadrant", (F.col("x") > 0.5) & (F.col("y") > 0.5))
    ranked = hash_rank(out, key, f"sq|{seed}", ["quadrant"], "_r")
    share = F.when(F.col("quadrant"), 0.9).otherwise(0.1)
    label = F.when(F.col("_r") < F.floor(F.col("_r_n") * share), 0).otherwise(1).cast("int")
    out = ranked.withColumn("label", label).drop("_r", "_r_n")
    z = gaussian_draw(key, f"z|{seed}") + F.when(F.col("label") == 0, F.lit(effect)).otherwise(0.0)
    return out.withColumn("p", norm_sf(z)).withColumn("alpha_true", F.when(F.col("quadrant"), 0.1).otherwise(0.9))


def blob_data(
    df: DataFrame, key: str = "id", d: int = 2, centres: int = 3, spread: float = 0.5, effect: float = 2.0, seed: int = 42
) -> DataFrame:
    """Exactly 20% signals placed around a few centres, the rest standard normal; label 1 = null as everywhere here."""
    ranked = hash_rank(df.select(key), key, f"blob|{seed}", (), "_r")
    out = ranked.withColumn("label", F.when(F.col("_r") < F.floor(F.col("_r_n") * 0.2), 0).otherwise(1).cast("int"))
    which = F.floor(hash_uniform(key, f"c|{seed}") * centres).cast("int")
    rng = np.random.default_rng(seed)
    table = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in rng.normal(size=(centres, d)) * 2])
    noise = [gaussian_draw(key, f"n{j}|{seed}") for j in range(d)]
    centre = F.element_at(table, which + 1)
    v = F.array(*[F.when(F.col("label") == 0, centre[j] + noise[j] * spread).otherwise(noise[j]) for j in range(d)])
    z = gaussian_draw(key, f"z|{seed}") + F.when(F.col("label") == 0, F.lit(effect)).otherwise(0.0)
    return out.withColumn("v", v).withColumn("p", norm_sf(z)).drop("_r", "_r_n")


def noisy_alpha(df: DataFrame, truth: str = "alpha_true", key: str = "id", sd: float = 0.05) -> DataFrame:
    """Simulated Stage-1 output: truth plus normal noise, clipped to [0.01, 0.99]."""
    a = F.col(truth) + gaussian_draw(key, "alpha") * F.lit(sd)
    return df.withColumn("alpha", F.least(F.lit(0.99), F.greatest(F.lit(0.01), a)))


def group_quota(df: DataFrame, quotas: dict[int, int], group: str = "group_id", key: str = "id", salt: str = "quota") -> DataFrame:
    """Fixed number of rows per group id (all rows of groups that are too small); other groups are left out."""
    q = F.create_map(*chain.from_iterable((F.lit(g), F.lit(n)) for g, n in quotas.items()))
    chosen = df.where(F.col(group).isin(*quotas))
    return hash_take(chosen, key, salt, q[F.col(group)], [group])


def corrupt_labels(df: DataFrame, group: str, fraction: float, key: str = "id", seed: int = 42) -> DataFrame:
    """Flip exactly int(n * fraction) labels of each group."""
    ranked = hash_rank(df, key, f"flip|{seed}", [group], "_r")
    flip = F.col("_r") < F.floor(F.col("_r_n") * F.lit(fraction))
    return ranked.withColumn("label", F.when(flip, 1 - F.col("label")).otherwise(F.col("label")).cast("int")).drop(
        "_r", "_r_n"
    )



def ratio_subsample(df: DataFrame, signal: int, n_total: int = 500, h1_ratio: float = 0.1, group: str = "cluster", key: str = "id") -> DataFrame:
    """int(n * ratio) signals from one cluster and the remaining quota of nulls from all others; a short signal cluster
    gives all of its rows."""
    n1 = int(n_total * h1_ratio)
    pool = df.withColumn("label", F.when(F.col(group) == signal, 0).otherwise(1).cast("int"))
    return hash_take(pool, key, "ratio", F.when(F.col("label") == 0, n1).otherwise(n_total - n1), ["label"])
