"""Testing procedures: step-up rules, adjusted values, local-FDR rules, rank p-values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import hash32
from .ordered import (
    BUCKET,
    GROUP,
    SUB,
    attach,
    average_rank,
    hinted,
    keyed,
    numbers,
    ordered_rows,
    plan_order,
    prefix_over,
    row_prefix,
    settle,
    value_ranks,
    with_bucket,
    with_hash_order,
    with_missing,
)


def bh_threshold(df: DataFrame, p: str = "p", by: Sequence[str] = (), level: float = 0.1) -> DataFrame:
    """Benjamini-Hochberg cut line per group: ``threshold`` (0.0 if nothing passes), ``n``.

    Bucket extremes decide almost every bucket: a bucket whose largest p passes at its own rank settles all
    buckets below it, and a bucket whose smallest p is above the line at its last rank cannot pass.  Only
    the undecided buckets are read again and ranked.
    """
    base, keys = keyed(numbers(df.select(*by, F.col(p).alias("_p")), "_p"), by)
    b = with_bucket(base, "_p", plan_order(base, "_p"))
    stats = b.groupBy(*keys, BUCKET).agg(
        F.count(F.lit(1)).alias("cnt"), F.min("_p").alias("lo"), F.max("_p").alias("hi")
    )
    stats = prefix_over(stats, keys, [BUCKET], ["cnt"])
    whole = W.partitionBy(*keys)
    stats = stats.withColumn("n", F.sum("cnt").over(whole))
    line = (F.col("cnt_before") + F.col("cnt")) / F.col("n") * F.lit(level)
    stats = stats.withColumn("sure", F.col("hi") <= line).withColumn("maybe", F.col("lo") <= line)
    stats = stats.withColumn("top", F.coalesce(F.max(F.when(F.col("sure"), F.col(BUCKET))).over(whole), F.lit(-1)))
    stats, tiny = settle(stats, by)
    settled = stats.groupBy(*keys).agg(F.max(F.when(F.col("sure"), F.col("hi"))).alias("t1"), F.first("n").alias("n"))
    unsettled = stats.where((F.col(BUCKET) > F.col("top")) & F.col("maybe")).select(*keys, BUCKET, "cnt_before", "n")
    inside = b.join(hinted(unsettled, tiny), [*keys, BUCKET]).groupBy(*keys, BUCKET, "cnt_before", "n", "_p")
    inside = inside.agg(F.count(F.lit(1)).alias("cnt"))
    local = W.partitionBy(*keys, BUCKET).orderBy("_p").rowsBetween(W.unboundedPreceding, 0)
    inside = inside.withColumn("rank", F.col("cnt_before") + F.sum("cnt").over(local))
    passed = inside.where(F.col("_p") <= F.col("rank") / F.col("n") * F.lit(level))
    refined = passed.groupBy(*keys).agg(F.max("_p").alias("t2"))
    out = settled.join(refined, keys, "left")
    return out.select(
        *by, F.coalesce(F.greatest("t1", "t2"), F.lit(0.0)).alias("threshold"), F.col("n").alias("n")
    )


def benjamini_hochberg(df: DataFrame, p: str = "p", by: Sequence[str] = (), level: float = 0.1) -> DataFrame:
    """Add ``threshold`` and ``rejected`` (p <= threshold, ties included)."""
    cut = bh_threshold(df, p, by, level)
    out = attach(df, cut.drop("n"), by)
    keep = (F.col("threshold") > 0) & (F.col(p) <= F.col("threshold"))
    return out.withColumn("rejected", F.coalesce(keep, F.lit(False)))


def bh_first_k(df: DataFrame, p: str = "p", key: str = "id", by: Sequence[str] = (), level: float = 0.1) -> DataFrame:
    """Variant that rejects exactly the first k rows.  All ties at the cut line belong to the first k, because
    the last of them has the most favourable rank, so both forms agree; kept as a named option."""
    return benjamini_hochberg(df, p, by, level)


def bh_adjusted(df: DataFrame, p: str = "p", key: str = "id", by: Sequence[str] = (), level: float = 0.05) -> DataFrame:
    """Add step-up adjusted ``q`` (running minimum of p * n / rank from the largest p, capped at 1) and ``rejected``.

    Rows without a number in ``p`` stay: NULL ``q``, not rejected.  Inside a bucket the running minimum is local; the minimum over the later buckets is that bucket's offset.
    """
    rows, cell = ordered_rows(df, p, key, by)
    keys = cell[:-2]
    rows = rows.withColumn("_h", hash32(key, "tie"))
    local = W.partitionBy(*cell).orderBy(p, "_h", key)
    rows = rows.withColumn("_raw", F.col(p) / ((F.row_number().over(local) + F.col("_k0")) / F.col("rk_n")))
    later = W.partitionBy(*keys).orderBy(F.col(BUCKET).desc(), F.col(SUB).desc()).rowsBetween(W.unboundedPreceding, -1)
    # the last row of a cell has its largest p and rank; a cell's minimum needs all of its rows
    tail = rows.groupBy(*cell).agg(F.min("_raw").alias("_m")).withColumn("_tail", F.min("_m").over(later)).drop("_m")
    down = W.partitionBy(*cell).orderBy(F.col(p).desc(), F.col("_h").desc(), F.col(key).desc())
    best = F.min("_raw").over(down.rowsBetween(W.unboundedPreceding, 0))
    out = rows.join(tail, cell).withColumn("q", F.least(best, F.col("_tail"), F.lit(1.0)))
    out = out.drop("_h", "_raw", "_tail", BUCKET, SUB, "_k0", "_bn", "_v0", "_hot", "rk_n", GROUP)
    return with_missing(out, df, p).withColumn("rejected", F.coalesce(F.col("q") <= level, F.lit(False)))


def strict_signal_truth(df: DataFrame, p: str = "p", by: Sequence[str] = (), level: float = 0.05) -> DataFrame:
    """Proxy truth for held-out nodes: ``label`` = 0 where p is strictly below the step-up cut line."""
    out = attach(df, bh_threshold(df, p, by, level).drop("n"), by)
    return out.withColumn("label", F.when(F.col(p) < F.col("threshold"), 0).otherwise(1).cast("int"))


def local_fdr_rule(df: DataFrame, lfdr: str = "lfdr", level: float = 0.1) -> DataFrame:
    """Reject where the local FDR is at most the level."""
    return df.withColumn("rejected", F.coalesce(F.col(lfdr) <= level, F.lit(False)))


def discovery_count(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if("rejected").alias("n_discoveries"))


def step_up_cutoff(df: DataFrame, lfdr: str = "lfdr", by: Sequence[str] = (), level: float = 0.1) -> DataFrame:
    """Where the running mean of the sorted local FDR leaves the level: ``cut`` value, ``ties`` = how many rows
    equal to the cut are still accepted, ``k`` = number of rejections.

    The running mean of an ascending sequence never falls, so whole buckets pass until the first one whose
    end exceeds the level; only that bucket is read again.
    """
    base, keys = keyed(numbers(df.select(*by, F.col(lfdr).alias("_v")), "_v"), by)
    b = with_bucket(base, "_v", plan_order(base, "_v"))
    stats = b.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("cnt"), F.sum("_v").alias("s"), F.max("_v").alias("hi"))
    stats = prefix_over(stats, keys, [BUCKET], ["cnt", "s"])
    whole = W.partitionBy(*keys)
    over = (F.col("s_before") + F.col("s")) > F.lit(level) * (F.col("cnt_before") + F.col("cnt"))
    stats = stats.withColumn("edge", F.min(F.when(over, F.col(BUCKET))).over(whole))
    stats = stats.withColumn("all_n", F.sum("cnt").over(whole)).withColumn("last", F.max("hi").over(whole))
    stats, tiny = settle(stats, by)
    full = stats.groupBy(*keys).agg(F.first("edge").alias("edge"), F.first("all_n").alias("n"), F.first("last").alias("last"))
    at_edge = stats.where(F.col(BUCKET) == F.col("edge")).select(*keys, BUCKET, "cnt_before", "s_before")
    inside = b.join(hinted(at_edge, tiny), [*keys, BUCKET]).groupBy(*keys, BUCKET, "cnt_before", "s_before", "_v")
    inside = inside.agg(F.count(F.lit(1)).alias("cnt"))
    local = W.partitionBy(*keys, BUCKET).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    c0 = F.col("cnt_before") + F.sum("cnt").over(local) - F.col("cnt")
    s0 = F.col("s_before") + F.sum(F.col("_v") * F.col("cnt")).over(local) - F.col("_v") * F.col("cnt")
    inside = inside.withColumn("c0", c0).withColumn("s0", s0)
    over_first = F.col("s0") + F.col("_v") > F.lit(level) * (F.col("c0") + 1)
    room = F.floor((F.lit(level) * F.col("c0") - F.col("s0")) / (F.col("_v") - F.lit(level)))
    ties = F.when(F.col("_v") <= level, F.col("cnt")).when(over_first, 0).otherwise(F.least(F.col("cnt"), room))
    inside = inside.withColumn("ties", ties.cast("bigint"))
    stop = inside.where(F.col("ties") < F.col("cnt")).groupBy(*keys).agg(F.min(F.struct("_v", "ties", "c0")).alias("m"))
    out = full.join(stop, keys, "left")
    return out.select(
        *by,
        F.when(F.col("edge").isNull(), F.col("last")).otherwise(F.col("m._v")).alias("cut"),
        F.when(F.col("edge").isNull(), F.col("n")).otherwise(F.col("m.ties")).cast("bigint").alias("ties"),
        F.when(F.col("edge").isNull(), F.col("n")).otherwise(F.col("m.c0") + F.col("m.ties")).cast("bigint").alias("k"),
        F.col("n").cast("bigint").alias("n"),
    )


def lfdr_step_up(
    df: DataFrame, lfdr: str = "lfdr", key: str = "id", by: Sequence[str] = (), level: float = 0.1
) -> DataFrame:
    """Add ``rejected`` by the running-mean rule; equal values at the cut are taken in key-hash order."""
    cut = step_up_cutoff(df, lfdr, by, level)
    out = attach(df, cut.drop("n", "k"), by)
    below = F.coalesce(F.col(lfdr) < F.col("cut"), F.lit(False))
    partial = out.where(F.col(lfdr).eqNullSafe(F.col("cut")))
    rest = out.where(~F.col(lfdr).eqNullSafe(F.col("cut"))).withColumn("rejected", below)
    tied = tie_accept(partial, key, by)
    return rest.unionByName(tied.select(rest.columns)).drop("cut", "ties")


def tie_accept(partial: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """Among rows equal to the cut accept the first ``ties`` in hash order, ranking inside hash buckets only."""
    base, keys = keyed(with_hash_order(partial, key, "tie"), by)
    sizes = base.groupBy(*keys, BUCKET, "ties").agg(F.count(F.lit(1)).alias("cnt"))
    sizes = prefix_over(sizes, keys, [BUCKET], ["cnt"]).select(*keys, BUCKET, F.col("cnt_before").alias("_off"))
    r = F.row_number().over(W.partitionBy(*keys, BUCKET).orderBy("_h", key)) + F.col("_off")
    out = base.join(sizes, [*keys, BUCKET]).withColumn("rejected", r <= F.col("ties"))
    return out.drop("_h", BUCKET, "_off", GROUP)


def running_mean_q(df: DataFrame, lfdr: str = "lfdr", key: str = "id", by: Sequence[str] = ()) -> DataFrame:
    """Add ``q`` = running mean of the sorted local FDR at each row's own position (ties in key-hash order)."""
    out = row_prefix(df, lfdr, key, by, {"q": F.col(lfdr)})
    return with_missing(out.withColumn("q", F.col("q_cum") / F.col("rk")).drop("q_cum", "rk", "rk_n"), df, lfdr)


def rolling_by_rank(
    df: DataFrame, order: str, value: str, key: str = "id", by: Sequence[str] = (), min_width: int = 5, parts: int = 5
) -> DataFrame:
    """Centred rolling mean and sample deviation over the order of another column, window max(min_width, n // parts).

    The window is a share of the group, so no frame is materialised: each row subtracts two prefix sums that
    it finds by rank.  Rows without a full frame get NULL.
    """
    mean = df.where(F.col(order).isNotNull() & ~F.isnan(F.col(order).cast("double"))).groupBy(*by).agg(F.avg(value).alias("_mid"))
    y = F.col(value) - F.col("_mid")  # moments about the group's mean: squares of large values would cancel
    pre = row_prefix(attach(df, mean, by, "left"), order, key, by, {"y": y, "yy": y * y})
    pre = pre.withColumn("w", F.greatest(F.lit(min_width), F.floor(F.col("rk_n") / parts)).cast("bigint"))
    after = F.floor((F.col("w") - 1) / 2).cast("bigint")
    pre = pre.withColumn("_hi", F.col("rk") + after).withColumn("_lo", F.col("rk") + after - F.col("w"))
    top = pre.select(*by, F.col("rk").alias("_hi"), F.col("y_cum").alias("_y1"), F.col("yy_cum").alias("_yy1"))
    low = pre.select(*by, F.col("rk").alias("_lo"), F.col("y_cum").alias("_y0"), F.col("yy_cum").alias("_yy0"))
    out = pre.join(top, [*by, "_hi"], "left").join(low, [*by, "_lo"], "left")
    full = (F.col("_lo") >= 0) & F.col("_y1").isNotNull()
    s = F.col("_y1") - F.coalesce("_y0", F.lit(0.0))
    ss = F.col("_yy1") - F.coalesce("_yy0", F.lit(0.0))
    var = (ss - s * s / F.col("w")) / (F.col("w") - 1)
    out = out.withColumn("roll_mean", F.when(full, F.col("_mid") + s / F.col("w")))
    out = out.withColumn("roll_std", F.when(full, F.sqrt(F.greatest(var, F.lit(0.0)))))
    return with_missing(out.drop("_hi", "_lo", "_y0", "_y1", "_yy0", "_yy1", "y_cum", "yy_cum", "_mid"), df, order)


def rank_p_values(
    df: DataFrame, score: str, key: str = "id", by: Sequence[str] = (), eps: float = 1e-10
) -> DataFrame:
    """Anomaly score to p: 1 - average rank / n, clipped to [eps, 1-eps]."""
    r = average_rank(df, score, key, by, "_r")
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.lit(1.0) - F.col("_r") / F.col("_r_n")))
    return with_missing(r.withColumn("p", p).drop("_r", "_r_n"), df, score)


def auc(df: DataFrame, score: str, positive: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank-sum AUC, exact under ties; NULL plus ``reason`` when only one class is present."""
    pos = F.when(F.col(positive), 1).otherwise(0)
    r = value_ranks(df, score, by, {"pos": pos})
    neg_before = F.col("cnt_before") - F.col("pos_before")
    neg_here = F.col("cnt") - F.col("pos")
    agg = r.groupBy(*by).agg(
        F.sum(F.col("pos") * (neg_before + neg_here / F.lit(2.0))).alias("u"),
        F.sum("pos").alias("n_pos"),
        F.sum("cnt").alias("n"),
    )
    n_neg = F.col("n") - F.col("n_pos")
    both = (F.col("n_pos") > 0) & (n_neg > 0)
    return agg.select(
        *by,
        F.when(both, F.col("u") / F.col("n_pos") / n_neg).alias("auc"),
        "n_pos",
        "n",
        F.when(both, "ok").otherwise("single class").alias("reason"),
    )
