"""Set enrichment: universe intersection, hypergeometric tail, ranking quality."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import lgamma
from ..session import cut_lineage
from .ordered import attach
from .testing import auc


def explode_sets(df: DataFrame, sets: str = "pathways") -> DataFrame:
    """map<name, array<gene>> to rows (pathway, gene)."""
    rest = [c for c in df.columns if c != sets]
    long = df.select(*rest, F.explode(sets).alias("pathway", "genes"))
    return long.select(*rest, "pathway", F.explode("genes").alias("gene"))


def log_choose(n: Column, k: Column) -> Column:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


@F.pandas_udf(DoubleType())
def tail_series(first: pd.Series, x: pd.Series, M: pd.Series, n: pd.Series, N: pd.Series, up: pd.Series) -> pd.Series:
    """Sum of the terms from x away from the mode, given the first: all rows in step, a row ends when its terms no longer count.

    The ratio of neighbouring terms falls on the way, so once a term t has ratio r < 1 the rest is below t r / (1 - r).
    """
    t, x, M, n, N = (c.to_numpy(float).copy() for c in (first, x, M, n, N))
    up, total = up.fillna(True).to_numpy(bool), t.copy()
    live = np.flatnonzero(t > 0)
    while len(live):
        p, m, k, d = x[live], M[live], n[live], N[live]
        r = np.where(up[live], (k - p) * (d - p) / ((p + 1) * (m - k - d + p + 1)), p * (m - k - d + p) / ((k - p + 1) * (d - p + 1)))
        t[live] *= r
        total[live] += t[live]
        x[live] += np.where(up[live], 1.0, -1.0)
        live = live[(t[live] > 0) & ((r >= 1) | (t[live] * r > 1e-17 * total[live] * (1 - r)))]
    return pd.Series(total)


def hypergeom_sf(k: Column, M: Column, n: Column, N: Column) -> Column:
    """P(X >= k) for X hypergeometric: population M, n marked, N drawn.

    The first term comes from log-gammas, the others by the ratio of neighbours, summed away from the mode so
    that terms only shrink: upwards from k above the mode, else one minus the lower tail downwards from k - 1.  A set needs a
    few spreads of the distribution in terms and no memory, however large it is.
    """
    k, M, n, N = (c.cast("double") for c in (k, M, n, N))
    top, low = F.least(n, N), F.greatest(F.lit(0.0), n + N - M)
    above = k > F.floor((n + 1) * (N + 1) / (M + 2))
    x = F.when(above, k).otherwise(k - 1)
    inside = (k > low) & (k <= top)
    first = F.when(inside, F.exp(log_choose(n, x) + log_choose(M - n, N - x) - log_choose(M, N)))
    tail = tail_series(first, x, M, n, N, above)
    out = F.when(k <= low, 1.0).when(k > top, 0.0).when(above, tail).otherwise(F.lit(1.0) - tail)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))


def enrichment(
    members: DataFrame, selected: DataFrame, universe: DataFrame, by: Sequence[str] = (), min_size: int = 3
) -> DataFrame:
    """Per pathway: size within the universe, overlap with the selection, tail probability.

    members (by, pathway, gene); selected and universe (by, gene), selection flags travel with the universe, so
    the large membership relation is joined once.  Sets below ``min_size`` report p = 1 and overlap 0.
    """
    genes = universe.select(*by, "gene").distinct()
    chosen = selected.select(*by, "gene").distinct().withColumn("_sel", F.lit(1))
    flags = cut_lineage(genes.join(chosen, [*by, "gene"], "left"))
    totals = flags.groupBy(*by).agg(F.count(F.lit(1)).alias("M"), F.count("_sel").alias("N"))
    # one pass over the members; the join is salted, so a hub gene of very many sets does not pile up in one task
    flags = flags.withColumn("_in", F.lit(1))
    hits = attach(members.select(*by, "pathway", "gene").distinct(), flags, [*by, "gene"], "left")
    counts = hits.groupBy(*by, "pathway").agg(F.count("_in").alias("size"), F.count("_sel").alias("overlap"))
    if by:
        both = counts.join(totals, list(by))
    else:
        both = counts.withColumn("_one", F.lit(1)).join(F.broadcast(totals.withColumn("_one", F.lit(1))), "_one").drop("_one")
    small = F.col("size") < min_size
    sf = hypergeom_sf(F.col("overlap"), F.col("M"), F.col("size"), F.col("N"))
    out = both.withColumn("pval", F.when(small | (F.col("overlap") == 0), 1.0).otherwise(sf))
    return out.select(*by, "pathway", "pval", F.when(small, 0).otherwise(F.col("overlap")).cast("bigint").alias("overlap"), "size")


def enrichment_auc(result: DataFrame, positives: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AUC of -log10(pval + 1e-100) against the positive pathways."""
    flag = positives.select(*by, "pathway").distinct().withColumn("_pos", F.lit(True))
    r = result.join(flag, [*by, "pathway"], "left")
    r = r.withColumn("score", -F.log10(F.col("pval") + F.lit(1e-100))).withColumn("pos", F.coalesce("_pos", F.lit(False)))
    return auc(r, "score", "pos", by)
