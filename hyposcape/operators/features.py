"""Feature preparation and key hygiene."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import attach


def standardize(df: DataFrame, features: str = "v", by: Sequence[str] = ()) -> DataFrame:
    """Centre and scale every dimension by mean and population deviation; constant dimensions keep scale 1.

    One tree-aggregated pass; the state is one vector per group.
    """
    v = array_to_vector(F.col(features))
    s = df.groupBy(*by).agg(Summarizer.metrics("mean", "variance", "count").summary(v).alias("s"))
    n = F.col("s.count")
    pop = F.transform(
        vector_to_array(F.col("s.variance")),
        lambda x: F.sqrt(F.greatest(F.lit(0.0), x * (n - 1) / n)),
    )
    params = s.select(
        *by, vector_to_array(F.col("s.mean")).alias("_mean"), F.transform(pop, lambda x: F.when(x > 0, x).otherwise(1.0)).alias("_std")
    )
    out = attach(df, params, by)
    centred = F.zip_with(F.col(features), F.col("_mean"), lambda a, b: a - b)
    return out.withColumn(features, F.zip_with(centred, F.col("_std"), lambda a, b: a / b)).drop("_mean", "_std")


def keep_first(df: DataFrame, key: Sequence[str], order: str, ties: Sequence[str] = ()) -> DataFrame:
    """Drop duplicate keys keeping the first row in a stated order; combines map-side, so hot keys do not pile up.  Rows that the
    order leaves open go by the ``ties`` columns, which are not returned."""
    rest = [c for c in df.columns if c not in (*key, *ties) and c != order]
    first = df.groupBy(*key).agg(F.min(F.struct(order, *ties, *rest)).alias("_s"))
    return first.select(*key, *[F.col(f"_s.{c}").alias(c) for c in (order, *rest)])


def concat_results(*frames: DataFrame) -> DataFrame:
    """Stack result logs by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def min_max_isolation(df: DataFrame, score: str, by: Sequence[str] = (), out: str = "isolation") -> DataFrame:
    """1 - min-max scaled score, per group."""
    lim = df.groupBy(*by).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    scaled = (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-10)
    return attach(df, lim, by).withColumn(out, F.lit(1.0) - scaled).drop("_lo", "_hi")
