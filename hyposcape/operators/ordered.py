"""Exact order statistics without a single-partition sort.

A global ``ORDER BY`` window would send a whole dataset to one task.  Here a value is first mapped to one of
N ordered buckets (cut points come from a sample, so they steer balance only, never the result).  Per-bucket
counts and sums form a small table; its prefix sums are the offsets of each bucket.  Operators that need one
rank (thresholds, quantiles, cut-offs) then read only the bucket that holds it; operators that need all ranks
sort inside (group, bucket).  A value that covers more than one cut point is hot: it gets a bucket of its own,
which is spread further over hash buckets of the row key.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import hash32
from ..session import cut_lineage, order_buckets

GROUP = "_g"
BUCKET = "_b"
SUB = "_sub"
MAX_SMALL = 200_000


def keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Give ungrouped input a constant key so that one code path serves both cases."""
    by = list(by)
    return (df, by) if by else (df.withColumn(GROUP, F.lit(0)), [GROUP])


@dataclass(frozen=True)
class Order:
    """Ordered buckets of a column: cut points and the buckets that hold a single hot value."""

    cuts: tuple[float, ...]
    hot: tuple[int, ...]


def plan_order(df: DataFrame, value: str, n_buckets: int | None = None) -> Order:
    """Cut points from a mergeable quantile sketch of the column; at most n-1 numbers reach the driver.

    ``hyposcape.order.sampleFraction`` lets a very large input be sketched from a sample.
    """
    spark = df.sparkSession
    n = n_buckets or order_buckets(spark)
    column = df.select(F.col(value).cast("double").alias(value))
    probs = [i / n for i in range(1, n)]
    error = 1.0 / (4 * n)
    fraction = float(spark.conf.get("hyposcape.order.sampleFraction", "1.0"))
    cuts: list[float] = []
    if fraction < 1.0:
        cuts = column.sample(fraction, seed=7).approxQuantile(value, probs, error)
    if not cuts:
        cuts = column.approxQuantile(value, probs, error)
    finite = [c for c in cuts if math.isfinite(c)]
    hot = {c for c, times in Counter(finite).items() if times > 1}
    points = sorted(set(finite) | {math.nextafter(c, math.inf) for c in hot})
    return Order(tuple(points), tuple(i + 1 for i, c in enumerate(points) if c in hot))


def with_bucket(df: DataFrame, value: str, order: Order) -> DataFrame:
    """Ordered bucket of a double column; the lookup is a JVM binary search."""
    if not order.cuts:
        return df.withColumn(BUCKET, F.lit(0))
    splits = [float("-inf"), *order.cuts, float("inf")]
    out = Bucketizer(splits=splits, inputCol=value, outputCol=BUCKET, handleInvalid="keep").transform(df)
    return out.withColumn(BUCKET, F.col(BUCKET).cast("int"))


def with_spread(df: DataFrame, order: Order, key: str) -> DataFrame:
    """Sub-bucket: rows of a hot value are spread by the hash of their key, others stay in 0."""
    if not order.hot:
        return df.withColumn(SUB, F.lit(0))
    n = order_buckets(df.sparkSession)
    return df.withColumn(SUB, F.when(F.col(BUCKET).isin(*order.hot), hash_bucket(key, "tie", n)).otherwise(F.lit(0)))


def numbers(df: DataFrame, *columns: str) -> DataFrame:
    """Drop NULL and NaN in the given columns."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c))
    return df


def with_missing(out: DataFrame, df: DataFrame, value: str) -> DataFrame:
    """Add back the rows of ``df`` that have no number in ``value``; the columns that ``out`` gained are NULL there."""
    absent = df.where(F.col(value).isNull() | F.isnan(value))
    return out.unionByName(absent, allowMissingColumns=True)


def prefix_over(df: DataFrame, keys: Sequence[str], order: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Exclusive prefix sums over a small ordered table (buckets of a group)."""
    w = W.partitionBy(*keys).orderBy(*order)
    for m in measures:
        df = df.withColumn(f"{m}_before", F.sum(m).over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col(m))
    return df


def settle(table: DataFrame, by: Sequence[str]) -> tuple[DataFrame, bool]:
    """Materialise a per-bucket table once and say whether it may be broadcast: its rows are counted."""
    done = cut_lineage(table)
    return done, done.count() <= MAX_SMALL


def hinted(table: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(table) if small else table


def cumulate(
    df: DataFrame, value: str, measures: Sequence[str], by: Sequence[str] = (), order: Order | None = None
) -> DataFrame:
    """Per distinct value, add ``<m>_before`` = sum of m over smaller values of the group, and ``<m>_all``.

    ``df`` must hold one row per (group, value).
    """
    base, keys = keyed(df, by)
    b = with_bucket(base, value, order or plan_order(base, value))
    totals = b.groupBy(*keys, BUCKET).agg(*[F.sum(m).alias(m) for m in measures])
    totals, tiny = settle(prefix_over(totals, keys, [BUCKET], measures), by)
    whole = W.partitionBy(*keys)
    offsets = totals.select(
        *keys,
        BUCKET,
        *[F.col(f"{m}_before").alias(f"_{m}_off") for m in measures],
        *[F.sum(m).over(whole).alias(f"{m}_all") for m in measures],
    )
    local = W.partitionBy(*keys, BUCKET).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    out = b.join(hinted(offsets, tiny), [*keys, BUCKET])
    for m in measures:
        out = out.withColumn(f"{m}_before", F.col(f"_{m}_off") + F.sum(m).over(local) - F.col(m))
    return out.drop(BUCKET, GROUP, *[f"_{m}_off" for m in measures])


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = (), extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per (group, distinct value): ``cnt``, ``cnt_before``, ``cnt_all`` and the same for extra sums."""
    extra = extra or {}
    base = numbers(df, value)
    order = plan_order(base, value)
    vc = base.groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("cnt"), *[F.sum(c).alias(name) for name, c in extra.items()]
    )
    return cumulate(vc, value, ["cnt", *extra], by, order)


def attach(df: DataFrame, params: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Attach a table with one row per group.

    Ungrouped parameters are one row, hence a broadcast of proven size.  With groups both sides carry a salt,
    so a group that holds a third of all rows is still spread over many tasks (the parameter table is small
    next to the rows and is repeated once per salt).
    """
    if not by:
        right = params if GROUP in params.columns else params.withColumn(GROUP, F.lit(0))
        return df.withColumn(GROUP, F.lit(0)).join(F.broadcast(right), GROUP, how).drop(GROUP)
    salts = min(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    scalar = ["id"] if "id" in df.columns else [f.name for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct")]
    left = df.withColumn("_salt", F.pmod(F.xxhash64(*scalar), F.lit(salts)))
    right = params.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return left.join(right, [*by, "_salt"], how).drop("_salt")


def bucket_totals(b: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, bool]:
    """Rows per bucket and before it, materialised; also whether the table may be broadcast."""
    totals = prefix_over(b.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("cnt")), keys, [BUCKET], ["cnt"])
    return settle(totals, [k for k in keys if k != GROUP])


def select_by_rank(
    b: DataFrame, value: str, ranks: DataFrame, keys: Sequence[str], totals: DataFrame, tiny: bool
) -> DataFrame:
    """Values at 0-based ranks: ``ranks`` (keys, ``rank``) gains the value column.  Only the buckets that hold a wanted
    rank are read again."""
    wanted = totals.join(ranks, keys).where(
        (F.col("rank") >= F.col("cnt_before")) & (F.col("rank") < F.col("cnt_before") + F.col("cnt"))
    )
    places = wanted.groupBy(*keys, BUCKET).agg(F.first("cnt_before").alias("off"), F.collect_set("rank").alias("rs"))
    inside = b.join(hinted(places.select(*keys, BUCKET, "off"), tiny), [*keys, BUCKET])
    inside = inside.groupBy(*keys, BUCKET, "off", value).agg(F.count(F.lit(1)).alias("cnt"))
    w = W.partitionBy(*keys, BUCKET).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    inside = inside.withColumn("hi", F.col("off") + F.sum("cnt").over(w)).withColumn("lo", F.col("hi") - F.col("cnt"))
    return inside.join(hinted(places.select(*keys, BUCKET, "rs"), tiny), [*keys, BUCKET]).select(
        *keys, F.col(value), F.explode(F.filter("rs", lambda r: (r >= F.col("lo")) & (r < F.col("hi")))).alias("rank")
    )


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolation quantiles, one row per (group, ``prob``) with ``value`` and the row count ``n``."""
    base, keys = keyed(numbers(df.select(*by, value), value), by)
    b = with_bucket(base, value, plan_order(base, value))
    totals, tiny = bucket_totals(b, keys)
    at = totals.groupBy(*keys).agg(F.sum("cnt").alias("n"))
    at = at.withColumn("prob", F.explode(F.array(*[F.lit(float(q)) for q in probs])))
    at = at.withColumn("pos", (F.col("n") - 1) * F.col("prob"))
    lo, hi = F.floor("pos").cast("bigint"), F.ceil("pos").cast("bigint")
    each = at.withColumn("rank", F.explode(F.array_distinct(F.array(lo, hi))))
    found = select_by_rank(b, value, each.select(*keys, "rank").distinct(), keys, totals, tiny).withColumnRenamed(value, "_v")
    low, high = F.min_by("_v", "rank"), F.max_by("_v", "rank")
    part = F.col("pos") - F.floor("pos")
    out = each.join(found, [*keys, "rank"]).groupBy(*keys, "prob", "n", "pos").agg((low + (high - low) * part).alias("value"))
    return out.select(*by, "prob", "value", "n")


def quantile_row(df: DataFrame, value: str, named: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Quantiles side by side: one row per group, one column per name."""
    q = exact_quantiles(df, value, sorted(set(named.values())), by)
    return q.groupBy(*by).agg(
        *[F.max(F.when(F.col("prob") == float(p), F.col("value"))).alias(name) for name, p in named.items()]
    )


HASH_SPAN = 4294967296


def hash_bucket(key: str, salt: str, n_buckets: int) -> Column:
    """Ordered bucket of the hash; uniform by construction, so no sampling is needed."""
    return bucket_of_hash(hash32(key, salt), n_buckets)


def bucket_of_hash(h: Column, n_buckets: int) -> Column:
    return F.floor(h * F.lit(n_buckets) / F.lit(float(HASH_SPAN))).cast("int")


def with_hash_order(df: DataFrame, key: str, salt: str) -> DataFrame:
    n = order_buckets(df.sparkSession)
    return df.withColumn("_h", hash32(key, salt)).withColumn(BUCKET, bucket_of_hash(F.col("_h"), n))


def hash_rank(df: DataFrame, key: str, salt: str, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """0-based rank of each row in (hash, key) order within its group, plus ``<out>_n`` = group size."""
    base, keys = keyed(with_hash_order(df, key, salt), by)
    sizes = prefix_over(base.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("cnt")), keys, [BUCKET], ["cnt"])
    sizes = sizes.select(
        *keys, BUCKET, F.col("cnt_before").alias("_off"), F.sum("cnt").over(W.partitionBy(*keys)).alias(f"{out}_n")
    )
    sizes, tiny = settle(sizes, by)
    local = W.partitionBy(*keys, BUCKET).orderBy("_h", key)
    ranked = base.join(hinted(sizes, tiny), [*keys, BUCKET]).withColumn(out, F.row_number().over(local) - 1 + F.col("_off"))
    return ranked.drop("_h", BUCKET, "_off", GROUP)


def hash_take(df: DataFrame, key: str, salt: str, quota: Column | int, by: Sequence[str] = ()) -> DataFrame:
    """The first ``quota`` rows of each group in (hash, key) order.

    Whole buckets below the quota pass straight through; only the one bucket that straddles it is ranked.
    ``quota`` may use the per-group row count ``_n``.
    """
    base, keys = keyed(with_hash_order(df, key, salt), by)
    sizes = prefix_over(base.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("cnt")), keys, [BUCKET], ["cnt"])
    sizes = sizes.withColumn("_n", F.sum("cnt").over(W.partitionBy(*keys)))
    want = quota if isinstance(quota, Column) else F.lit(quota)
    sizes, tiny = settle(sizes.withColumn("_left", want - F.col("cnt_before")).where("_left > 0"), by)
    cols = df.columns
    picked = base.join(hinted(sizes, tiny).select(*keys, BUCKET, "cnt", "_left"), [*keys, BUCKET])
    whole = picked.where("cnt <= _left").select(*cols)
    edge = picked.where("cnt > _left").withColumn("_r", F.row_number().over(W.partitionBy(*keys, BUCKET).orderBy("_h", key)))
    return whole.unionByName(edge.where("_r <= _left").select(*cols))


def ordered_rows(
    df: DataFrame, value: str, key: str, by: Sequence[str] = (), measures: dict[str, Column] | None = None
) -> tuple[DataFrame, list[str]]:
    """Rows with the offsets of their bucket: ``_k0`` rows and ``_s_<m>`` sums before it, ``_bn`` rows in its value
    bucket, ``_v0`` rows before its value bucket, group size ``rk_n``.  Also returns the bucket key columns."""
    measures = measures or {}
    base, keys = keyed(numbers(df, value), by)
    for m, c in measures.items():
        base = base.withColumn(f"_m_{m}", c)
    order = plan_order(base, value)
    rows = with_spread(with_bucket(base, value, order), order, key)
    cell = [*keys, BUCKET, SUB]
    sizes = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("c"), *[F.sum(f"_m_{m}").alias(m) for m in measures])
    sizes = prefix_over(sizes, keys, [BUCKET, SUB], ["c", *measures])
    sizes = sizes.select(
        *cell,
        F.col("c_before").alias("_k0"),
        *[F.col(f"{m}_before").alias(f"_s_{m}") for m in measures],
        F.sum("c").over(W.partitionBy(*keys, BUCKET)).alias("_bn"),
        F.min("c_before").over(W.partitionBy(*keys, BUCKET)).alias("_v0"),
        F.sum("c").over(W.partitionBy(*keys)).alias("rk_n"),
    )
    sizes, tiny = settle(sizes, by)
    hot = F.col(BUCKET).isin(*order.hot) if order.hot else F.lit(False)
    return rows.join(hinted(sizes, tiny), cell).withColumn("_hot", hot), cell


def row_prefix(
    df: DataFrame, value: str, key: str, by: Sequence[str] = (), measures: dict[str, Column] | None = None
) -> DataFrame:
    """Per row, in (value, hash of key) order of its group: 1-based ``rk``, group size ``rk_n`` and, for each
    measure m, the inclusive prefix sum ``<m>_cum``."""
    measures = measures or {}
    rows, cell = ordered_rows(df, value, key, by, measures)
    rows = rows.withColumn("_h", hash32(key, "tie"))
    local = W.partitionBy(*cell).orderBy(value, "_h", key)
    running = local.rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("rk", F.row_number().over(local) + F.col("_k0"))
    for m in measures:
        out = out.withColumn(f"{m}_cum", F.col(f"_s_{m}") + F.sum(f"_m_{m}").over(running))
    drop = ["_h", BUCKET, SUB, "_k0", "_bn", "_v0", "_hot", GROUP, *[f"{a}{m}" for m in measures for a in ("_m_", "_s_")]]
    return out.drop(*drop)


def average_rank(df: DataFrame, value: str, key: str, by: Sequence[str] = (), out: str = "rk") -> DataFrame:
    """1-based average rank (ties share the mean of their positions) plus group size ``<out>_n``."""
    rows, cell = ordered_rows(df, value, key, by)
    first = F.rank().over(W.partitionBy(*cell).orderBy(value))
    ties = F.count(F.lit(1)).over(W.partitionBy(*cell, value))
    cold = F.col("_k0") + first + (ties - 1) / F.lit(2.0)
    hot = F.col("_v0") + (F.col("_bn") + 1) / F.lit(2.0)
    ranked = rows.withColumn(out, F.when(F.col("_hot"), hot).otherwise(cold)).withColumnRenamed("rk_n", f"{out}_n")
    return ranked.drop(BUCKET, SUB, "_k0", "_bn", "_v0", "_hot", GROUP)
