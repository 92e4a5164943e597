"""Hypothesis relations derived from the given tables.  Label convention: 1 = null, 0 = signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hash_uniform
from .tables import load_points, table

SIGNAL_GROUPS = (0, 1)


def hyp_events(spark: SparkSession, sf: str, a: float = 0.1) -> DataFrame:
    """One hypothesis per event: ``value`` is near Exp(50), so exp(-value/50) is near uniform; purchases are signals
    with p = u^(1/a), an exact Beta(a, 1) draw."""
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    u = F.exp(-F.col("value") / 50.0)
    signal = F.col("event_type") == "purchase"
    return e.select(
        F.col("event_id").alias("id"),
        "event_type",
        u.alias("u"),
        F.when(signal, 0).otherwise(1).cast("int").alias("label"),
        F.when(signal, F.pow(u, F.lit(1.0 / a))).otherwise(u).alias("p"),
    )


def hyp_events_null(spark: SparkSession, sf: str) -> DataFrame:
    """Negative control: every event is a null."""
    return hyp_events(spark, sf).select("id", "event_type", F.col("u").alias("p"), F.lit(1).alias("label"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    df = load_points(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")
    return df.withColumnRenamed("y", "group_id")


def hyp_points(spark: SparkSession, sf: str, a: float = 0.1) -> DataFrame:
    """Embeddings with hash p-values; rows of the signal groups are signals."""
    signal = F.col("group_id").isin(*SIGNAL_GROUPS)
    out = points(spark, sf).withColumn("u", hash_uniform("id", "p|42"))
    out = out.withColumn("label", F.when(signal, 0).otherwise(1).cast("int"))
    return out.withColumn("p", F.when(signal, F.pow("u", F.lit(1.0 / a))).otherwise(F.col("u")))


def part_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring lines of one order as (src, dst), a row a pair: at most one per line, no group is expanded into pairs."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    nxt = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    e = li.join(nxt, ["l_orderkey", "l_linenumber"]).where(F.col("l_partkey") != F.col("dst"))
    return e.select(F.col("l_partkey").alias("src"), "dst")


def part_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Directed part-part edges, weighted by their number of neighbouring lines."""
    return part_pairs(spark, sf).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def hyp_parts(spark: SparkSession, sf: str, a: float = 0.1) -> DataFrame:
    """Graph hypotheses: one gene-like row per part; small sizes are signals."""
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_brand")
    u = hash_uniform("p_partkey", "gene|7")
    signal = F.col("p_size") <= 5
    return p.select(
        F.col("p_partkey").alias("id"),
        "p_brand",
        F.when(signal, 0).otherwise(1).cast("int").alias("label"),
        F.when(signal, F.pow(u, F.lit(1.0 / a))).otherwise(u).alias("p"),
    )
