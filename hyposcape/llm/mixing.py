"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Targets: source sizes are summed, weights share the total, a target stops at ``most`` times its source's size and the excess is
shared by weight among the others until none is above. In the order of size / weight the capped sources come first, so one
ordered pass over the source table (a row a source) gives the level at which the others stand.

Sampling: a document of a source is expected target / size times. Documents of a source are put in an order by size class and
key hash, expected copies are summed along it with one offset of the source added, and a document is emitted once for each
whole number its share crosses. The order by size makes the words taken follow the target closely, since any stretch of sizes
gets its share; of sixteen offsets spaced evenly from a random one, the one whose words come nearest to the target is used. Sums are whole numbers of 2^-28, so no document exceeds ``most`` copies through rounding.

Positions come from counts of (source, class, hash range) buckets and a row number inside a bucket: a source with a third of all
rows is spread over all of its buckets. The bucket count steers balance only; the order, and so the result, does not depend on it.

Defined cases: null text has size 0; a null source is a source of its own, last; sources of size 0 have target 0. A null doc_id is
hashed as such. Repeated rows are documents of their own. An empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash32
from . import common

ONE = 1 << 28
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[int], most: int) -> DataFrame:
    """(source, source_size) -> (source, source_size, target): one row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    all_rows = Window.partitionBy(F.lit(0))
    named = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    named = named.withColumn("total", F.sum("source_size").over(all_rows)).withColumn("w_all", F.sum("w").over(all_rows))
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.col("w_all") - F.coalesce(F.sum("w").over(before), F.lit(0))
    named = named.withColumn("level", left / open_weight)  # if all before are capped and none from here on
    fits = F.col("level") <= F.col("cap") / F.col("w")
    level = F.min_by("level", F.when(fits, F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source")))).over(all_rows)
    return named.withColumn("target", F.least(level * F.col("w"), F.col("cap").cast("double"))).select("source", "source_size", "target")


TRIES = 16  # offsets of a source, a sixteenth apart from its random one; the one whose words come nearest to the target is used
_BUCKET = ["_key", "_class", "_range"]  # _key: the source, never null, so that joins keep the partitioning of the windows


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))


def _keyed(rows: DataFrame, size: str, seed: str) -> DataFrame:
    """rows plus size class, key hash, hash range and the row's number inside its (source, class, range)."""
    bits = max(1, (4 * common.shuffle_width(rows.sparkSession) - 1).bit_length())
    h = hash32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), seed)
    keyed = (
        rows.withColumn("_key", _source_key()).withColumn("_class", F.floor(8 * F.ln(F.col(size) + 1) / F.ln(F.lit(2.0)) + 1e-9).cast("int"))
        .withColumn("_h", h)
        .withColumn("_range", F.shiftright("_h", 32 - bits))
    )
    return keyed.withColumn("_row", F.row_number().over(Window.partitionBy(*_BUCKET).orderBy("_h", "doc_id", size)))


def _crossed(k: Column, offset: Column) -> Column:
    """Whole numbers crossed by the k-th document of a source."""
    upto = lambda n: F.shiftright(n * F.col("_rate") + offset, 28)
    return upto(k) - upto(k - 1)


def _meet(keyed: DataFrame, starts: DataFrame) -> DataFrame:
    return keyed.join(common.dealt(starts), _BUCKET)


def sampling_plan(light: DataFrame, weights: list[int], most: int, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size) -> a row a bucket: the documents of the source before it, and the source's target, rate and offset."""
    plan = targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    share = F.least(F.floor(F.col("target") / F.col("source_size") * ONE + 0.5), F.lit(most * ONE))
    rate = F.when(F.col("source_size") > 0, share).otherwise(F.lit(0)).cast("long")
    offset = hash32(F.coalesce(F.col("source"), F.lit("\x00null")), seed + "-offset").bitwiseAND(F.lit(ONE - 1))
    plan = plan.select(_source_key().alias("_key"), "source_size", "target", rate.alias("_rate"), offset.alias("_offset"))
    keyed = _keyed(light, "size", seed)
    # positions before a bucket: those of the source's lower classes (a few hundred rows a source), then of the class's lower ranges
    counted = keyed.groupBy(*_BUCKET).agg(F.count("*").alias("_n"))
    lower = Window.partitionBy("_key").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    classes = counted.groupBy("_key", "_class").agg(F.sum("_n").alias("_n")).withColumn("_lower", F.coalesce(F.sum("_n").over(lower), F.lit(0)))
    inside = Window.partitionBy("_key", "_class").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(classes.drop("_n").join(plan, "_key"), ["_key", "_class"])
    starts = starts.withColumn("_before", F.col("_before") + F.col("_lower")).drop("_n", "_lower")
    k = F.col("_before") + F.col("_row")
    tried = [(F.col("_offset") + F.lit(j * (ONE // TRIES))).bitwiseAND(F.lit(ONE - 1)) for j in range(TRIES)]
    met = _meet(keyed, starts).groupBy("_key").agg(
        F.first("target").alias("t"), F.first("_offset").alias("_offset"), *[F.sum(F.col("size") * _crossed(k, o)).alias(f"w{j}") for j, o in enumerate(tried)]
    )
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"w{j}") - F.col("t")).alias("d"), F.lit(j).alias("j"), o.alias("o")) for j, o in enumerate(tried)]))
    chosen = met.select("_key", best["o"].alias("_chosen"))
    return common.scratch(starts.join(chosen, "_key").drop("_offset").withColumnRenamed("_chosen", "_offset"), "mix-plan")


def with_copies(rows: DataFrame, size: str, starts: DataFrame, seed: str = "mix") -> DataFrame:
    """rows (doc_id, source, size, ...) plus source_size, target and copies; names in ``rows`` must not clash with them."""
    met = _meet(_keyed(rows, size, seed), starts)
    return met.withColumn("copies", _crossed(F.col("_before") + F.col("_row"), F.col("_offset"))).select(*rows.columns, "source_size", "target", "copies")


WEIGHTS, MOST = [1, 2, 3], 3


def sizes_of(docs: DataFrame) -> DataFrame:
    return common.scratch(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")


def sampled(docs: DataFrame, weights: list[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every document row; taken = size times copies."""
    sized = sizes_of(docs)
    found = with_copies(sized, "size", sampling_plan(sized, weights, most))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, weights: list[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixture: every row as often as it is taken, all columns kept."""
    starts = sampling_plan(sizes_of(docs), weights, most)
    whole = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"), words(F.col("text")).alias("_size"))
    dealt = with_copies(whole, "_size", starts).where("copies > 0")
    return dealt.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_whole.*")
