"""Input tables of the plots: the engine computes them, any renderer can draw them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import confusion_code, logit, neg_log10
from ..operators import metrics, testing
from ..operators.kernels import Kernel, Points, group_similarity


def structural_groups(points: Points, groups: DataFrame, kernel: Kernel, signal_group: int = 0) -> DataFrame:
    """Mean similarity of each group's rows to the signal group (self left out)."""
    sim = group_similarity(points, kernel, "group_id").where(F.col("other") == signal_group)
    rows = sim.join(groups.select("id", "group_id"), "id")
    return rows.groupBy("group_id").agg((F.sum("sim_sum") / F.sum("sim_n")).alias("mean_similarity"), F.count(F.lit(1)).alias("n"))


def dataset_overview(df: DataFrame, bins: int = 30) -> DataFrame:
    """p-value histogram by label."""
    return metrics.histogram(df, "p", bins, 0.0, 1.0, ["label"])


def decision_map(df: DataFrame, features: str = "v") -> DataFrame:
    """First two coordinates, p on the -log10 scale and the confusion category of every row."""
    return df.select(
        "id", F.col(features)[0].alias("x"), F.col(features)[1].alias("y"), neg_log10("p").alias("neg_log10_p"),
        confusion_code("rejected", "label").alias("category"),
    )


def manhattan(df: DataFrame, level: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """-log10(p) per row with the step-up cut line of its dataset."""
    out = testing.benjamini_hochberg(df, by=by, level=level)
    return out.withColumn("neg_log10_p", neg_log10("p")).withColumn("cut", neg_log10("threshold"))


def gain_bars(runs: DataFrame, base: str = "baseline", other: str = "spatial") -> DataFrame:
    """Mean power of both methods and the relative gain per condition (0 where the baseline finds nothing)."""
    pick = lambda m: F.avg(F.when(F.col("method") == m, F.col("power")))
    out = runs.groupBy("condition").agg(pick(base).alias("base_power"), pick(other).alias("power"))
    return out.withColumn("gain", metrics.relative_gain("power", "base_power", zero_base=0.0))


def alpha_by_isolation(df: DataFrame, alpha: str = "alpha", isolation: str = "isolation", by: Sequence[str] = ("group_id",)) -> DataFrame:
    """Rolling mean and deviation of the null probability along the isolation score, per group."""
    return testing.rolling_by_rank(df, isolation, alpha, by=by)


def prediction_logits(df: DataFrame, alpha: str = "alpha_null", bins: int = 40) -> DataFrame:
    """Histogram of the logit of predicted probabilities over [-10, 10]."""
    return metrics.histogram(df.withColumn("_l", logit(alpha)), "_l", bins, -10.0, 10.0)


def all_tables(runs: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """Every report of a finished run: log summary, calibration, gains, overview and decision map."""
    return {
        "summary": metrics.summarize(runs, ["power", "FDR"], ["method", "condition"]),
        "calibration": metrics.calibration(runs),
        "gain": gain_bars(runs),
        "overview": dataset_overview(decisions),
        "decisions": decision_map(decisions),
    }
