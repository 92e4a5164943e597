"""Table readers and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_points(
    df: DataFrame, key: str, features: str, label: str | None = None, head: int | None = None
) -> DataFrame:
    """Feature rows as ``id, v array<double>[, y]``; ``head`` keeps the first rows in key order (loader option)."""
    cols = [F.col(key).cast("bigint").alias("id"), F.col(features).cast("array<double>").alias("v")]
    if label:
        cols.append(F.col(label).cast("int").alias("y"))
    out = df.select(*cols)
    return out if head is None else out.orderBy("id").limit(head)


def list_datasets(spark: SparkSession, folder: str, suffix: str = ".parquet") -> DataFrame:
    """Dataset discovery: names and bytes of the stored datasets under a folder, single files as well as folders of part files,
    through the Hadoop file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(conf)
    found = [f.getPath() for f in fs.listStatus(where)]
    named = [(p, p.getName()) for p in found if p.getName().endswith(suffix) and not p.getName().startswith(("_", "."))]
    rows = [(name.removesuffix(suffix), fs.getContentSummary(p).getLength()) for p, name in named]
    return spark.createDataFrame(rows, "dataset string, length long")


def save_log(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Result log as CSV with a header, optionally one folder per dataset."""
    w = df.write.mode("overwrite").option("header", True)
    (w.partitionBy(*by) if by else w).csv(path)


def load_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def save_cache(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Result cache: parquet, partitioned by e.g. (benchmark, dataset)."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


BUNDLE = ("edges", "genes", "positives", "pathways")


def save_bundle(folder: str, **tables: DataFrame) -> None:
    """Graph benchmark as tables partitioned by (benchmark, dataset): edges (src, dst, w), genes (id, p), positives
    (pathway), pathways (pathway, gene).  Plain tables take the place of a pickled object."""
    for name in BUNDLE:
        tables[name].write.mode("overwrite").partitionBy("benchmark", "dataset").parquet(f"{folder}/{name}")


def load_bundle(
    spark: SparkSession, folder: str, benchmarks: list[str] | None = None, max_datasets: int | None = None
) -> dict[str, DataFrame]:
    """Read a bundle; the benchmark filter prunes partitions.  ``max_datasets`` keeps the first datasets by name of each
    benchmark, an option of the benchmark settings."""
    out = {n: spark.read.parquet(f"{folder}/{n}") for n in BUNDLE}
    if benchmarks is not None:
        out = {n: t.where(F.col("benchmark").isin(*benchmarks)) for n, t in out.items()}
    if max_datasets is not None:
        names = out["genes"].select("benchmark", "dataset").distinct()
        rank = F.row_number().over(W.partitionBy("benchmark").orderBy("dataset"))
        keep = names.withColumn("_r", rank).where(F.col("_r") <= max_datasets).drop("_r")
        out = {n: t.join(keep, ["benchmark", "dataset"], "left_semi") for n, t in out.items()}
    return out


def status_log(counts: DataFrame, expected: int, seconds: float | None = None) -> DataFrame:
    """Run log: one row per dataset with its count, OK / FAILED and the elapsed seconds.  counts: (dataset, n)."""
    status = F.when(F.col("n") >= expected, "OK").otherwise("FAILED")
    return counts.withColumn("status", status).withColumn("seconds", F.lit(seconds).cast("double"))
