"""Shared helpers: table access, scratch tables in the cluster's shared folder, slicing of Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_tables: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; unset (tests): a temporary one on local masters."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    ensure_checkpoint_dir(spark)
    return str(spark.sparkContext.getCheckpointDir()).rstrip("/")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends there, so a lost executor costs a read."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    _tables.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one small file to a place that Spark's file systems reach; ``release_tables`` deletes it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    try:
        out.write(data)
    finally:
        out.close()
    _tables.append(path)


def delete(df: DataFrame) -> None:
    """Delete the files of a scratch table that nothing reads any more."""
    path = getattr(df, "scratch_path", None)
    if path in _tables:
        _remove(df.sparkSession, path)
        _tables.remove(path)


def release_tables(spark: SparkSession) -> None:
    """Delete every scratch table of this driver; call it once the results that read them are written."""
    while _tables:
        _remove(spark, _tables.pop())


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is sorted and merged.  Spark takes a table's size from its compressed file and counts an exploded
    array as one element, so a table of many rows can pass for one that fits a broadcast, which the driver builds in its memory."""
    return df.hint("merge")


def unique_name(taken: list[str], stem: str) -> str:
    """A column name that clashes with none of ``taken`` (names compare without case)."""
    low = {c.lower() for c in taken}
    name = stem
    while name.lower() in low:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the byte sizes of ``column`` stay near ``limit``: bounds memory under very long texts."""
    from pyarrow import compute as pc

    n = batch.num_rows
    if n <= 1 or batch.column(column).nbytes <= limit:
        yield batch
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i in range(n):
        if i > start and total + sizes[i] > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(sizes[i])
    yield batch.slice(start)
    pa.default_memory_pool().release_unused()


def add_id_check(df: DataFrame, needed: list[str]) -> DataFrame:
    """Keep the needed columns only, so extra columns of any name cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in needed])
