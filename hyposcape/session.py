"""Session helpers: local builder, checkpoint folder, bucket count."""

from __future__ import annotations

import gc
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "hyposcape", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and single-node runs; on a cluster pass the cluster's own session around."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``; a temporary one only on local masters."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="hyposcape-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the plan restarts from files, so lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read it back; ``discard`` deletes it when nothing reads it any more."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of scratch tables."""
    for df in tables:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        where.getFileSystem(conf).delete(where, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files that no plan reads any more.  Spark deletes them once the driver has collected its garbage, which a
    driver with much free memory puts off through a whole loop."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def planned_at_once(spark: SparkSession, tasks: int | None = None):
    """Without runtime re-planning: for long chains over tables that are already placed, where planning again after every
    exchange costs more than it can gain.  ``tasks`` sets the width of the exchanges to that of the placed tables."""
    before, width = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    if tasks:
        spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", width)


def order_buckets(spark: SparkSession) -> int:
    """How many ordered buckets replace a single-partition sort; grows with the shuffle width."""
    return max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, for drivers that run outside its folder and clusters without it installed."""
    root = Path(__file__).resolve().parent.parent
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="hyposcape-zip-")) / "hyposcape"), "zip", root, "hyposcape")
    spark.sparkContext.addPyFile(archive)
