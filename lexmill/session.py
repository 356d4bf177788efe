"""Session building, table access and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Session settings the operators rely on; a cluster's own values win over them.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "lexmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; keyword settings override them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch of long texts holds in a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def driver_sized(df: DataFrame, limit_bytes: int) -> bool:
    """Whether the optimizer's size estimate of the plan is under the limit."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= limit_bytes


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it. Where it is unset a session on one machine gets one of its own; a cluster's is refused."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "lexmill-checkpoints")


_written: list = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once as a table in the shared folder and read them from there.

    Cuts lineage, survives lost executors, and later readers scan only the columns they need.
    The folder is the one of ``spark.checkpoint.dir``; the tables are removed when Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lexmill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_remove)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _remove() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone already
            pass
    _written.clear()


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where a scan gives fewer parts than there are cores, as for one small file.

    Only then are they shuffled; a scan that already has a part for every core is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
