"""Helpers on the driver."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that their tasks can import it."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        to = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="spark-")), os.path.basename(top))
        spark.sparkContext.addPyFile(shutil.make_archive(to, "zip", os.path.dirname(top), os.path.basename(top)))
        _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir. Where that is unset a local folder serves a local master only (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
        base = _LOCAL[context.applicationId]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet in the shared folder and read again: cuts lineage and outlives lost executors.

    The write's shuffle files are let go as soon as it ends; nothing reads them again.
    """
    spark, schema = df.sparkSession, df.schema
    path, key = shared_dir(spark, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(schema).parquet(path)
    out._saved_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes what ``saved`` wrote, once nothing reads it any more."""
    for df in tables:
        spark, path = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._saved_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
