"""Scratch tables in the folder that driver and executors share.

Lineage is cut with Parquet tables below ``spark.checkpoint.dir``; they survive the loss of
any executor and are read back as ordinary scans. Only where that setting is absent and the
master is local (tests, a notebook) is a local folder made and set.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session, as a URI that Spark can write to."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="textloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a scratch table, unique to this call."""
    app = spark.sparkContext.applicationId
    path = f"{shared_root(spark)}/textloom-{app}/{name}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.setdefault(app, []).append(path)
    return path


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once and return a scan of what was written."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the scratch tables of this application; call it when results are written."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    return len(paths)
