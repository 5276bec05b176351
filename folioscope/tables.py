"""Written tables in the folder that driver and executors share: steps that must not be worked out twice."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local master gets one of its own; on a cluster that raises."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("folioscope.shared.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("folioscope.shared.dir", base)
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
    return f"{base.rstrip('/')}/folioscope-{sc.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: later stages neither recompute it nor need its executors."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folioscope_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_durable(*tables: DataFrame | None) -> None:
    """Deletes tables that ``durable`` wrote and nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_folioscope_path", None):
            _delete(t.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Deletes what this application wrote to the shared folder; for when no result is read any more."""
    _delete(spark, shared_dir(spark))
