"""Storage that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_runs: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset and the master is local (tests, a laptop) a local folder."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "claimloom-shared")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def _hadoop(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """(file system, path) as the JVM knows them."""
    sc = spark.sparkContext
    there = sc._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(sc._jsc.hadoopConfiguration()), there


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's own part of the shared folder, which goes when the driver's JVM ends in order."""
    app = spark.sparkContext.applicationId
    if app not in _runs:
        folder = f"{shared_folder(spark)}/claimloom-{app}-{uuid.uuid4().hex}"
        files, there = _hadoop(spark, folder)
        files.mkdirs(there)
        files.deleteOnExit(there)
        _runs[app] = folder
    return f"{_runs[app]}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Delete what was written to a path of :func:`scratch`; for data that nothing reads any more."""
    files, there = _hadoop(spark, path)
    files.delete(there, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
