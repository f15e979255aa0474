"""Scratch tables: fresh paths in the folder that all executors share, and their removal."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []
_own_folder: str | None = None


def folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names.

    Where it is unset, a session in a single process (tests, a laptop) gets a temporary folder until the process
    ends. On a cluster that would be a folder of each machine for itself, so there it is an error.
    """
    global _own_folder
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return _own_folder


def path(spark: SparkSession, name: str) -> str:
    """A fresh path."""
    _made.append(f"{folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: the lineage ends there."""
    at = path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables; without ``paths`` all that this process made. What still reads them fails afterwards."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths or tuple(_made):
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
        if p in _made:
            _made.remove(p)
