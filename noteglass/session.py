"""Session helpers: import path of the workers, table loading, materialisation."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
_LOCAL: dict[str, str] = {}  # folders of applications on one machine that name none


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it isn't installed on them."""
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster. A local one is made only where none is set and driver and executors are one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import atexit
        import shutil
        import tempfile

        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="noteglass-")
            atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
        folder = _LOCAL[app]
    return folder.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it again: cuts the lineage, survives lost executors.

    The table is deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
