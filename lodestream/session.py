"""Session helpers: table access and the shared folder that survives the loss of an executor."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that tasks can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestream_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="spark-lodestream-"), "lodestream")
    sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here)))
    sc._lodestream_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only in local mode, where that is unset (tests), one of our own."""
    sc = spark.sparkContext
    ship(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-lodestream-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, prefix: str) -> str:
    """A new, unused path in the shared folder, under one folder for each application, which may go when the application has ended."""
    return f"{shared_root(spark).rstrip('/')}/lodestream-{spark.sparkContext.applicationId}/{prefix}-{uuid.uuid4().hex}"


def _file(spark: SparkSession, path: str):
    """The Hadoop file system of a path, whatever its scheme, and the path in it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Is there such a file or folder? Raises where the file system cannot be reached."""
    fs, p = _file(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    fs, p = _file(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def materialize(df: DataFrame, prefix: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage in a way that survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, prefix)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hinted(keys: DataFrame, most: int = 2_000_000) -> DataFrame:
    """Keys to filter a table of texts by: broadcast if they are few, so that the texts are not shuffled; ``keys`` are counted, so they should be written."""
    return F.broadcast(keys) if keys.count() <= most else keys
