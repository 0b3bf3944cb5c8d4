"""Session helpers: table access, shared storage, code shipping, worker caches."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import keepsake

# Python functions travel inside the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(keepsake)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory (one file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none (tests, a laptop) a folder below the
    warehouse directory is set as the checkpoint directory.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        root = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
        named = str(Path(root) / "_shared")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The copy survives the loss of executors; Spark removes it once the frame
    is no longer referenced if the session asks for that.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh_path(spark: SparkSession, prefix: str) -> str:
    return f"{shared_dir(spark)}/{prefix}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path object) of the JVM for ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores if its scan has fewer splits than there are cores.

    A file of one row group is one task, however many cores wait for the costly
    work on its rows. A table with a split for every core stays where it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
