"""Where intermediate results go."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only a local master may go without one (tests, a single machine) and gets a folder of its
    own; on a cluster such a folder would lie on one machine, so a missing name is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) \
            or context.getConf().get("spark.checkpoint.dir")
        if not folder:
            master = context.master or ""
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="pyrogrid-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the work folder."""
    work_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash partition for compute-heavy tasks. The number is explicit so that adaptive
    execution does not merge partitions that are small in bytes but slow to process."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *columns)


_KEPT: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Hold a stage that several later steps read; lost blocks are recomputed."""
    _KEPT.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return _KEPT[-1]


def release_kept() -> None:
    """Let go of every held stage. Results made from them stay valid and recompute."""
    while _KEPT:
        _KEPT.pop().unpersist()
