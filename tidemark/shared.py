"""Where intermediate tables live, and how small tables reach big ones."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_LOCAL_KEY = "tidemark.local.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a machine-local
    folder would be lost with its executor.
    """
    configured = spark.sparkContext.getConf().get(_CHECKPOINT_KEY) or spark.conf.get(_CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a shared folder before running on a cluster")
    folder = spark.conf.get(_LOCAL_KEY, None)
    if folder is None:
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set(_LOCAL_KEY, folder)
    return folder


def run_dir(spark: SparkSession) -> str:
    """Folder of this application's kept tables."""
    return f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def discard_kept(spark: SparkSession) -> bool:
    """Remove this application's kept tables; call it when no frame built on them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keep(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The table survives lost executors, cuts the lineage, fixes the values for every later use, and
    gives the planner the true byte size. A small kept table is therefore broadcast by Spark's own
    ``autoBroadcastJoinThreshold`` check, and a large one is shuffled with skew handling, without
    any hint here.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(rows: DataFrame, stats: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join per-group statistics back to their rows.

    The statistics are pre-aggregated (map-side combine, one row per group) and kept, so that Spark
    knows their size when it plans this join and need not shuffle the rows for a small table.
    """
    return rows.join(keep(stats, "stats"), on=keys, how=how)
