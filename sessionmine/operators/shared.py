"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below `spark.checkpoint.dir`.

    Where the setting is missing, a local master (tests) gets a temporary folder; a cluster
    gets an error, because its executors could not see such a folder.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _scratch.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="sessionmine-"))
    return f"{root.rstrip('/')}/sessionmine-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The table, computed now and kept as checkpoint files, for plans that read a small
    intermediate result several times: what comes after starts from the files, not from a copy
    of the plan. Spark deletes the files with the table where
    `spark.cleaner.referenceTracking.cleanCheckpoints` is set."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a write to this folder came to its end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
