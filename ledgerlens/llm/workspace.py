"""Durable intermediate tables in the shared folder of ``spark.checkpoint.dir``.

Lineage is cut by writing Parquet there: every executor can read it back after
any other one is lost, and what was written (chunk ids, for one) stays as it is
when a task runs again.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LIVE: list["Workspace"] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only in local mode, where driver and executors are one."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlens-"))
    return context.getCheckpointDir().rstrip("/")


class Workspace:
    """A folder of intermediate tables for one call of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/ledgerlens/{name}-{uuid.uuid4().hex}"
        _LIVE.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written once; the returned frame reads the files."""
        path = f"{self.path}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Delete the tables; frames that read them can't be used afterwards."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if self in _LIVE:
            _LIVE.remove(self)


@atexit.register
def _drop_all() -> None:
    for workspace in list(_LIVE):
        try:
            workspace.drop()
        except Exception:  # the session has ended: nothing is left to delete with
            return
