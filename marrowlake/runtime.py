"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once a session, wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_marrowlake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # it is imported from a shipped archive itself
        return
    path = os.path.join(tempfile.mkdtemp(prefix="marrowlake-"), "marrowlake.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"marrowlake/{f.relative_to(root)}")
    sc.addPyFile(path)
    sc._marrowlake_shipped = True


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The parquet table `name` under the folder `base`."""
    ship(spark)
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the session's spark.checkpoint.dir. Only a local session may go without: there a
    temporary folder is made once and set, since driver and executors are one process.
    """
    sc = spark.sparkContext
    if (known := sc.getCheckpointDir()) is not None:
        return known
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="marrowlake-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below this session's scratch in the shared folder."""
    return os.path.join(shared_dir(spark), f"scratch-{spark.sparkContext.applicationId}", f"{label}-{uuid.uuid4().hex}")


def clean(spark: SparkSession, keep: tuple[str, ...] = ()) -> int:
    """Deletes this session's scratch, except what begins with a label in keep; the number of things deleted.

    Results that were not written yet may still read from there, so it is called between jobs, not in them. What a lost session left is its folder scratch-<application id>.
    """
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(os.path.join(shared_dir(spark), f"scratch-{spark.sparkContext.applicationId}"))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = 0
    for s in fs.listStatus(path) if fs.exists(path) else ():
        if not s.getPath().getName().startswith(tuple(f"{k}-" for k in keep) or ("\0",)):
            gone += bool(fs.delete(s.getPath(), True))
    return gone


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def through_table(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: columnar, so that readers prune columns."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
