"""The folder that every executor can read, for what must outlive a lost one."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths handed out, in order, by application and thread: threads may run jobs of their own side by side.
_made: dict[tuple[str, int], list[str]] = {}


def _own(spark: SparkSession) -> list[str]:
    return _made.setdefault((spark.sparkContext.applicationId, threading.get_ident()), [])


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where the setting is absent, a temporary folder is set once for the session if all of it runs in this one
    process (tests); on a cluster, whose machines don't share such a folder, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="cinderspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """The part of the shared folder that is this application's."""
    return f"{shared_dir(spark)}/cinderspark-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _own(spark).append(path)
    return path


def staged_paths(spark: SparkSession) -> list[str]:
    """What this thread has staged so far."""
    return list(_own(spark))


def release(spark: SparkSession, keep: list[str]) -> None:
    """Delete what this thread has staged but the paths of ``keep``: between two steps of a job, when all that goes on
    reading is what they hold."""
    made = _own(spark)
    for path in made:
        if path not in keep:
            delete_path(spark, path)
    made[:] = [p for p in made if p in keep]


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application has staged: only when no result that reads it is needed any more."""
    delete_path(spark, scratch_root(spark))
    for key in [k for k in _made if k[0] == spark.sparkContext.applicationId]:
        del _made[key]


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a
    lost executor costs a re-read rather than a recomputation."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
