"""Folders of one's own in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: list[tuple] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset and one machine does it all, a temporary one.  A cluster has to name one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
    return sc.getCheckpointDir()


def _sweep() -> None:
    for path, conf in _made:
        try:
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # noqa: BLE001, S110 - the JVM may have gone before us
            pass


def new_folder(spark: SparkSession, name: str) -> str:
    """The address of a folder that isn't there yet; what comes to be there is removed when this session's Python ends."""
    where = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep)
    sc = spark.sparkContext
    _made.append((sc._jvm.org.apache.hadoop.fs.Path(where), sc._jsc.hadoopConfiguration()))
    return where
