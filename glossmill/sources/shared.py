"""The folder that all machines of a cluster share: for cut lineages and for files that a job writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and all of Spark is one local process (as in tests), a temporary folder of this session; else an error, as no other machine could reach it."""
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    known = context._jsc.sc().getCheckpointDir()
    if not known.isEmpty():
        return known.get()
    if not re.fullmatch(r"local(\[[^,\]]*(,\s*\d+)?\])?", context.master):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all machines share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return context._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """A name in the shared folder that nobody has yet; what is written there is removed when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)  # or the file system forgets the name
    fs.deleteOnExit(hadoop)
    return f"{path}/data"


def checkpoint(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder, so that a lost executor costs no earlier work and plans don't grow."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
