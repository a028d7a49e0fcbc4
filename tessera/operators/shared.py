"""Intermediate results in the shared folder, and folders that go when their results are kept."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def _local(spark: SparkSession) -> bool:
    return bool(re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master))


def kept(df: DataFrame) -> DataFrame:
    """Computed at once and once, as a checkpoint in spark.checkpoint.dir, so that it outlives what it was read from; only a session of one process may leave that unset."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not _local(spark):
            raise ValueError("spark.checkpoint.dir isn't set: on a cluster it has to name a folder that all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


@contextmanager
def folder(spark: SparkSession) -> Iterator[str]:
    """A new folder beside the checkpoints, or in the warehouse of a session of one process; it is removed at the end."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not _local(spark):
        raise ValueError("spark.checkpoint.dir isn't set: on a cluster it has to name a folder that all executors share")
    at = f"{(base or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/work-{uuid.uuid4().hex}"
    try:
        yield at
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
