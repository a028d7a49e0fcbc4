"""What the operators share: tables, checkpoints and broadcasts of a checked size."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(spark: SparkSession) -> None:
    """Texts are long: Arrow batches of 1,000 rows, unless the session has another number than Spark's own."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "1000")


def columns(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the names that an operator uses; others can't clash with its own."""
    text_batches(df.sparkSession)
    return df.select(*(df[f"`{old}`"].alias(new) for new, old in names.items()))


def _checkpoints(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir. Only a session of one process may leave it unset; then a temporary folder is as good."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        given = context.getConf().get("spark.checkpoint.dir")
        if not given and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir isn't set: on a cluster it has to name a folder that all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Written to the shared folder. Spark removes checkpoints that nothing refers to any more with spark.cleaner.referenceTracking.cleanCheckpoints."""
    _checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder."""
    return f"{_checkpoints(spark)}/{name}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def total_bytes(df: DataFrame, column: str) -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(column)) + 16), F.lit(0))).first()[0]


def share(spark: SparkSession, value: Any) -> Any:
    return spark.sparkContext.broadcast(value)


Scan = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def freed(scan: Scan) -> Scan:
    """The same function; at a task's end the memory that it no longer uses goes back, since its Python worker lives on."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from scan(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return scanned
