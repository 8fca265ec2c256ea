"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="barloom-")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of this process where it is unset and there is only one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _own_dir()
    return found.rstrip("/")


def fresh_dir(spark: SparkSession) -> str:
    """The name of a folder below the shared one that nothing is in yet."""
    return f"{shared_dir(spark)}/barloom/{uuid.uuid4().hex}"


def settle(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under ``folder`` (the shared one) and read it back: lineage ends there, and a lost executor costs no recomputation."""
    path = f"{folder}/{uuid.uuid4().hex}" if folder else fresh_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
