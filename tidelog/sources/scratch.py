"""Scratch folders that driver and executors share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own() -> str:
    return tempfile.mkdtemp(prefix="spark-scratch-")


def scratch_root(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir``.

    Where that is unset, as in tests, a session on one machine gets an own folder; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = _own()
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in that folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to a scratch folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
