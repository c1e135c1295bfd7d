"""Shared pieces of the training-data operators: scratch tables and small column helpers."""

from __future__ import annotations

import contextlib
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyspark.sql.functions as F
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: the setting ``spark.checkpoint.dir``.

    Where it is unset, as in tests, a session on one machine gets an own folder; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = _own_dir()
    return path.rstrip("/")


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: While a table is written: Spark drops the execution's shuffle files as it ends, rather than when the driver next
#: collects garbage; and rows pass to Python workers in batches of a few MB of texts, not of 10,000 texts.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what runs inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def write(df: DataFrame, path: str, codec: str = "zstd", by: str | None = None) -> None:
    """Write Parquet whose shuffle files go once the files stand: nothing reads this execution again."""
    with settings(df.sparkSession, WHILE_WRITING):
        out = df.write.option("compression", codec)
        (out.partitionBy(by) if by else out).parquet(path)


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage."""
    path = new_path(df.sparkSession, name)
    write(df, path, codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(docs: DataFrame, column: str) -> DataFrame:
    """Add the long ``column``, a number of each row's own that is the same whenever the table is read.

    It holds the row's index in its Parquet file and, above these bits, a hash of the file's path that is checked to
    be another for every file; neither depends on how files are split over tasks. A table that isn't read from
    Parquet files is written first, with its numbers.
    """
    try:
        at = docs.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("index"))
    except AnalysisException:
        return stored(docs.withColumn(column, F.monotonically_increasing_id()), "rows")
    files = stored(at.groupBy("path").agg(F.max("index").alias("last")), "files")
    bits = int(files.agg(F.max("last")).first()[0] or 0).bit_length()
    for salt in range(8):
        own = lambda path: F.shiftleft(F.shiftright(F.xxhash64(path, F.lit(salt)), bits), bits)  # noqa: B023, E731
        n, distinct = files.agg(F.count("*"), F.count_distinct(own("path"))).first()
        if n == distinct:
            return docs.select(own("_metadata.file_path").bitwiseOR(F.col("_metadata.row_index")).alias(column), "*")
    return stored(docs.withColumn(column, F.monotonically_increasing_id()), "rows")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def share_below(key: Column, share: float) -> Column:
    """True for a fixed pseudo-random ``share`` of the keys; the same keys at every run."""
    steps = 1 << 24
    return F.pmod(F.xxhash64(key, F.lit(7)), F.lit(steps)) < F.lit(int(share * steps) + (share >= 1))


def bounded_share(rows: int, bound: int) -> float:
    return 1.0 if rows <= bound else bound / rows
