"""Session defaults and materialisation in the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def build_session(app: str = "mnemosa", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; `conf` adds or overrides settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a local session gets a folder of its own and a cluster an error, as
    executors couldn't read each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "mnemosa-shared")
    return folder.rstrip("/")


_scopes: list[list[tuple[SparkSession, str]]] = []


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared or any other file system, if it is there."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Removes on exit what was materialised inside: wrap building and writing a result in it."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            remove(spark, path)


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back.

    Cuts lineage, so a lost executor costs only the tasks it held, and fixes results of
    nondeterministic steps such as range bounds. Files go at the end of the enclosing
    scratch(), or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mnemosa-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    if _scopes:
        _scopes[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


#: Most rows and bytes that are broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 8 << 20


def _bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes."""
    size = F.lit(16)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(c), F.lit(0)) + 8
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c.alias("v")))), F.lit(0))
        else:
            size = size + 8
    return size


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if it has at most so many rows and bytes, else `df` as it is.

    Counting stops at `max_rows` + 1 rows, so the check is cheap on any size.
    """
    got = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(_bytes(df)), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if got.n <= max_rows and got.b <= max_bytes else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
