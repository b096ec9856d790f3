"""Ordered work within groups of any size: range chunks, and totals carried from chunk to chunk.

A window over a key puts the whole key into one task. Here rows are range partitioned by
(keys, order), so a hot key spans many tasks; each task works on its chunk, and a small
table with one row per (keys, chunk) carries what a chunk needs from those before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemosa.session import materialize, partitions

CHUNK = "_chunk"


def range_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int | None = None) -> DataFrame:
    """`df` with a column `_chunk`: rows of a key with a smaller chunk come before those with a larger.

    `order` must end in a unique column. Written to the shared folder, as range bounds come
    from a sample and must not change between the uses of the result.
    """
    n = n or partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *keys, *order).withColumn(CHUNK, F.spark_partition_id())
    return materialize(ranged)


def with_rank(chunked: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """The rank (bigint, from 1) of each row within its key, from the output of range_chunks."""
    local = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunked.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ranked = chunked.withColumn("_local", F.row_number().over(local))
    return ranked.join(offsets.drop("_n"), [*keys, CHUNK]).withColumn(name, F.col("_before") + F.col("_local")).drop("_before", "_local")
