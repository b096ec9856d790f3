"""Per-key results where a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemosa.functions.keys import norm_key


def key_profile(df: DataFrame, key: str, time: str) -> DataFrame:
    """key, n_rows, first_at, last_at of every key of `df`.

    Count, minimum and maximum are algebraic, so each map task folds its rows into a hash
    table of key states (spilled and sorted when it outgrows memory) and only those partial
    states are shuffled: a hot key sends one row per map task, whatever its share.
    Keys are compared without blanks and case; rows without a key form no group.
    """
    keyed = df.select(norm_key(key).alias("key"), F.col(time).alias("_at")).filter("key IS NOT NULL")
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), F.min("_at").alias("first_at"), F.max("_at").alias("last_at"))


def heavy_keys(df: DataFrame, key: str, time: str, share: float = 0.02) -> DataFrame:
    """The rows of key_profile whose key is on at least `share` of all rows of `df`, with that share.

    Rows without a key count in the total. An empty table has no heavy keys.
    """
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    profile = key_profile(df, key, time)
    return profile.withColumn("row_share", F.col("n_rows") / total).filter(F.col("n_rows") >= F.lit(share) * total)
