"""The first N items of every group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemosa.functions.keys import latest_state, norm_key

FIRST = 5


def top_n(df: DataFrame, group: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first `n` rows of every non-null `group` by `order`, with rank_no from 1.

    `order` must be total: its last column settles ties. The filter on the rank lets the
    optimizer put a group limit before the shuffle, so every map task sends at most `n` rows
    of a group and a group of any size ends as at most `n` rows per map task in one task.
    """
    window = Window.partitionBy(group).orderBy(*order)
    ranked = df.filter(F.col(group).isNotNull()).withColumn("rank_no", F.row_number().over(window))
    return ranked.filter(F.col("rank_no") <= n)


def top_facts(facts: DataFrame, n: int = FIRST) -> DataFrame:
    """entity_id, rank_no, uuid: the first `n` facts of every entity by state.

    Significance descending (5 where null or outside 1 to 10), then reinforced_count
    descending (0 where null), then uuid. Facts of no entity are left out.
    """
    state = latest_state(facts, ["entity_id", "significance", "reinforced_count"]).select(
        norm_key("entity_id").alias("entity_id"),
        "uuid",
        F.when(F.col("significance").between(1, 10), F.col("significance")).otherwise(5).alias("_sig"),
        F.coalesce("reinforced_count", F.lit(0)).alias("_count"),
    )
    order = [F.col("_sig").desc(), F.col("_count").desc(), F.col("uuid").asc()]
    return top_n(state, "entity_id", order, n).select("entity_id", "rank_no", "uuid")
