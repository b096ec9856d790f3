"""Keys, white space and record state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The code points of Unicode's White_Space property, and the information separators.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(col: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.trim(F.col(col) if isinstance(col, str) else col, F.lit(WHITE_SPACE))


def norm_key(col: Column | str) -> Column:
    """A key as it is compared: no surrounding blanks, lower case; null where nothing is left."""
    key = F.lower(strip(col))
    return F.when(key != "", key)


def row_hash(df: DataFrame, without: Sequence[str] = ()) -> Column:
    """One number made of a row's columns; maps, which have no order, don't count."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if c not in without and "map<" not in t and "variant" not in t])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key by `order`; equals are settled by a hash of the row's other columns.

    A ranked window, so the group limit also runs before the shuffle and a hot key sends
    one row per map task. The hash is made at the scan of the columns at hand, so select what
    is needed first: what `df` doesn't carry isn't read, and equal hashes mean equal results.
    """
    window = Window.partitionBy(*keys).orderBy(*order, "_tie")
    ranked = df.withColumn("_tie", row_hash(df, keys)).withColumn("_rn", F.row_number().over(window))
    return ranked.filter("_rn = 1").drop("_rn", "_tie")


def latest_state(facts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The state of every fact: of the rows of one uuid the one with the latest updated_at.

    uuid comes out as compared; rows without uuid are no records. Only `columns` are read and
    carried; rows equal in uuid and updated_at are settled by them, or by the change they
    were written with where the table has change numbers.
    """
    change = [F.col("change_no").alias("_change")] if "change_no" in facts.columns else []
    slim = facts.filter("uuid IS NOT NULL").select(norm_key("uuid").alias("uuid"), F.col("updated_at").alias("_at"), *change, *[F.col(c) for c in columns if c != "uuid"])
    order = [F.col("_at").desc_nulls_last(), *[F.col("_change").desc_nulls_last() for _ in change]]
    return first_per_key(slim.filter("uuid IS NOT NULL"), ["uuid"], order).drop("_at", "_change")
