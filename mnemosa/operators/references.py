"""References to rows that are not there, or came later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemosa.functions.keys import norm_key


def broken_references(
    child: DataFrame, field: str, fk: str, parent: DataFrame, check_late: bool, marks: tuple[str, ...] = ()
) -> DataFrame:
    """field, ref_month, uuid, reason: every record of `child` whose `fk` names no row of `parent`,
    or (with `check_late`) a row created after the record.

    The distinct keys of the child, with their earliest record, are anti-joined against the
    parent's keys; the few keys at fault are joined back to the records. Null and blank
    references and those in `marks` refer to nothing. A record without created_at has the
    month `unknown` and is never late. Repeated rows of a record come out once.
    """
    refs = child.select(norm_key("uuid").alias("uuid"), norm_key(fk).alias("_fk"), F.col("created_at").alias("_at"))
    refs = refs.filter(F.col("_fk").isNotNull() & ~F.col("_fk").isin(*marks) if marks else F.col("_fk").isNotNull())
    keys = refs.groupBy("_fk").agg(F.min("_at").alias("_first"))
    parents = parent.select(norm_key("uuid").alias("_fk"), F.col("created_at").alias("_made")).filter("_fk IS NOT NULL")
    if check_late:
        parents = parents.groupBy("_fk").agg(F.max("_made").alias("_made"))
        faulty = keys.join(parents.withColumn("_there", F.lit(True)), "_fk", "left").filter("_there IS NULL OR _made > _first")
        faulty = faulty.select("_fk", "_made", F.col("_there").isNull().alias("_missing"))
        bad = refs.join(faulty, "_fk").filter("_missing OR _made > _at")
    else:
        missing = keys.join(parents.select("_fk"), "_fk", "left_anti").select("_fk")
        bad = refs.join(missing, "_fk").withColumn("_missing", F.lit(True))
    return bad.select(
        F.lit(field).alias("field"),
        F.coalesce(F.date_format("_at", "yyyy-MM"), F.lit("unknown")).alias("ref_month"),
        "uuid",
        F.when(F.col("_missing"), "missing").otherwise("late").alias("reason"),
    ).distinct()
