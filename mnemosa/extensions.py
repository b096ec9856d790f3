"""Additions that are off unless called: retention, budgets by tier, slots matched to canonical ones, cards, deny lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemosa.functions.vectors import cosine
from mnemosa.operators.recall import DAY_US, micros
from mnemosa.operators.scans import first_in_group
from mnemosa.session import broadcast_if_small


def retention(as_of: Column) -> Column:
    """How much of a fact is left: it fades with the days since its last use, the slower the more it matters."""
    idle = F.greatest(F.lit(0.0), (micros(as_of) - micros(F.greatest("created_at", "reinforced_at", "last_recalled_at"))) / DAY_US)
    strength = F.col("significance") + 0.5 * F.col("reinforced_count") + 2.0 * F.coalesce("emotional_weight", F.lit(0.0))
    return F.exp(-F.try_divide(idle, strength))


def tier_budgets(total: int, semantic_used: int, working_used: int, semantic: float = 0.15, working: float = 0.35) -> dict[str, int]:
    """Tokens of each tier; what a tier doesn't use goes to the episodic one."""
    s, w = int(total * semantic), int(total * working)
    return {"semantic": s, "working": w, "episodic": total - min(s, semantic_used) - min(w, working_used)}


def list_canonical_slots(slots: DataFrame) -> DataFrame:
    """The registry of slots with position, in order of names; it is small and fixed."""
    return slots.withColumn("position", F.row_number().over(Window.orderBy("name")))


def find_canonical_slot(slots: DataFrame, names: DataFrame) -> DataFrame:
    """The registered slots of the given names (name)."""
    return slots.join(names.select("name").distinct(), "name", "left_semi")


def canonical_slots(facts: DataFrame, slots: DataFrame, least: float = 0.85) -> DataFrame:
    """uuid, slot, canonical, cos: the closest canonical slot of every fact's vector, if close enough.

    The registry is small; if it isn't, the join is by vector length and shuffles.
    """
    names = broadcast_if_small(slots.select(F.col("name").alias("canonical"), F.col("embedding").alias("_s"), F.size("embedding").alias("_len")))
    pairs = facts.filter("embedding IS NOT NULL").select("uuid", "slot", F.col("embedding").alias("_f"), F.size("embedding").alias("_len")).join(names, "_len")
    close = pairs.withColumn("cos", F.round(cosine("_f", "_s"), 6)).filter(F.col("cos") >= least)
    return first_in_group(close, "uuid", [F.desc("cos"), F.asc("canonical")], 1).select("uuid", "slot", "canonical", "cos")


def denied(facts: DataFrame, deny: DataFrame) -> DataFrame:
    """`facts` without those whose entity denied their content key."""
    return facts.join(deny.select("entity_id", "content_key"), ["entity_id", "content_key"], "left_anti")


def tag_insights(facts: DataFrame, as_of: Column, least: int = 10, share: float = 0.25, days: int = 90) -> DataFrame:
    """entity_id, tag, n_facts, tag_share of tags that make up much of an entity's last `days`."""
    recent = facts.filter(F.col("created_at") > as_of - F.expr(f"INTERVAL {days} DAY"))
    tags = recent.groupBy("entity_id", "tag").agg(F.count(F.lit(1)).alias("n_facts"))
    total = tags.groupBy("entity_id").agg(F.sum("n_facts").alias("_n"))
    out = tags.join(total.filter(F.col("_n") > least), "entity_id").withColumn("tag_share", F.round(F.col("n_facts") / F.col("_n"), 6))
    return out.filter(F.col("tag_share") > share).drop("_n")
