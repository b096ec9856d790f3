"""The life of facts: adding, reinforcing, promoting, superseding, expiring, folding changes.

Nothing is changed in place: operators return new rows or change events, and fold turns
a state and its events into the next state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemosa.functions import text as X
from mnemosa.operators.scans import first_in_group

# Mentions after which a fact is promoted, and closeness at which two facts are one.
PROMOTION, SEMANTIC, PATTERN, ARTIFACT = 5, 0.92, 0.88, 0.8


def expiry(significance: Column | str, start: Column) -> Column:
    """When a fact expires: never from 10, after 30 days from 5, else after 7."""
    s = X.col(significance)
    return F.when(s >= 10, F.lit(None)).when(s >= 5, start + F.expr("INTERVAL 30 DAY")).otherwise(start + F.expr("INTERVAL 7 DAY"))


def split_expired(facts: DataFrame, as_of: Column) -> DataFrame:
    """`facts` with `expired`: whether pruning at `as_of` takes it (at the very moment it stays)."""
    return facts.withColumn("expired", F.coalesce(F.col("expires_at") < as_of, F.lit(False)))


def prune_summaries(conversations: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Summaries older than `days` emptied, with their vectors."""
    stale = (F.col("created_at") < as_of - F.expr(f"INTERVAL {days} DAY")) & (F.coalesce("summary", F.lit("")) != "")
    return conversations.withColumns({"summary_embedding": F.when(~F.coalesce(stale, F.lit(False)), F.col("summary_embedding")), "summary": F.when(stale, "").otherwise(F.col("summary"))})


def promoted(count: Column, significance: Column) -> Column:
    """Whether one more mention makes a fact lasting."""
    return (count + 1 >= PROMOTION) & (significance < 10)


def reinforce(facts: DataFrame, mentions: DataFrame, as_of: Column) -> DataFrame:
    """`facts` after `mentions` (uuid, seq, significance), as one batch.

    Counts add up; the fact is promoted if one mention more than its count before the batch
    reaches the threshold, else it expires as the last mention does.
    """
    last = mentions.groupBy("uuid").agg(F.count(F.lit(1)).alias("_n"), F.max_by("significance", "seq").alias("_sig"))
    rows = facts.join(last, "uuid", "left")
    hit, up = F.col("_n").isNotNull(), promoted(F.col("reinforced_count") + F.coalesce("_n", F.lit(0)) - 1, F.col("significance"))
    return rows.withColumns(
        {
            "expires_at": F.when(hit & ~up, expiry("_sig", as_of)).when(hit, F.lit(None)).otherwise(F.col("expires_at")),
            "significance": F.when(hit & up, 10).otherwise(F.col("significance")),
            "reinforced_at": F.when(hit, as_of).otherwise(F.col("reinforced_at")),
            "reinforced_count": F.col("reinforced_count") + F.coalesce("_n", F.lit(0)).cast("int"),
        }
    ).drop("_n", "_sig")


def add_memories(facts: DataFrame, incoming: DataFrame, as_of: Column) -> DataFrame:
    """entity_id, content_key, action, uuid, content, significance, expires_at, mentions: what a batch of memories does.

    incoming: entity_id, seq, content, significance. The newest fact with the same key is
    reinforced and keeps its expiry; else the first memory of the key is inserted and the
    others reinforce it. `mentions` counts the reinforcements. A new uuid is made of entity,
    key and time, so a repeated run gives the same rows.
    """
    keyed = incoming.withColumn("content_key", X.content_key("content")).filter("entity_id IS NOT NULL AND content IS NOT NULL")
    batch = keyed.groupBy("entity_id", "content_key").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("seq", "content", "significance")).alias("_first"))
    there = first_in_group(facts.select("entity_id", "content_key", "uuid", "created_at"), ["entity_id", "content_key"], [F.desc("created_at"), F.asc("uuid")], 1)
    rows = batch.join(there.select("entity_id", "content_key", "uuid"), ["entity_id", "content_key"], "left")
    new = F.col("uuid").isNull()
    made = F.substring(F.sha2(F.concat_ws("|", "entity_id", "content_key", as_of.cast("string")), 256), 1, 32)
    sig = F.coalesce(F.when(F.col("_first.significance").between(1, 10), F.col("_first.significance")), F.lit(5))
    return rows.select(
        "entity_id", "content_key", F.when(new, "insert").otherwise("reinforce").alias("action"), F.coalesce("uuid", made).alias("uuid"), F.col("_first.content").alias("content"),
        sig.alias("significance"), F.when(new, expiry(sig, as_of)).alias("expires_at"), (F.col("_n") - F.when(new, 1).otherwise(0)).cast("bigint").alias("mentions"),
    )


def recall_usage(recalled: DataFrame) -> DataFrame:
    """uuid, recalls, last_recalled_at of recall events (uuid, at)."""
    return recalled.groupBy("uuid").agg(F.count(F.lit(1)).alias("recalls"), F.max("at").alias("last_recalled_at"))


def slot_conflicts(facts: DataFrame, new: DataFrame) -> DataFrame:
    """entity_id, slot, uuid, superseded_by: current identity facts that the first new identity fact of their slot replaces.

    new: entity_id, slot, uuid, seq. A fact isn't in conflict with itself.
    """
    first = new.filter("slot <> ''").groupBy("entity_id", "slot").agg(F.min_by("uuid", F.struct("seq", "uuid")).alias("superseded_by"))
    old = facts.filter("fact_type = 'identity' AND temporal_status = 'current' AND slot <> ''").select("entity_id", "slot", "uuid")
    return old.join(first, ["entity_id", "slot"]).filter("uuid <> superseded_by").select("entity_id", "slot", "uuid", "superseded_by")


def ingest(facts: DataFrame, extracted: DataFrame, as_of: Column, strict: bool = True) -> DataFrame:
    """entity_id, seq, uuid, action, target: what each extracted fact does, against the facts before the batch.

    extracted: entity_id, seq, content, fact_type, significance, slot, vec. In order: a fact
    with the same key, of whatever status, is reinforced (also one of the batch); a new
    identity fact makes the current ones of its slot historical; one whose vector is close to
    that of a current, unexpired fact reinforces that; the rest is inserted. With `strict`, facts just made historical can still be reinforced, so their
    superseder may never come to be; without it they can't.
    """
    from mnemosa.operators.recall import best_match

    rows = extracted.filter("entity_id IS NOT NULL AND content IS NOT NULL").withColumn("content_key", X.content_key("content"))
    rows = rows.withColumn("uuid", F.substring(F.sha2(F.concat_ws("|", "entity_id", "content_key", as_of.cast("string")), 256), 1, 32))
    there = first_in_group(facts.select("entity_id", "content_key", F.col("uuid").alias("_old"), "created_at"), ["entity_id", "content_key"], [F.desc("created_at"), F.asc("_old")], 1)
    rows = rows.join(there.select("entity_id", "content_key", "_old"), ["entity_id", "content_key"], "left")
    nth = F.row_number().over(Window.partitionBy("entity_id", "content_key").orderBy("seq"))
    rows = rows.withColumn("_nth", nth)
    fresh = rows.filter("_old IS NULL AND _nth = 1")
    conflicts = slot_conflicts(facts.filter(F.col("expires_at").isNull() | (F.col("expires_at") > as_of)), fresh.filter("fact_type = 'identity'").select("entity_id", "slot", "uuid", "seq"))
    alive = facts.filter((F.col("temporal_status") == "current") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of)))
    pool = alive if strict else alive.join(conflicts.select("uuid"), "uuid", "left_anti")
    close = best_match(fresh.select("entity_id", F.col("uuid").alias("new_id"), "vec"), pool.select("entity_id", F.col("uuid").alias("old_id"), F.col("embedding").alias("vec"), "created_at"), SEMANTIC)
    out = rows.join(close.select(F.col("new_id").alias("uuid"), F.col("old_id").alias("_near")), "uuid", "left")
    action = F.when(F.col("_old").isNotNull() | (F.col("_nth") > 1) | F.col("_near").isNotNull(), "reinforce").otherwise("insert")
    per_fact = out.select("entity_id", "seq", "uuid", action.alias("action"), F.coalesce("_old", "_near", F.when(F.col("_nth") > 1, F.col("uuid"))).alias("target"))
    demoted = conflicts.select("entity_id", F.lit(None).cast("bigint").alias("seq"), "uuid", F.lit("supersede").alias("action"), F.col("superseded_by").alias("target"))
    return per_fact.select("entity_id", F.col("seq").cast("bigint").alias("seq"), "uuid", "action", "target").unionByName(demoted)


def artifact_supersessions(new: DataFrame, existing: DataFrame, least: float = ARTIFACT) -> DataFrame:
    """uuid, superseded_by: existing artifacts closer than `least` to a new one of their conversation; the last new one by seq counts."""
    from mnemosa.functions.vectors import cosine

    old = existing.filter("superseded_by IS NULL").select("conversation_id", F.col("uuid").alias("_old"), F.col("description_embedding").alias("_v"))
    pairs = new.select("conversation_id", "uuid", "seq", F.col("description_embedding").alias("_w")).join(old, "conversation_id").filter("uuid <> _old")
    close = pairs.filter(F.round(cosine("_v", "_w"), 6) > least)
    return close.groupBy(F.col("_old").alias("uuid")).agg(F.max_by("uuid", "seq").alias("superseded_by"))


#: Change events: what each kind sets.
EVENT = "uuid string, seq bigint, kind string, at timestamp, number double, text string, note string"


def fold(facts: DataFrame, events: DataFrame) -> DataFrame:
    """The next state of `facts` after `events` (EVENT), in the order of seq.

    Kinds: reinforce (text: expiry or null), recall, significance, status (text; note:
    superseder), thread, emotion (number, text), engagement, pin, unpin, confirm, delete.
    The last writer of each value counts; counters add up. Each event contributes to
    map-side combined aggregates, so a fact with many events is no hot task.
    """
    e = events
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    last = lambda cond, value: F.max(F.when(cond, F.struct("seq", value.alias("v"))))
    sums = e.groupBy("uuid").agg(
        F.sum(F.when(is_("reinforce", "confirm"), 1).otherwise(0)).cast("int").alias("_reinforced"),
        F.max(F.when(is_("reinforce", "confirm"), F.col("at"))).alias("_reinforced_at"),
        F.sum(F.when(is_("recall"), 1).otherwise(0)).cast("int").alias("_recalled"),
        F.max(F.when(is_("recall"), F.col("at"))).alias("_recalled_at"),
        last(is_("reinforce", "pin"), F.when(F.col("kind") == "reinforce", F.try_to_timestamp("text"))).alias("_expires"),
        last(is_("significance", "pin"), F.when(F.col("kind") == "pin", 10.0).otherwise(F.col("number"))).alias("_significance"),
        last(is_("status"), F.struct("text", "note", "at")).alias("_status"),
        last(is_("thread"), F.col("text")).alias("_thread"),
        last(is_("emotion"), F.struct("number", "text")).alias("_emotion"),
        last(is_("engagement"), F.col("number")).alias("_engagement"),
        last(is_("pin", "unpin"), F.col("kind") == "pin").alias("_pinned"),
        F.max(is_("confirm")).alias("_confirmed"),
        F.max(is_("delete")).alias("_deleted"),
    )
    pick = lambda name, col: F.when(F.col(name).isNotNull(), F.col(f"{name}.v")).otherwise(F.col(col))
    ended = F.col("_status").isNotNull() & (F.col("_status.v.text") == "historical") & F.col("_status.v.note").isNotNull()
    rows = facts.join(sums, "uuid", "left").filter("NOT coalesce(_deleted, false)")
    return rows.withColumns(
        {
            "superseded_at": F.when(ended, F.col("_status.v.at")).otherwise(F.col("superseded_at")),
            "superseded_by": F.when(ended, F.col("_status.v.note")).otherwise(F.col("superseded_by")),
            "temporal_status": F.coalesce("_status.v.text", "temporal_status"),
            "expires_at": pick("_expires", "expires_at"),
            "significance": F.coalesce("_significance.v", "significance").cast("int"),
            "thread_status": pick("_thread", "thread_status"),
            "emotional_weight": F.when(F.col("_emotion").isNotNull(), F.col("_emotion.v.number")).otherwise(F.col("emotional_weight")),
            "emotional_valence": F.when(F.col("_emotion").isNotNull(), F.col("_emotion.v.text")).otherwise(F.col("emotional_valence")),
            "engagement_score": pick("_engagement", "engagement_score"),
            "pinned": pick("_pinned", "pinned"),
            "confidence": F.when(F.coalesce("_confirmed", F.lit(False)), 1.0).otherwise(F.col("confidence")),
            "reinforced_count": F.col("reinforced_count") + F.coalesce("_reinforced", F.lit(0)),
            "reinforced_at": F.greatest("reinforced_at", "_reinforced_at"),
            "recall_count": F.col("recall_count") + F.coalesce("_recalled", F.lit(0)),
            "last_recalled_at": F.greatest("last_recalled_at", "_recalled_at"),
        }
    ).select(*facts.columns)


def delete_facts(facts: DataFrame, gone: DataFrame) -> DataFrame:
    """`facts` without those named by (entity_id, uuid)."""
    return facts.join(gone.select("entity_id", "uuid"), ["entity_id", "uuid"], "left_anti")


def old_events(facts: DataFrame, as_of: Column, newest: int = 500, days: int = 30, max_significance: int = 5) -> DataFrame:
    """The newest `newest` current minor events of each entity with a reference date `days` ago or earlier; tag `_untagged` where there is none."""
    day = F.date_format(as_of - F.expr(f"INTERVAL {days} DAY"), "yyyy-MM-dd")
    old = facts.filter((F.col("fact_type") == "event") & (F.col("temporal_status") == "current") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of)))
    old = old.filter((F.col("reference_time") <= day) & (F.col("significance") <= max_significance))
    pool = first_in_group(old, "entity_id", [F.desc("created_at"), F.asc("uuid")], newest)
    return pool.withColumn("tag", F.when(F.col("tag") == "", "_untagged").otherwise(F.col("tag")))


def consolidation_groups(facts: DataFrame, as_of: Column, min_group: int = 3, newest: int = 500, days: int = 30, max_significance: int = 5) -> DataFrame:
    """entity_id, tag, n_facts, lines: old_events by tag that may become a pattern, of at least `min_group`; contents in binary order."""
    tags = old_events(facts, as_of, newest, days, max_significance).groupBy("entity_id", "tag").agg(
        F.count(F.lit(1)).alias("n_facts"), F.concat(F.lit("- "), F.array_join(F.array_sort(F.collect_list("content")), "\n- ")).alias("lines")
    )
    return tags.filter(F.col("n_facts") >= min_group)


def duplicate_patterns(new: DataFrame, existing: DataFrame, least: float = PATTERN) -> DataFrame:
    """entity_id, new_id, old_id: each new pattern's first existing one (newest first) of its entity that is closer to it than `least`."""
    from mnemosa.functions.vectors import cosine

    pairs = new.select("entity_id", F.col("uuid").alias("new_id"), F.col("embedding").alias("_a")).join(
        existing.filter("fact_type = 'pattern'").select("entity_id", F.col("uuid").alias("old_id"), F.col("embedding").alias("_b"), "created_at"), "entity_id"
    )
    close = pairs.filter(F.col("new_id") != F.col("old_id")).filter(F.round(cosine("_a", "_b"), 6) > least)
    return first_in_group(close, ["entity_id", "new_id"], [F.desc("created_at"), F.asc("old_id")], 1).select("entity_id", "new_id", "old_id")
