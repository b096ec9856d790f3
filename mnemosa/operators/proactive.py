"""Things worth bringing up: five kinds of triggers, and the choice among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemosa.functions.filters import FactFilter
from mnemosa.operators.recall import micros
from mnemosa.operators.scans import entity_stats, first_in_group, list_facts, open_threads

# What counts as a hard feeling, and the marks of a milestone.
HARD = ("grief", "anxiety", "anger", "fear")
FACT_MARKS, DAY_MARKS = (50, 100, 250, 500, 1000), (30, 90, 180, 365)
KINDS = ("open_thread", "emotional_checkin", "milestone", "nostalgia", "prediction_followup")


def days_between(start: Column | str, end: Column) -> Column:
    """Whole days, by elapsed time."""
    return F.floor((micros(end) - micros(start)) / 86_400_000_000).cast("bigint")


def gate(entity: Column | str, day: Column | str) -> Column:
    """Whether an entity may be approached on a day: about two days in three, the same for all who ask."""
    first = F.conv(F.substring(F.sha2(F.concat(entity, day), 256), 1, 2), 16, 10).cast("int")
    return first % 3 != 0


def _out(df: DataFrame, kind: str, content: Column, priority: Column, days: Column, uuid: Column, position: Column) -> DataFrame:
    return df.select("entity_id", F.lit(kind).alias("kind"), content.alias("content"), uuid.alias("uuid"), F.round(priority, 6).alias("priority"), days.alias("days_since"), position.cast("bigint").alias("position"))


def thread_triggers(facts: DataFrame, as_of: Column) -> DataFrame:
    rows = open_threads(facts, 10).withColumn("_d", days_between("created_at", as_of))
    since = F.when(F.col("_d") == 0, "today").when(F.col("_d") == 1, "yesterday").otherwise(F.concat(F.col("_d").cast("string"), F.lit(" days ago")))
    priority = F.col("significance") * 0.1 + F.when(F.col("_d") > 7, 0.3).otherwise(0.1)
    return _out(rows, KINDS[0], F.concat("content", F.lit(" (open since "), since, F.lit(")")), priority, F.col("_d"), F.col("uuid"), F.col("rank_no"))


def feeling_triggers(facts: DataFrame, as_of: Column) -> DataFrame:
    rows = list_facts(facts, 20, FactFilter(valences=HARD, exclude_expired=True), as_of).withColumn("_d", days_between("created_at", as_of)).filter("_d BETWEEN 1 AND 14")
    said = F.concat(F.lit("You mentioned experiencing "), F.col("emotional_valence"), F.lit(" "), F.col("_d").cast("string"), F.when(F.col("_d") == 1, " day").otherwise(" days"), F.lit(" ago. How are you feeling about that now?"))
    return _out(rows, KINDS[1], said, 0.5 * F.coalesce("emotional_weight", F.lit(0.5)), F.col("_d"), F.col("uuid"), F.col("rank_no"))


def milestone_triggers(facts: DataFrame, as_of: Column) -> DataFrame:
    stats = entity_stats(facts).withColumn("_d", days_between("first_fact_at", as_of))
    of_facts = stats.filter(F.array_contains(F.transform(F.array(*map(F.lit, FACT_MARKS)), lambda m: F.col("n_facts").between(m, m + 9)), True))
    of_days = stats.filter(F.array_contains(F.transform(F.array(*map(F.lit, DAY_MARKS)), lambda m: F.col("_d").between(m, m + 2)), True))
    a = _out(of_facts, KINDS[2], F.concat(F.lit("This is a milestone — "), F.col("n_facts").cast("string"), F.lit(" memories stored together.")), F.lit(0.8), F.lit(None).cast("bigint"), F.lit(""), F.lit(1))
    b = _out(of_days, KINDS[2], F.concat(F.lit("It's been "), F.col("_d").cast("string"), F.lit(" days since our first conversation.")), F.lit(0.8), F.col("_d"), F.lit(""), F.lit(2))
    return a.unionByName(b)


def nostalgia_triggers(facts: DataFrame, as_of: Column) -> DataFrame:
    pool = list_facts(facts, 50, FactFilter(min_significance=7, exclude_expired=True, statuses=("current",)), as_of).withColumn("_d", days_between("created_at", as_of))
    old = pool.filter((F.col("_d") >= 30) & (F.col("last_recalled_at").isNull() | (days_between("last_recalled_at", as_of) >= 14)))
    best = first_in_group(old, "entity_id", [F.coalesce("engagement_score", F.lit(0.0)).desc(), F.asc("rank_no")], 2, "_n")
    said = F.concat(F.lit('Remember when you mentioned: "'), "content", F.lit('"? That was '), F.col("_d").cast("string"), F.lit(" days ago."))
    return _out(best, KINDS[3], said, F.lit(0.4), F.col("_d"), F.col("uuid"), F.col("_n"))


def prediction_triggers(facts: DataFrame, as_of: Column, name: str = "prediction") -> DataFrame:
    tagged = list_facts(facts, 20, FactFilter(tags=(name,), exclude_expired=True), as_of).withColumn("_s", F.lit(0))
    slotted = list_facts(facts, 20, FactFilter(slots=(name,), exclude_expired=True), as_of).withColumn("_s", F.lit(1))
    both = first_in_group(tagged.unionByName(slotted), ["entity_id", "uuid"], [F.asc("_s")], 1, "_n").withColumn("_d", days_between("created_at", as_of))
    due = both.filter((F.col("_d") >= 7) & (F.col("_d") <= 30) & ~F.col("thread_status").eqNullSafe("resolved"))
    said = F.concat(F.lit("You made a prediction "), F.col("_d").cast("string"), F.lit(' days ago: "'), "content", F.lit('". Has anything changed?'))
    return _out(due, KINDS[4], said, F.lit(0.6), F.col("_d"), F.col("uuid"), F.col("_s") * 1000 + F.col("rank_no"))


MAKERS = {"open_thread": thread_triggers, "emotional_checkin": feeling_triggers, "milestone": milestone_triggers, "nostalgia": nostalgia_triggers, "prediction_followup": prediction_triggers}


def proactive(facts: DataFrame, as_of: Column, kinds: tuple[str, ...] = KINDS, limit: int = 3, gated: bool = True) -> DataFrame:
    """The `limit` most urgent triggers of every entity that may be approached; ties in the order of kinds, then of rows."""
    all_ = None
    for i, kind in enumerate(kinds):
        part = MAKERS[kind](facts, as_of).withColumn("_kind", F.lit(i))
        all_ = part if all_ is None else all_.unionByName(part)
    if gated:
        all_ = all_.filter(gate("entity_id", F.date_format(as_of, "yyyy-MM-dd")))
    best = first_in_group(all_, "entity_id", [F.desc("priority"), F.asc("_kind"), F.asc("position")], limit)
    return best.select("entity_id", "rank_no", "kind", "content", "uuid", "priority", "days_since")
