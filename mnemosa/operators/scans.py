"""Scans of the store for all entities, conversations or sessions at once. A limit is per group; 0 or less is none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemosa.functions.filters import FactFilter

NEWEST = (F.desc, "created_at"), (F.asc, "uuid")


def _order(spec) -> list[Column]:
    return [f(c) for f, c in spec]


def first_in_group(df: DataFrame, group: str | Sequence[str], order: Sequence[Column], limit: int, rank: str = "rank_no") -> DataFrame:
    """The first `limit` rows of each group with their rank; the limit also runs before the shuffle."""
    window = Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(*order)
    out = df.withColumn(rank, F.row_number().over(window))
    return out.filter(F.col(rank) <= limit) if limit > 0 else out


def list_facts(facts: DataFrame, limit: int = 0, where: FactFilter = FactFilter(), as_of: Column | None = None) -> DataFrame:
    """Facts of every entity, newest first."""
    return first_in_group(facts.filter(where.condition(as_of if as_of is not None else F.lit(None))), "entity_id", _order(NEWEST), limit)


def list_metadata(facts: DataFrame, limit: int = 0, where: FactFilter = FactFilter(), as_of: Column | None = None) -> DataFrame:
    """list_facts without vectors; the scan doesn't read them unless the filter asks if they are there."""
    return list_facts(facts, limit, where, as_of).drop("embedding")


def find_by_key(facts: DataFrame, keys: DataFrame) -> DataFrame:
    """For each (entity_id, content_key) of `keys` its newest fact, of any status."""
    hits = facts.join(keys.select("entity_id", "content_key").distinct(), ["entity_id", "content_key"], "left_semi")
    return first_in_group(hits, ["entity_id", "content_key"], _order(NEWEST), 1).drop("rank_no")


def open_threads(facts: DataFrame, limit: int = 20) -> DataFrame:
    """Open threads of every entity, most significant first."""
    return first_in_group(facts.filter("thread_status = 'open'"), "entity_id", [F.desc("significance"), *_order(NEWEST)], limit)


def messages_in_order(messages: DataFrame) -> DataFrame:
    return first_in_group(messages, "conversation_id", [F.asc("created_at"), F.asc("uuid")], 0, "position")


def recent_messages(messages: DataFrame, limit: int) -> DataFrame:
    """The last `limit` messages of every conversation; position counts from the oldest of them."""
    last = first_in_group(messages, "conversation_id", _order([(F.desc, "created_at"), (F.desc, "uuid")]), limit, "_back")
    forward = Window.partitionBy("conversation_id").orderBy(F.desc("_back"))
    return last.withColumn("position", F.row_number().over(forward)).drop("_back")


def summaries(conversations: DataFrame, limit: int = 100) -> DataFrame:
    """Conversations of every entity with a summary and its vector, newest first."""
    usable = conversations.filter("entity_id IS NOT NULL AND coalesce(summary, '') <> '' AND summary_embedding IS NOT NULL")
    return first_in_group(usable, "entity_id", _order(NEWEST), limit)


def unsummarized(conversations: DataFrame, current_sessions: DataFrame | None = None) -> DataFrame:
    """The newest conversation without summary of every entity, outside the given sessions (entity_id, session_id)."""
    open_ = conversations.filter("entity_id IS NOT NULL AND coalesce(summary, '') = ''")
    if current_sessions is not None:
        open_ = open_.join(current_sessions, ["entity_id", "session_id"], "left_anti")
    return first_in_group(open_, "entity_id", _order(NEWEST), 1).drop("rank_no")


def active_conversations(conversations: DataFrame) -> DataFrame:
    """The newest conversation of every session."""
    return first_in_group(conversations.filter("session_id IS NOT NULL"), "session_id", _order(NEWEST), 1).drop("rank_no", "summary_embedding")


def turn_summaries_in_order(turns: DataFrame) -> DataFrame:
    """Turn summaries of every conversation: ranges by start, then the overview."""
    return first_in_group(turns, "conversation_id", [F.asc("is_overview"), F.asc("start_turn"), F.asc("created_at"), F.asc("uuid")], 0, "position")


def turn_summary_stats(turns: DataFrame) -> DataFrame:
    """conversation_id, n_ranges, highest_end of the ranges that are no overview."""
    return turns.filter("NOT coalesce(is_overview, false)").groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n_ranges"), F.max("end_turn").alias("highest_end"))


def entity_stats(facts: DataFrame) -> DataFrame:
    """entity_id, n_facts, first_fact_at."""
    return facts.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_facts"), F.min("created_at").alias("first_fact_at"))


def active_artifacts(artifacts: DataFrame, group: str = "conversation_id", limit: int = 0) -> DataFrame:
    return first_in_group(artifacts.filter("superseded_by IS NULL"), group, _order(NEWEST), limit)


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The rows of `incoming` to append: one per key that isn't there yet, the earliest by created_at."""
    first = first_in_group(incoming, key, [F.asc("created_at"), *[F.asc(c) for c in incoming.columns if c not in (key, "created_at") and not dict(incoming.dtypes)[c].startswith("map")]], 1)
    return first.drop("rank_no").join(existing.select(key), key, "left_anti")
