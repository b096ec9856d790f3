"""Queries over the memory tables for the general data problems (2, 3, 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemosa.operators.history import attribute_history
from mnemosa.operators.references import broken_references
from mnemosa.operators.skew import heavy_keys, key_profile
from mnemosa.sources.tables import read_table
from mnemosa.functions.keys import latest_state

KEYED = (("mg_entity_fact", "entity_id"), ("mg_message", "conversation_id"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The keys on at least 2 % of the rows of their table."""
    parts = [heavy_keys(read_table(spark, sf, t), k, "created_at").select(F.lit(f"{t}.{k}").alias("field"), F.col("key").alias("heavy_key")) for t, k in KEYED]
    return parts[0].unionByName(parts[1])


def p2_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Number of rows, first and last time of every entity and conversation."""
    parts = [key_profile(read_table(spark, sf, t), k, "created_at").withColumn("field", F.lit(f"{t}.{k}")) for t, k in KEYED]
    return parts[0].unionByName(parts[1]).select("field", "key", "n_rows", "first_at", "last_at")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every reference to a row that is missing or came later."""
    conversations = read_table(spark, sf, "mg_conversation")
    facts = latest_state(read_table(spark, sf, "mg_entity_fact"), ["created_at", "superseded_by"])
    messages, turns = read_table(spark, sf, "mg_message"), read_table(spark, sf, "mg_turn_summary")
    return (
        broken_references(messages, "mg_message.conversation_id", "conversation_id", conversations, True)
        .unionByName(broken_references(turns, "mg_turn_summary.conversation_id", "conversation_id", conversations, True))
        .unionByName(broken_references(facts, "mg_entity_fact.superseded_by", "superseded_by", facts, False, ("consolidated",)))
    )


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    """Number of broken references per field, month and reason."""
    return p3_found(spark, sf).groupBy("field", "ref_month", "reason").agg(F.count(F.lit(1)).alias("n_refs"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every version of every canonical slot of every entity, with its period in milliseconds."""
    found = attribute_history(read_table(spark, sf, "mg_entity_fact"), read_table(spark, sf, "mg_slot_canonical"))
    ends = F.coalesce(F.unix_millis("valid_to"), F.lit(-1).cast("long"))
    return found.select("entity_id", "slot", "uuid", F.unix_millis("valid_from").alias("valid_from_ms"), ends.alias("valid_to_ms"))


QUERIES = {q.__name__: q for q in (p2_found, p2_profile, p3_found, p3_report, p6_found)}

_KEY = "nullif(lower(trim({}, ' ' || chr(9) || chr(10) || chr(13))), '')"
_STATE = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY " + _KEY.format("uuid") + " ORDER BY updated_at DESC) AS state_no FROM mg_entity_fact WHERE uuid IS NOT NULL) WHERE state_no = 1)"

_P2 = " UNION ALL ".join(
    f"SELECT '{t}.{k}' AS field, {_KEY.format(k)} AS key, count(*) AS n_rows, min(created_at) AS first_at, max(created_at) AS last_at FROM {t} WHERE {_KEY.format(k)} IS NOT NULL GROUP BY ALL"
    for t, k in KEYED
)


def _late(table: str) -> str:
    return f"""SELECT DISTINCT '{table}.conversation_id' AS field, coalesce(strftime(r.created_at, '%Y-%m'), 'unknown') AS ref_month,
      {_KEY.format("r.uuid")} AS uuid, CASE WHEN c.uuid IS NULL THEN 'missing' ELSE 'late' END AS reason
    FROM {table} r LEFT JOIN mg_conversation c ON {_KEY.format("c.uuid")} = {_KEY.format("r.conversation_id")}
    WHERE {_KEY.format("r.conversation_id")} IS NOT NULL AND (c.uuid IS NULL OR c.created_at > r.created_at)"""


_P3 = f"""{_late("mg_message")} UNION ALL {_late("mg_turn_summary")} UNION ALL
SELECT 'mg_entity_fact.superseded_by', coalesce(strftime(created_at, '%Y-%m'), 'unknown'), {_KEY.format("uuid")}, 'missing' FROM {_STATE} f
WHERE {_KEY.format("superseded_by")} <> 'consolidated' AND NOT EXISTS (SELECT 1 FROM mg_entity_fact p WHERE {_KEY.format("p.uuid")} = {_KEY.format("f.superseded_by")})"""

_P6 = f"""WITH s AS (SELECT *, {_KEY.format("uuid")} AS u FROM {_STATE}),
f AS (SELECT {_KEY.format("s.entity_id")} AS entity_id, n.name AS slot, s.u, s.created_at, s.updated_at, s.superseded_at, p.created_at AS by_at,
    lower(trim(s.temporal_status)) AS status,
    trim(regexp_replace(regexp_replace(lower(coalesce(s.content, '')), '[\\p{{P}}\\p{{S}}]+', '', 'g'), '[\\s\\x0b\\p{{Z}}]+', ' ', 'g')) AS say
  FROM s JOIN mg_slot_canonical n ON regexp_replace(lower(n.name), '[^\\p{{L}}\\p{{N}}]+', '', 'g') = regexp_replace(lower(s.slot), '[^\\p{{L}}\\p{{N}}]+', '', 'g')
  LEFT JOIN s p ON p.u = {_KEY.format("s.superseded_by")}
  WHERE {_KEY.format("s.entity_id")} IS NOT NULL AND s.created_at IS NOT NULL),
g AS (SELECT *, CASE WHEN say = lag(say) OVER w THEN 0 ELSE 1 END AS is_new FROM f WINDOW w AS (PARTITION BY entity_id, slot ORDER BY created_at, u)),
h AS (SELECT *, sum(is_new) OVER (PARTITION BY entity_id, slot ORDER BY created_at, u) AS version_no,
    CASE WHEN superseded_at >= created_at THEN superseded_at WHEN by_at >= created_at THEN by_at WHEN status = 'historical' THEN updated_at END AS ends FROM g),
v AS (SELECT entity_id, slot, version_no, arg_min(u, (created_at, u)) AS uuid, min(created_at) AS started,
    last(ends ORDER BY created_at, u) AS ends FROM h GROUP BY ALL)
SELECT entity_id, slot, uuid, epoch_ms(started) AS valid_from_ms,
  coalesce(epoch_ms(least(ends, lead(started) OVER (PARTITION BY entity_id, slot ORDER BY version_no))), -1) AS valid_to_ms FROM v"""

SQL = {
    "p2_found": f"SELECT field, key AS heavy_key FROM ({_P2}) WHERE n_rows >= 0.02 * CASE field WHEN 'mg_message.conversation_id' THEN (SELECT count(*) FROM mg_message) ELSE (SELECT count(*) FROM mg_entity_fact) END",
    "p2_profile": _P2,
    "p3_found": _P3,
    "p3_report": f"SELECT field, ref_month, reason, count(*) AS n_refs FROM ({_P3}) GROUP BY ALL",
    "p6_found": _P6,
}
