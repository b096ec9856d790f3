"""Table schemas of the memory store, defaults and additive evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemosa.functions.keys import latest_state, norm_key


ENTITY = "uuid string, external_id string, created_at timestamp"
FACT = (
    "uuid string, entity_id string, content string, embedding array<float>, created_at timestamp, updated_at timestamp, fact_type string, temporal_status string, significance int, "
    "content_key string, reference_time string, expires_at timestamp, reinforced_at timestamp, reinforced_count int, tag string, slot string, confidence double, embedding_model string, "
    "source_role string, recall_count int, last_recalled_at timestamp, emotional_weight double, emotional_valence string, verbatim string, started_at string, thread_status string, "
    "engagement_score double, pinned boolean, superseded_at timestamp, superseded_by string"
)
PROCESS = "uuid string, external_id string, created_at timestamp"
PROCESS_ATTRIBUTE = "uuid string, process_id string, key string, value string, created_at timestamp"
SESSION = "uuid string, entity_id string, process_id string, created_at timestamp, expires_at timestamp, entity_mentions array<string>, message_count int"
CONVERSATION = "uuid string, session_id string, entity_id string, summary string, summary_embedding array<float>, summary_embedding_model string, created_at timestamp, updated_at timestamp"
MESSAGE = "uuid string, conversation_id string, role string, content string, kind string, created_at timestamp"
SLOT_CANONICAL = "name string, embedding array<float>, created_at timestamp"
TURN_SUMMARY = (
    "uuid string, conversation_id string, entity_id string, start_turn int, end_turn int, summary string, summary_embedding array<float>, is_overview boolean, created_at timestamp"
)
ARTIFACT = (
    "uuid string, conversation_id string, entity_id string, content string, artifact_type string, language string, description string, description_embedding array<float>, "
    "superseded_by string, turn_number int, created_at timestamp"
)
TABLES = {
    "entity": ENTITY, "entity_fact": FACT, "process": PROCESS, "process_attribute": PROCESS_ATTRIBUTE, "session": SESSION, "conversation": CONVERSATION,
    "message": MESSAGE, "slot_canonical": SLOT_CANONICAL, "turn_summary": TURN_SUMMARY, "artifact": ARTIFACT,
}

#: What a fact's missing values read as.
FACT_DEFAULTS = {
    "content": "", "fact_type": "identity", "temporal_status": "current", "significance": 5, "content_key": "", "reinforced_count": 0, "tag": "", "slot": "", "confidence": 1.0,
    "embedding_model": "", "source_role": "", "recall_count": 0, "pinned": False,
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    """An empty table of the store."""
    return spark.createDataFrame([], TABLES[table])


def evolve(df: DataFrame, table: str) -> DataFrame:
    """`df` with all columns of the table, those it lacks null; other columns go."""
    base = empty(df.sparkSession, table)
    return base.unionByName(df.select(*[c for c in df.columns if c in base.columns]), allowMissingColumns=True)


def with_defaults(facts: DataFrame) -> DataFrame:
    """Missing values of facts as their defaults; status in lower case without blanks; an empty vector is none."""
    cols = []
    for name in facts.columns:
        col = F.col(name)
        if name == "temporal_status":
            col = norm_key(name)
        if name == "embedding" and dict(facts.dtypes)[name].startswith("array"):
            col = F.when(F.size(name) > 0, col)
        if name in FACT_DEFAULTS:
            col = F.coalesce(col, F.lit(FACT_DEFAULTS[name]))
        cols.append(col.alias(name))
    return facts.select(*cols)


def current_facts(facts: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per fact, by state and with defaults, of facts that belong to an entity. Only `columns` are read, by default all."""
    columns = list(columns) if columns is not None else [c for c in facts.columns if c not in ("uuid", "updated_at")]
    if "entity_id" not in columns:
        columns = ["entity_id", *columns]
    state = latest_state(facts, columns).withColumn("entity_id", norm_key("entity_id")).filter("entity_id IS NOT NULL")
    return with_defaults(state)


def vector_presence(facts: DataFrame) -> DataFrame:
    """`facts` with 1 in place of each vector, so that asking which facts have none carries no vectors."""
    return facts.withColumn("embedding", F.when(F.size("embedding") > 0, F.lit(1)))
