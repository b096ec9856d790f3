"""Code, JSON and SQL inside messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemosa.functions import text as X

FENCE = r"(?s)```([A-Za-z0-9_]*)\n(.*?)```"
SQL_LINE = r"(?i)^(?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP)(?![A-Za-z0-9_])"
BLOCK = "(?m)(?:^(?: {4}|\\t)[^\\n]*(?:\\n|\\z)){4,}"


def _found(kind: int, type_: str, bodies: Column, languages: Column | None = None) -> Column:
    langs = languages if languages is not None else F.transform(bodies, lambda b: F.lit(""))
    return F.transform(F.arrays_zip(bodies.alias("b"), langs.alias("l")), lambda z: F.struct(F.lit(kind).alias("kind"), z["b"].alias("content"), F.lit(type_).alias("artifact_type"), z["l"].alias("language")))


def detect_artifacts(messages: DataFrame, group: str = "conversation_id") -> DataFrame:
    """`group`, position, content, artifact_type, language, source_role: artifacts of users and assistants, each content once, in the order first seen.

    messages: group, created_at, uuid, role, content. Fenced code, then runs of more than
    three indented lines, then brace blocks that read as JSON, then lines that begin like SQL.
    """
    rows = messages.filter(F.col("role").isin("user", "assistant") & F.col("content").isNotNull())
    fenced = F.regexp_extract_all("content", F.lit(FENCE), F.lit(2))
    languages = F.regexp_extract_all("content", F.lit(FENCE), F.lit(1))
    rows = rows.withColumns({"_fenced": F.transform(fenced, lambda b: X.jstrip(b)), "_languages": languages, "_rest": F.regexp_replace("content", FENCE, "")})
    blocks = F.transform(F.regexp_extract_all("_rest", F.lit(BLOCK), F.lit(0)), lambda b: X.jstrip(b))
    jsons = F.filter(F.regexp_extract_all("_rest", F.lit(r"(?s)\{.*?\}"), F.lit(0)), lambda j: F.try_parse_json(j).isNotNull())
    lines = F.filter(F.transform(F.split("_rest", "\n"), lambda s: X.jstrip(s)), lambda s: s.rlike(SQL_LINE))
    all_ = F.concat(_found(0, "code", F.col("_fenced"), F.col("_languages")), _found(1, "code", blocks), _found(2, "json", jsons), _found(3, "sql", lines))
    one = rows.select(group, "created_at", "uuid", F.col("role").alias("source_role"), F.posexplode(all_).alias("_at", "_a")).select(group, "created_at", "uuid", "_at", "source_role", "_a.*")
    one = one.filter(F.coalesce("content", F.lit("")) != "")
    first = one.groupBy(group, "content").agg(F.min(F.struct("created_at", "uuid", "_at", "source_role", "artifact_type", "language")).alias("_f"))
    order = Window.partitionBy(group).orderBy("_f.created_at", "_f.uuid", "_f._at")
    return first.select(group, F.row_number().over(order).alias("position"), "content", "_f.artifact_type", "_f.language", "_f.source_role")


def entity_mentions(facts: DataFrame, most: int = 15) -> DataFrame:
    """entity_id, position, mention: the first `most` different mentions of an entity, from its oldest fact on."""
    words = facts.select("entity_id", "created_at", "uuid", F.posexplode(X.mention_tokens("content")).alias("_at", "mention"))
    first = words.groupBy("entity_id", F.lower("mention").alias("_low")).agg(F.min(F.struct("created_at", "uuid", "_at", "mention")).alias("_f"))
    order = Window.partitionBy("entity_id").orderBy("_f.created_at", "_f.uuid", "_f._at")
    return first.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= most).select("entity_id", "position", F.col("_f.mention").alias("mention"))
