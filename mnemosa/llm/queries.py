"""Queries and SQL of the operators for language-model data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemosa.llm.conversations import rebuild
from mnemosa.llm.mixing import mix_sources, plan, reached_shares, sized
from mnemosa.llm.neighbors import nearest, similar_pairs, usable_vectors
from mnemosa.llm.privacy import find_personal, redact
from mnemosa.llm.tokens import with_ids
from mnemosa.llm.quality import classify, common_words, statistics
from mnemosa.llm.topn import top_facts
from mnemosa.functions.keys import norm_key
from mnemosa.sources.tables import read_table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """The first five facts of every entity."""
    return top_facts(read_table(spark, sf, "mg_entity_fact"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """All turns of the whole conversations, in order; times as sent."""
    return rebuild(read_table(spark, sf, "mg_message")).select("conversation_id", "turn_no", "uuid")


def p4_clock_corrected(spark: SparkSession, sf: str) -> DataFrame:
    """All turns of the conversations that are whole once clocks may be off by up to 5 seconds."""
    return rebuild(read_table(spark, sf, "mg_message"), 5_000_000)


def _vectors(spark: SparkSession, sf: str) -> list[tuple[DataFrame, bool]]:
    facts = usable_vectors(read_table(spark, sf, "mg_entity_fact"), "mg_entity_fact.embedding", "embedding", "embedding_model", "updated_at")
    talks = usable_vectors(read_table(spark, sf, "mg_conversation"), "mg_conversation.summary_embedding", "summary_embedding", "summary_embedding_model")
    return [(facts, True), (talks, False)]


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of vectors of one field, model and length with a cosine of at least 0.90."""
    pairs = similar_pairs(_vectors(spark, sf), 0.90)
    return pairs.select(F.substring_index("grp", "|", 1).alias("field"), F.col("a").alias("uuid_a"), F.col("b").alias("uuid_b"))


def p5_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The 10 most similar vectors of every 50th vector (by a number made of its uuid), among all vectors."""
    found = nearest(_vectors(spark, sf), F.pmod(F.crc32("id"), F.lit(50)) == 0)
    return found.select(F.substring_index("grp", "|", 1).alias("field"), F.col("query").alias("uuid"), "rank_no", F.col("neighbor").alias("uuid_near"), F.round("cos", 4).alias("cos"))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    facts, messages = read_table(spark, sf, "mg_entity_fact"), read_table(spark, sf, "mg_message")
    pick = lambda df, table, col: df.select(F.lit(f"{table}.{col}").alias("field"), norm_key("uuid").alias("uuid"), F.col(col).alias("text"))
    return pick(messages, "mg_message", "content").unionByName(pick(facts, "mg_entity_fact", "verbatim")).unionByName(pick(facts, "mg_entity_fact", "content"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every different item of personal information in every record."""
    return find_personal(_texts(spark, sf), read_table(spark, sf, "given_name"))


def p7_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """All texts with placeholders in place of personal information."""
    return redact(_texts(spark, sf), read_table(spark, sf, "given_name"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The token ids of every document."""
    return with_ids(read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The largest mixture of the sources in mix_target that reaches every weight within its cap."""
    mix = read_table(spark, sf, "mix_target")
    docs = sized(read_table(spark, sf, "documents"), mix)
    return mix_sources(docs, plan(docs, mix))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and reached share of every source of the mixture."""
    return reached_shares(p9_mix(spark, sf), read_table(spark, sf, "mix_target"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that are lists, tables or junk."""
    kinds = classify(read_table(spark, sf, "documents"), read_table(spark, sf, "common_word"))
    return kinds.filter("kind <> 'prose'").select("doc_id", "kind")


def p10_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """The kind of every document that has visible text, with its calibrated probability."""
    kinds = classify(read_table(spark, sf, "documents"), read_table(spark, sf, "common_word"))
    return kinds.select("doc_id", "kind", F.round("probability", 4).alias("probability"))


def p10_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Word count, mean word length, symbol ratio, and shares of punctuated lines and common words of every document."""
    stats = statistics(read_table(spark, sf, "documents"), common_words(read_table(spark, sf, "common_word")))
    return stats.select("doc_id", "word_count", *[F.round(c, 6).alias(c) for c in stats.columns[2:]])


QUERIES = {q.__name__: q for q in (p1_found, p4_found, p4_clock_corrected, p5_found, p5_neighbours, p7_found, p7_redacted, p8_ids, p9_mix, p9_shares, p10_found, p10_kinds, p10_stats)}

_KEY = "nullif(lower(trim({}, ' ' || chr(9) || chr(10) || chr(13))), '')"

SQL = {
    "p1_found": f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY {_KEY.format("uuid")} ORDER BY updated_at DESC) AS n FROM mg_entity_fact),
r AS (SELECT {_KEY.format("entity_id")} AS entity_id, {_KEY.format("uuid")} AS uuid,
  CASE WHEN significance BETWEEN 1 AND 10 THEN significance ELSE 5 END AS sig, coalesce(reinforced_count, 0) AS cnt FROM s WHERE n = 1),
k AS (SELECT entity_id, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY sig DESC, cnt DESC, uuid) AS INTEGER) AS rank_no, uuid FROM r WHERE entity_id IS NOT NULL)
SELECT * FROM k WHERE rank_no <= 5""",
    "p4_found": f"""WITH m AS (SELECT DISTINCT {_KEY.format("conversation_id")} AS conversation_id, {_KEY.format("uuid")} AS uuid, lower(trim(role)) AS role,
  regexp_replace(regexp_replace(content, '^[\\s\\x0b\\p{{Z}}]+', ''), '[\\s\\x0b\\p{{Z}}]+$', '') AS said, created_at FROM mg_message),
r AS (SELECT *, CASE WHEN role IN ('user', 'human') THEN 0 WHEN role IN ('assistant', 'ai', 'bot') THEN 1 END AS side,
  coalesce(role NOT IN ('user', 'human', 'assistant', 'ai', 'bot', 'system', 'tool'), true) AS bad FROM m WHERE conversation_id IS NOT NULL),
t AS (SELECT * FROM r WHERE side IS NOT NULL AND said <> ''),
broken AS (SELECT conversation_id FROM r WHERE bad UNION SELECT conversation_id FROM t WHERE created_at IS NULL),
p AS (SELECT *, lag(side) OVER w AS ps, lag(said) OVER w AS px FROM t WINDOW w AS (PARTITION BY conversation_id ORDER BY created_at, side, uuid)),
k AS (SELECT * FROM p WHERE ps IS NULL OR ps <> side OR px <> said),
n AS (SELECT *, row_number() OVER w AS turn_no, lag(side) OVER w AS ks FROM k WINDOW w AS (PARTITION BY conversation_id ORDER BY created_at, side, uuid)),
good AS (SELECT conversation_id FROM n GROUP BY conversation_id
  HAVING bool_and(side <> coalesce(ks, 1)) AND count(*) % 2 = 0)
SELECT conversation_id, CAST(turn_no AS INTEGER) AS turn_no, uuid FROM n
WHERE conversation_id IN (SELECT conversation_id FROM good) AND conversation_id NOT IN (SELECT conversation_id FROM broken)""",
    "p5_found": f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY {_KEY.format("uuid")} ORDER BY updated_at DESC) AS n FROM mg_entity_fact),
v AS (SELECT 'mg_entity_fact.embedding' AS field, {_KEY.format("uuid")} AS id, embedding::DOUBLE[] AS e, coalesce({_KEY.format("embedding_model")}, '') AS m FROM s WHERE n = 1
  UNION ALL SELECT 'mg_conversation.summary_embedding', {_KEY.format("uuid")}, summary_embedding::DOUBLE[], coalesce({_KEY.format("summary_embedding_model")}, '') FROM mg_conversation),
u AS (SELECT * FROM v WHERE len(e) > 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0)
SELECT a.field, a.id AS uuid_a, b.id AS uuid_b FROM u a JOIN u b ON a.field = b.field AND a.m = b.m AND len(a.e) = len(b.e) AND a.id < b.id
WHERE list_cosine_similarity(a.e, b.e) >= 0.9""",
    "p10_stats": """WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
l AS (SELECT *, list_filter(regexp_split_to_array(x, '\\r\\n|\\n|\\r|\\x{85}|\\x{2028}|\\x{2029}'), lambda s: regexp_matches(s, '[^\\s\\x0b]')) AS lines,
  regexp_extract_all(lower(x), '[\\p{L}\\p{M}\\p{N}]+(?:[''’-][\\p{L}\\p{M}\\p{N}]+)*', 0) AS ws FROM t),
c AS (SELECT list(DISTINCT lower(word)) AS cw FROM common_word WHERE word IS NOT NULL),
n AS (SELECT doc_id, len(ws) AS word_count, length(x) AS chars, len(lines) AS n_lines, list_sum(list_transform(ws, lambda w: length(w))) AS letters,
  length(regexp_replace(x, '[\\p{L}\\p{M}\\p{N}\\p{Z}\\s\\x0b\\x{85}]', '', 'g')) AS symbols,
  len(list_filter(lines, lambda s: regexp_matches(s, '[.!?…。！？]["»”’)\\]]*[ \\t]*$'))) AS punct, len(list_filter(ws, lambda w: list_contains(cw, w))) AS known FROM l, c)
SELECT doc_id, word_count, round(CASE WHEN word_count > 0 THEN letters / word_count ELSE 0 END, 6) AS mean_word_length, round(CASE WHEN chars > 0 THEN symbols / chars ELSE 0 END, 6) AS symbol_ratio,
  round(CASE WHEN n_lines > 0 THEN punct / n_lines ELSE 0 END, 6) AS punct_line_share, round(CASE WHEN word_count > 0 THEN known / word_count ELSE 0 END, 6) AS common_word_share FROM n""",
}
