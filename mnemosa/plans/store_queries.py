"""Queries for the store's writes, small functions and model steps, over the whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemosa import extensions as E
from mnemosa.functions import text as X
from mnemosa.functions.filters import FactFilter, significance_label, significance_of
from mnemosa.functions.keys import norm_key
from mnemosa.functions.vectors import decode_vector, encode_vector
from mnemosa.operators import context as C
from mnemosa.operators import lifecycle as L
from mnemosa.operators import models as M
from mnemosa.operators import rank as R
from mnemosa.operators import recall as Q
from mnemosa.operators import scans as S
from mnemosa.operators import sessions as T
from mnemosa.plans import memory_sql as Y
from mnemosa.plans.memory_queries import CONSCIOUS, EVENTS, as_of, conversations_of, facts_of, keyed_facts, messages_of, turns_of
from mnemosa.sources.tables import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: What is taken for new: facts and entities from this time on.
SINCE = "2023-12-15 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _since():
    return F.lit(SINCE).cast("timestamp_ntz")


_MIX = "'user', 'assistant', 'mixed'"


@query(f"WITH {Y.FACTS} SELECT entity_id, uuid, source_role FROM f WHERE source_role IN ({_MIX}) AND significance >= 3")
def facts_by_role(spark, sf):
    """Facts that users, assistants or both gave, of some significance."""
    where = FactFilter(source_roles=("user", "assistant", "mixed"), min_significance=3)
    return facts_of(spark, sf, "source_role", "significance").filter(where.condition(as_of())).select("entity_id", "uuid", "source_role")


@query(f"WITH {Y.FACTS} SELECT DISTINCT entity_id FROM f")
def entity_ids(spark, sf):
    return facts_of(spark, sf).select("entity_id").distinct()


@query("SELECT name, CAST(row_number() OVER (ORDER BY name) AS INTEGER) AS position FROM mg_slot_canonical")
def canonical_slot_list(spark, sf):
    """The canonical slots in order of their names; the registry is small and fixed."""
    return E.list_canonical_slots(read_table(spark, sf, "mg_slot_canonical")).select("name", "position")


@query(f"SELECT {Y.KEY.format('uuid')} AS uuid, len(coalesce(entity_mentions, [])) AS n_mentions, array_to_string(coalesce(entity_mentions, []), '|') AS mentions FROM mg_session")
def session_mentions(spark, sf):
    """What every session's mentions read after being stored as JSON."""
    stored = read_table(spark, sf, "mg_session").select(norm_key("uuid").alias("uuid"), F.to_json("entity_mentions").alias("entity_mentions"))
    read = F.coalesce(F.from_json("entity_mentions", "array<string>"), F.array().cast("array<string>"))
    return stored.select("uuid", F.size(read).cast("bigint").alias("n_mentions"), F.array_join(read, "|").alias("mentions"))


@query(f"SELECT external_id, uuid FROM mg_entity WHERE created_at >= TIMESTAMP '2023-02-16'")
def entities_inserted(spark, sf):
    """Which entities an insert of all adds to those there were before."""
    rows = read_table(spark, sf, "mg_entity").select("uuid", "external_id", "created_at")
    return S.insert_or_ignore(rows.filter("created_at < TIMESTAMP_NTZ '2023-02-16'"), rows.unionByName(rows), "external_id").select("external_id", "uuid")


@query(f"WITH {Y.FACTS} SELECT uuid, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM f WHERE embedding IS NOT NULL")
def vectors_stored(spark, sf):
    """Length and sum of every vector after being stored as bytes."""
    read = facts_of(spark, sf, "embedding").filter("embedding IS NOT NULL").select("uuid", decode_vector(encode_vector("embedding")).alias("v"))
    return read.select("uuid", F.size("v").cast("bigint").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query(f"WITH {Y.FACTS} SELECT uuid, CASE WHEN significance >= 10 THEN 10 WHEN significance >= 5 THEN 5 ELSE 1 END AS significance FROM f")
def labels_read(spark, sf):
    """The significance that each fact's label stands for."""
    return facts_of(spark, sf, "significance").select("uuid", significance_label("significance").alias("label")).select("uuid", significance_of("label").alias("significance"))


@query(f"WITH {Y.FACTS} SELECT entity_id, uuid, content, fact_type, CASE WHEN significance >= 10 THEN 'high' WHEN significance >= 5 THEN 'medium' ELSE 'low' END AS significance, tag, pinned, no AS rank_no FROM (SELECT *, CAST(row_number() OVER ({Y.NEWEST}) AS INTEGER) AS no FROM f WHERE fact_type IN ('identity', 'pattern')) WHERE no <= 100")
def memories_listed(spark, sf):
    """The newest 100 memories of every entity as a user sees them."""
    facts = facts_of(spark, sf, "created_at", "fact_type", "significance", "tag", "pinned", "content")
    return S.list_metadata(facts, 100, FactFilter(types=("identity", "pattern"))).select("entity_id", "uuid", "content", "fact_type", significance_label("significance").alias("significance"), "tag", "pinned", "rank_no")


_PATTERN = f"""WITH {Y.FACTS}, p AS (SELECT * FROM f WHERE fact_type = 'pattern' AND embedding IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY entity_id, tag ORDER BY created_at DESC, uuid) AS no FROM p),
  m AS (SELECT a.entity_id, a.uuid AS new_id, b.uuid AS old_id, row_number() OVER (PARTITION BY a.entity_id, a.uuid ORDER BY b.created_at DESC, b.uuid) AS k FROM n a JOIN p b ON a.entity_id = b.entity_id AND a.uuid <> b.uuid
    WHERE a.no = 1 AND round({Y.cosine("a.embedding", "b.embedding")}, 6) > 0.88) SELECT entity_id, new_id, old_id FROM m WHERE k = 1"""


def _new_patterns(spark, sf, least):
    facts = facts_of(spark, sf, "fact_type", "embedding", "tag", "created_at").filter("fact_type = 'pattern' AND embedding IS NOT NULL")
    newest = S.first_in_group(facts, ["entity_id", "tag"], [F.desc("created_at"), F.asc("uuid")], 1)
    return L.duplicate_patterns(newest, facts, least)


@query(_PATTERN)
def pattern_duplicates(spark, sf):
    """For the newest pattern of each entity and tag the newest other pattern that is as good as it; these tables have few or none."""
    return _new_patterns(spark, sf, L.PATTERN)


@query(_PATTERN.replace("> 0.88", "> 0.2"))
def patterns_alike(spark, sf):
    """The same for patterns that are a little alike."""
    return _new_patterns(spark, sf, 0.2)


_TURN_VECTORS = f"""t AS (SELECT * FROM (SELECT {Y.KEY.format("uuid")} AS uuid, {Y.KEY.format("conversation_id")} AS conversation_id, {Y.KEY.format("entity_id")} AS entity_id, start_turn, summary, summary_embedding AS vec, is_overview, created_at,
  row_number() OVER (PARTITION BY {Y.KEY.format("uuid")} ORDER BY created_at) AS copy_no FROM mg_turn_summary WHERE {Y.KEY.format("uuid")} IS NOT NULL AND {Y.KEY.format("conversation_id")} IS NOT NULL) WHERE copy_no = 1)"""


def _turn_artifacts(spark, sf):
    """Turn summaries as artifacts, as the tables have none."""
    turns = turns_of(spark, sf, "entity_id", "start_turn", "summary", "summary_embedding", "is_overview").withColumn("entity_id", norm_key("entity_id"))
    return turns.withColumnsRenamed({"summary": "description", "summary_embedding": "description_embedding"}).withColumn("superseded_by", F.lit(None).cast("string"))


_REPLACED = f"""WITH {_TURN_VECTORS} SELECT b.uuid, arg_max(a.uuid, (coalesce(a.start_turn, -1), a.uuid)) AS superseded_by FROM t a JOIN t b ON a.conversation_id = b.conversation_id AND a.uuid <> b.uuid
  WHERE a.is_overview AND NOT coalesce(b.is_overview, false) AND round({Y.cosine("a.vec", "b.vec")}, 6) > 0.8 GROUP BY 1"""


def _replaced(spark, sf, least):
    rows = _turn_artifacts(spark, sf)
    new = rows.filter("is_overview").withColumn("seq", F.struct(F.coalesce("start_turn", F.lit(-1)), "uuid"))
    return L.artifact_supersessions(new, rows.filter("NOT coalesce(is_overview, false)"), least)


@query(_REPLACED)
def artifacts_superseded(spark, sf):
    """Which turn summaries the overviews of their conversation are close enough to to replace; these tables have few or none."""
    return _replaced(spark, sf, L.ARTIFACT)


@query(_REPLACED.replace("> 0.8 ", "> 0.1 "))
def artifacts_alike(spark, sf):
    """The same for those a little alike."""
    return _replaced(spark, sf, 0.1)


@query(f"""WITH {Y.FACTS}, p AS (SELECT f.uuid, f.slot, n.name AS canonical, round({Y.cosine("f.embedding", "n.embedding")}, 6) AS cos FROM f JOIN mg_slot_canonical n ON len(f.embedding) = len(n.embedding))
  SELECT uuid, slot, canonical, cos FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY cos DESC, canonical) AS k FROM p WHERE cos >= 0.3) WHERE k = 1""")
def slots_matched(spark, sf):
    """The canonical slot closest to every fact, if it is at all close (fact vectors and slot vectors of these tables are not of one text)."""
    return E.canonical_slots(facts_of(spark, sf, "slot", "embedding"), read_table(spark, sf, "mg_slot_canonical"), 0.3)


@query(f"WITH {Y.MESSAGES}, {Y.TALKS} SELECT c.session_id AS uuid, count(*) AS message_count FROM m JOIN c ON c.uuid = m.conversation_id WHERE c.session_id IS NOT NULL GROUP BY 1")
def session_message_counts(spark, sf):
    """Messages of every session, counted per conversation first."""
    counts = messages_of(spark, sf).groupBy("conversation_id").agg(F.count(F.lit(1)).alias("_n"))
    talks = conversations_of(spark, sf).select(F.col("uuid").alias("conversation_id"), "session_id").filter("session_id IS NOT NULL")
    return counts.join(talks, "conversation_id").groupBy(F.col("session_id").alias("uuid")).agg(F.sum("_n").alias("message_count"))


@query(f"""WITH {Y.FACTS}, r AS (SELECT entity_id, tag, count(*) AS n_facts FROM f WHERE created_at > {Y.AS_OF} - INTERVAL 90 DAY GROUP BY 1, 2), t AS (SELECT *, sum(n_facts) OVER (PARTITION BY entity_id) AS n FROM r)
  SELECT entity_id, tag, n_facts, round(n_facts / n, 6) AS tag_share FROM t WHERE n > 10 AND round(n_facts / n, 6) > 0.25""")
def tag_insights(spark, sf):
    return E.tag_insights(facts_of(spark, sf, "tag", "created_at"), as_of())


@query(f"""WITH {Y.FACTS}, r AS (SELECT uuid, greatest(0, (epoch_us({Y.AS_OF}) - epoch_us(greatest(created_at, reinforced_at, last_recalled_at))) / 86400000000) AS idle, significance + 0.5::DOUBLE * reinforced_count + 2.0::DOUBLE * coalesce(emotional_weight, 0) AS strength FROM f)
  SELECT uuid, round(exp(-idle / strength), 6) AS retention FROM r WHERE strength > 0 AND idle IS NOT NULL""")
def retentions(spark, sf):
    """How much is left of every fact that has a strength."""
    facts = facts_of(spark, sf, "created_at", "reinforced_at", "last_recalled_at", "significance", "reinforced_count", "emotional_weight")
    return facts.select("uuid", F.round(E.retention(as_of()), 6).alias("retention"), (F.col("significance") + 0.5 * F.col("reinforced_count") + 2.0 * F.coalesce("emotional_weight", F.lit(0.0))).alias("_s")).filter("retention IS NOT NULL AND _s > 0").drop("_s")


_FOLDED = ("significance", "pinned", "expires_at", "temporal_status", "superseded_by", "thread_status", "emotional_weight", "emotional_valence", "engagement_score", "confidence", "reinforced_count", "reinforced_at", "recall_count", "last_recalled_at", "superseded_at")


@query(f"""WITH {Y.FACTS} SELECT uuid, CASE WHEN pinned OR slot = 'pet' THEN 10 WHEN tag = 'work' THEN 7 ELSE significance END AS significance, NOT pinned AND slot = 'pet' AS pinned,
  CASE WHEN pinned OR slot = 'pet' OR recall_count > 2 THEN NULL ELSE expires_at END AS expires_at, CASE WHEN superseded_by IS NOT NULL THEN 'historical' ELSE temporal_status END AS temporal_status, superseded_by,
  CASE WHEN thread_status = 'open' THEN 'resolved' ELSE thread_status END AS thread_status, CASE WHEN emotional_valence = 'grief' THEN 0.25 ELSE emotional_weight END AS emotional_weight,
  CASE WHEN emotional_valence = 'grief' THEN 'hope' ELSE emotional_valence END AS emotional_valence, CASE WHEN slot = 'diet' THEN 0.75 ELSE engagement_score END AS engagement_score,
  CASE WHEN tag = 'home' OR slot = 'diet' THEN 1.0 ELSE confidence END AS confidence, CAST(reinforced_count + CASE WHEN recall_count > 2 THEN recall_count ELSE 0 END + CASE WHEN tag = 'home' OR slot = 'diet' THEN 1 ELSE 0 END AS INTEGER) AS reinforced_count,
  CAST(recall_count + CASE WHEN confidence >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS recall_count FROM f WHERE fact_type <> 'event' OR significance > 2 OR pinned""")
def facts_folded(spark, sf):
    """Every fact after events of all kinds that its own state stands for: reinforced as often as it was recalled, recalled, judged, ended, resolved, felt, engaged, pinned, unpinned, confirmed, deleted."""
    facts = facts_of(spark, sf, *dict.fromkeys((*_FOLDED, "tag", "slot", "fact_type")))
    none = F.lit(None)
    at = as_of().cast("timestamp")

    def event(cond, seq, kind, number=none, text=none, note=none):
        values = (F.lit(seq).cast("bigint").alias("seq"), F.lit(kind).alias("kind"), at.alias("at"), number.cast("double").alias("number"), text.cast("string").alias("text"), note.cast("string").alias("note"))
        return F.when(cond, F.array(F.struct(*values))).otherwise(F.array())

    often = F.array_repeat(F.struct(F.lit(1).cast("bigint").alias("seq"), F.lit("reinforce").alias("kind"), at.alias("at"), none.cast("double").alias("number"), none.cast("string").alias("text"), none.cast("string").alias("note")), F.when(F.col("recall_count") > 2, F.col("recall_count")).otherwise(0))
    diet = F.col("slot") == "diet"
    kinds = F.concat(
        often, event(F.col("confidence") >= 0.5, 2, "recall"), event(F.col("tag") == "work", 3, "significance", number=F.lit(7.0)), event(F.col("superseded_by").isNotNull(), 4, "status", text=F.lit("historical"), note=F.col("superseded_by")),
        event(F.col("thread_status") == "open", 5, "thread", text=F.lit("resolved")), event(F.col("emotional_valence") == "grief", 6, "emotion", number=F.lit(0.25), text=F.lit("hope")), event(diet, 7, "engagement", number=F.lit(0.75)),
        event(F.col("pinned"), 8, "pin"), event(F.col("pinned"), 9, "unpin"), event(~F.col("pinned") & (F.col("slot") == "pet"), 9, "pin"), event((F.col("tag") == "home") | diet, 10, "confirm"),
        event((F.col("fact_type") == "event") & (F.col("significance") <= 2) & ~F.col("pinned"), 11, "delete"),
    )
    folded = L.fold(facts, facts.select("uuid", F.inline(kinds)))
    return folded.select("uuid", *[c for c in _FOLDED if c not in ("superseded_at", "reinforced_at", "last_recalled_at")])


_INGEST = f"""WITH {Y.FACTS}, k AS (SELECT *, {Y.content_key("content")} AS content_key FROM f), o AS (SELECT * FROM k WHERE created_at < TIMESTAMP '{SINCE}' OR created_at IS NULL),
  x AS (SELECT entity_id, content, content_key, fact_type, slot, embedding AS vec, epoch_us(created_at) AS came, uuid AS src FROM k WHERE created_at >= TIMESTAMP '{SINCE}'),
  i AS (SELECT *, row_number() OVER (PARTITION BY entity_id, content_key ORDER BY came, src) AS nth FROM x),
  old AS (SELECT entity_id, content_key, uuid AS old_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, content_key ORDER BY created_at DESC, uuid) AS no FROM o) WHERE no = 1),
  j AS (SELECT i.*, old_id FROM i LEFT JOIN old USING (entity_id, content_key)), fresh AS (SELECT * FROM j WHERE old_id IS NULL AND nth = 1),
  live AS (SELECT * FROM o WHERE temporal_status = 'current' AND {Y.ALIVE}),
  firsts AS (SELECT entity_id, slot, arg_min(src, (came, src)) AS src FROM fresh WHERE fact_type = 'identity' AND slot <> '' GROUP BY 1, 2),
  gone AS (SELECT live.entity_id, live.uuid AS target, firsts.src FROM live JOIN firsts USING (entity_id, slot) WHERE live.fact_type = 'identity'),
  near AS (SELECT a.src, b.uuid AS near_id, row_number() OVER (PARTITION BY a.src ORDER BY round({Y.cosine("a.vec", "b.embedding")}, 6) DESC, b.created_at DESC, b.uuid) AS no FROM fresh a JOIN live b ON a.entity_id = b.entity_id WHERE round({Y.cosine("a.vec", "b.embedding")}, 6) >= 0.92)
  SELECT j.entity_id, 'reinforce' AS action, coalesce(old_id, near_id, 'of this batch') AS target FROM j LEFT JOIN (SELECT entity_id, content_key, near_id FROM near JOIN fresh USING (src) WHERE no = 1) n USING (entity_id, content_key) WHERE old_id IS NOT NULL OR nth > 1 OR near_id IS NOT NULL
  UNION ALL SELECT j.entity_id, 'insert', NULL FROM j LEFT JOIN (SELECT src, near_id FROM near WHERE no = 1) n USING (src) WHERE old_id IS NULL AND nth = 1 AND near_id IS NULL
  UNION ALL SELECT entity_id, 'supersede', target FROM gone"""


@query(_INGEST)
def facts_ingested(spark, sf):
    """What extracting the facts from mid December on again would do to those before: which are reinforced, ended and how many are new."""
    facts = keyed_facts(spark, sf, "content", "created_at", "fact_type", "temporal_status", "significance", "slot", "embedding", "expires_at")
    old = facts.filter((F.col("created_at") < _since()) | F.col("created_at").isNull())
    seq = F.unix_micros(F.col("created_at").cast("timestamp"))
    new = facts.filter(F.col("created_at") >= _since()).select("entity_id", seq.alias("seq"), "content", "fact_type", "significance", "slot", F.col("embedding").alias("vec"))
    done = L.ingest(old, new, as_of())
    mine = F.when((F.col("action") == "reinforce") & (F.col("target") == F.col("uuid")), "of this batch").when(F.col("action") == "reinforce", F.col("target")).when(F.col("action") == "supersede", F.col("uuid"))
    return done.select("entity_id", "action", mine.alias("target"))


_TAGS, _VALENCES = Y.words(X.TAGS), Y.words(X.VALENCES)


@query(f"""WITH {Y.FACTS} SELECT uuid, {Y.strip("content")} AS content, CASE WHEN lower({Y.strip("fact_type")}) IN ('event', 'pattern') THEN lower({Y.strip("fact_type")}) ELSE 'identity' END AS fact_type,
  CASE WHEN significance BETWEEN 1 AND 10 THEN significance ELSE 5 END AS significance, CASE WHEN lower({Y.strip("tag")}) = '' OR list_contains({_TAGS}, lower({Y.strip("tag")})) THEN lower({Y.strip("tag")}) ELSE 'other' END AS tag,
  greatest(0, least(1, confidence)) AS confidence, CASE WHEN regexp_matches(reference_time, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND try_cast(reference_time AS DATE) IS NOT NULL THEN reference_time ELSE '' END AS reference_time,
  CASE WHEN emotional_weight IS NOT NULL THEN greatest(0, least(1, emotional_weight)) END AS emotional_weight, CASE WHEN list_contains({_VALENCES}, lower({Y.strip("emotional_valence")})) THEN lower({Y.strip("emotional_valence")}) END AS emotional_valence
  FROM f WHERE {Y.strip("content")} <> '' AND length({Y.strip("content")}) <= 1000""")
def answers_read(spark, sf):
    """Every fact written as a model's answer in a fence, read back and checked."""
    columns = ("content", "fact_type", "significance", "tag", "slot", "confidence", "reference_time", "emotional_weight", "emotional_valence", "verbatim", "started_at", "thread_status")
    facts = facts_of(spark, sf, *columns)
    answer = F.concat(F.lit("```json\n"), F.to_json(F.array(F.struct(*[F.col(c).alias("type" if c == "fact_type" else c) for c in columns]))), F.lit("\n```"))
    read = facts.select("uuid", F.explode(M.parse_list(answer)).alias("f")).select("uuid", "f.*")
    return M.validated(read, as_of().cast("timestamp")).select("uuid", "content", "fact_type", "significance", "tag", "confidence", "reference_time", "emotional_weight", "emotional_valence")


@query(f"""WITH s AS (SELECT {Y.KEY.format("uuid")} AS uuid, coalesce(entity_mentions, []) AS a FROM mg_session), b AS (SELECT *, list_concat(a[2:], ['then', 'now']) AS b FROM s),
  k AS (SELECT *, coalesce(list_max(list_filter(range(1, least(len(a), len(b)) + 1), lambda k: a[len(a) - k + 1:] = b[1:k])), 0) AS k FROM b)
  SELECT uuid, k AS overlap, array_to_string(list_concat(a, b[k + 1:]), '|') AS merged FROM k""")
def histories_merged(spark, sf):
    """Each session's mentions merged with a later list that repeats all but the first."""
    lists = read_table(spark, sf, "mg_session").select(norm_key("uuid").alias("uuid"), F.coalesce("entity_mentions", F.array().cast("array<string>")).alias("a"))
    later = F.concat(F.slice("a", 2, F.greatest(F.size("a"), F.lit(1))), F.array(F.lit("then"), F.lit("now")))
    rows = lists.withColumn("b", later)
    return rows.select("uuid", T.overlap(F.col("a"), F.col("b")).cast("bigint").alias("overlap"), F.array_join(T.merge_history(F.col("a"), F.col("b")), "|").alias("merged"))


@query(f"WITH {Y.MESSAGES} SELECT conversation_id, md5(arg_max(content, (created_at, uuid))) AS digest FROM m WHERE role = 'user' AND coalesce(content, '') <> '' GROUP BY 1")
def last_user_messages(spark, sf):
    rows = messages_of(spark, sf, "role", "content").withColumn("position", F.struct("created_at", "uuid"))
    return M.last_user_message(rows).select("conversation_id", F.md5("content").alias("digest"))


@query(f"WITH {Y.MESSAGES} SELECT conversation_id, count(*) FILTER (role IN ('user', 'assistant') AND coalesce(content, '') <> '') + 1 AS n_messages FROM m GROUP BY 1")
def exchanges(spark, sf):
    """How long every conversation is with a reply added."""
    rows = messages_of(spark, sf, "role", "content").withColumn("position", F.unix_micros(F.col("created_at").cast("timestamp")))
    answers = rows.select("conversation_id").distinct().withColumn("content", F.lit("ok"))
    return M.exchange(rows, answers).groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n_messages"))


@query(f"WITH {Y.MESSAGES}, n AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, uuid) AS no FROM m) SELECT uuid, md5(CASE WHEN no = 1 THEN 'Topic: ' || conversation_id || chr(10) ELSE '' END || content) AS digest FROM n WHERE content IS NOT NULL")
def segments_prefixed(spark, sf):
    """Every message, the first of a conversation with its topic before it."""
    order = ["created_at", "uuid"]
    ranked = T.with_rank(T.range_chunks(messages_of(spark, sf, "content"), ["conversation_id"], order), ["conversation_id"], order, "position")
    rows = ranked.filter("content IS NOT NULL").withColumns({"topic": F.col("conversation_id"), "classification": F.lit("")})
    return M.segment_prefix(rows).select("uuid", F.md5("content").alias("digest"))


@query(f"""WITH {Y.FACTS}, {Y.CONSCIOUS} SELECT k.entity_id, md5('[Memory Context]' || chr(10) || 'The following are relevant memories about this user:' || chr(10) || string_agg('- ' || f.content, chr(10) ORDER BY k.rank_no) || chr(10) || '[End Memory Context]') AS digest
  FROM k JOIN f USING (uuid) WHERE k.rank_no <= 10 GROUP BY 1""")
def memory_blocks(spark, sf):
    """The facts kept in mind of every entity as the text before a request."""
    facts = facts_of(spark, sf, *CONSCIOUS, "content")
    mind = Q.conscious(facts, as_of()).withColumnRenamed("rank_no", "position").join(facts.select("uuid", "content"), "uuid")
    return M.memory_block(mind, "entity_id").select("entity_id", F.md5("block").alias("digest"))


@query(f"WITH {Y.FACTS}, u AS (SELECT entity_id, count(*) * 40 AS used FROM f GROUP BY 1) SELECT entity_id, CAST(greatest(4, least(20, floor(greatest(4000 - used, 800) / 200))) AS INTEGER) AS turns FROM u")
def working_windows(spark, sf):
    """How many turns fit beside 40 tokens of every fact of an entity."""
    used = facts_of(spark, sf).groupBy("entity_id").agg((F.count(F.lit(1)) * 40).alias("used"))
    return used.select("entity_id", C.window_turns(F.lit(4000), F.col("used"), 20).alias("turns"))


@query(f"""WITH {Y.FACTS}, n AS (SELECT *, row_number() OVER ({Y.NEWEST}) AS no FROM f), t AS (SELECT *, count(*) OVER (PARTITION BY entity_id) AS n, row_number() OVER (PARTITION BY entity_id, tag ORDER BY no) AS nth FROM n WHERE no <= 20)
  SELECT entity_id, uuid FROM t WHERE nth <= greatest(1, ceil(n * 0.4::DOUBLE))""")
def tags_capped(spark, sf):
    """Of the newest 20 facts of every entity at most 40 % of one tag."""
    rows = S.list_facts(facts_of(spark, sf, "tag", "created_at"), 20).withColumnRenamed("rank_no", "position")
    return C.tag_cap(rows, "entity_id").select("entity_id", "uuid")


_AGO = lambda n, unit: f"{n} || ' {unit}' || CASE WHEN {n} = 1 THEN '' ELSE 's' END || ' ago'"


@query(f"""WITH {Y.FACTS}, d AS (SELECT uuid, created_at, CAST(floor((epoch_ms({Y.AS_OF}) - epoch_ms(created_at)) / 86400000) AS BIGINT) AS d FROM f)
  SELECT uuid, CASE WHEN created_at IS NULL THEN 'unknown time ago' WHEN created_at > {Y.AS_OF} THEN 'just now' WHEN d < 1 THEN 'today' WHEN d < 7 THEN {_AGO("d", "day")} WHEN d // 7 < 5 THEN {_AGO("(d // 7)", "week")} ELSE {_AGO("(d // 30)", "month")} END AS said FROM d""")
def relative_dates(spark, sf):
    return facts_of(spark, sf, "created_at").select("uuid", X.relative_date(F.col("created_at").cast("timestamp"), as_of().cast("timestamp")).alias("said"))


@query(f"WITH {Y.FACTS} SELECT uuid, significance > 5 AS judged FROM f")
def judgements_read(spark, sf):
    """Whether a judge's answer says correct."""
    said = F.concat(F.lit(" \n"), F.when(F.col("significance") > 5, "Correct. ").otherwise("Incorrect: not correct"))
    return facts_of(spark, sf, "significance").select("uuid", M.judged(said).alias("judged"))


@query(f"""WITH {Y.TALKS}, n AS (SELECT entity_id, session_id, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, uuid) AS no FROM c WHERE entity_id IS NOT NULL AND session_id IS NOT NULL)
  SELECT entity_id, uuid FROM (SELECT c.*, row_number() OVER (PARTITION BY c.entity_id ORDER BY created_at DESC, uuid) AS no FROM c LEFT JOIN n ON n.entity_id = c.entity_id AND n.session_id = c.session_id AND n.no = 1
  WHERE c.entity_id IS NOT NULL AND coalesce(summary, '') = '' AND n.no IS NULL) WHERE no = 1""")
def unsummarized_elsewhere(spark, sf):
    """The newest conversation without summary of every entity outside the session of its newest conversation."""
    talks = conversations_of(spark, sf)
    current = S.first_in_group(talks.filter("entity_id IS NOT NULL AND session_id IS NOT NULL"), "entity_id", [F.desc("created_at"), F.asc("uuid")], 1)
    return S.unsummarized(talks, current.select("entity_id", "session_id")).select("entity_id", "uuid")


@query(f"""WITH {Y.FACTS}, p AS (SELECT *, row_number() OVER ({Y.NEWEST}) AS no FROM f WHERE fact_type = 'event' AND temporal_status = 'current' AND {Y.ALIVE} AND reference_time <= '2024-01-02' AND significance <= 5)
  SELECT entity_id, CASE WHEN tag = '' THEN '_untagged' ELSE tag END AS tag, uuid FROM p WHERE no <= 500""")
def consolidation_events(spark, sf):
    """The old minor events that patterns are sought among, by the limits in use."""
    return L.old_events(facts_of(spark, sf, *EVENTS), as_of()).select("entity_id", "tag", "uuid")


@query(f"""WITH {Y.FACTS}, p AS (SELECT *, row_number() OVER ({Y.NEWEST}) AS no FROM f WHERE fact_type = 'event' AND temporal_status = 'current' AND {Y.ALIVE} AND reference_time <= '2024-01-02' AND significance <= 5)
  SELECT entity_id, CASE WHEN tag = '' THEN '_untagged' ELSE tag END AS tag, count(*) AS n_facts, md5('- ' || string_agg(content, chr(10) || '- ' ORDER BY content)) AS digest FROM p WHERE no <= 500 GROUP BY 1, 2 HAVING count(*) >= 3""")
def consolidation_due(spark, sf):
    """Groups of three or more such events."""
    return L.consolidation_groups(facts_of(spark, sf, *EVENTS), as_of()).select("entity_id", "tag", "n_facts", F.md5("lines").alias("digest"))


def _ranked_over(cte: str, limit: int) -> str:
    """The SQL of hybrid ranking with other candidates in place of facts."""
    return Y._rank(limit).replace(Y.FACTS + ", ", "").replace(Y._SCORES, cte + ", " + Y._SCORES)


_PLAIN = "'current' AS temporal_status, NULL::TIMESTAMP AS expires_at, 1.0::DOUBLE AS confidence, NULL::DOUBLE AS emotional_weight, false AS pinned, NULL AS thread_status, 0.0::DOUBLE AS engagement_score, '' AS tag"

SQL["summary_recall"] = f"WITH {_ranked_over(f'f AS (SELECT uuid, entity_id, summary AS content, vec AS embedding, model AS embedding_model, created_at, 0 AS significance, {_PLAIN} FROM s WHERE no <= 100)', 5)} SELECT query_id, id, rank_no, score FROM top"


@query(f"WITH {_TURN_VECTORS}, {_ranked_over(f'''f AS (SELECT uuid, entity_id, summary AS content, CASE WHEN len(t.vec) > 0 THEN t.vec END AS embedding, '' AS embedding_model, created_at, 5 AS significance, {_PLAIN} FROM t WHERE entity_id IS NOT NULL)''', 5)} SELECT query_id, id, rank_no, score FROM top")
def artifact_recall(spark, sf):
    """The best 5 artifacts (turn summaries) of every entity for its newest question, by their descriptions."""
    rows = _turn_artifacts(spark, sf).filter("entity_id IS NOT NULL")
    return Q.recall_artifacts(rows, Q.newest_questions(conversations_of(spark, sf)), R.RankOptions(limit=5)).select("query_id", "id", "rank_no", "score")
