"""Queries for the memory store's own operators, over the whole tables. All times are relative to AS_OF."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemosa.functions import text as X
from mnemosa.functions.filters import FactFilter, significance_label
from mnemosa.functions.keys import first_per_key, norm_key
from mnemosa.functions.vectors import cosine
from mnemosa.operators import artifacts as A
from mnemosa.operators import context as C
from mnemosa.operators import evaluate as E
from mnemosa.operators import lifecycle as L
from mnemosa.operators import proactive as P
from mnemosa.operators import rank as R
from mnemosa.operators import recall as Q
from mnemosa.operators import scans as S
from mnemosa.operators import sessions as T
from mnemosa.schema import current_facts, vector_presence
from mnemosa.sources.tables import read_table

QUERIES: dict = {}


def as_of():
    """The present of all queries."""
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


def query(f):
    QUERIES[f.__name__] = f
    return f


#: What the choice of facts always kept in mind needs.
CONSCIOUS = ("temporal_status", "expires_at", "created_at", "reinforced_at", "last_recalled_at", "fact_type", "significance")
#: What triggers need.
TRIGGERS = ("content", "significance", "created_at", "thread_status", "emotional_valence", "emotional_weight", "expires_at", "last_recalled_at", "temporal_status", "engagement_score", "tag", "slot")
#: What the search for patterns among events needs.
EVENTS = ("content", "fact_type", "temporal_status", "expires_at", "reference_time", "significance", "created_at", "tag")
#: What ranking needs of a fact.
RANKED = (*[c for c in R.CANDIDATE if c != "id"], "embedding", "embedding_model", "expires_at")


def facts_of(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The state of every fact, with uuid, entity_id and `columns`; nothing else is read but updated_at."""
    return current_facts(read_table(spark, sf, "mg_entity_fact"), columns)


def conversations_of(spark: SparkSession, sf: str) -> DataFrame:
    df = read_table(spark, sf, "mg_conversation")
    vec = F.when(F.size("summary_embedding") > 0, F.col("summary_embedding"))
    return df.withColumns({"uuid": norm_key("uuid"), "session_id": norm_key("session_id"), "entity_id": norm_key("entity_id"), "summary_embedding": vec})


def _records(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Each record once, the first by created_at, with uuid, conversation_id, created_at and `columns`."""
    there = " AND ".join(f"{c} IS NOT NULL" for c in ("uuid", "conversation_id"))
    keyed = df.filter(there).select(norm_key("uuid").alias("uuid"), norm_key("conversation_id").alias("conversation_id"), "created_at", *[norm_key(c).alias(c) if c == "role" else c for c in columns])
    return first_per_key(keyed.filter(there), ["uuid"], [F.asc("created_at")])


def messages_of(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return _records(read_table(spark, sf, "mg_message").filter("created_at IS NOT NULL"), columns)


def turns_of(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return _records(read_table(spark, sf, "mg_turn_summary"), columns)


def keyed_facts(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """facts_of with the content's key, made at the scan so that contents needn't travel."""
    made = read_table(spark, sf, "mg_entity_fact").withColumn("content_key", X.content_key(F.coalesce("content", F.lit(""))))
    return current_facts(made, ["content_key", *columns])


@query
def facts_newest(spark, sf):
    """The newest 100 facts of every entity."""
    return S.list_metadata(facts_of(spark, sf, "created_at"), 100).select("entity_id", "uuid", "rank_no")


@query
def facts_filtered(spark, sf):
    """Facts that meet most of the optional predicates."""
    where = FactFilter(types=("identity", "event"), statuses=("current",), tags=("work", "preference", "personal", "location"), min_significance=3, max_significance=9, min_confidence=0.2, exclude_expired=True, pinned=False)
    columns = ("fact_type", "temporal_status", "tag", "significance", "confidence", "expires_at", "pinned", "created_at")
    return S.list_facts(facts_of(spark, sf, *columns), 0, where, as_of()).select("entity_id", "uuid", "fact_type", "tag", "significance")


@query
def facts_in_lists(spark, sf):
    """Facts by slot, type, thread, feeling and reference date."""
    a = FactFilter(thread_statuses=("open", "resolved"), valences=("grief", "joy", "anxiety", "hope", "love", "anger", "fear"), reference_after="2023-08-01", reference_before="2023-12-31")
    b = FactFilter(slots=("diet", "pet", "housing", "employer"), types=("identity", "event", "pattern"))
    facts = facts_of(spark, sf, "slot", "thread_status", "emotional_valence", "reference_time", "fact_type")
    return facts.filter(a.condition(as_of()) | b.condition(as_of())).select("entity_id", "uuid", "slot", "thread_status", "emotional_valence", "reference_time")


@query
def unembedded(spark, sf):
    """The newest 50 facts without a vector of every entity."""
    facts = current_facts(vector_presence(read_table(spark, sf, "mg_entity_fact")), ["created_at", "embedding"])
    return S.list_facts(facts, 50, FactFilter(unembedded_only=True)).select("entity_id", "uuid", "rank_no")


@query
def open_threads_topk(spark, sf):
    return S.open_threads(facts_of(spark, sf, "thread_status", "significance", "created_at")).select("entity_id", "uuid", "rank_no", "significance")


@query
def fact_by_key(spark, sf):
    """Of facts that say the same about an entity, the newest."""
    facts = keyed_facts(spark, sf, "created_at")
    return S.find_by_key(facts, facts).select("entity_id", "content_key", "uuid")


@query
def entity_stats(spark, sf):
    return S.entity_stats(facts_of(spark, sf, "created_at"))


@query
def fact_labels(spark, sf):
    """The significance of every fact in words."""
    return facts_of(spark, sf, "significance").select("uuid", significance_label("significance").alias("label"))


@query
def recent_messages(spark, sf):
    """The last 10 messages of every conversation, oldest first."""
    return S.recent_messages(messages_of(spark, sf), 10).select("conversation_id", "uuid", "position")


@query
def summaries_newest(spark, sf):
    return S.summaries(conversations_of(spark, sf), 100).select("entity_id", "uuid", "rank_no")


@query
def unsummarized(spark, sf):
    return S.unsummarized(conversations_of(spark, sf)).select("entity_id", "uuid")


@query
def active_conversations(spark, sf):
    return S.active_conversations(conversations_of(spark, sf)).select("session_id", "uuid")


@query
def turn_summaries(spark, sf):
    turns = turns_of(spark, sf, "start_turn", "end_turn", "is_overview")
    return S.turn_summaries_in_order(turns).join(S.turn_summary_stats(turns), "conversation_id", "left").select("conversation_id", "uuid", "position", "n_ranges", "highest_end")


@query
def content_keys(spark, sf):
    """The content key and token estimate of every document."""
    docs = read_table(spark, sf, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", X.content_key("text").alias("content_key"), X.estimate_tokens("text").alias("tokens"))


@query
def dedup_texts(spark, sf):
    return facts_of(spark, sf, "content").select("uuid", X.dedup_text("content").alias("norm"))


@query
def trivial_conversations(spark, sf):
    return T.trivial_conversations(messages_of(spark, sf, "content"))


@query
def transcripts(spark, sf):
    """Every conversation's transcript by pieces of 64 messages, as hashes with their lengths."""
    t = T.transcripts(T.normalize_messages(messages_of(spark, sf, "role", "content")))
    return t.select("conversation_id", "piece_no", "n_messages", F.length("transcript").cast("bigint").alias("n_chars"), F.md5("transcript").alias("digest"))


@query
def entity_mentions(spark, sf):
    return A.entity_mentions(facts_of(spark, sf, "content", "created_at"))


@query
def query_entities(spark, sf):
    """Entities and dates that every summary names as a question would."""
    rows = conversations_of(spark, sf).filter("summary IS NOT NULL")
    return rows.select("uuid", F.array_join(X.query_entities("summary"), "|").alias("entities"), X.temporal_intent("summary").alias("intent"))


@query
def artifacts_found(spark, sf):
    return A.detect_artifacts(messages_of(spark, sf, "role", "content")).select("conversation_id", "position", "artifact_type", F.md5("content").alias("digest"))


@query
def cosine_best(spark, sf):
    """Cosine of every fact with its entity's newest question, where they compare."""
    questions = Q.newest_questions(conversations_of(spark, sf))
    rows = facts_of(spark, sf, "embedding").select("entity_id", "uuid", "embedding").join(questions.select("entity_id", "query_vec"), "entity_id")
    return rows.select("entity_id", "uuid", F.round(cosine("embedding", "query_vec"), 6).alias("cos"))


@query
def bm25_scores(spark, sf):
    """Lexical scores of every unexpired fact for its entity's newest question."""
    questions = R.with_query_parts(Q.newest_questions(conversations_of(spark, sf)))
    facts = Q.fact_candidates(facts_of(spark, sf, "content", "expires_at"), as_of()).select("entity_id", "id", "content")
    return R.bm25(facts.join(questions.select("query_id", "entity_id", "_terms"), "entity_id")).filter("lexical > 0").select("query_id", "id", "lexical")


@query
def rank_full(spark, sf):
    """Hybrid recall of every entity's facts for its newest question."""
    found = Q.recall_facts(facts_of(spark, sf, *RANKED), Q.newest_questions(conversations_of(spark, sf)), as_of(), R.RankOptions(limit=50))
    return found.select("query_id", "id", "rank_no", "score")


@query
def rank_diversified(spark, sf):
    found = Q.recall_facts(facts_of(spark, sf, *RANKED), Q.newest_questions(conversations_of(spark, sf)), as_of(), R.RankOptions(limit=20, diversify=True))
    return found.select("query_id", "id", "rank_no", "score", "tag")


@query
def kneedle_cut(spark, sf):
    found = Q.recall_facts(facts_of(spark, sf, *RANKED), Q.newest_questions(conversations_of(spark, sf)), as_of(), R.RankOptions(limit=50))
    return R.kneedle(found).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_kept"))


@query
def summary_recall(spark, sf):
    """The best 5 summaries of every entity for its newest one."""
    talks = conversations_of(spark, sf)
    return Q.recall_summaries(talks, Q.newest_questions(talks), R.RankOptions(limit=5)).select("query_id", "id", "rank_no", "score")


@query
def conscious_topk(spark, sf):
    return Q.conscious(facts_of(spark, sf, *CONSCIOUS), as_of())


@query
def proactive_threads(spark, sf):
    return P.thread_triggers(facts_of(spark, sf, "content", "significance", "created_at", "thread_status"), as_of()).drop("position")


@query
def proactive_feelings(spark, sf):
    return P.feeling_triggers(facts_of(spark, sf, "content", "created_at", "emotional_valence", "emotional_weight", "expires_at"), as_of()).drop("position")


@query
def proactive_milestones(spark, sf):
    return P.milestone_triggers(facts_of(spark, sf, "created_at"), as_of()).drop("position")


@query
def proactive_nostalgia(spark, sf):
    return P.nostalgia_triggers(facts_of(spark, sf, "content", "significance", "created_at", "expires_at", "temporal_status", "last_recalled_at", "engagement_score"), as_of()).drop("position")


@query
def proactive_predictions(spark, sf):
    """Follow-ups of study goals, as the tables have no slot for predictions."""
    return P.prediction_triggers(facts_of(spark, sf, "content", "created_at", "tag", "slot", "expires_at", "thread_status"), as_of(), "study_goal").drop("position")


@query
def proactive_union(spark, sf):
    return P.proactive(facts_of(spark, sf, *TRIGGERS), as_of()).select("entity_id", "rank_no", "kind", "uuid", "priority")


@query
def ttl_assigned(spark, sf):
    return facts_of(spark, sf, "significance", "created_at").select("uuid", L.expiry("significance", F.col("created_at")).alias("expires_at"))


@query
def expired_split(spark, sf):
    return L.split_expired(facts_of(spark, sf, "expires_at"), as_of()).groupBy("entity_id", "expired").agg(F.count(F.lit(1)).alias("n_facts"))


@query
def stale_summaries(spark, sf):
    pruned = L.prune_summaries(conversations_of(spark, sf), as_of())
    return pruned.groupBy("entity_id").agg(F.count(F.when(F.coalesce("summary", F.lit("")) != "", 1)).alias("n_summaries"), F.count("summary_embedding").alias("n_vectors"))


@query
def memories_added(spark, sf):
    """What adding every fact's verbatim as a memory of its entity does."""
    facts = keyed_facts(spark, sf, "created_at", "verbatim", "significance")
    incoming = facts.filter("verbatim <> ''").select("entity_id", F.col("uuid").alias("seq"), F.col("verbatim").alias("content"), "significance")
    return L.add_memories(facts, incoming, as_of()).select("entity_id", "content_key", "action", "significance", "expires_at", "mentions")


@query
def reinforced(spark, sf):
    """Facts after each was mentioned once more for every message role, with promotion."""
    facts = facts_of(spark, sf, "significance", "reinforced_count", "reinforced_at", "expires_at", "recall_count").select("uuid", "significance", "reinforced_count", "reinforced_at", "expires_at", "recall_count")
    mentions = facts.filter("recall_count > 0").select("uuid", F.explode(F.sequence(F.lit(1), F.least("recall_count", F.lit(3)))).alias("seq"), (F.col("significance") - 1).alias("significance"))
    return L.reinforce(facts, mentions, as_of()).select("uuid", "significance", "reinforced_count", "expires_at")


@query
def recall_usage(spark, sf):
    """Recalls per customer of events taken as recall events."""
    return L.recall_usage(read_table(spark, sf, "events").select(F.col("user_id").alias("uuid"), F.col("ts").alias("at")))


@query
def slot_supersede(spark, sf):
    """Which current identity facts each slot's newest one replaces."""
    facts = facts_of(spark, sf, "fact_type", "slot", "temporal_status", "created_at")
    newest = S.first_in_group(facts.filter("fact_type = 'identity' AND slot <> ''"), ["entity_id", "slot"], [F.desc("created_at"), F.asc("uuid")], 1)
    return L.slot_conflicts(facts, newest.select("entity_id", "slot", "uuid", F.col("rank_no").alias("seq")))


@query
def semantic_dedup(spark, sf):
    """The fact closest to each slot's newest one, among all of its entity, if it is at all alike."""
    facts = facts_of(spark, sf, "embedding", "embedding_model", "slot", "created_at").filter("embedding IS NOT NULL AND embedding_model <> ''")
    newest = S.first_in_group(facts.filter("slot <> ''"), ["entity_id", "slot"], [F.desc("created_at"), F.asc("uuid")], 1)
    new = newest.select("entity_id", F.col("uuid").alias("new_id"), F.col("embedding").alias("vec"))
    return Q.best_match(new, facts.select("entity_id", F.col("uuid").alias("old_id"), F.col("embedding").alias("vec"), "created_at"), 0.4)


@query
def semantic_duplicates(spark, sf):
    """Every fact's closest other fact of its entity, where they are as good as one."""
    facts = facts_of(spark, sf, "embedding", "embedding_model", "created_at").filter("embedding IS NOT NULL AND embedding_model <> ''")
    return Q.best_match_within(facts.select("entity_id", "uuid", F.col("embedding").alias("vec"), "created_at"), L.SEMANTIC)


@query
def consolidation_groups(spark, sf):
    groups = L.consolidation_groups(facts_of(spark, sf, *EVENTS), as_of(), min_group=2, max_significance=10)
    return groups.select("entity_id", "tag", "n_facts", F.md5("lines").alias("digest"))


@query
def sessions_30m(spark, sf):
    return T.sessionize(read_table(spark, sf, "events"), "user_id", "ts")


@query
def turn_ranges(spark, sf):
    return T.turn_ranges(messages_of(spark, sf), turns_of(spark, sf, "end_turn", "is_overview"))


@query
def overview_merges(spark, sf):
    return T.overview_merges(turns_of(spark, sf, "start_turn", "end_turn", "is_overview", "summary"), most=2).select("conversation_id", "end_turn", "n_inputs")


@query
def ingest_chunks(spark, sf):
    return T.chunks_of_turns(messages_of(spark, sf))


#: What a context says of facts and chooses them by.
SAID = tuple(dict.fromkeys((*CONSCIOUS, *TRIGGERS, *RANKED, "verbatim", "started_at")))


def _context_inputs(spark, sf):
    """Every entity's facts kept in mind, and what its newest question recalls of facts and of past conversations."""
    facts, talks = facts_of(spark, sf, *SAID), conversations_of(spark, sf)
    text = facts.select("uuid", "content", "temporal_status", "reference_time", "tag", "confidence", "verbatim")
    profile = Q.conscious(facts, as_of()).join(text, "uuid").withColumnRenamed("rank_no", "position")
    questions = Q.newest_questions(talks)
    found = Q.recall_facts(facts, questions, as_of(), R.RankOptions(limit=30)).select("entity_id", F.col("id").alias("uuid"), F.col("rank_no").alias("position"))
    recalled = found.join(text, "uuid")
    said = Q.recall_summaries(talks, questions, R.RankOptions(limit=10)).select("entity_id", F.col("id").alias("uuid"), F.col("rank_no").alias("position"))
    past = said.join(talks.select("uuid", F.col("summary").alias("content"), "created_at"), "uuid")
    return facts, profile, recalled, past


@query
def context_flat(spark, sf):
    """Every entity's context lines for its newest question within 400 tokens, 150 of them for summaries."""
    _, profile, recalled, past = _context_inputs(spark, sf)
    return C.flat_context("entity_id", profile.select("entity_id", "position", "content"), recalled, past, budget=C.Budget(400, 150))


@query
def context_identity(spark, sf):
    """Every entity's identity lines within 120 tokens."""
    facts = facts_of(spark, sf, *CONSCIOUS, "content", "tag", "confidence", "verbatim")
    profile = Q.conscious(facts, as_of()).join(facts.select("uuid", "content", "tag", "confidence", "verbatim"), "uuid").withColumnRenamed("rank_no", "position")
    return C.identity_section(profile, "entity_id", 120).select("entity_id", "line_no", "tag", F.md5("line").alias("digest"))


@query
def context_tiers(spark, sf):
    """Every entity's tiered context for its newest question within 300 tokens, 60 of them for past conversations."""
    facts, profile, recalled, past = _context_inputs(spark, sf)
    now = as_of().cast("timestamp")
    pick = lambda df: df.select("entity_id", F.col("rank_no").alias("position"), "content", "confidence", "verbatim", "tag", "started_at", "created_at")
    raised = P.proactive(facts, as_of(), gated=False).select("entity_id", F.col("rank_no").alias("position"), F.concat(F.lit("- ["), "kind", F.lit("] "), "content").alias("line"))
    sections = {
        "identity": C.identity_lines(profile, "entity_id"),
        "emotional": C.emotional_lines(pick(S.list_facts(facts, 10, FactFilter(valences=C.FELT, exclude_expired=True), as_of())), "entity_id", now),
        "threads": C.thread_lines(pick(S.open_threads(facts, 10)), "entity_id", now),
        "verified": C.recalled_lines(recalled, "entity_id", True),
        "inferred": C.recalled_lines(recalled, "entity_id", False),
        "proactive": raised,
        "past": C.past_lines(past, "entity_id", now),
    }
    made = C.tiered_context(sections, "entity_id", C.Budget(300, 60), 8)
    return made.select("entity_id", "total_tokens", *[F.length(t).alias(t) for t in ("semantic", "emotional", "episodic", "proactive", "past")], F.md5("formatted").alias("digest"))


@query
def answers_scored(spark, sf):
    """Verbatims scored as answers to their facts' contents."""
    return E.score_answers(_answers(spark, sf)).select("question_id", "f1", "exact_match", "refusal", "n_keywords", "context_coverage", "answer_coverage", "retrieval_miss", "format_mismatch")


@query
def category_scores(spark, sf):
    return E.category_scores(E.score_answers(_answers(spark, sf)))


@query
def diagnostics_summary(spark, sf):
    return E.diagnostics_summary(E.score_answers(_answers(spark, sf)))


def _answers(spark, sf):
    facts = facts_of(spark, sf, "significance", "verbatim", "content", "tag", "slot").filter("verbatim <> ''")
    return facts.select(F.col("uuid").alias("question_id"), (F.col("significance") % 5 + 1).alias("category"), F.col("verbatim").alias("predicted"), F.col("content").alias("truth"), F.concat_ws(" ", "tag", "slot", "verbatim").alias("context"), (F.col("significance") % 5 == 4).alias("adversarial"))


from mnemosa.plans.memory_sql import SQL  # noqa: E402, F401
