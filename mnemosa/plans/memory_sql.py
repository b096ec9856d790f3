"""The memory store's queries in SQL, for comparison in DuckDB."""

from __future__ import annotations

from mnemosa.functions import text as X

KEY = "nullif(lower(trim({}, ' ' || chr(9) || chr(10) || chr(13))), '')"
AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"
WS = "[\\s\\x0b\\p{Z}]"


def words(items) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in items) + "]"


FACTS = f"""f AS (SELECT {KEY.format("uuid")} AS uuid, {KEY.format("entity_id")} AS entity_id, coalesce(content, '') AS content, CASE WHEN len(embedding) > 0 THEN embedding END AS embedding,
  created_at, updated_at, coalesce(fact_type, 'identity') AS fact_type, coalesce({KEY.format("temporal_status")}, 'current') AS temporal_status, coalesce(significance, 5) AS significance,
  reference_time, expires_at, reinforced_at, coalesce(reinforced_count, 0) AS reinforced_count, coalesce(tag, '') AS tag, coalesce(slot, '') AS slot, coalesce(confidence, 1.0) AS confidence,
  coalesce(embedding_model, '') AS embedding_model, coalesce(recall_count, 0) AS recall_count, last_recalled_at, emotional_weight, emotional_valence, verbatim, thread_status, engagement_score, coalesce(pinned, false) AS pinned,
  coalesce(source_role, '') AS source_role, started_at, superseded_at, superseded_by
  FROM (SELECT *, row_number() OVER (PARTITION BY {KEY.format("uuid")} ORDER BY updated_at DESC) AS state_no FROM mg_entity_fact)
  WHERE state_no = 1 AND {KEY.format("entity_id")} IS NOT NULL)"""
TALKS = f"""c AS (SELECT {KEY.format("uuid")} AS uuid, {KEY.format("session_id")} AS session_id, {KEY.format("entity_id")} AS entity_id, summary,
  CASE WHEN len(summary_embedding) > 0 THEN summary_embedding END AS vec, coalesce(summary_embedding_model, '') AS model, created_at FROM mg_conversation)"""
MESSAGES = f"""m AS (SELECT * FROM (SELECT {KEY.format("uuid")} AS uuid, {KEY.format("conversation_id")} AS conversation_id, {KEY.format("role")} AS role, content, created_at,
  row_number() OVER (PARTITION BY {KEY.format("uuid")} ORDER BY created_at) AS copy_no FROM mg_message
  WHERE {KEY.format("uuid")} IS NOT NULL AND {KEY.format("conversation_id")} IS NOT NULL AND created_at IS NOT NULL) WHERE copy_no = 1)"""
TURNS = f"""t AS (SELECT * FROM (SELECT {KEY.format("uuid")} AS uuid, {KEY.format("conversation_id")} AS conversation_id, start_turn, end_turn, summary, is_overview, created_at,
  row_number() OVER (PARTITION BY {KEY.format("uuid")} ORDER BY created_at) AS copy_no FROM mg_turn_summary WHERE {KEY.format("uuid")} IS NOT NULL AND {KEY.format("conversation_id")} IS NOT NULL) WHERE copy_no = 1)"""
NEWEST = "PARTITION BY entity_id ORDER BY created_at DESC, uuid"
QUESTIONS = f"""s AS (SELECT *, row_number() OVER ({NEWEST}) AS no FROM c WHERE entity_id IS NOT NULL AND coalesce(summary, '') <> '' AND vec IS NOT NULL),
q AS (SELECT entity_id, entity_id AS query_id, summary AS query, vec AS query_vec, model AS query_model FROM s WHERE no = 1)"""


def tokens(col: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({col}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND NOT list_contains({words(X.STOP_WORDS)}, w))"


def content_key(col: str) -> str:
    bare = f"regexp_replace(lower({col}), '[^\\p{{L}}\\p{{N}}\\s\\x0b\\p{{Z}}]', '', 'g')"
    return f"substr(sha256(array_to_string(list_filter(regexp_split_to_array({bare}, '{WS}+'), lambda w: w <> ''), ' ')), 1, 16)"


def token_estimate(col: str) -> str:
    n = f"len(list_filter(regexp_split_to_array({col}, '{WS}+'), lambda w: w <> ''))"
    return f"CAST(CASE WHEN length({col}) = 0 THEN 0 WHEN {n} = 0 THEN ceil(length({col}) * 2 / 3) ELSE ceil({n} * CAST(1.3 AS DOUBLE)) END AS BIGINT)"


def strip(col: str) -> str:
    return f"regexp_replace({col}, '^{WS}+|{WS}+$', '', 'g')"


def dedup_text(col: str) -> str:
    out = strip(f"lower({col})")
    for p in X.DEDUP_PREFIXES:
        p = p.replace("'", "''")
        out = f"regexp_replace({out}, '^{p.replace('[', chr(92) + '[').replace(']', chr(92) + ']')}', '')"
    return strip(out)


def cosine(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = len({b}) AND len({a}) > 0 THEN CASE WHEN list_sum(list_transform({a}, lambda x: abs(x))) > 0 AND list_sum(list_transform({b}, lambda x: abs(x))) > 0 THEN list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]) ELSE 0 END ELSE 0 END"


def answer(col: str) -> str:
    bare = f"regexp_replace(lower({col}), '[^a-z0-9_\\s\\x0b\\p{{Z}}]', ' ', 'g')"
    return strip(f"regexp_replace(regexp_replace({bare}, '\\b({'|'.join(X.AUXILIARY)})\\b', ' ', 'g'), '{WS}+', ' ', 'g')")


def answer_tokens(col: str, stop: bool) -> str:
    rest = f" AND NOT list_contains({words(X.STOP_WORDS)}, w)" if stop else ""
    return f"list_filter(string_split({answer(col)}, ' '), lambda w: w <> ''{rest})"


def overlap(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda w: least(len(list_filter({a}, lambda x: x = w)), len(list_filter({b}, lambda x: x = w))))), 0)"


def days(a: str, b: str = AS_OF) -> str:
    return f"CAST(floor((epoch_us({b}) - epoch_us({a})) / 86400000000) AS BIGINT)"


ALIVE = f"(expires_at IS NULL OR expires_at > {AS_OF})"
CONSCIOUS = f"""p AS (SELECT *, row_number() OVER ({NEWEST}) AS no FROM f WHERE temporal_status = 'current' AND {ALIVE}),
w AS (SELECT *, (epoch_us({AS_OF}) - epoch_us(greatest(created_at, reinforced_at, last_recalled_at))) / 86400000000 AS idle FROM p WHERE no <= 50),
x AS (SELECT *, round(significance * CASE WHEN fact_type = 'identity' AND significance < 10 AND idle > 30 THEN 1 - least((idle - 30) / 90, 0.5) ELSE 1 END, 6) AS staleness_score FROM w),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY staleness_score DESC, uuid) AS INTEGER) AS rank_no FROM x)"""

_THREADS = f"""SELECT entity_id, 'open_thread' AS kind, content || ' (open since ' || CASE d WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday' ELSE d || ' days ago' END || ')' AS content, uuid,
  round(significance * CAST(0.1 AS DOUBLE) + CASE WHEN d > 7 THEN 0.3 ELSE 0.1 END, 6) AS priority, d AS days_since, no AS position
  FROM (SELECT *, {days("created_at")} AS d, row_number() OVER (PARTITION BY entity_id ORDER BY significance DESC, created_at DESC, uuid) AS no FROM f WHERE thread_status = 'open') WHERE no <= 10"""
_FEELINGS = f"""SELECT entity_id, 'emotional_checkin' AS kind, 'You mentioned experiencing ' || emotional_valence || ' ' || d || CASE d WHEN 1 THEN ' day' ELSE ' days' END || ' ago. How are you feeling about that now?' AS content, uuid,
  round(0.5 * coalesce(emotional_weight, 0.5), 6) AS priority, d AS days_since, no AS position
  FROM (SELECT *, {days("created_at")} AS d, row_number() OVER ({NEWEST}) AS no FROM f WHERE emotional_valence IN ('grief', 'anxiety', 'anger', 'fear') AND {ALIVE}) WHERE no <= 20 AND d BETWEEN 1 AND 14"""
_STATS = "SELECT entity_id, count(*) AS n_facts, min(created_at) AS first_fact_at FROM f GROUP BY entity_id"
_MILESTONES = f"""SELECT entity_id, 'milestone' AS kind, 'This is a milestone — ' || n_facts || ' memories stored together.' AS content, '' AS uuid, CAST(0.8 AS DOUBLE) AS priority, CAST(NULL AS BIGINT) AS days_since, 1 AS position
  FROM ({_STATS}) WHERE list_contains(list_transform([50, 100, 250, 500, 1000], lambda m: n_facts BETWEEN m AND m + 9), true)
  UNION ALL SELECT entity_id, 'milestone', 'It''s been ' || d || ' days since our first conversation.', '', 0.8, d, 2
  FROM (SELECT *, {days("first_fact_at")} AS d FROM ({_STATS})) WHERE list_contains(list_transform([30, 90, 180, 365], lambda m: d BETWEEN m AND m + 2), true)"""
_NOSTALGIA = f"""SELECT entity_id, 'nostalgia' AS kind, 'Remember when you mentioned: "' || content || '"? That was ' || d || ' days ago.' AS content, uuid, CAST(0.4 AS DOUBLE) AS priority, d AS days_since, n AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY coalesce(engagement_score, 0) DESC, no) AS n FROM (
    SELECT *, {days("created_at")} AS d, row_number() OVER ({NEWEST}) AS no FROM f WHERE significance >= 7 AND {ALIVE} AND temporal_status = 'current')
  WHERE no <= 50 AND d >= 30 AND (last_recalled_at IS NULL OR {days("last_recalled_at")} >= 14)) WHERE n <= 2"""


def _predictions(name: str) -> str:
    one = lambda cond, s: f"SELECT *, {s} AS s, row_number() OVER ({NEWEST}) AS no FROM f WHERE {cond} = '{name}' AND {ALIVE}"
    return f"""SELECT entity_id, 'prediction_followup' AS kind, 'You made a prediction ' || d || ' days ago: "' || content || '". Has anything changed?' AS content, uuid, CAST(0.6 AS DOUBLE) AS priority, d AS days_since, s * 1000 + no AS position
  FROM (SELECT *, {days("created_at")} AS d, row_number() OVER (PARTITION BY entity_id, uuid ORDER BY s) AS n FROM ({one("tag", 0)} UNION ALL {one("slot", 1)}) WHERE no <= 20)
  WHERE n = 1 AND d BETWEEN 7 AND 30 AND thread_status IS DISTINCT FROM 'resolved'"""


_TRIGGER = "entity_id, kind, content, uuid, priority, days_since"
_ENTITIES = f"list_filter(list_transform(regexp_extract_all(query, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*\\b', 0), lambda e: lower(e)), lambda e: NOT list_contains({words(X.QUESTION_WORDS)}, e))"
_INTENT = " OR ".join(f"regexp_matches(query, '(?i){p}')" for p in X.TEMPORAL_INTENT)

_SCORES = f"""qq AS (SELECT *, {tokens("query")} AS terms FROM q),
n AS (SELECT q.query_id, q.terms, f.entity_id, f.uuid AS id, f.content, f.created_at, f.embedding AS vec, f.embedding_model AS model, q.query_vec, q.query_model, {tokens("f.content")} AS ws
  FROM f JOIN qq q USING (entity_id) WHERE {ALIVE}),
st AS (SELECT query_id, count(*) AS n, avg(len(ws)) AS al FROM n GROUP BY query_id),
tf AS (SELECT query_id, id, pos, terms[pos] AS term, len(list_filter(ws, lambda w: w = terms[pos])) AS tf, len(ws) AS dl FROM (SELECT *, unnest(range(1, len(terms) + 1)) AS pos FROM n)),
df AS (SELECT query_id, pos, count(*) AS df FROM tf WHERE tf > 0 GROUP BY ALL),
raw AS (SELECT tf.query_id, id, sum(CASE WHEN tf > 0 THEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / al)) ELSE 0 END) AS raw
  FROM tf JOIN st USING (query_id) LEFT JOIN df USING (query_id, pos) GROUP BY ALL),
lex AS (SELECT query_id, id, round(CASE WHEN mx > 0 THEN raw / mx ELSE 0 END, 6) AS lexical FROM (SELECT *, max(raw) OVER (PARTITION BY query_id) AS mx FROM raw))"""

_DATES = "''"
_RANK = f"""{FACTS}, {TALKS}, {QUESTIONS}, {_SCORES},
e AS (SELECT query_id, {_ENTITIES} AS entities, ({_INTENT}) AS intent, lower(query) AS lq FROM q),
d AS (SELECT n.query_id, n.id, n.created_at, coalesce(l.lexical, 0) AS lexical, e.intent, e.lq,
    round(CASE WHEN n.model = '' OR n.query_model = '' OR n.model = n.query_model THEN {cosine("n.vec", "n.query_vec")} ELSE 0 END, 6) AS dense,
    len(list_filter(e.entities, lambda x: contains(lower(n.content), x))) AS matches
  FROM n JOIN e USING (query_id) LEFT JOIN lex l ON l.query_id = n.query_id AND l.id = n.id),
g AS (SELECT *, round(CASE WHEN matches > 0 THEN matches + 0.35::DOUBLE * lexical + 0.15::DOUBLE * dense ELSE 0 END, 6) AS entity_score FROM d),
ch AS (SELECT query_id, id, 0 AS ch, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, created_at DESC, id) AS r FROM g WHERE dense > 0
  UNION ALL SELECT query_id, id, 1, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, created_at DESC, id) FROM g WHERE lexical > 0
  UNION ALL SELECT query_id, id, 2, row_number() OVER (PARTITION BY query_id ORDER BY entity_score DESC, created_at DESC, id) FROM g WHERE entity_score > 0),"""


def _rank(limit: int) -> str:
    w = max(4 * limit, 100)
    return f"""{_RANK}
fu AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS fused, min(ch * 1000000 + r) AS tie FROM ch WHERE r <= {w} GROUP BY ALL),
fw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, tie) AS r FROM fu) WHERE r <= {w}),
sh AS (SELECT fw.*, fused / max(fused) OVER (PARTITION BY query_id) AS share FROM fw),
ad AS (SELECT sh.query_id, sh.id, fused, tie, f.tag, f.significance, round(share * CASE WHEN temporal_status = 'historical' THEN 0.95::DOUBLE ELSE 1 END
    * CASE WHEN CASE WHEN confidence <= 0 THEN 1 ELSE confidence END < 1 THEN 0.95::DOUBLE + 0.05::DOUBLE * confidence ELSE 1 END * (1 + 0.05::DOUBLE * coalesce(emotional_weight, 0))
    * CASE WHEN pinned THEN 1.1::DOUBLE ELSE 1 END * CASE WHEN thread_status = 'open' THEN 1.03::DOUBLE ELSE 1 END * (1 + 0.02::DOUBLE * coalesce(engagement_score, 0))
    + 0.1::DOUBLE * 0.15::DOUBLE * least(g.matches, 2) + 1e-9::DOUBLE, 6) AS score
  FROM sh JOIN f ON f.uuid = sh.id JOIN g ON g.query_id = sh.query_id AND g.id = sh.id),
cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused DESC, tie) AS no FROM ad WHERE score >= 0.05) WHERE no <= {limit}),
fin AS (SELECT *, round(score + 0.001::DOUBLE * significance + 1e-9::DOUBLE, 6) AS s FROM cut),
top AS (SELECT query_id, id, tag, fused, tie, s AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, fused DESC, tie) AS INTEGER) AS rank_no FROM fin)"""


_ANSWERS = f"""{FACTS}, a AS (SELECT uuid AS question_id, CAST(significance % 5 + 1 AS INTEGER) AS category, significance % 5 = 4 AS adversarial, verbatim AS predicted, content AS truth, concat_ws(' ', tag, slot, verbatim) AS context FROM f WHERE verbatim <> ''),
b AS (SELECT *, {answer_tokens("predicted", False)} AS p, {answer_tokens("truth", False)} AS t, {answer_tokens("truth", True)} AS kt, {answer_tokens("context", True)} AS kc, {answer_tokens("predicted", True)} AS kp,
  {answer("predicted")} = {answer("truth")} AS exact_match, lower({strip("predicted")}) AS lp FROM a),
o AS (SELECT *, {overlap("p", "t")} AS shared, len(kt) AS n_keywords, {overlap("kt", "kc")} AS n_in_context, {overlap("kt", "kp")} AS n_in_answer,
  length(lp) < 5 OR {" OR ".join(f"regexp_matches(lp, '{p.replace(chr(39), chr(39) * 2)}')" for p in X.REFUSALS)} AS refusal FROM b),
sc AS (SELECT *, round(CASE WHEN len(p) = 0 AND len(t) = 0 THEN 1 WHEN len(p) = 0 OR len(t) = 0 OR shared = 0 THEN 0 ELSE 2.0::DOUBLE * shared / (len(p) + len(t)) END, 6) AS f1,
  round(CASE WHEN n_keywords > 0 THEN n_in_context / n_keywords ELSE 0 END, 6) AS context_coverage, round(CASE WHEN n_keywords > 0 THEN n_in_answer / n_keywords ELSE 0 END, 6) AS answer_coverage,
  NOT adversarial AND n_keywords > 0 AND n_in_context = 0 AS retrieval_miss FROM o),
sd AS (SELECT *, NOT adversarial AND n_keywords > 0 AND NOT refusal AND f1 = 0 AND n_in_context > 0 AND n_in_answer = 0 AS format_mismatch FROM sc)"""

SQL = {
    "facts_newest": f"WITH {FACTS} SELECT entity_id, uuid, rank_no FROM (SELECT *, CAST(row_number() OVER ({NEWEST}) AS INTEGER) AS rank_no FROM f) WHERE rank_no <= 100",
    "facts_filtered": f"""WITH {FACTS} SELECT entity_id, uuid, fact_type, tag, significance FROM f WHERE fact_type IN ('identity', 'event') AND temporal_status = 'current'
      AND tag IN ('work', 'preference', 'personal', 'location') AND significance BETWEEN 3 AND 9 AND confidence >= 0.2 AND {ALIVE} AND NOT pinned""",
    "facts_in_lists": f"""WITH {FACTS} SELECT entity_id, uuid, slot, thread_status, emotional_valence, reference_time FROM f WHERE slot IN ('diet', 'pet', 'housing', 'employer') AND fact_type IN ('identity', 'event', 'pattern')
      OR thread_status IN ('open', 'resolved') AND emotional_valence IN ('grief', 'joy', 'anxiety', 'hope', 'love', 'anger', 'fear') AND reference_time BETWEEN '2023-08-01' AND '2023-12-31'""",
    "unembedded": f"WITH {FACTS} SELECT entity_id, uuid, rank_no FROM (SELECT *, CAST(row_number() OVER ({NEWEST}) AS INTEGER) AS rank_no FROM f WHERE embedding IS NULL) WHERE rank_no <= 50",
    "open_threads_topk": f"WITH {FACTS} SELECT entity_id, uuid, rank_no, significance FROM (SELECT *, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY significance DESC, created_at DESC, uuid) AS INTEGER) AS rank_no FROM f WHERE thread_status = 'open') WHERE rank_no <= 20",
    "fact_by_key": f"WITH {FACTS}, k AS (SELECT *, {content_key('content')} AS content_key FROM f) SELECT entity_id, content_key, uuid FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, content_key ORDER BY created_at DESC, uuid) AS no FROM k) WHERE no = 1",
    "entity_stats": f"WITH {FACTS} {_STATS}",
    "fact_labels": f"WITH {FACTS} SELECT uuid, CASE WHEN significance >= 10 THEN 'high' WHEN significance >= 5 THEN 'medium' ELSE 'low' END AS label FROM f",
    "recent_messages": f"""WITH {MESSAGES}, b AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, uuid DESC) AS back FROM m)
      SELECT conversation_id, uuid, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY back DESC) AS INTEGER) AS position FROM b WHERE back <= 10""",
    "summaries_newest": f"WITH {TALKS}, {QUESTIONS} SELECT entity_id, uuid, CAST(no AS INTEGER) AS rank_no FROM s WHERE no <= 100",
    "unsummarized": f"WITH {TALKS} SELECT entity_id, uuid FROM (SELECT *, row_number() OVER ({NEWEST}) AS no FROM c WHERE entity_id IS NOT NULL AND coalesce(summary, '') = '') WHERE no = 1",
    "active_conversations": f"WITH {TALKS} SELECT session_id, uuid FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, uuid) AS no FROM c WHERE session_id IS NOT NULL) WHERE no = 1",
    "turn_summaries": f"""WITH {TURNS}, n AS (SELECT conversation_id, count(*) AS n_ranges, max(end_turn) AS highest_end FROM t WHERE NOT coalesce(is_overview, false) GROUP BY 1)
      SELECT conversation_id, uuid, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY is_overview NULLS FIRST, start_turn NULLS FIRST, created_at NULLS FIRST, uuid) AS INTEGER) AS position, n_ranges, highest_end FROM t LEFT JOIN n USING (conversation_id)""",
    "content_keys": f"SELECT doc_id, {content_key('text')} AS content_key, {token_estimate('text')} AS tokens FROM documents WHERE text IS NOT NULL",
    "dedup_texts": f"WITH {FACTS} SELECT uuid, {dedup_text('content')} AS norm FROM f",
    "trivial_conversations": f"""WITH {MESSAGES}, b AS (SELECT conversation_id, trim(regexp_replace({strip("lower(content)")}, '[^a-z0-9 ]', '', 'g')) AS x FROM m)
      SELECT conversation_id, bool_and(coalesce(x = '' OR list_contains({words(X.TRIVIAL)}, x), true)) AS is_trivial FROM b GROUP BY 1""",
    "transcripts": f"""WITH {MESSAGES}, n AS (SELECT *, {strip("content")} AS body FROM m WHERE role IN ('user', 'assistant')),
      k AS (SELECT *, (row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, uuid) - 1) // 64 AS piece_no FROM n WHERE body <> ''),
      l AS (SELECT conversation_id, piece_no, count(*) AS n_messages, string_agg(role || ': ' || body, chr(10) ORDER BY created_at, uuid) AS x FROM k GROUP BY 1, 2)
      SELECT conversation_id, piece_no, n_messages, length(x) AS n_chars, md5(x) AS digest FROM l""",
    "entity_mentions": f"""WITH {FACTS}, w AS (SELECT entity_id, created_at, uuid, unnest(ws) AS w, unnest(range(len(ws))) AS wpos FROM (SELECT *, list_filter(regexp_split_to_array(content, '[^\\p{{L}}\\p{{N}}@./]+'),
      lambda w: length(w) >= 3 AND NOT list_contains({words(X.MENTION_STOP)}, lower(w)) AND (substr(w, 1, 1) <> lower(substr(w, 1, 1)) OR regexp_matches(w, '[0-9@./]'))) AS ws FROM f)),
      g AS (SELECT entity_id, lower(w) AS low, arg_min(w, (created_at, uuid, wpos)) AS mention, min((created_at, uuid, wpos)) AS o FROM w GROUP BY ALL)
      SELECT * FROM (SELECT entity_id, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY o) AS INTEGER) AS position, mention FROM g) WHERE position <= 15""",
    "query_entities": f"WITH {TALKS} SELECT uuid, array_to_string({_ENTITIES.replace('query', 'summary')}, '|') AS entities, ({_INTENT.replace('query', 'summary')}) AS intent FROM c WHERE summary IS NOT NULL",
    "cosine_best": f"WITH {FACTS}, {TALKS}, {QUESTIONS} SELECT entity_id, uuid, round({cosine('embedding', 'query_vec')}, 6) AS cos FROM f JOIN q USING (entity_id)",
    "bm25_scores": f"WITH {FACTS}, {TALKS}, {QUESTIONS}, {_SCORES} SELECT query_id, id, lexical FROM lex WHERE lexical > 0",
    "rank_full": f"WITH {_rank(50)} SELECT query_id, id, rank_no, score FROM top",
    "rank_diversified": f"""WITH {_rank(20)}, dn AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id, tag ORDER BY score DESC, fused DESC, tie) AS nth FROM top),
      dv AS (SELECT query_id, id, tag, fused, tie, CASE WHEN n > 2 AND nth > greatest(1, floor(n * 0.6)) THEN round(score * 0.85::DOUBLE + 1e-9::DOUBLE, 6) ELSE score END AS score FROM dn)
      SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused DESC, tie) AS INTEGER) AS rank_no, score, tag FROM dv""",
    "kneedle_cut": f"""WITH {_rank(50)}, a AS (SELECT *, count(*) OVER w AS n, max(score) OVER w AS mx, min(score) OVER w AS mn FROM top WINDOW w AS (PARTITION BY query_id)),
      b AS (SELECT *, round((1 - (rank_no - 1) / (n - 1)) - (score - mn) / (mx - mn), 9) AS bend FROM a),
      k AS (SELECT query_id, any_value(n) AS n, any_value(mx - mn) AS rng, max(bend) AS most, arg_max(rank_no, (bend, -rank_no)) AS knee FROM b GROUP BY 1)
      SELECT query_id, CAST(CASE WHEN n <= 5 OR rng < 1e-9 OR most < 0.3 THEN n ELSE greatest(knee - 1, least(10, n)) END AS BIGINT) AS n_kept FROM k""",
    "conscious_topk": f"WITH {FACTS}, {CONSCIOUS} SELECT entity_id, rank_no, uuid, staleness_score FROM k WHERE rank_no <= 10",
    "proactive_threads": f"WITH {FACTS} SELECT {_TRIGGER} FROM ({_THREADS})",
    "proactive_feelings": f"WITH {FACTS} SELECT {_TRIGGER} FROM ({_FEELINGS})",
    "proactive_milestones": f"WITH {FACTS} SELECT {_TRIGGER} FROM ({_MILESTONES})",
    "proactive_nostalgia": f"WITH {FACTS} SELECT {_TRIGGER} FROM ({_NOSTALGIA})",
    "proactive_predictions": f"WITH {FACTS} SELECT {_TRIGGER} FROM ({_predictions('study_goal')})",
    "proactive_union": f"""WITH {FACTS}, u AS (SELECT *, 0 AS kno FROM ({_THREADS}) UNION ALL SELECT *, 1 FROM ({_FEELINGS}) UNION ALL SELECT *, 2 FROM ({_MILESTONES}) UNION ALL SELECT *, 3 FROM ({_NOSTALGIA}) UNION ALL SELECT *, 4 FROM ({_predictions("prediction")}))
      SELECT * FROM (SELECT entity_id, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY priority DESC, kno, position) AS INTEGER) AS rank_no, kind, uuid, priority FROM u
      WHERE CAST('0x' || substr(sha256(entity_id || '2024-02-01'), 1, 2) AS INTEGER) % 3 <> 0) WHERE rank_no <= 3""",
    "ttl_assigned": f"WITH {FACTS} SELECT uuid, CASE WHEN significance >= 10 THEN NULL WHEN significance >= 5 THEN created_at + INTERVAL 30 DAY ELSE created_at + INTERVAL 7 DAY END AS expires_at FROM f",
    "expired_split": f"WITH {FACTS} SELECT entity_id, coalesce(expires_at < {AS_OF}, false) AS expired, count(*) AS n_facts FROM f GROUP BY ALL",
    "stale_summaries": f"""WITH {TALKS}, p AS (SELECT *, coalesce(created_at < {AS_OF} - INTERVAL 90 DAY AND coalesce(summary, '') <> '', false) AS stale FROM c)
      SELECT entity_id, count(*) FILTER (NOT stale AND coalesce(summary, '') <> '') AS n_summaries, count(vec) FILTER (NOT stale) AS n_vectors FROM p GROUP BY 1""",
    "memories_added": f"""WITH {FACTS}, i AS (SELECT entity_id, uuid AS seq, significance, verbatim, {content_key("verbatim")} AS content_key FROM f WHERE verbatim <> ''),
      b AS (SELECT entity_id, content_key, count(*) AS n, arg_min(significance, (seq, verbatim, significance)) AS sig FROM i GROUP BY ALL), h AS (SELECT DISTINCT entity_id, {content_key("content")} AS content_key, true AS there FROM f)
      SELECT entity_id, content_key, CASE WHEN there THEN 'reinforce' ELSE 'insert' END AS action, CASE WHEN sig BETWEEN 1 AND 10 THEN sig ELSE 5 END AS significance,
      CASE WHEN there OR sig = 10 THEN NULL WHEN sig BETWEEN 1 AND 4 THEN {AS_OF} + INTERVAL 7 DAY ELSE {AS_OF} + INTERVAL 30 DAY END AS expires_at, n - CASE WHEN there THEN 0 ELSE 1 END AS mentions FROM b LEFT JOIN h USING (entity_id, content_key)""",
    "reinforced": f"""WITH {FACTS}, r AS (SELECT *, least(recall_count, 3) AS n, significance < 10 AND reinforced_count + least(recall_count, 3) >= 5 AS up FROM f)
      SELECT uuid, CASE WHEN n > 0 AND up THEN 10 ELSE significance END AS significance, reinforced_count + CASE WHEN n > 0 THEN n ELSE 0 END AS reinforced_count,
      CASE WHEN n > 0 AND (up OR significance - 1 >= 10) THEN NULL WHEN n > 0 AND significance - 1 >= 5 THEN {AS_OF} + INTERVAL 30 DAY WHEN n > 0 THEN {AS_OF} + INTERVAL 7 DAY ELSE expires_at END AS expires_at FROM r""",
    "recall_usage": "SELECT user_id AS uuid, count(*) AS recalls, max(ts) AS last_recalled_at FROM events GROUP BY 1",
    "slot_supersede": f"""WITH {FACTS}, n AS (SELECT entity_id, slot, arg_max(uuid, (created_at, -no)) AS newer FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, slot ORDER BY created_at DESC, uuid) AS no FROM f WHERE fact_type = 'identity' AND slot <> '') WHERE no = 1 GROUP BY ALL)
      SELECT entity_id, slot, uuid, newer AS superseded_by FROM f JOIN n USING (entity_id, slot) WHERE fact_type = 'identity' AND temporal_status = 'current' AND uuid <> newer""",
    "semantic_dedup": f"""WITH {FACTS}, v AS (SELECT * FROM f WHERE embedding IS NOT NULL AND embedding_model <> ''),
      n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, slot ORDER BY created_at DESC, uuid) AS no FROM v WHERE slot <> '') WHERE no = 1),
      p AS (SELECT a.entity_id, a.uuid AS new_id, b.uuid AS old_id, b.created_at, round({cosine("a.embedding", "b.embedding")}, 6) AS cos FROM n a JOIN v b ON a.entity_id = b.entity_id AND a.uuid <> b.uuid)
      SELECT entity_id, new_id, old_id, cos FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, new_id ORDER BY cos DESC, created_at DESC, old_id) AS no FROM p WHERE cos >= 0.4) WHERE no = 1""",
    "consolidation_groups": f"""WITH {FACTS}, p AS (SELECT *, row_number() OVER ({NEWEST}) AS no FROM f WHERE fact_type = 'event' AND temporal_status = 'current' AND {ALIVE} AND reference_time <= '2024-01-02' AND significance <= 10)
      SELECT entity_id, CASE WHEN tag = '' THEN '_untagged' ELSE tag END AS tag, count(*) AS n_facts, md5('- ' || string_agg(content, chr(10) || '- ' ORDER BY content)) AS digest FROM p WHERE no <= 500 GROUP BY 1, 2 HAVING count(*) >= 2""",
    "sessions_30m": """WITH a AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
      b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session_no FROM a)
      SELECT user_id, CAST(session_no AS BIGINT) AS session_no, min(ts) AS started_at, max(ts) + INTERVAL 30 MINUTE AS expires_at, count(*) AS n_touches FROM b GROUP BY ALL""",
    "turn_ranges": f"""WITH {MESSAGES}, {TURNS}, n AS (SELECT conversation_id, count(*) AS n FROM m GROUP BY 1), d AS (SELECT conversation_id, max(end_turn) AS e FROM t WHERE NOT coalesce(is_overview, false) GROUP BY 1)
      SELECT conversation_id, CAST(coalesce(e, 0) + 1 AS BIGINT) AS start_turn, n - 10 AS end_turn FROM n LEFT JOIN d USING (conversation_id) WHERE n > 10 AND coalesce(e, 0) < n - 10""",
    "overview_merges": f"""WITH {TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY start_turn NULLS FIRST, created_at NULLS FIRST, uuid) AS no, count(*) OVER (PARTITION BY conversation_id) AS n FROM t WHERE NOT coalesce(is_overview, false)),
      o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, uuid) AS no FROM t WHERE is_overview) WHERE no = 1),
      u AS (SELECT conversation_id, end_turn FROM r WHERE n > 2 AND no <= 2 UNION ALL SELECT conversation_id, end_turn FROM o WHERE conversation_id IN (SELECT conversation_id FROM r WHERE n > 2))
      SELECT conversation_id, max(end_turn) AS end_turn, count(*) AS n_inputs FROM u GROUP BY 1""",
    "ingest_chunks": f"""WITH {MESSAGES} SELECT conversation_id, chunk_no, count(*) AS n_messages FROM (SELECT conversation_id, (row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, uuid) - 1) // 8 AS chunk_no FROM m) GROUP BY ALL""",
    "answers_scored": f"WITH {_ANSWERS} SELECT question_id, f1, exact_match, refusal, CAST(n_keywords AS INTEGER) AS n_keywords, context_coverage, answer_coverage, retrieval_miss, format_mismatch FROM sd",
    "category_scores": f"""WITH {_ANSWERS}, u AS (SELECT category, f1, exact_match, refusal FROM sd UNION ALL SELECT NULL, f1, exact_match, refusal FROM sd WHERE NOT adversarial)
      SELECT category, count(*) AS n_questions, round(avg(f1), 6) AS mean_f1, round(avg(exact_match::INT), 6) AS exact_rate, round(avg(refusal::INT), 6) AS refusal_rate FROM u GROUP BY 1""",
    "diagnostics_summary": f"""WITH {_ANSWERS}, z AS (SELECT count(*) AS n_questions, count(*) FILTER (NOT adversarial) AS n_answerable, count(*) FILTER (NOT adversarial AND refusal) AS n_refusals, count(*) FILTER (retrieval_miss) AS n_retrieval_misses,
      count(*) FILTER (format_mismatch) AS n_format_mismatches, count(*) FILTER (NOT adversarial AND f1 = 0) AS n_zero_f1, round(avg(context_coverage) FILTER (NOT adversarial), 6) AS mean_context_coverage, round(avg(answer_coverage) FILTER (NOT adversarial), 6) AS mean_answer_coverage FROM sd)
      SELECT *, round(n_refusals / n_answerable, 6) AS refusals_rate, round(n_retrieval_misses / n_answerable, 6) AS retrieval_misses_rate, round(n_format_mismatches / n_answerable, 6) AS format_mismatches_rate, round(n_zero_f1 / n_answerable, 6) AS zero_f1_rate FROM z""",
}
