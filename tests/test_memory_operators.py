"""The memory store's operators on hand-made cases, against plain models, and as streams."""

import datetime as dt
import json
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemosa.functions import text as X
from mnemosa.functions.filters import FactFilter
from mnemosa.functions.vectors import HashEmbedder, backfill, cosine, decode_vector, encode_vector
from mnemosa.operators import artifacts as A
from mnemosa.operators import context as C
from mnemosa.operators import lifecycle as L
from mnemosa.operators import models as M
from mnemosa.operators import rank as R
from mnemosa.operators import sessions as T
from mnemosa.operators import recall as Q
from mnemosa.operators.recall import recall_artifacts
from mnemosa.schema import TABLES, empty

T0 = dt.datetime(2024, 1, 1)


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def one(spark, column, *values, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_text_functions(spark):
    assert one(spark, X.estimate_tokens("v"), "", "   ", "one", "one two three", "a b") == [0, 2, 2, 4, 3]
    assert one(spark, X.dedup_text("v"), "The User likes tea ", "User's [historical] x", "[historical] The user") == ["likes tea", "x", "the user"]
    a, b = one(spark, X.content_key("v"), "I like  TEA!", "i like tea")
    assert a == b and len(a) == 16
    assert one(spark, X.trivial("v"), "Thanks!", "привет", "no", "got it.", "") == [True, True, False, True, True]
    assert one(spark, F.array_join(X.query_entities("v"), "|"), "When did Anna Bell meet Émile and Bob?", "What") == ["anna bell|bob", ""]
    assert one(spark, X.temporal_intent("v"), "When did it start?", "I maybe go", "what time is it", "on May 3") == [True, False, True, True]
    assert one(spark, X.is_refusal("v"), "No", "I don't know that", "She lives in Graz") == [True, True, False]


def test_temporal_boost(spark):
    q = spark.createDataFrame([("when did we meet on 2023-05-07?", "2023-05-07"), ("when was it in may 2023", "2023-05-01"), ("in 2023", "2023-01-01"), ("when was it", "2020-01-01"), ("tell me", "2020-01-01"), ("when was it", "")], "q string, r string")
    got = [r[0] for r in q.select(X.temporal_boost(X.query_dates("q"), X.temporal_intent("q"), "r")).collect()]
    assert got == [0.5, 0.35, 0.2, 0.2, 0.0, 0.0]


@pytest.mark.parametrize("p, t, want", [("The red cat", "a red cat", 1.0), ("", "", 1.0), ("x", "", 0.0), ("red red cat", "red dog", 0.4), ("no", "yes", 0.0)])
def test_token_f1(spark, p, t, want):
    assert spark.createDataFrame([(p, t)], "p string, t string").select(X.token_f1("p", "t")).first()[0] == pytest.approx(want)


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0]), ([], [])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in rows.select(cosine("a", "b")).collect()] == [0.707107, 0.0, 0.0, 0.0, 0.0]
    back = rows.select(decode_vector(encode_vector("a"))).collect()
    assert [r[0] for r in back] == [[1.0, 0.0], [0.0, 0.0], [1.0], None, None]
    assert [r[0] for r in spark.createDataFrame([(bytearray(b"[1, 2.5]"),), (bytearray(b"[x"),)], "b binary").select(decode_vector("b")).collect()] == [[1.0, 2.5], None]
    facts = spark.createDataFrame([("u", "hello", None, ""), ("v", "there", [1.0], "m"), ("w", None, [], "")], "uuid string, content string, embedding array<float>, embedding_model string")
    got = {r.uuid: r for r in backfill(facts, HashEmbedder(8)).collect()}
    assert len(got["u"].embedding) == 8 and got["v"].embedding == [1.0] and got["w"].embedding is None


def plain_rank(cands, q, limit, threshold):
    """The ranking of one query, written from its rules."""
    words = lambda s: [w for w in "".join(c if c.isalnum() else " " for c in s.lower()).split() if w not in X.STOP_WORDS]
    docs, terms = [words(c["content"]) for c in cands], words(q["query"])
    avg = sum(map(len, docs)) / len(docs)
    raw = []
    for d in docs:
        s = 0.0
        for t in terms:
            tf, df = d.count(t), sum(t in x for x in docs)
            if tf:
                s += math.log((len(docs) - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg))
        raw.append(s)
    lex = [round(x / max(raw), 6) if max(raw) > 0 else 0 for x in raw]
    dense = [round(sum(a * b for a, b in zip(c["vec"], q["vec"])) / math.hypot(*c["vec"]) / math.hypot(*q["vec"]), 6) if c["vec"] and any(c["vec"]) else 0 for c in cands]
    order = sorted(range(len(cands)), key=lambda i: (-cands[i]["created_at"].timestamp(), cands[i]["id"]))
    fused, tie = {}, {}
    for ch, s in enumerate((dense, lex)):
        for r, i in enumerate(sorted((i for i in order if s[i] > 0), key=lambda i: -s[i]), 1):
            fused[i] = fused.get(i, 0) + 1 / (60 + r)
            tie[i] = min(tie.get(i, (9, 9)), (ch, r))
    if not fused:
        return []
    best = max(round(f, 9) for f in fused.values())
    score = {i: round(round(f, 9) / best + 1e-9, 6) for i, f in fused.items()}
    top = sorted((i for i in score if score[i] >= threshold), key=lambda i: (-score[i], tie[i]))[:limit]
    final = {i: round(score[i] + 0.001 * cands[i]["significance"] + 1e-9, 6) for i in top}
    return [(cands[i]["id"], final[i]) for i in sorted(top, key=lambda i: (-final[i], tie[i]))]


@pytest.mark.parametrize("seed", range(3))
def test_rank_equals_plain_model(spark, seed):
    r = random.Random(seed)
    vocab = "tea coffee garden bread lamp river cat dog moon stone".split()
    cands = [
        dict(id=f"c{i:02d}", content=" ".join(r.choices(vocab, k=r.randint(0, 6))), vec=r.choice([None, [r.gauss(0, 1) for _ in range(4)]]), created_at=T0 + dt.timedelta(days=r.randrange(5)), significance=r.randint(1, 9))
        for i in range(40)
    ]
    q = dict(query="tea tea in the garden by the river", vec=[r.gauss(0, 1) for _ in range(4)])
    schema = "entity_id string, id string, content string, created_at timestamp, reference_time string, temporal_status string, confidence double, emotional_weight double, pinned boolean, thread_status string, engagement_score double, significance int, tag string, vec array<float>, model string"
    df = spark.createDataFrame([("e", c["id"], c["content"], c["created_at"], "", "current", 1.0, None, False, None, None, c["significance"], "t", c["vec"], "") for c in cands], schema)
    queries = spark.createDataFrame([("q", "e", q["query"], q["vec"], ""), ("other", "nobody", "x", None, "")], "query_id string, entity_id string, query string, query_vec array<float>, query_model string")
    got = [(x.id, x.score) for x in R.rank(df, queries, R.RankOptions(limit=8, threshold=0.3)).orderBy("query_id", "rank_no").collect()]
    want = plain_rank(cands, q, 8, 0.3)
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=2e-6)


def test_rank_of_nothing(spark):
    facts = empty(spark, "artifact")
    queries = spark.createDataFrame([], "query_id string, entity_id string, query string, query_vec array<float>, query_model string")
    assert recall_artifacts(facts, queries).count() == 0


def test_filters(spark):
    rows = spark.createDataFrame([(1, "identity", None, True), (5, "event", T0, False), (9, None, dt.datetime(2025, 1, 1), False)], "significance int, fact_type string, expires_at timestamp, pinned boolean")
    n = lambda **k: rows.filter(FactFilter(**k).condition(now())).count()
    assert (n(), n(types=["event"]), n(exclude_expired=True), n(pinned=False), n(min_significance=5, max_significance=8), n(min_significance=-1)) == (3, 1, 2, 2, 1, 3)


def test_fold_and_reinforce(spark):
    base = empty(spark, "entity_fact")
    rows = spark.createDataFrame([("a", 4, 4, T0), ("b", 9, 0, T0), ("c", 3, 0, T0)], "uuid string, significance int, reinforced_count int, expires_at timestamp")
    facts = base.unionByName(rows, allowMissingColumns=True).fillna({"recall_count": 0, "temporal_status": "current"})
    at = T0 + dt.timedelta(days=3)
    ev = [("a", 1, "recall", at, None, None, None), ("a", 2, "recall", at, None, None, None), ("a", 3, "pin", at, None, None, None), ("a", 4, "unpin", at, None, None, None), ("b", 1, "status", at, None, "historical", "z"), ("b", 2, "significance", at, 6.0, None, None), ("c", 1, "delete", at, None, None, None), ("b", 3, "confirm", at, None, None, None)]
    got = {r.uuid: r for r in L.fold(facts, spark.createDataFrame(ev, L.EVENT)).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].recall_count, got["a"].pinned, got["a"].significance, got["a"].expires_at) == (2, False, 10, None)
    assert (got["b"].temporal_status, got["b"].superseded_by, got["b"].significance, got["b"].confidence, got["b"].reinforced_count) == ("historical", "z", 6, 1.0, 1)
    up = {r.uuid: r for r in L.reinforce(facts, spark.createDataFrame([("a", 1, 2), ("b", 1, 2), ("b", 2, 7)], "uuid string, seq int, significance int"), now()).collect()}
    assert (up["a"].significance, up["a"].expires_at, up["b"].reinforced_count, up["c"].reinforced_count) == (10, None, 2, 0)
    assert up["b"].expires_at == dt.datetime(2024, 3, 2)


def test_add_and_ingest(spark):
    facts = empty(spark, "entity_fact").unionByName(spark.createDataFrame([("old", "e", "Likes tea", [1.0, 0.0], T0, "identity", "current", "drink", 5)], "uuid string, entity_id string, content string, embedding array<float>, created_at timestamp, fact_type string, temporal_status string, slot string, significance int"), allowMissingColumns=True)
    facts = facts.withColumn("content_key", X.content_key("content"))
    new = spark.createDataFrame([("e", 1, "likes TEA!", 5), ("e", 2, "Has a cat", 3), ("e", 3, "has a cat.", 3), (None, 4, "x", 1), ("e", 5, None, 1)], "entity_id string, seq int, content string, significance int")
    got = sorted((r.action, r.mentions) for r in L.add_memories(facts, new, now()).collect())
    assert got == [("insert", 1), ("reinforce", 1)]
    ext = [("e", 1, "likes tea", "identity", 5, "drink", [1.0, 0.0]), ("e", 2, "Drinks coffee", "identity", 5, "drink", [0.0, 1.0]), ("e", 3, "Tea lover", "event", 5, "", [0.99, 0.01]), ("e", 4, "New thing", "event", 5, "", [0.5, 0.9]), ("e", 5, "new thing", "event", 5, "", None)]
    done = L.ingest(facts, spark.createDataFrame(ext, "entity_id string, seq int, content string, fact_type string, significance int, slot string, vec array<float>"), now()).collect()
    by = {r.seq: (r.action, r.target) for r in done if r.seq}
    assert by[1] == ("reinforce", "old") and by[2][0] == "insert" and by[3] == ("reinforce", "old") and by[4][0] == "insert" and by[5][0] == "reinforce"
    assert [(r.uuid, r.action) for r in done if r.seq is None] == [("old", "supersede")]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=6), st.lists(st.integers(0, 2), max_size=6))
def test_overlap_law(spark, a, b):
    row = spark.createDataFrame([(a, b)], "a array<int>, b array<int>").select(T.merge_history(F.col("a"), F.col("b")), T.new_messages(F.col("a"), F.col("b"))).first()
    k = max([k for k in range(1, min(len(a), len(b)) + 1) if a[-k:] == b[:k]], default=0)
    assert row[1] == b[k:] and row[0] == a + b[k:]


def test_artifacts(spark):
    text = "Look:\n```sql\nSELECT 1\n```\nand {\"a\": 1} then\nselect * from t\n    x\n    y\n    z\n    w\nend {bad"
    rows = [("c", T0, "1", "user", text), ("c", T0 + dt.timedelta(1), "2", "assistant", text), ("c", T0, "3", "system", "```\nno\n```"), ("c", T0, "4", "user", None)]
    got = [(r.artifact_type, r.content, r.language) for r in A.detect_artifacts(spark.createDataFrame(rows, "conversation_id string, created_at timestamp, uuid string, role string, content string")).orderBy("position").collect()]
    assert got == [("code", "SELECT 1", "sql"), ("code", "x\n    y\n    z\n    w", ""), ("json", '{"a": 1}', ""), ("sql", "select * from t", "")]


def test_context_budget_and_dedup(spark):
    profile = spark.createDataFrame([("q", 1, "The user likes tea"), ("q", 2, "likes tea"), ("q", 3, "has a very long list of things to say here")], "q string, position int, content string")
    recalled = spark.createDataFrame([("q", i, c, "historical" if i == 1 else "current", "2023-01-01" if i == 2 else "") for i, c in enumerate(["Likes TEA", "walks", "has a very long list of things to say here", "a b", "c d", "e f", "g h", "i j"], 1)], "q string, position int, content string, temporal_status string, reference_time string")
    past = spark.createDataFrame([("q", 1, "walks", T0), ("q", 2, "spoke of the sea", T0)], "q string, position int, content string, created_at timestamp")
    lines = [(r.section, r.line) for r in C.flat_context("q", profile, recalled, past, budget=C.Budget(34, 20)).orderBy("section", "position").collect()]
    assert ("profile", "- The user likes tea") in lines and not any("Likes TEA" in x for _, x in lines)
    assert ("recalled", "- [2023-01-01] walks") in lines and lines.count(("profile", "- likes tea")) == 0
    assert len([1 for s, _ in lines if s == "recalled"]) >= 5
    text = C.render(C.flat_context("q", profile, recalled, past), "q").first()
    assert text.context.startswith("User profile:\n- The user likes tea") and "Jan 1, 2024] spoke of the sea" in text.context


def test_identity_section_goes_on_with_later_tags(spark):
    rows = [("q", 1, "a", "work", 0.9, None), ("q", 2, "x " * 40, "work", 0.9, None), ("q", 3, "never", "work", 0.9, None), ("q", 4, "b", "home", 0.6, 'said "b"'), ("q", 5, "c", "", 0.1, None)]
    got = [(r.tag, r.line) for r in C.identity_section(spark.createDataFrame(rows, "q string, position int, content string, tag string, confidence double, verbatim string"), "q", 40).orderBy("line_no").collect()]
    assert got == [("work", "- a (verified)"), ("home", '- b (likely) | User said: "said \\"b\\""')]


def test_tiered_context(spark):
    rows = [("q", i, t, c, v, "", None, T0) for i, (t, c, v) in enumerate([("Likes tea", 0.9, 'I "love" it'), ("Owns a cat", 0.6, None), ("Sings", 0.4, ""), ("Lies", 0.1, None)], 1)]
    facts = spark.createDataFrame(rows, "q string, position int, content string, confidence double, verbatim string, tag string, started_at string, created_at timestamp")
    raised = spark.createDataFrame([("q", 1, "- [nostalgia] the sea")], "q string, position int, line string")
    turns = spark.createDataFrame([("q", 1, 1, 4, False, "spoke of tea"), ("q", 2, None, None, True, "all of it")], "q string, position int, start_turn int, end_turn int, is_overview boolean, summary string")
    past = spark.createDataFrame([("q", 1, "old talk", T0), ("other", 1, "x", T0)], "q string, position int, content string, created_at timestamp")

    def make(total, most, *names):
        parts = {"identity": C.identity_lines(facts, "q"), "threads": C.thread_lines(facts, "q", now()), "verified": C.recalled_lines(facts, "q", True), "inferred": C.recalled_lines(facts, "q", False), "proactive": raised, "session": C.session_lines(turns, "q"), "past": C.past_lines(past, "q", now())}
        return {r.q: r for r in C.tiered_context({n: parts[n] for n in names}, "q", C.Budget(total, 60), most).collect()}

    h = C.TIER_HEADERS
    got = make(4000, 1, "threads", "verified", "inferred", "proactive", "session", "past")["q"]
    # what is raised joins the open threads, whose place comes first
    assert got.proactive == f"{h['threads']}\n- General: Likes tea (still open)\n\n{h['proactive']}\n- [nostalgia] the sea"
    assert got.episodic == f"{h['verified']}\n- Likes tea (confidence: 0.9) | User said: \"I \\\"love\\\" it\"\n\n{h['inferred']}\n- May be owns a cat (confidence: 0.6)\n- Possibly sings (confidence: 0.4)"
    assert got.working == f"{h['session']}\n- [Turns 1-4] spoke of tea\n- [Overview] all of it" and got.past == f"{h['past']}\n- [4 weeks ago] old talk"
    assert got.formatted == "\n\n".join([got.proactive, got.episodic, got.working, got.past])
    assert got.total_tokens == sum(map(C.estimate, (got.proactive, got.episodic, got.working, got.past)))
    assert make(4000, None, "past")["other"].past.endswith("x")
    # without room: the heading of what is recalled stays, other sections go
    assert make(30, 9, "threads", "past")["q"].past == "" and make(30, 9, "threads")["q"].proactive.count("\n") == 2 and make(5, 9, "verified")["q"].episodic == h["verified"]
    assert make(5, 9, "threads")["q"].formatted == ""
    # in identity only the tag ends at a line that doesn't fit
    wide = facts.withColumn("tag", F.when(F.col("position") == 1, "a").otherwise("b")).withColumn("content", F.when(F.col("position") == 1, F.repeat(F.lit("w "), 90)).otherwise(F.col("content")))
    assert [r.semantic.count("Owns a cat") for r in C.tiered_context({"identity": C.identity_lines(wide, "q")}, "q", C.Budget(40, 10)).collect()] == [1]


@pytest.mark.parametrize("text", ["", "  ", "one", "a b\u00a0c\u3000d", "日本", "\ufeff", "x\x1cy"])
def test_token_estimates_agree(spark, text):
    assert one(spark, X.estimate_tokens("v"), text) == [C.estimate(text)]


def test_model_steps(spark):
    answers = ['[{"content": "x", "significance": 99}]', '```json\n[{"content": "y", "tag": "Odd"}]\n```', 'Sure: [{"content": "z"}] ok', '{"content": "w"} junk {"content": "v"', "nothing"]
    got = [[f.content for f in r[0] or []] for r in spark.createDataFrame([(a,) for a in answers], "a string").select(M.parse_list("a")).collect()]
    assert got == [["x"], ["y"], ["z"], ["w"], []]
    rows = spark.createDataFrame([(f" x{i}", t, s, g, "", c, d, w, v, "", d, o) for i, (t, s, g, c, d, w, v, o) in enumerate([("EVENT", 0, "Odd", 7.0, "2023-02-30", -1.0, "JOY ", "Open"), (None, 7, " work", None, "2023-02-03", None, "x", "closed")])], M.EXTRACTED)
    a, b = M.validated(rows, now()).orderBy("content").collect()
    assert (a.fact_type, a.significance, a.tag, a.confidence, a.reference_time, a.emotional_weight, a.emotional_valence, a.thread_status, a.started_at) == ("event", 5, "other", 1.0, "", 0.0, "joy", "open", None)
    assert (b.fact_type, b.significance, b.tag, b.confidence, b.reference_time, b.emotional_valence, b.thread_status, b.started_at) == ("identity", 7, "work", 0.5, "2023-02-03", None, None, "2023-02-03")
    asked = M.call_model(spark.createDataFrame([("a",), (None,)], "prompt string"), "prompt", lambda ps: [p.upper() for p in ps])
    assert sorted(str(r.answer) for r in asked.collect()) == ["A", "None"]


def test_session_stream_equals_batch(spark, tmp_path):
    from mnemosa.streaming.state import session_batch, session_stream

    r = random.Random(3)
    rows = [(r.choice("ab"), T0 + dt.timedelta(minutes=r.choice([0, 10, 30, 45]) + 30 * r.randrange(40))) for _ in range(60)] + [("a", T0 + dt.timedelta(days=30)), (None, T0)]
    df = spark.createDataFrame(rows, "user string, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = session_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "user", "ts")
    q = stream.writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {tuple(x) for x in spark.sql("SELECT user, started_at, expires_at, n_touches FROM sessions").collect()}
    want = {tuple(x) for x in session_batch(df, "user", "ts").collect()}
    assert got == {w for w in want if w[1] < T0 + dt.timedelta(days=30)} or got == want


def test_reinforcement_goes_on_from_the_store():
    import pandas as pd

    from mnemosa.streaming.state import reinforcement_step

    class State:
        exists, hasTimedOut, get = False, False, None

        def update(self, value):
            self.exists, self.get = True, value

        def setTimeoutDuration(self, ms):
            self.ms = ms

        def remove(self):
            self.exists = False

    days = lambda n: T0 + dt.timedelta(days=n)
    state, step = State(), reinforcement_step(5, 365)
    feed = lambda *rows: [tuple(r)[1:] for r in next(step(("a",), [pd.DataFrame(rows, columns=["at", "significance", "stored_count", "stored_significance"])], state)).itertuples(index=False)][0]
    row = lambda n, sig: (pd.Timestamp(days(n)), sig, 2, 4)
    assert feed(row(5, 3)) == (3, 4, days(5), days(12))
    assert feed(row(2, 9)) == (4, 4, days(5), days(12))  # late: counts, but times don't go back
    count, significance, last, ends = feed(row(6, 3))
    assert (count, significance, last) == (5, 10, days(6)) and pd.isna(ends)  # promoted
    assert feed(row(7, 3))[:2] == (6, 10) and state.get[3] is not None  # mentioned lightly, it expires again


def test_store_and_api(spark, tmp_path):
    from mnemosa.api import Memory
    from mnemosa.sources.stores import ParquetStore

    store = ParquetStore(spark, str(tmp_path))
    assert store.read("entity_fact").count() == 0
    m = Memory(store, HashEmbedder(16), as_of=dt.datetime(2024, 2, 1))
    new = spark.createDataFrame([("e", 1, "Anna likes green tea", 5), ("e", 2, "has a cat", 10), ("f", 1, "works at night", 3)], "entity_id string, seq int, content string, significance int")
    assert sorted(r.action for r in m.add(new).collect()) == ["insert"] * 3
    m2 = Memory(store, HashEmbedder(16), as_of=dt.datetime(2024, 2, 2))
    m2.add(new.filter("seq = 1"))
    assert {r.content: r.reinforced_count for r in m2.facts().collect()} == {"Anna likes green tea": 1, "has a cat": 0, "works at night": 1}
    asked = spark.createDataFrame([("q", "e", "Does Anna like tea?")], "query_id string, entity_id string, query string")
    found, events = m2.search(asked, 5)
    assert found.orderBy("rank_no").first().content == "Anna likes green tea" and events.count() >= 1
    ids = m2.facts().filter("content = 'works at night'").select("entity_id", "uuid")
    m3 = Memory(store, HashEmbedder(16), as_of=dt.datetime(2024, 2, 3))
    m3.pin(ids)
    m3.pin(ids.withColumn("entity_id", F.lit("someone else")))
    assert [r.pinned for r in m3.facts().orderBy("content").collect()] == [False, False, True]
    assert "Anna likes green tea" in m3.context(asked).first().context
    for t in TABLES:
        assert store.read(t).count() >= 0


def test_qa_dataset(spark, tmp_path):
    from mnemosa.sources.stores import read_qa_dataset

    turn = lambda s, t: {"speaker": s, "dia_id": "D1:1", "text": t}
    entry = {"qa": [{"question": "Who?", "answer": "Ann", "evidence": ["D1:1"], "category": 4}], "conversation": {"speaker_a": "Ann", "speaker_b": "Bo", "session_10": [turn("Bo", "late")], "session_2": [turn("Ann", "hi"), turn("Bo", "yo")], "session_2_date_time": "4:04 pm on 20 January, 2023"}}
    path = tmp_path / "d.json"
    path.write_text(json.dumps([entry]))
    turns, questions = read_qa_dataset(spark, str(path))
    got = [(r.session_no, str(r.session_date), r.turn_no, r.role, r.text) for r in turns.orderBy("session_no", "turn_no").collect()]
    assert got == [(2, "2023-01-20", 1, "user", "hi"), (2, "2023-01-20", 2, "assistant", "yo"), (10, "None", 1, "assistant", "late")]
    assert questions.first().ground_truth == "Ann"


@pytest.mark.parametrize("block", [3, 2_048])
def test_best_match_of_every_fact_equals_brute_force(spark, monkeypatch, block):
    from mnemosa.plans.memory_queries import QUERIES

    assert "semantic_duplicates" in QUERIES
    monkeypatch.setattr(Q, "BLOCK", block)
    r = random.Random(3)
    rows = []
    for i in range(60):
        base = rows[r.randrange(len(rows))][2] if rows and r.random() < 0.6 else [r.gauss(0, 1) for _ in range(r.choice((4, 4, 6)))]
        vec = [x + r.gauss(0, 0.05) for x in base] if base and r.random() < 0.6 else list(base or [0.0] * 4)
        rows.append((r.choice(("hot", "hot", "cold")), f"u{i:02}", vec, T0 + dt.timedelta(days=r.randrange(5)) if r.random() < 0.9 else None))
    rows += [("hot", "z0", [0.0] * 4, T0), ("hot", "z1", [], T0), ("hot", "z2", None, T0), ("lone", "z3", [1.0] * 4, T0)]
    facts = spark.createDataFrame(rows, "entity_id string, uuid string, vec array<float>, created_at timestamp_ntz")
    want = Q.best_match(facts.withColumnRenamed("uuid", "new_id").drop("created_at"), facts.withColumnRenamed("uuid", "old_id"), 0.92).collect()
    got = Q.best_match_within(facts, 0.92).collect()
    assert len(want) > 20 and {(x.entity_id, x.new_id, x.old_id, x.cos) for x in got} == {(x.entity_id, x.new_id, x.old_id, x.cos) for x in want}
    assert Q.best_match_within(facts.limit(0), 0.92).count() == 0
