"""Stores keep what is written, and the verbs of Memory work end to end with stub models."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from mnemosa.api import Config, Memory
from mnemosa.functions.vectors import HashEmbedder
from mnemosa.sources.stores import JdbcStore, ParquetStore, list_runs, read_run, write_run

NOW = dt.datetime(2024, 2, 1)
NEW = "entity_id string, seq int, content string, significance int"


def memory(spark, tmp_path, at=NOW, **config):
    return Memory(ParquetStore(spark, str(tmp_path / "store")), HashEmbedder(16), Config(**config), as_of=at)


def state(m):
    return {r.content: (r.pinned, r.significance, r.reinforced_count) for r in m.facts().collect()}


def test_writes_of_one_object_follow_each_other(spark, tmp_path):
    m = memory(spark, tmp_path)
    m.add(spark.createDataFrame([("e", 1, "likes tea", 5), ("e", 2, "has a cat", 4), ("f", 1, "sings", 3)], NEW))
    ids = m.facts().filter("content = 'likes tea'").select("entity_id", "uuid")
    m.pin(ids)
    assert state(m)["likes tea"] == (True, 10, 0)
    m.unpin(ids)
    m.pin(ids.withColumn("entity_id", F.lit("f")))  # not its own
    assert state(m)["likes tea"] == (False, 10, 0)
    m.confirm(ids)
    m.add(spark.createDataFrame([("e", 1, "Likes TEA!", 5), ("e", 2, "likes tea", 5)], NEW))
    assert state(m) == {"likes tea": (False, 10, 3), "has a cat": (False, 4, 0), "sings": (False, 3, 0)}
    assert m.delete(ids.withColumn("entity_id", F.lit("f"))) == 0 and m.delete(ids) == 1 and m.delete(ids) == 0
    assert set(state(m)) == {"has a cat", "sings"}
    late = memory(spark, tmp_path, NOW + dt.timedelta(days=7, seconds=1))
    assert late.prune() == (2, 0) and late.facts().count() == 0
    late.add(spark.createDataFrame([("e", 1, "has a cat", 5), ("g", 1, "x", 5)], NEW))  # a deleted fact can come back
    assert set(state(late)) == {"has a cat", "x"} and late.entity_ids().count() == 2
    assert late.delete_all(spark.createDataFrame([("e",)], "entity_id string")) == 1 and set(state(late)) == {"x"}
    late.store.compact("entity_fact")
    assert set(state(late)) == {"x"} and late.store.last_change("entity_fact") > 5


def test_events_delete_and_unknown_tables(spark, tmp_path):
    from mnemosa.operators.lifecycle import EVENT

    m = memory(spark, tmp_path)
    m.add(spark.createDataFrame([("e", 1, "a", 5), ("e", 2, "b", 5)], NEW))
    uuid = m.facts().filter("content = 'a'").first().uuid
    m.apply(spark.createDataFrame([(uuid, 1, "delete", NOW, None, None, None), ("nobody", 1, "pin", NOW, None, None, None)], EVENT))
    assert set(state(m)) == {"b"}
    with pytest.raises(ValueError):
        m.store.read("nothing")
    first = m.ensure_entities(spark.createDataFrame([("x",), ("x",), (None,)], "external_id string")).collect()
    assert len(first) == 1 and first == m.ensure_entities(spark.createDataFrame([("x",)], "external_id string")).collect()


def test_database_store(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    store = JdbcStore(spark, url, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert store.read("entity_fact").count() == 0
    m = Memory(store, HashEmbedder(8), as_of=NOW)
    done = m.add(spark.createDataFrame([("e", 1, "likes tea", 5), ("e", 2, "has a cat", 10)], NEW))
    assert {r.action for r in done.collect()} == {"insert"}  # also when asked after the write
    rows = {r.content: r for r in m.facts().collect()}
    assert len(rows["likes tea"].embedding) == 8 and rows["has a cat"].expires_at is None
    m.pin(m.facts().filter("content = 'likes tea'").select("entity_id", "uuid"))
    assert state(m)["likes tea"][0] and m.delete_all(spark.createDataFrame([("e",)], "entity_id string")) == 2 and m.facts().count() == 0
    mentions = spark.createDataFrame([("s", "e", ["Anna", "Bo"])], "uuid string, entity_id string, entity_mentions array<string>")
    store.append("session", mentions)
    assert store.read("session").first().entity_mentions == ["Anna", "Bo"]


def said(*rows):
    return [("e", c, NOW + dt.timedelta(seconds=i), f"m{c}{i}", r, t) for i, (c, r, t) in enumerate(rows)]


MSG = "entity_id string, conversation_id string, created_at timestamp, uuid string, role string, content string"


def test_extraction_is_stored(spark, tmp_path):
    m = memory(spark, tmp_path)
    m.add(spark.createDataFrame([("e", 1, "drinks tea", 5)], NEW))
    uuid = m.facts().first().uuid
    from mnemosa.operators.lifecycle import EVENT

    m.apply(spark.createDataFrame([(uuid, 1, "engagement", NOW, 0.5, None, None)], EVENT))
    rows = m.facts().withColumns({"slot": F.lit("drink")})
    m.store.append("entity_fact", rows)

    def model(prompts):
        assert all("user: I now drink coffee" in p for p in prompts)
        return ['[{"content": "drinks coffee", "type": "identity", "slot": " Drink ", "significance": 7}, {"content": "Drinks TEA"}, {"content": "drinks coffee"}, {"content": ""}]' for _ in prompts]

    messages = spark.createDataFrame(said(("c", "user", "I now drink coffee"), ("c", "assistant", "ok"), ("d", "user", "thanks")), MSG)
    out = m.extract(messages, model).first()
    assert (out.inserted, out.reinforced, out.superseded) == (1, 2, 1)
    got = {r.content: r for r in m.facts().collect()}
    assert set(got) == {"drinks tea", "drinks coffee"}
    assert (got["drinks coffee"].slot, got["drinks coffee"].reinforced_count, got["drinks coffee"].source_role) == ("drink", 1, "mixed")
    assert (got["drinks tea"].temporal_status, got["drinks tea"].superseded_by, got["drinks tea"].reinforced_count) == ("historical", got["drinks coffee"].uuid, 1)


def test_consolidation_is_stored(spark, tmp_path):
    m = memory(spark, tmp_path)
    events = [("e", i, f"ran {i} miles", "event", "hobby") for i in range(4)] + [("e", 9, "saw a film", "event", "other")]
    m.add(spark.createDataFrame([(e, s, c, 4, t, g) for e, s, c, t, g in events], NEW + ", fact_type string, tag string"))
    old = m.facts().withColumns({"reference_time": F.lit("2023-11-01"), "expires_at": F.lit(None).cast("timestamp")})
    m.store.append("entity_fact", old)
    out = m.consolidate(lambda ps: ["Runs often " for p in ps]).collect()
    assert [(r.tag, r.pattern, r.old_id) for r in out] == [("hobby", "Runs often", None)]
    got = {r.content: r for r in m.facts().collect()}
    assert got["Runs often"].fact_type == "pattern" and got["ran 1 miles"].superseded_by == got["Runs often"].uuid and got["saw a film"].temporal_status == "current"
    again = m.facts().filter("content LIKE 'ran%'").withColumn("temporal_status", F.lit("current"))
    m.store.append("entity_fact", again)
    assert m.consolidate(lambda ps: ["Runs often" for p in ps]).first().old_id == got["Runs often"].uuid
    after = {r.content: r for r in m.facts().collect()}
    assert after["Runs often"].reinforced_count == 1 and after["ran 2 miles"].superseded_by == "consolidated" and len(after) == 6
    assert m.consolidate(lambda ps: ["none" for p in ps]).count() == 0


def test_sessions_chat_summaries_and_artifacts(spark, tmp_path):
    m = memory(spark, tmp_path, working_turns=2)
    m.add(spark.createDataFrame([("e", 1, "Anna likes green tea", 8)], NEW))
    asked = spark.createDataFrame([("e", 1, "user", "What tea does Anna like?"), ("e", 2, "system", "x")], "entity_id string, position int, role string, content string")
    seen = []

    def model(prompts):
        return [f"answer to: {p.splitlines()[-1]}" if "Anna likes green tea" in p else "lost" for p in prompts]

    out = m.chat(asked, model, lambda ps: ['[{"content": "asks about tea"}]' for _ in ps]).first()
    assert out.content.startswith("answer to:") and "Anna likes green tea" in out.context
    assert {r.content for r in m.facts().collect()} == {"Anna likes green tea", "asks about tea"}
    del seen
    soon = memory(spark, tmp_path, NOW + dt.timedelta(minutes=5), working_turns=2)
    soon.chat(asked.filter("position = 1"), model)
    sessions = soon.store.read("session").collect()
    assert [(s.message_count, s.expires_at) for s in sessions] == [(4, NOW + dt.timedelta(minutes=35))]
    assert soon.store.read("message").count() == 4 and soon.store.read("conversation").first().updated_at > NOW + dt.timedelta(minutes=4)
    late = memory(spark, tmp_path, NOW + dt.timedelta(hours=3), working_turns=2)
    assert late.ensure_sessions(spark.createDataFrame([("e",)], "entity_id string")).first().is_new and late.store.read("session").count() == 2
    late.store.append("message", spark.createDataFrame([(f"x{i}", late.store.read("message").first().conversation_id, "user", f"turn {i}", NOW + dt.timedelta(minutes=6 + i)) for i in range(6)], "uuid string, conversation_id string, role string, content string, created_at timestamp"))
    assert late.maintain_turn_summaries(lambda ps: ["sum"] * len(ps)) == (1, 0)
    assert [(t.start_turn, t.end_turn) for t in late.store.read("turn_summary").collect()] == [(1, 8)] and late.maintain_turn_summaries(lambda ps: ["sum"] * len(ps)) == (0, 0)
    c = late.store.read("turn_summary").first().conversation_id
    late.store.append("turn_summary", spark.createDataFrame([(f"t{i}", c, "e", 10 + i, 10 + i, f"r{i}", False, NOW) for i in range(3)], "uuid string, conversation_id string, entity_id string, start_turn int, end_turn int, summary string, is_overview boolean, created_at timestamp"))
    late.store.append("message", spark.createDataFrame([(f"y{i}", c, "user", f"turn {i}", NOW + dt.timedelta(minutes=30 + i)) for i in range(9)], "uuid string, conversation_id string, role string, content string, created_at timestamp"))
    assert late.maintain_turn_summaries(lambda ps: ["over"] * len(ps)) == (1, 1)
    kept = late.store.read("turn_summary").collect()
    assert len([t for t in kept if t.is_overview]) == 1 and len(kept) == 4  # two oldest ranges went into the overview
    running = late.ensure_sessions(spark.createDataFrame([("e",)], "entity_id string")).select("entity_id", "session_id")
    assert late.summarize(lambda ps: ["A talk about tea"] * len(ps), running).count() == 1
    assert late.store.read("conversation").filter("uuid = '%s'" % c).first().summary == "A talk about tea"
    code = spark.createDataFrame([("e", c, NOW, "z1", "user", "look\n```sql\nSELECT 1\n```")], MSG)
    assert late.store_artifacts(code, lambda ps: ["a query"] * len(ps)).count() == 1
    later = memory(spark, tmp_path, NOW + dt.timedelta(hours=4))
    later.store_artifacts(code.withColumn("content", F.replace("content", F.lit("1"), F.lit("2"))), lambda ps: ["a query"] * len(ps))
    assert sorted(r.superseded_by is None for r in later.store.read("artifact").collect()) == [False, True]
    q = spark.createDataFrame([("q", "e", "query?", c)], "query_id string, entity_id string, query string, conversation_id string")
    assert later.recall_artifacts(q).count() == 1
    text = later.context(q).first().context
    assert "Session context:\n- [Turns" in text and "```sql\n  SELECT 2" in text and "[Overview] over" in text
    assert later.tiered_context(q).first().formatted.startswith("[IDENTITY] Who this user is:")
    later.note_mentions()
    assert later.store.read("session").first().entity_mentions == ["Anna"]
    assert later.backfill() == 0 and later.list(5).count() == 2


def test_runs(spark, tmp_path):
    for run in ("r1", "r2"):
        write_run(spark.createDataFrame([(1, 0.5)], "question_id int, f1 double"), str(tmp_path / "runs"), run)
    assert [(r.run_id, r.n_results) for r in list_runs(spark, str(tmp_path / "runs")).collect()] == [("r2", 1), ("r1", 1)]
    assert json.loads(read_run(spark, str(tmp_path / "runs"), "r1").toJSON().first())["f1"] == 0.5
