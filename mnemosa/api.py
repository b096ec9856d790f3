"""The memory store as one object: every verb works on all entities a frame names, and returns frames."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemosa.functions.filters import FactFilter, significance_label
from mnemosa.functions.text import content_key, jstrip
from mnemosa.functions.vectors import Embedder, HashEmbedder, backfill, check_embedder, embed_udf
from mnemosa.operators import artifacts as A
from mnemosa.operators import context as C
from mnemosa.operators import lifecycle as L
from mnemosa.operators import models as M
from mnemosa.operators import proactive as P
from mnemosa.operators import recall as Q
from mnemosa.operators import scans as S
from mnemosa.operators import sessions as T
from mnemosa.operators.rank import RankOptions
from mnemosa.schema import with_defaults
from mnemosa.session import materialize, scratch
from mnemosa.sources.stores import Store


@dataclass(frozen=True)
class Config:
    recall_limit: int = 200
    recall_threshold: float = 0.05
    max_candidates: int = 0
    conscious_limit: int = 10
    token_budget: int = 4000
    summary_budget: int = 1000
    working_turns: int = 10
    session_minutes: int = 30
    extraction: str = "List what these messages tell about the user as a JSON array of objects with content, type, significance, tag, slot, confidence, reference_time, emotional_weight, emotional_valence, verbatim, started_at and thread_status."


class Memory:
    """Verbs over a store. `as_of` is the present; fixed at construction, so results can be repeated.

    Writes of one object follow each other by the store's change numbers, whatever its time.
    """

    def __init__(self, store: Store, embedder: Embedder | None = None, config: Config = Config(), as_of: datetime.datetime | None = None):
        self.store, self.embedder, self.config = store, embedder or HashEmbedder(), config
        check_embedder(self.embedder)
        now = as_of or datetime.datetime.now(datetime.timezone.utc)
        self.now: Column = F.lit(now.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")

    # facts -----------------------------------------------------------------------------

    def facts(self, columns: Sequence[str] | None = None) -> DataFrame:
        """The facts of entities as they are now, with defaults; with `columns`, no others are read."""
        keep = list(dict.fromkeys(["uuid", "entity_id", *columns])) if columns is not None else None
        return with_defaults(self.store.read("entity_fact", keep)).filter("entity_id IS NOT NULL")

    def entities(self) -> DataFrame:
        """entity_id, external_id of all entities."""
        return self.store.read("entity", ["uuid", "external_id"]).withColumnRenamed("uuid", "entity_id")

    def entity_ids(self) -> DataFrame:
        """The different entities that have facts."""
        return self.facts([]).select("entity_id").distinct()

    def ensure_entities(self, external: DataFrame) -> DataFrame:
        """entity_id, external_id of the named (external_id) entities, those new to the store added under an id made of their name."""
        made = F.substring(F.sha2(F.concat(F.lit("entity|"), "external_id"), 256), 1, 32)
        rows = external.select("external_id").filter("external_id IS NOT NULL").distinct()
        self.store.append_new("entity", rows.select(made.alias("uuid"), "external_id", self.now.alias("created_at")), "external_id")
        return self.entities().join(rows, "external_id", "left_semi")

    def _vector(self, text: str) -> Column:
        return embed_udf(self.embedder)(text)

    def _new_facts(self, rows: DataFrame) -> DataFrame:
        """`rows` (uuid, entity_id, content, ...) as facts, with what they lack."""
        given = {
            "embedding": self._vector("content"), "created_at": self.now, "updated_at": self.now, "fact_type": F.lit("identity"), "temporal_status": F.lit("current"), "content_key": content_key("content"),
            "reinforced_count": F.lit(0), "tag": F.lit(""), "slot": F.lit(""), "confidence": F.lit(1.0), "embedding_model": F.lit(self.embedder.model_name), "source_role": F.lit("user"), "recall_count": F.lit(0),
            "pinned": F.lit(False),
        }
        return rows.withColumns({c: v for c, v in given.items() if c not in rows.columns})

    def add(self, memories: DataFrame) -> DataFrame:
        """Adds memories (entity_id, seq, content, significance, and optionally fact_type, tag); returns what each did."""
        keyed = self.facts(["content_key", "content", "created_at"]).withColumn("content_key", F.when(F.col("content_key") == "", content_key("content")).otherwise(F.col("content_key")))
        done = materialize(L.add_memories(keyed, memories, self.now))
        extra = memories.groupBy("entity_id", content_key("content").alias("content_key")).agg(
            *[F.min_by(c, "seq").alias(c) if c in memories.columns else F.lit(d).alias(c) for c, d in (("fact_type", "identity"), ("tag", ""))]
        )
        new = done.filter("action = 'insert'").join(extra, ["entity_id", "content_key"])
        rows = self._new_facts(new.select("uuid", "entity_id", "content", "significance", "content_key", "expires_at", "fact_type", "tag", F.when(F.col("mentions") > 0, self.now).alias("reinforced_at"), F.col("mentions").cast("int").alias("reinforced_count")))
        touched = done.filter("action = 'reinforce'").select("uuid", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("mentions").cast("bigint"))).alias("seq"))
        events = self._events(touched.join(self.facts(["expires_at"]), "uuid"), "reinforce", text=F.col("expires_at").cast("string"))
        self._write_facts(rows.unionByName(self._changed(events), allowMissingColumns=True))
        return done

    def _events(self, rows: DataFrame, kind: str, text: Column | None = None, note: Column | None = None) -> DataFrame:
        """`rows` (uuid, and seq if there are several of one fact) as events (lifecycle.EVENT)."""
        none = F.lit(None)
        seq = F.col("seq") if "seq" in rows.columns else F.lit(1).cast("bigint")
        values = (seq.alias("seq"), F.lit(kind).alias("kind"), self.now.alias("at"), none.cast("double").alias("number"), (text if text is not None else none).cast("string").alias("text"), (note if note is not None else none).cast("string").alias("note"))
        return rows.select("uuid", *values)

    def _changed(self, events: DataFrame) -> DataFrame:
        """New versions of the facts that events touch."""
        touched = self.facts().join(events.select("uuid").distinct(), "uuid", "left_semi")
        return L.fold(touched, events).withColumn("updated_at", F.greatest("updated_at", self.now))

    def _write_facts(self, rows: DataFrame) -> None:
        with scratch():
            self.store.append("entity_fact", materialize(rows))

    def apply(self, events: DataFrame) -> None:
        """Writes the new state of the facts that events (lifecycle.EVENT) touch, and deletes those they delete."""
        with scratch():
            events = materialize(events)
            self.store.append("entity_fact", materialize(self._changed(events)))
            self.store.delete("entity_fact", events.filter("kind = 'delete'").select("uuid"))

    def _own(self, ids: DataFrame) -> DataFrame:
        """Of (entity_id, uuid) those that are the entity's own facts."""
        return ids.select("entity_id", "uuid").distinct().join(self.facts([]), ["entity_id", "uuid"], "left_semi")

    def pin(self, ids: DataFrame) -> None:
        self.apply(self._events(self._own(ids), "pin"))

    def unpin(self, ids: DataFrame) -> None:
        self.apply(self._events(self._own(ids), "unpin"))

    def confirm(self, ids: DataFrame) -> None:
        self.apply(self._events(self._own(ids), "confirm"))

    def resolve_thread(self, ids: DataFrame) -> None:
        self.apply(self._events(self._own(ids), "thread", text=F.lit("resolved")))

    def delete(self, ids: DataFrame) -> int:
        """Deletes facts (entity_id, uuid) of the entity itself; how many there were."""
        with scratch():
            gone = materialize(self._own(ids).select("uuid"))
            self.store.delete("entity_fact", gone)
            return gone.count()

    def delete_all(self, entities: DataFrame) -> int:
        """Deletes all facts of entities (entity_id); how many there were."""
        with scratch():
            gone = materialize(self.facts([]).join(entities.select("entity_id").distinct(), "entity_id", "left_semi").select("uuid"))
            self.store.delete("entity_fact", gone)
            return gone.count()

    def prune(self, summary_days: int = 90) -> tuple[int, int]:
        """Deletes expired facts and empties stale summaries; how many of each."""
        with scratch():
            gone = materialize(L.split_expired(self.facts(["expires_at"]), self.now).filter("expired").select("uuid"))
            self.store.delete("entity_fact", gone)
            talks = self.store.read("conversation").filter("coalesce(summary, '') <> ''")
            stale = materialize(L.prune_summaries(talks, self.now, summary_days).filter("summary = ''"))
            self.store.append("conversation", stale.withColumn("updated_at", F.greatest("updated_at", self.now)))
            return gone.count(), stale.count()

    def backfill(self, newest: int = 50) -> int:
        """Gives vectors to the newest facts without one of every entity; how many."""
        with scratch():
            lacking = L.split_expired(S.list_facts(self.facts(), newest, FactFilter(unembedded_only=True)).drop("rank_no"), self.now).filter("NOT expired").drop("expired")
            done = materialize(backfill(lacking, self.embedder).withColumn("updated_at", F.greatest("updated_at", self.now)))
            self.store.append("entity_fact", done)
            return done.count()

    # recall ----------------------------------------------------------------------------

    def questions(self, asked: DataFrame) -> DataFrame:
        """asked (query_id, entity_id, query) with vectors."""
        return asked.select("query_id", "entity_id", "query", self._vector("query").alias("query_vec"), F.lit(self.embedder.model_name).alias("query_model"))

    def search(self, asked: DataFrame, limit: int = 10, where: FactFilter = FactFilter()) -> tuple[DataFrame, DataFrame]:
        """Memories found for each question, and the recall events to apply."""
        options = RankOptions(limit=limit, threshold=self.config.recall_threshold)
        found = materialize(Q.recall_facts(self.facts(), self.questions(asked), self.now, options, where, self.config.max_candidates))
        events = self._events(found.select(F.col("id").alias("uuid"), F.monotonically_increasing_id().alias("seq")), "recall")
        text = self.facts(["content", "fact_type", "significance", "created_at"]).select(F.col("uuid").alias("id"), "content", "fact_type", significance_label("significance").alias("significance"), "created_at")
        return found.select("query_id", "entity_id", "id", "rank_no", "score").join(text, "id"), events

    def list(self, limit: int = 100, types: Sequence[str] = (), tags: Sequence[str] = ()) -> DataFrame:
        columns = [c for c in self.store.read("entity_fact").columns if c != "embedding"]
        return S.list_metadata(self.facts(columns), limit, FactFilter(types=types, tags=tags), self.now)

    def open_threads(self, limit: int = 20) -> DataFrame:
        return S.open_threads(self.facts(), limit)

    def proactive(self, limit: int = 3) -> DataFrame:
        return P.proactive(self.facts(), self.now, limit=limit)

    def _recalled(self, asked: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """What a context is made of: facts kept in mind, facts recalled, past conversations; by query_id and position."""
        facts = self.facts()
        text = facts.select("uuid", "content", "temporal_status", "reference_time", "tag", "confidence", "verbatim")
        questions = self.questions(asked)
        options = RankOptions(limit=limit, threshold=self.config.recall_threshold)
        named = lambda df: df.select("query_id", F.col("id").alias("uuid"), F.col("rank_no").alias("position"))
        recalled = named(Q.recall_facts(facts, questions, self.now, options, max_candidates=self.config.max_candidates)).join(text, "uuid")
        mind = Q.conscious(facts, self.now, self.config.conscious_limit).withColumnRenamed("rank_no", "position").join(text, "uuid").join(asked.select("query_id", "entity_id"), "entity_id")
        talks = self.store.read("conversation")
        past = named(Q.recall_summaries(talks, questions, RankOptions(limit=10, threshold=self.config.recall_threshold)))
        past = past.join(talks.select("uuid", F.col("summary").alias("content"), "created_at"), "uuid")
        return mind, recalled, past

    def context(self, asked: DataFrame) -> DataFrame:
        """query_id, context, tokens: the flat context of every question (query_id, entity_id, query, and optionally conversation_id, whose turn summaries and artifacts come in)."""
        mind, recalled, past = self._recalled(asked, self.config.recall_limit)
        session = artifacts = None
        if "conversation_id" in asked.columns:
            here = asked.select("query_id", "conversation_id").filter("conversation_id IS NOT NULL")
            session = C.session_lines(S.turn_summaries_in_order(self.store.read("turn_summary")).join(here, "conversation_id"), "query_id")
            artifacts = C.artifact_lines(S.active_artifacts(self.store.read("artifact"), limit=50).withColumnRenamed("rank_no", "position").join(here, "conversation_id"), "query_id")
        lines = C.flat_context("query_id", mind.select("query_id", "position", "content"), recalled, past, session, artifacts, C.Budget(self.config.token_budget, self.config.summary_budget))
        return C.render(lines, "query_id")

    def tiered_context(self, asked: DataFrame, most_personal: int | None = None, diversify: bool = False, floor: float = 0.3) -> DataFrame:
        """query_id, the text of each tier, total_tokens, formatted of every question (query_id, entity_id, query)."""
        mind, recalled, past = self._recalled(asked, self.config.recall_limit)
        facts, own = self.facts(), asked.select("query_id", "entity_id")
        if diversify:
            recalled = C.tag_cap(recalled.filter(F.coalesce("confidence", F.lit(0.5)) >= floor), "query_id")
        at = lambda df: df.withColumnRenamed("rank_no", "position").join(own, "entity_id")
        felt = S.list_facts(facts, 10, FactFilter(valences=C.FELT, exclude_expired=True), self.now)
        raised = at(P.proactive(facts, self.now)).select("query_id", "position", F.concat(F.lit("- ["), "kind", F.lit("] "), "content").alias("line"))
        sections = {
            "identity": C.identity_lines(mind, "query_id", floor), "emotional": C.emotional_lines(at(felt), "query_id", self.now, floor), "threads": C.thread_lines(at(S.open_threads(facts, 10)), "query_id", self.now, floor),
            "verified": C.recalled_lines(recalled, "query_id", True, floor), "inferred": C.recalled_lines(recalled, "query_id", False, floor), "proactive": raised, "past": C.past_lines(past, "query_id", self.now),
        }
        return C.tiered_context(sections, "query_id", C.Budget(self.config.token_budget, self.config.summary_budget), most_personal)

    # what models add ---------------------------------------------------------------------

    def extract(self, messages: DataFrame, model: M.Model) -> DataFrame:
        """Learns facts from messages (entity_id, conversation_id, created_at, uuid, role, content, and optionally position, topic, classification).

        A conversation here is any segment of one entity. Returns entity_id, inserted, reinforced, superseded.
        """
        rows = messages if "topic" not in messages.columns else M.segment_prefix(messages)
        owner = messages.groupBy("conversation_id").agg(F.min("entity_id").alias("entity_id"))
        asked = M.extraction_prompts(T.normalize_messages(rows), self.config.extraction)
        answers = M.call_model(asked, "prompt", model).select("conversation_id", "piece_no", F.posexplode(M.parse_list("answer")).alias("_at", "_f")).select("conversation_id", "piece_no", "_at", "_f.*")
        checked = M.validated(answers, self.now).join(owner, "conversation_id")
        extracted = materialize(checked.orderBy("entity_id", "conversation_id", "piece_no", "_at").withColumns({"seq": F.monotonically_increasing_id(), "vec": self._vector("content")}))
        facts = self.facts()
        keyed = facts.withColumn("content_key", F.when(F.col("content_key") == "", content_key("content")).otherwise(F.col("content_key")))
        done = materialize(L.ingest(keyed, extracted, self.now))
        made = extracted.join(done.filter("action = 'insert'").select("entity_id", "seq", "uuid"), ["entity_id", "seq"])
        fields = ["uuid", "entity_id", "content", "fact_type", "significance", "content_key", "reference_time", "expires_at", "tag", "slot", "confidence", "emotional_weight", "emotional_valence", "verbatim", "started_at", "thread_status"]
        new = self._new_facts(made.select(*fields, F.col("vec").alias("embedding"), F.lit("mixed").alias("source_role")))
        mentions = done.filter("action = 'reinforce'").select("entity_id", "seq", F.col("target").alias("uuid")).join(extracted.select("entity_id", "seq", "significance"), ["entity_id", "seq"])
        demoted = done.filter("action = 'supersede'")
        touched = facts.join(mentions.select("uuid").union(demoted.select("uuid")).distinct(), "uuid", "left_semi")
        folded = L.fold(touched, self._events(demoted, "status", text=F.lit("historical"), note=F.col("target")))
        all_ = L.reinforce(folded.unionByName(new, allowMissingColumns=True), mentions.select("uuid", "seq", "significance"), self.now)
        self._write_facts(all_.withColumn("updated_at", F.greatest("updated_at", self.now)))
        count = lambda a: F.count_if(F.col("action") == a)
        return done.groupBy("entity_id").agg(count("insert").alias("inserted"), count("reinforce").alias("reinforced"), count("supersede").alias("superseded"))

    def consolidate(self, model: M.Model, min_group: int = 3, newest: int = 500, days: int = 30, max_significance: int = 5) -> DataFrame:
        """Turns old minor events into patterns; returns entity_id, tag, uuid, pattern, and old_id where one like it was there and is reinforced instead."""
        facts = self.facts()
        events = L.old_events(facts, self.now, newest, days, max_significance)
        groups = L.consolidation_groups(facts, self.now, min_group, newest, days, max_significance)
        asked = groups.withColumn("prompt", F.concat(F.replace(F.lit(M.PATTERN_PROMPT), F.lit("{}"), F.col("n_facts").cast("string")), "lines"))
        said = M.call_model(asked, "prompt", model).withColumn("content", M.summary_of("answer")).filter("content IS NOT NULL")
        uuid = F.substring(F.sha2(F.concat_ws("|", F.lit("pattern"), "entity_id", "tag", "content", self.now.cast("string")), 256), 1, 32)
        made = materialize(said.select("entity_id", "tag", "content", uuid.alias("uuid"), self._vector("content").alias("embedding")))
        known = S.list_facts(facts.filter("fact_type = 'pattern' AND temporal_status = 'current'"), newest)
        fresh = made.withColumn("uuid", F.concat(F.lit("new|"), "uuid"))  # else the same pattern found again at the same time would be itself
        twins = L.duplicate_patterns(fresh, known).select(F.substring("new_id", 5, 64).alias("uuid"), "old_id")
        out = materialize(made.join(twins, "uuid", "left").select("entity_id", "tag", "uuid", F.col("content").alias("pattern"), "embedding", "old_id"))
        new = self._new_facts(out.filter("old_id IS NULL").select("uuid", "entity_id", F.col("pattern").alias("content"), "embedding", "tag", F.lit("pattern").alias("fact_type"), F.lit(max_significance).alias("significance"), F.lit("").alias("source_role")))
        spent = events.select("entity_id", "tag", F.col("uuid").alias("_event")).join(out.select("entity_id", "tag", "uuid", "old_id"), ["entity_id", "tag"])
        ended = self._events(spent.select(F.col("_event").alias("uuid"), F.when(F.col("old_id").isNull(), F.col("uuid")).otherwise("consolidated").alias("_by")), "status", text=F.lit("historical"), note=F.col("_by"))
        again = self._events(out.filter("old_id IS NOT NULL").select(F.col("old_id").alias("uuid"), F.monotonically_increasing_id().alias("seq")), "reinforce")
        changed = self._changed(ended.unionByName(again))
        self._write_facts(new.unionByName(changed, allowMissingColumns=True))
        return out.drop("embedding")

    def _pieces(self, messages: DataFrame, model: M.Model, prompt: str) -> DataFrame:
        """conversation_id, content: what a model says of each conversation; of a long one, of what it said of its pieces."""
        pieces = T.transcripts(messages).withColumn("prompt", F.concat(F.lit(prompt), "transcript"))
        said = materialize(M.call_model(pieces, "prompt", model).select("conversation_id", "piece_no", M.summary_of("answer").alias("content")).filter("content IS NOT NULL"))
        parts = said.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("_n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "content"))), lambda x: x["content"]), "\n").alias("content"))
        again = M.call_model(parts.filter("_n > 1").withColumn("prompt", F.concat(F.lit(M.OVERVIEW_PROMPT), "content")), "prompt", model).withColumn("content", M.summary_of("answer"))
        return parts.filter("_n = 1").select("conversation_id", "content").unionByName(again.filter("content IS NOT NULL").select("conversation_id", "content"))

    def summarize(self, model: M.Model, current_sessions: DataFrame | None = None) -> DataFrame:
        """Summarises the newest conversation without summary of every entity, outside the given sessions; returns conversation_id, content."""
        talks = self.store.read("conversation")
        due = S.unsummarized(talks, current_sessions)
        messages = T.normalize_messages(self.store.read("message").join(due.select(F.col("uuid").alias("conversation_id")), "conversation_id", "left_semi"))
        said = materialize(self._pieces(messages, model, M.SUMMARY_PROMPT + "\n\n"))
        told = talks.drop("summary", "summary_embedding", "summary_embedding_model").join(said.select(F.col("conversation_id").alias("uuid"), F.col("content").alias("summary"), self._vector("content").alias("summary_embedding")), "uuid")
        with scratch():
            self.store.append("conversation", materialize(told.withColumns({"summary_embedding_model": F.lit(self.embedder.model_name), "updated_at": F.greatest("updated_at", self.now)})))
        return said

    def maintain_turn_summaries(self, model: M.Model) -> tuple[int, int]:
        """Summarises the turns that left the working window, then folds the oldest ranges of conversations with more than three into their overview; how many of each."""
        messages = materialize(T.normalize_messages(self.store.read("message")))
        owner = self.store.read("conversation", ["uuid", "entity_id"]).select(F.col("uuid").alias("conversation_id"), "entity_id")
        due = T.turn_ranges(messages, self.store.read("turn_summary"), self.config.working_turns)
        order = ["created_at", "uuid"]
        ranked = T.with_rank(T.range_chunks(messages.join(due.select("conversation_id"), "conversation_id", "left_semi"), ["conversation_id"], order), ["conversation_id"], order)
        inside = ranked.join(due, "conversation_id").filter("rank BETWEEN start_turn AND end_turn")
        said = self._pieces(inside.drop("rank", "_chunk"), model, M.TURNS_PROMPT)
        uuid = lambda what: F.substring(F.sha2(F.concat_ws("|", F.lit(what), "conversation_id", "end_turn", self.now.cast("string")), 256), 1, 32)
        row = lambda df, overview: df.join(owner, "conversation_id", "left").select(uuid("overview" if overview else "turns").alias("uuid"), "conversation_id", "entity_id", F.col("start_turn").cast("int").alias("start_turn"), F.col("end_turn").cast("int").alias("end_turn"), F.col("content").alias("summary"), self._vector("content").alias("summary_embedding"), F.lit(overview).alias("is_overview"), self.now.alias("created_at"))
        ranges = materialize(row(said.join(due, "conversation_id"), False))
        self.store.append("turn_summary", ranges)
        merges = materialize(T.overview_merges(self.store.read("turn_summary")))
        asked = merges.withColumn("prompt", F.concat(F.lit(M.OVERVIEW_PROMPT), "text"))
        overviews = materialize(row(M.call_model(asked, "prompt", model).withColumn("content", M.summary_of("answer")).filter("content IS NOT NULL").withColumn("start_turn", F.lit(1)), True))
        spent = merges.join(overviews.select("conversation_id"), "conversation_id", "left_semi").select(F.explode("inputs").alias("uuid"))
        self.store.append("turn_summary", overviews)
        self.store.delete("turn_summary", spent)
        return ranges.count(), overviews.count()

    def store_artifacts(self, messages: DataFrame, model: M.Model) -> DataFrame:
        """Finds code and data in messages (entity_id, conversation_id, created_at, uuid, role, content), describes and stores them; those of the conversation they are close to are superseded. Returns the new ones."""
        owner = messages.groupBy("conversation_id").agg(F.min("entity_id").alias("entity_id"))
        found = A.detect_artifacts(messages).join(owner, "conversation_id")
        asked = found.withColumn("prompt", F.concat(F.lit(M.ARTIFACT_PROMPT), F.substring("content", 1, 500)))
        said = M.call_model(asked, "prompt", model).withColumn("description", jstrip(F.coalesce("answer", F.lit(""))))
        uuid = F.substring(F.sha2(F.concat_ws("|", F.lit("artifact"), "conversation_id", "content", self.now.cast("string")), 256), 1, 32)
        new = materialize(said.select(uuid.alias("uuid"), "conversation_id", "entity_id", "content", "artifact_type", "language", "description", self._vector("description").alias("description_embedding"), F.col("position").alias("turn_number"), self.now.alias("created_at")))
        there = self.store.read("artifact")
        gone = L.artifact_supersessions(new.withColumnRenamed("turn_number", "seq"), there)
        replaced = materialize(there.drop("superseded_by").join(gone, "uuid"))
        self.store.append("artifact", new.unionByName(replaced, allowMissingColumns=True))
        return new

    def recall_artifacts(self, asked: DataFrame, limit: int = 5) -> DataFrame:
        """The best artifacts for each question (query_id, entity_id, query, and optionally conversation_id: then only of that)."""
        rows = self.store.read("artifact")
        if "conversation_id" in asked.columns:
            rows = rows.join(asked.select("entity_id", "conversation_id").distinct(), ["entity_id", "conversation_id"], "left_semi")
        return Q.recall_artifacts(rows, self.questions(asked), RankOptions(limit=limit, threshold=self.config.recall_threshold))

    # sessions and talks ------------------------------------------------------------------

    def ensure_sessions(self, entities: DataFrame, process: str = "default") -> DataFrame:
        """entity_id, session_id, conversation_id, is_new: each entity's running session, prolonged, or a new one with a new conversation."""
        minutes = F.expr(f"INTERVAL {self.config.session_minutes} MINUTE")
        old = self.store.read("session").filter(F.col("process_id") == process).filter(F.col("expires_at") > self.now)
        newest = S.first_in_group(old, "entity_id", [F.desc("created_at"), F.asc("uuid")], 1).drop("rank_no")
        asked = entities.select("entity_id").filter("entity_id IS NOT NULL").distinct()
        made = lambda what: F.substring(F.sha2(F.concat_ws("|", F.lit(what), "entity_id", F.lit(process), self.now.cast("string")), 256), 1, 32)
        rows = asked.join(newest, "entity_id", "left").withColumn("is_new", F.col("uuid").isNull())
        rows = materialize(rows.withColumns({"uuid": F.coalesce("uuid", made("session")), "process_id": F.lit(process), "created_at": F.coalesce("created_at", self.now), "expires_at": self.now + minutes, "message_count": F.coalesce("message_count", F.lit(0))}))
        self.store.append("session", rows.drop("is_new"))
        talks = S.active_conversations(self.store.read("conversation")).select(F.col("session_id"), F.col("uuid").alias("conversation_id"))
        out = materialize(rows.select("entity_id", F.col("uuid").alias("session_id"), "is_new").join(talks, "session_id", "left").withColumn("_none", F.col("conversation_id").isNull()).withColumn("conversation_id", F.coalesce("conversation_id", made("conversation"))))
        fresh = out.filter("_none").select(F.col("conversation_id").alias("uuid"), "session_id", "entity_id", F.lit("").alias("summary"), self.now.alias("created_at"), self.now.alias("updated_at"))
        self.store.append("conversation", fresh)
        return out.select("entity_id", "session_id", "conversation_id", "is_new")

    def save_messages(self, messages: DataFrame) -> None:
        """Stores messages (conversation_id, uuid, role, content, created_at) with text; their conversations are touched and their sessions count them."""
        with scratch():
            rows = materialize(messages.withColumn("content", jstrip("content")).filter("content <> ''").withColumn("kind", F.lit("text")))
            self.store.append("message", rows)
            talks = materialize(self.store.read("conversation").join(rows.groupBy(F.col("conversation_id").alias("uuid")).agg(F.count(F.lit(1)).alias("_n"), F.max("created_at").alias("_at")), "uuid"))
            self.store.append("conversation", talks.withColumn("updated_at", F.greatest("updated_at", "_at")))
            counted = talks.groupBy(F.col("session_id").alias("uuid")).agg(F.sum("_n").cast("int").alias("_n"))
            self.store.append("session", materialize(self.store.read("session").join(counted, "uuid").withColumn("message_count", F.coalesce("message_count", F.lit(0)) + F.col("_n"))))

    def note_mentions(self) -> None:
        """Stores in every session what its entity's facts mention first."""
        found = A.entity_mentions(self.facts(["content", "created_at"])).groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "mention"))), lambda m: m["mention"]).alias("_m"))
        with scratch():
            self.store.append("session", materialize(self.store.read("session").join(found, "entity_id").withColumn("entity_mentions", F.col("_m"))))

    def chat(self, messages: DataFrame, model: M.Model, extractor: M.Model | None = None) -> DataFrame:
        """Answers each entity's messages (entity_id, position, role, content): recalls, asks, stores the exchange and, with an extractor, learns from it. Returns entity_id, content, context."""
        sessions = self.ensure_sessions(messages)
        here = sessions.select("entity_id", "conversation_id")
        history = S.recent_messages(self.store.read("message").join(here.select("conversation_id"), "conversation_id", "left_semi"), self.config.working_turns)
        history = history.join(here, "conversation_id").select("entity_id", (F.col("position") - 1_000_000).cast("bigint").alias("position"), "role", "content")
        all_ = materialize(history.unionByName(messages.select("entity_id", F.col("position").cast("bigint").alias("position"), "role", "content")))
        asked = M.last_user_message(all_, "entity_id").select(F.col("entity_id").alias("query_id"), "entity_id", F.col("content").alias("query"))
        contexts = self.context(asked).select(F.col("query_id").alias("entity_id"), "context")
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "role", "content"))), lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
        prompts = all_.filter("content IS NOT NULL").groupBy("entity_id").agg(lines.alias("_talk")).join(contexts, "entity_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
        prompts = prompts.withColumn("prompt", F.concat(F.when(F.col("context") != "", F.concat("context", F.lit("\n\n"))).otherwise(""), "_talk"))
        answers = materialize(M.call_model(prompts, "prompt", model).select("entity_id", F.col("answer").alias("content"), "context"))
        uuid = F.substring(F.sha2(F.concat_ws("|", F.lit("message"), "conversation_id", "role", "content", self.now.cast("string")), 256), 1, 32)
        said = M.last_user_message(messages, "entity_id").withColumns({"role": F.lit("user"), "_late": F.lit(0)}).unionByName(answers.select("entity_id", "content").withColumns({"role": F.lit("assistant"), "_late": F.lit(1)}))
        said = said.join(here, "entity_id").select("conversation_id", uuid.alias("uuid"), "role", "content", F.timestamp_micros(F.unix_micros(self.now) + F.col("_late")).alias("created_at"))
        self.save_messages(said)
        if extractor is not None:
            whole = M.exchange(all_, answers, "entity_id").withColumns({"conversation_id": F.col("entity_id"), "created_at": F.timestamp_micros(F.unix_micros(self.now) + F.col("position")), "uuid": F.concat_ws("|", "entity_id", "position")})
            self.extract(whole.drop("position"), extractor)
        return answers
