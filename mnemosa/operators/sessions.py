"""Sessions, message histories and turn summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemosa.functions import text as X
from mnemosa.functions.keys import first_per_key
from mnemosa.operators.chunks import CHUNK, range_chunks, with_rank
from mnemosa.operators.recall import micros


def sessionize(touches: DataFrame, user: str, time: str, timeout_minutes: int = 30) -> DataFrame:
    """user, session_no, started_at, expires_at, n_touches: sessions that slide with each touch; a touch at the very end begins a new one.

    A user of any size is spread over range chunks; the last touch before a chunk and the
    number of sessions begun before it are carried by a table with one row per user and chunk.
    Touches without user or time belong to no session.
    """
    rows = touches.select(user, time).filter(F.col(user).isNotNull() & F.col(time).isNotNull())
    chunked = range_chunks(rows, [user], [time])
    across = Window.partitionBy(user).orderBy(CHUNK)
    local = Window.partitionBy(user, CHUNK).orderBy(time)
    edges = chunked.groupBy(user, CHUNK).agg(F.max(time).alias("_last")).select(user, CHUNK, F.lag("_last").over(across).alias("_edge"))
    gap = micros(time) - micros(F.coalesce(F.lag(time).over(local), F.col("_edge")))
    marked = chunked.join(edges, [user, CHUNK]).withColumn("_new", F.coalesce((gap >= timeout_minutes * 60_000_000).cast("int"), F.lit(1)))
    begun = marked.groupBy(user, CHUNK).agg(F.sum("_new").alias("_n"))
    begun = begun.select(user, CHUNK, F.coalesce(F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.sum("_new").over(local.rangeBetween(Window.unboundedPreceding, 0))
    numbered = marked.join(begun, [user, CHUNK]).withColumn("session_no", number)
    out = numbered.groupBy(user, "session_no").agg(F.min(time).alias("started_at"), F.max(time).alias("_last"), F.count(F.lit(1)).alias("n_touches"))
    return out.select(user, "session_no", "started_at", (F.col("_last") + F.expr(f"INTERVAL {timeout_minutes} MINUTE")).alias("expires_at"), "n_touches")


def normalize_messages(messages: DataFrame) -> DataFrame:
    """Messages of users and assistants with content, both trimmed; of repeated rows of a message the earliest."""
    role, content = X.jstrip("role"), X.jstrip("content")
    rows = messages.withColumns({"role": role, "content": content}).filter("role IN ('user', 'assistant') AND content <> ''")
    return first_per_key(rows, ["uuid"], [F.asc("created_at")])


def overlap(existing: Column, incoming: Column) -> Column:
    """The most messages that end `existing` and begin `incoming` (arrays)."""
    most = F.least(F.size(existing), F.size(incoming))
    tries = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array())
    fits = F.filter(tries, lambda k: F.slice(existing, -k, k) == F.slice(incoming, F.lit(1), k))
    return F.coalesce(F.array_max(fits), F.lit(0))


def new_messages(existing: Column, incoming: Column) -> Column:
    """The messages of `incoming` after the overlap."""
    k = overlap(existing, incoming)
    return F.slice(incoming, k + 1, F.greatest(F.size(incoming) - k, F.lit(0)))


def merge_history(existing: Column, incoming: Column) -> Column:
    return F.concat(existing, new_messages(existing, incoming))


#: Messages in a piece of a transcript.
PIECE = 64


def transcripts(messages: DataFrame, size: int = PIECE) -> DataFrame:
    """conversation_id, piece_no (from 0), n_messages, transcript: `role: content` lines in order, `size` messages a piece, so that no row or task holds a long conversation whole."""
    order = ["created_at", "uuid"]
    ranked = with_rank(range_chunks(messages.select("conversation_id", *order, "role", "content"), ["conversation_id"], order), ["conversation_id"], order)
    pieces = ranked.withColumn("piece_no", F.floor((F.col("rank") - 1) / size).cast("bigint"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "role", "content"))), lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return pieces.groupBy("conversation_id", "piece_no").agg(F.count(F.lit(1)).alias("n_messages"), F.array_join(lines, "\n").alias("transcript"))


def trivial_conversations(messages: DataFrame) -> DataFrame:
    """conversation_id, is_trivial: whether all its messages say nothing."""
    return messages.groupBy("conversation_id").agg(F.bool_and(F.coalesce(X.trivial("content"), F.lit(True))).alias("is_trivial"))


def turn_ranges(messages: DataFrame, turns: DataFrame, working: int = 10) -> DataFrame:
    """conversation_id, start_turn, end_turn: what to summarise next, leaving the last `working` messages.

    From the turn after the highest summarised one; nothing where that leaves no turn.
    """
    n = messages.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("_n"))
    done = turns.filter("NOT coalesce(is_overview, false)").groupBy("conversation_id").agg(F.max("end_turn").alias("_end"))
    rows = n.join(done, "conversation_id", "left").withColumn("_end", F.coalesce("_end", F.lit(0)))
    due = rows.filter((F.col("_n") > working) & (F.col("_end") < F.col("_n") - working))
    return due.select("conversation_id", (F.col("_end") + 1).cast("bigint").alias("start_turn"), (F.col("_n") - working).cast("bigint").alias("end_turn"))


def overview_merges(turns: DataFrame, most: int = 3, oldest: int = 2) -> DataFrame:
    """conversation_id, end_turn, n_inputs, text, inputs (uuids): the next overview of conversations with more than `most` ranges, of the old overview and the oldest ranges."""
    ranges = turns.filter("NOT coalesce(is_overview, false)")
    by = Window.partitionBy("conversation_id").orderBy("start_turn", "created_at", "uuid")
    many = ranges.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select("conversation_id")
    first = ranges.withColumn("_nth", F.row_number().over(by)).filter(F.col("_nth") <= oldest).join(many, "conversation_id")
    newest = Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), "uuid")
    over = turns.filter("is_overview").withColumn("_nth", F.row_number().over(newest)).filter("_nth = 1").withColumn("_nth", F.lit(0)).join(many, "conversation_id")
    parts = first.unionByName(over)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "summary"))), lambda x: F.coalesce(x["summary"], F.lit(""))), "\n")
    return parts.groupBy("conversation_id").agg(F.max("end_turn").alias("end_turn"), F.count(F.lit(1)).alias("n_inputs"), text.alias("text"), F.collect_list("uuid").alias("inputs"))


def chunks_of_turns(messages: DataFrame, size: int = 8) -> DataFrame:
    """conversation_id, chunk_no, n_messages: `size` messages each, in order, for extraction."""
    ranked = with_rank(range_chunks(messages.select("conversation_id", "created_at", "uuid"), ["conversation_id"], ["created_at", "uuid"]), ["conversation_id"], ["created_at", "uuid"])
    numbered = ranked.withColumn("chunk_no", F.floor((F.col("rank") - 1) / size))
    return numbered.groupBy("conversation_id", "chunk_no").agg(F.count(F.lit(1)).alias("n_messages"))
