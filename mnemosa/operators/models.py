"""Language-model steps: prompts, calls in batches, and answers read back. The model is any function from prompts to texts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemosa.functions import text as X
from mnemosa.operators.lifecycle import expiry
from mnemosa.operators.sessions import PIECE, transcripts

Model = Callable[[Sequence[str]], Sequence[str]]

# What goes around memories that are put before a request.
BLOCK = ("[Memory Context]\nThe following are relevant memories about this user:\n", "\n[End Memory Context]")
#: The questions put to a model.
SUMMARY_PROMPT = (
    "Sum up this conversation in two to five sentences: its subjects, what was decided, what is left open, and what it tells about the user. "
    "Leave out what nobody would want to remember. If nothing is left, answer NONE and nothing else."
)
TURNS_PROMPT = "Sum up these turns of a conversation in at most 200 tokens: decisions, questions, code, data, open points.\n\n"
OVERVIEW_PROMPT = "Make one overview of these summaries, in at most 300 tokens.\n\n"
PATTERN_PROMPT = "These {} events have a subject in common. State in one sentence the habit or tendency they show, or answer NONE if they show none.\n\n"
ARTIFACT_PROMPT = "Say in one sentence what this code or data is: "

EXTRACTED = (
    "content string, type string, significance int, tag string, slot string, confidence double, reference_time string, emotional_weight double, emotional_valence string, "
    "verbatim string, started_at string, thread_status string"
)
_LIST = "array<struct<" + ",".join(f"{p.split()[0]}:{p.split()[1]}" for p in EXTRACTED.split(", ")) + ">>"


def call_model(rows: DataFrame, prompt: str, model: Model, out: str = "answer", batch: int = 16, retries: int = 3) -> DataFrame:
    """`rows` with the model's answer to each prompt; null where the prompt is null or all tries failed.

    Filter before calling: nothing is pushed through the call. Retries wait 1, 2, 4 s.
    """

    def ask(prompts: list[str]) -> list[str | None]:
        for attempt in range(retries + 1):
            try:
                return list(model(prompts))
            except Exception:  # noqa: BLE001
                if attempt < retries:
                    time.sleep(2**attempt)
        return [None] * len(prompts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            answers = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
            there = pdf.index[pdf[prompt].notna()]
            for at in range(0, len(there), batch):
                part = there[at : at + batch]
                for i, a in zip(part, ask(pdf.loc[part, prompt].tolist())):
                    answers[i] = a
            pdf[out] = answers
            yield pdf

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", `{out}` string"
    return rows.mapInPandas(run, schema)


def segment_prefix(messages: DataFrame) -> DataFrame:
    """`messages` (position, content, topic, classification) with lines for topic and classification before the content of position 1."""
    line = lambda c, name: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), F.col(c), F.lit("\n"))).otherwise("")
    head = F.concat(line("topic", "Topic"), line("classification", "Classification"))
    return messages.withColumn("content", F.when(F.col("position") == 1, F.concat(head, "content")).otherwise(F.col("content")))


def extraction_prompts(messages: DataFrame, instructions: str, size: int = PIECE) -> DataFrame:
    """conversation_id, piece_no, prompt of conversations that say something, by pieces of `size` messages."""
    from mnemosa.operators.sessions import trivial_conversations

    worth = trivial_conversations(messages).filter("NOT is_trivial").select("conversation_id")
    lines = transcripts(messages.join(worth, "conversation_id", "left_semi"), size)
    return lines.select("conversation_id", "piece_no", F.concat(F.lit(instructions + "\n\n"), "transcript").alias("prompt"))


def last_user_message(messages: DataFrame, group: str = "conversation_id") -> DataFrame:
    """`group`, content of the last message of a user with text, by position."""
    said = messages.filter((F.col("role") == "user") & (F.coalesce("content", F.lit("")) != ""))
    return said.groupBy(group).agg(F.max_by("content", "position").alias("content"))


def exchange(messages: DataFrame, answers: DataFrame, group: str = "conversation_id") -> DataFrame:
    """`group`, position, role, content: the messages of users and assistants with text, and the answer (group, content) after them."""
    said = messages.filter(F.col("role").isin("user", "assistant") & (F.coalesce("content", F.lit("")) != "")).select(group, F.col("position").cast("bigint").alias("position"), "role", "content")
    end = messages.groupBy(group).agg(F.max("position").alias("_last"))
    added = answers.filter(F.coalesce("content", F.lit("")) != "").join(end, group, "left")
    return said.unionByName(added.select(group, (F.coalesce("_last", F.lit(0)) + 1).cast("bigint").alias("position"), F.lit("assistant").alias("role"), "content"))


def memory_block(memories: DataFrame, group: str) -> DataFrame:
    """`group`, block: memories (group, position, content) as the text that goes before a request."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "content"))), lambda m: F.concat(F.lit("- "), m["content"])), "\n")
    return memories.filter("content IS NOT NULL").groupBy(group).agg(F.concat(F.lit(BLOCK[0]), lines, F.lit(BLOCK[1])).alias("block"))


def parse_list(answer: Column | str) -> Column:
    """The facts of an answer: as JSON, without a code fence, from the first to the last bracket, or whatever flat objects read."""
    raw = X.jstrip(answer)
    bare = F.regexp_replace(raw, r"^```[A-Za-z]*\s*|\s*```$", "")
    inner = F.regexp_extract(bare, r"(?s)\[.*\]", 0)
    read = lambda c: F.from_json(F.when(F.try_parse_json(c).isNotNull() & F.startswith(X.jstrip(c), F.lit("[")), c), _LIST)
    flat = F.filter(F.regexp_extract_all(bare, F.lit(r"\{[^{}]*\}"), F.lit(0)), lambda j: F.try_parse_json(j).isNotNull())
    salvaged = F.from_json(F.concat(F.lit("["), F.array_join(flat, ","), F.lit("]")), _LIST)
    return F.coalesce(read(raw), read(bare), read(F.when(inner != "", inner)), salvaged)


def validated(extracted: DataFrame, today: Column) -> DataFrame:
    """Extracted facts (EXTRACTED and others) with values in range; empty and overlong ones go.

    `expires_at` follows from the significance, from `today` on.
    """
    content = X.jstrip(F.coalesce("content", F.lit("")))
    iso = lambda c: F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.col(c))
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))
    low = lambda c: F.lower(X.jstrip(F.col(c)))
    rows = extracted.withColumn("content", content).filter((F.col("content") != "") & (F.length("content") <= 1000))
    tag = F.coalesce(low("tag"), F.lit(""))
    verbatim = X.jstrip("verbatim")
    started = iso("started_at")
    kind = F.coalesce(low("type"), F.lit(""))
    rows = rows.withColumns(
        {
            "fact_type": F.when(kind.isin("event", "pattern"), kind).otherwise("identity"),
            "significance": F.coalesce(F.when(F.col("significance").between(1, 10), F.col("significance")), F.lit(5)),
            "confidence": F.coalesce(F.when(F.col("confidence").isNotNull(), clamp("confidence")), F.lit(0.5)),
            "reference_time": F.coalesce(iso("reference_time"), F.lit("")),
            "tag": F.when((tag == "") | tag.isin(*X.TAGS), tag).otherwise("other"),
            "emotional_weight": F.when(F.col("emotional_weight").isNotNull() & ~F.isnan("emotional_weight"), clamp("emotional_weight")),
            "emotional_valence": F.when(low("emotional_valence").isin(*X.VALENCES), low("emotional_valence")),
            "verbatim": F.when(verbatim != "", F.substring(verbatim, 1, 300)),
            "started_at": F.when((started >= "1900-01-01") & (started <= F.date_format(today, "yyyy-MM-dd")), started),
            "thread_status": F.when(low("thread_status") == "open", "open"),
            "slot": F.coalesce(low("slot"), F.lit("")),
        }
    )
    return rows.withColumns({"content_key": X.content_key("content"), "expires_at": expiry("significance", today)}).drop("type")


def summary_of(answer: Column | str) -> Column:
    """A model's summary, null where it says NONE or nothing."""
    s = X.jstrip(answer)
    return F.when((F.upper(s) != "NONE") & (s != ""), s)


def judged(answer: Column | str) -> Column:
    return F.startswith(F.upper(X.jstrip(answer)), F.lit("CORRECT"))
