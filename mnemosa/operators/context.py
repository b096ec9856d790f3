"""Context within a token budget.

A section takes lines in order until one doesn't fit, and what fits hangs on the sections
before it. The lines of a query are few (bounded by the limits of the scans and of recall),
so they come together in one array per query and are folded in one pass over the queries,
by Arrow batches; nothing is written in between.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemosa.functions import text as X

# Headings of the flat context.
HEADERS = {"profile": "User profile:", "session": "\nSession context:", "recalled": "\nRelevant context from memory:", "artifacts": "\nRelevant code/data:", "summaries": "\nRelevant past conversations:"}


@dataclass(frozen=True)
class Budget:
    total: int = 4000
    summaries: int = 1000


def n_words(text: str) -> int:
    return len([w for w in re.split("[\t\n\x0b\x0c\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+", text) if w])


def estimate(text: str) -> int:
    """What X.estimate_tokens gives for one text."""
    n = n_words(text)
    return math.ceil(n * 1.3) if n else math.ceil(len(text) * 2 / 3)


def _fold(lines: DataFrame, query: str, item: str, fold: Callable[[list[dict]], list[tuple]], out: str) -> DataFrame:
    """`fold` over each query's lines (`section`, `position`, and what `item` names besides), in order; `out` is the schema of what it gives."""
    fields = ["section_no", "position", *item.split(", ")]
    lists = lines.groupBy(query).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_items"))
    names = [c.split(" ")[0] for c in out.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [(q, *row) for q, items in zip(pdf[query], pdf["_items"]) for row in fold([dict(zip(fields, x.values())) if isinstance(x, dict) else x.asDict() for x in items])]
            yield pd.DataFrame(found, columns=[query, *names], dtype=object)

    return lists.mapInPandas(run, f"`{query}` {dict(lines.dtypes)[query]}, {out}")


_SECTIONS = tuple(HEADERS)


def _flat(budget: Budget):
    def fold(items: list[dict]) -> list[tuple]:
        used, seen, out = 0, set(), []
        for no, section in enumerate(_SECTIONS):
            mine = [x for x in items if x["section_no"] == no]
            if not mine:
                continue
            spent = 0 if section == "profile" else estimate(HEADERS[section] + "\n")
            room = budget.total - used
            if section == "summaries":
                room = min(budget.summaries, room)
                if room <= 0:
                    continue
            taken = []
            for x in mine:
                if x["norm"] is not None:
                    if x["norm"] in seen:
                        continue
                    seen.add(x["norm"])
                cost = estimate(x["line"] + "\n")
                if spent + cost > room and not (section == "recalled" and len(taken) < 5):
                    break
                taken.append((section, x["position"], x["line"], cost))
                spent += cost
            if taken:
                out += taken
                used += spent
        return out

    return fold


def flat_context(query: str, profile: DataFrame, recalled: DataFrame, summaries: DataFrame, session: DataFrame | None = None, artifacts: DataFrame | None = None, budget: Budget = Budget()) -> DataFrame:
    """query, section, position, line, tokens of every query's context.

    profile, recalled: query, position, content (recalled also temporal_status and
    reference_time); session: query, position, line; artifacts: query, position, line;
    summaries: query, position, content, created_at. Memories that an earlier line already
    said are left out, also if that was the first that didn't fit its section; the first
    five recalled ones may exceed the budget. Null contents say nothing and are left out.
    """
    bullet = lambda c: F.concat(F.lit("- "), c)
    mark = F.concat(F.when(F.col("temporal_status") == "historical", "[historical] ").otherwise(""), F.when(F.coalesce("reference_time", F.lit("")) != "", F.concat(F.lit("["), "reference_time", F.lit("] "))).otherwise(""))
    dated = F.concat(F.lit("- ["), F.date_format("created_at", "MMM d, yyyy"), F.lit("] "), F.col("content"))
    given = {"profile": (profile, bullet(F.col("content")), True), "session": (session, F.col("line"), False), "recalled": (recalled, bullet(F.concat(mark, "content")), True), "artifacts": (artifacts, F.col("line"), False), "summaries": (summaries, dated, True)}
    lines = None
    for no, section in enumerate(_SECTIONS):
        df, line, said = given[section]
        if df is None:
            continue
        norm = X.dedup_text("content") if said else F.lit(None).cast("string")
        part = df.select(query, F.lit(no).alias("section_no"), F.col("position").cast("int").alias("position"), line.alias("line"), norm.alias("norm")).filter("line IS NOT NULL")
        lines = part if lines is None else lines.unionByName(part)
    return _fold(lines, query, "line, norm", _flat(budget), "section string, position int, line string, tokens bigint")


def session_lines(turns: DataFrame, query: str) -> DataFrame:
    """query, position, line of turn summaries (query, position, start_turn, end_turn, is_overview, summary)."""
    span = F.concat(F.lit("- [Turns "), F.col("start_turn").cast("string"), F.lit("-"), F.col("end_turn").cast("string"), F.lit("] "))
    return turns.select(query, "position", F.concat(F.when(F.coalesce("is_overview", F.lit(False)), "- [Overview] ").otherwise(span), F.coalesce("summary", F.lit(""))).alias("line"))


def artifact_lines(artifacts: DataFrame, query: str) -> DataFrame:
    """query, position, line of artifacts (query, position, artifact_type, language, description, content); code of a known language in a fence."""
    language = F.coalesce("language", F.lit(""))
    head = F.concat(F.lit("- ["), "artifact_type", F.when(language != "", F.concat(F.lit(":"), language)).otherwise(""), F.lit("] "), F.coalesce("description", F.lit("")), F.lit("\n"))
    fenced = F.concat(F.lit("  ```"), language, F.lit("\n  "), "content", F.lit("\n  ```"))
    return artifacts.select(query, "position", F.concat(head, F.when((F.col("artifact_type") == "code") & (language != ""), fenced).otherwise(F.concat(F.lit("  "), "content"))).alias("line"))


def render(lines: DataFrame, query: str) -> DataFrame:
    """query, context, tokens: the lines of each query as one text."""
    order = {s: i for i, s in enumerate(HEADERS)}
    no = F.element_at(F.create_map(*[F.lit(x) for s, i in order.items() for x in (s, i)]), F.col("section"))
    head = F.element_at(F.create_map(*[F.lit(x) for s, h in HEADERS.items() for x in (s, h)]), F.col("section"))
    text = lines.withColumns({"_no": no, "_head": head}).groupBy(query, "_no", "_head").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n").alias("_t"))
    whole = text.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_no", F.concat("_head", F.lit("\n"), "_t").alias("t")))), lambda x: x["t"]), "\n").alias("context"))
    return whole.withColumn("tokens", X.estimate_tokens("context"))


def confidence_label(c: Column | str) -> Column:
    c = X.col(c)
    return F.when(c >= 0.8, "verified").when(c >= 0.5, "likely").otherwise("inferred")


def identity_lines(profile: DataFrame, query: str, floor: float = 0.3) -> DataFrame:
    """query, position, tag, line of facts kept in mind (query, position, content, tag, confidence, verbatim), by tag in the order tags first appear."""
    said = F.when(F.coalesce("verbatim", F.lit("")) != "", F.concat(F.lit(' | User said: "'), F.replace("verbatim", F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise("")
    rows = profile.filter(F.coalesce("confidence", F.lit(1.0)) >= floor).withColumn("tag", F.when(F.coalesce("tag", F.lit("")) == "", "general").otherwise(F.col("tag")))
    rows = rows.withColumn("_first", F.min("position").over(Window.partitionBy(query, "tag")))
    at = F.row_number().over(Window.partitionBy(query).orderBy("_first", "position"))
    return rows.select(query, at.alias("position"), "tag", F.concat(F.lit("- "), "content", F.lit(" ("), confidence_label(F.coalesce("confidence", F.lit(1.0))), F.lit(")"), said).alias("line"))


def identity_section(profile: DataFrame, query: str, total: int = 4000, floor: float = 0.3, most: int | None = None) -> DataFrame:
    """query, tag, position, line of the identity tier: facts by tag in the order tags first appear; a tag ends at the first line that doesn't fit, later tags may still fit.

    An ordered fold over the few facts kept in mind for a query.
    """
    head = 7  # ceil(1.3 * 5) words of the heading
    line = F.concat(F.lit("- "), "content", F.lit(" ("), confidence_label("confidence"), F.lit(")"), F.when(F.coalesce("verbatim", F.lit("")) != "", F.concat(F.lit(' | User said: "'), F.replace("verbatim", F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(""))
    rows = profile.filter(F.coalesce("confidence", F.lit(1.0)) >= floor).withColumns({"tag": F.when(F.coalesce("tag", F.lit("")) == "", "general").otherwise(F.col("tag")), "line": line})
    rows = rows.withColumn("cost", X.estimate_tokens(F.concat("line", F.lit("\n"))))
    rows = rows.withColumn("_tag_at", F.min("position").over(Window.partitionBy(query, "tag")))
    lists = rows.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("_tag_at", "position", "tag", "line", "cost"))).alias("facts"))
    limit = most if most is not None else 1 << 30
    folded = lists.withColumn(
        "kept",
        F.expr(
            f"""aggregate(facts, named_struct('used', cast({head} as bigint), 'n', 0, 'closed', cast(-1 as int), 'kept', cast(array() as array<struct<tag:string,position:int,line:string>>)),
        (a, f) -> if(a.closed = f._tag_at OR a.n >= {limit} OR a.used + f.cost > {total},
          named_struct('used', a.used, 'n', a.n, 'closed', f._tag_at, 'kept', a.kept),
          named_struct('used', a.used + f.cost, 'n', a.n + 1, 'closed', a.closed, 'kept', concat(a.kept, array(named_struct('tag', f.tag, 'position', f.position, 'line', f.line))))),
        a -> a.kept)"""
        ),
    )
    return folded.select(query, F.posexplode("kept").alias("_i", "k")).select(query, (F.col("_i") + 1).alias("line_no"), "k.tag", "k.position", "k.line")


def tag_cap(lines: DataFrame, query: str, share: float = 0.4) -> DataFrame:
    """`lines` (query, position, tag) with at most a share of them from one tag, the first ones."""
    n = F.count(F.lit(1)).over(Window.partitionBy(query))
    nth = F.row_number().over(Window.partitionBy(query, "tag").orderBy("position"))
    return lines.withColumn("_keep", nth <= F.greatest(F.lit(1), F.ceil(n * share))).filter("_keep").drop("_keep")


def window_turns(total: Column, used: Column, default: int) -> Column:
    """How many recent turns fit: one per 200 tokens left, at least 4, at most `default`."""
    return F.greatest(F.lit(4), F.least(F.lit(default), F.floor(F.greatest(total - used, F.lit(800)) / 200))).cast("int")


# Headings of the tiered context.
TIER_HEADERS = {
    "identity": "[IDENTITY] Who this user is:", "emotional": "[EMOTIONAL STATE] Recent emotional context:", "threads": "[OPEN THREADS] Unresolved topics to follow up on:",
    "verified": "[RECALLED CONTEXT — VERIFIED] Facts the user explicitly stated:", "inferred": "[RECALLED CONTEXT — INFERRED] Likely facts based on conversation patterns:",
    "proactive": "[PROACTIVE CONTEXT] Consider naturally weaving in:", "session": "[SESSION CONTEXT] Current conversation:", "past": "[PAST CONVERSATIONS] Previous sessions:",
}


# Feelings that a tiered context tells of.
FELT = ("grief", "joy", "anxiety", "hope", "love", "anger", "fear", "pride")


def _quoted(verbatim: str, lead: str) -> Column:
    """What the user said, in quotes, where there is a verbatim."""
    escaped = F.replace(verbatim, F.lit('"'), F.lit('\\"'))
    return F.when(F.coalesce(verbatim, F.lit("")) != "", F.concat(F.lit(f'{lead}User said: "'), escaped, F.lit('"'))).otherwise("")


def emotional_lines(facts: DataFrame, query: str, now: Column, floor: float = 0.3) -> DataFrame:
    """facts (query, position, content, confidence, verbatim, created_at), newest first."""
    c = F.coalesce("confidence", F.lit(0.5))
    sure = F.when(c >= 0.8, ", confidence: high").when(c >= 0.5, ", confidence: medium").otherwise("")
    line = F.concat(F.lit("- "), "content", F.lit(" ("), X.relative_date(F.col("created_at").cast("timestamp"), now), sure, F.lit(")"), _quoted("verbatim", "\n  "))
    newest = Window.partitionBy(query).orderBy(F.desc("created_at"), "position")
    return facts.filter(c >= floor).select(query, F.row_number().over(newest).alias("position"), line.alias("line"))


def thread_lines(facts: DataFrame, query: str, now: Column, floor: float = 0.3) -> DataFrame:
    """facts (query, position, content, confidence, tag, started_at)."""
    began = F.when(F.coalesce("started_at", F.lit("")) != "", F.concat(F.lit(", started "), X.relative_date(F.try_to_timestamp("started_at"), now))).otherwise("")
    tag = F.when(F.coalesce("tag", F.lit("")) == "", "General").otherwise(F.col("tag"))
    line = F.concat(F.lit("- "), tag, F.lit(": "), "content", F.lit(" (still open"), F.coalesce(began, F.lit("")), F.lit(")"))
    return facts.filter(F.coalesce("confidence", F.lit(0.5)) >= floor).select(query, "position", line.alias("line"))


def past_lines(summaries: DataFrame, query: str, now: Column) -> DataFrame:
    """query, position, line of past conversations (query, position, content, created_at)."""
    return summaries.select(query, "position", F.concat(F.lit("- ["), X.relative_date(F.col("created_at").cast("timestamp"), now), F.lit("] "), "content").alias("line"))


def recalled_lines(facts: DataFrame, query: str, verified: bool, floor: float = 0.3) -> DataFrame:
    """facts (query, position, content, confidence, verbatim): those said outright, or those only likely, hedged."""
    c = F.coalesce("confidence", F.lit(0.5))
    rows = facts.filter((c >= floor) & ((c >= 0.8) if verified else (c < 0.8)))
    lowered = F.concat(F.lower(F.substring("content", 1, 1)), F.substring("content", 2, 1 << 30))
    said = F.col("content") if verified else F.concat(F.when(c >= 0.5, "May be ").otherwise("Possibly "), lowered)
    line = F.concat(F.lit("- "), said, F.lit(" (confidence: "), F.format_number(c, 1), F.lit(")"), _quoted("verbatim", " | "))
    return rows.select(query, "position", line.alias("line"))


#: The sections of the tiered context: name, tier, and whether its lines count as personal facts.
TIERS = (
    ("identity", "semantic", True), ("emotional", "emotional", True), ("threads", "proactive", True), ("verified", "episodic", False), ("inferred", "episodic", False), ("proactive", "proactive", False),
    ("session", "working", False), ("past", "past", False),
)
_TIER_TEXTS = ("semantic", "emotional", "episodic", "proactive", "working", "past")


def _tiered(budget: Budget, most_personal: int | None):
    """One query's lines to its texts by tier, their tokens, and the whole."""

    def fold(items: list[dict]) -> list[tuple]:
        texts: dict[str, str] = {}
        used, personal = 0, 0
        room = lambda spent, cost, cap: spent + cost <= (budget.total - used if cap is None else cap)
        done = 0
        while done < len(TIERS):
            name, tier, counts = TIERS[done]
            group = [done, done + 1] if name == "verified" else [done]  # both parts of what is recalled are one text
            done += len(group)
            cap = min(budget.summaries, budget.total - used) if name == "past" else None
            if cap is not None and cap <= 0:
                continue
            lines, taken, spent = [], 0, 0
            for no in group:
                mine = [x for x in items if x["section_no"] == no]
                if not mine:
                    continue
                if lines:
                    lines.append("")
                lines.append(TIER_HEADERS[TIERS[no][0]])
                spent += estimate(lines[-1] + "\n")
                closed = None
                for x in mine:
                    if closed is not None and (closed == x["tag"] or name != "identity"):
                        continue
                    cost = estimate(x["line"] + "\n")
                    if counts and most_personal is not None and personal >= most_personal or not room(spent, cost, cap):
                        closed = x["tag"]
                        if name != "identity":
                            break
                        continue
                    lines.append(x["line"])
                    spent, taken, personal = spent + cost, taken + 1, personal + counts
            if not lines or not taken and name != "verified":
                continue
            text = "\n".join(lines)
            old = texts.get(tier)
            texts[tier] = text if old is None else f"{old}\n\n{text}"
            used += estimate(texts[tier]) - (estimate(old) if old is not None else 0)
        whole = "\n\n".join(texts.values()).rstrip("\n")
        return [(*[texts.get(t, "") for t in _TIER_TEXTS], used, whole)]

    return fold


def tiered_context(sections: dict[str, DataFrame], query: str, budget: Budget = Budget(), most_personal: int | None = None) -> DataFrame:
    """query, the text of each tier (semantic, emotional, episodic, proactive, working, past), total_tokens and formatted, the whole.

    sections: for names of TIERS their lines (query, position, line, and for identity tag),
    as from identity_lines, emotional_lines, thread_lines, recalled_lines, session_lines. A
    section takes lines until one doesn't fit; in identity only the line's tag ends there.
    `most_personal` bounds the lines of the first three together. Things to bring up join the
    text of the open threads. A tier's tokens are estimated on its whole text. Queries without
    a line have no row.
    """
    lines = None
    for no, (name, _, _) in enumerate(TIERS):
        if name not in sections:
            continue
        df = sections[name]
        tag = F.col("tag") if "tag" in df.columns else F.lit("")
        part = df.select(query, F.lit(no).alias("section_no"), F.col("position").cast("int").alias("position"), F.col("line"), tag.alias("tag")).filter("line IS NOT NULL")
        lines = part if lines is None else lines.unionByName(part)
    texts = ", ".join(f"{t} string" for t in _TIER_TEXTS)
    return _fold(lines, query, "line, tag", _tiered(budget, most_personal), f"{texts}, total_tokens bigint, formatted string")
