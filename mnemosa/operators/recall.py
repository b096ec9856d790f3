"""Recall of facts, summaries and artifacts, and the facts always kept in mind."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemosa.functions.filters import FactFilter
from mnemosa.operators.rank import CANDIDATE, RankOptions, rank
from mnemosa.operators.scans import first_in_group, list_facts, summaries

DAY_US = 86_400_000_000
#: Facts of an entity in a block of best_match_within, on average at most.
BLOCK = 2_048


def _candidates(df: DataFrame, **columns: Column) -> DataFrame:
    given = {c: F.lit(None) for c in [*CANDIDATE, "vec", "model"]} | {
        "significance": F.lit(0), "confidence": F.lit(1.0), "emotional_weight": F.lit(0.0), "pinned": F.lit(False), "engagement_score": F.lit(0.0), "temporal_status": F.lit("current"),
        "reference_time": F.lit(""), "thread_status": F.lit(None).cast("string"), "tag": F.lit(""),
    }
    given |= columns
    return df.select("entity_id", *[given[c].alias(c) for c in [*CANDIDATE, "vec", "model"]])


def fact_candidates(facts: DataFrame, as_of: Column, where: FactFilter = FactFilter(), max_candidates: int = 0) -> DataFrame:
    """Facts that haven't expired and meet the filter, as candidates; the newest `max_candidates` of an entity, 0 for all."""
    alive = FactFilter(exclude_expired=True).condition(as_of) & where.condition(as_of)
    rows = facts.filter(alive)
    if max_candidates > 0:
        rows = list_facts(rows, max_candidates)
    same = {c: F.col(n) for c, n in {**{c: c for c in CANDIDATE if c != "id"}, "vec": "embedding", "model": "embedding_model"}.items() if n in rows.columns}
    return _candidates(rows, id=F.col("uuid"), **same)


def recall_facts(facts: DataFrame, queries: DataFrame, as_of: Column, options: RankOptions = RankOptions(), where: FactFilter = FactFilter(), max_candidates: int = 0) -> DataFrame:
    return rank(fact_candidates(facts, as_of, where, max_candidates), queries, options)


def recall_summaries(conversations: DataFrame, queries: DataFrame, options: RankOptions = RankOptions(limit=10), newest: int = 100) -> DataFrame:
    """The best of the newest 100 summaries of each entity."""
    rows = summaries(conversations, newest)
    cands = _candidates(rows, id=F.col("uuid"), content=F.col("summary"), created_at=F.col("created_at"), vec=F.col("summary_embedding"), model=F.coalesce("summary_embedding_model", F.lit("")))
    return rank(cands, queries, options)


def recall_artifacts(artifacts: DataFrame, queries: DataFrame, options: RankOptions = RankOptions(limit=5)) -> DataFrame:
    """The best artifacts of each entity by their descriptions."""
    rows = artifacts.filter("superseded_by IS NULL")
    cands = _candidates(rows, id=F.col("uuid"), content=F.col("description"), created_at=F.col("created_at"), vec=F.col("description_embedding"), model=F.lit(""), significance=F.lit(5))
    return rank(cands, queries, options)


def micros(c: Column | str) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def conscious(facts: DataFrame, as_of: Column, limit: int = 10) -> DataFrame:
    """entity_id, rank_no, uuid, staleness_score of the facts always kept in mind.

    Of the newest max(5 * limit, 50) current facts the first by significance; an identity
    fact below 10 loses up to half of it from the 30th day without mention or recall.
    """
    pool = list_facts(facts.filter((F.col("temporal_status") == "current") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of))), max(5 * limit, 50))
    idle = (micros(as_of) - micros(F.greatest("created_at", "reinforced_at", "last_recalled_at"))) / DAY_US
    worn = F.when((F.col("fact_type") == "identity") & (F.col("significance") < 10) & (idle > 30), 1.0 - F.least((idle - 30) / 90, F.lit(0.5))).otherwise(1.0)
    scored = pool.withColumn("staleness_score", F.round(F.col("significance") * worn, 6))
    out = first_in_group(scored.drop("rank_no"), "entity_id", [F.desc("staleness_score"), F.asc("uuid")], limit)
    return out.select("entity_id", "rank_no", "uuid", "staleness_score")


def newest_questions(conversations: DataFrame) -> DataFrame:
    """One query per entity: its newest summary with its vector."""
    newest = summaries(conversations, 1)
    return newest.select(
        F.col("entity_id").alias("query_id"), "entity_id", F.col("summary").alias("query"), F.col("summary_embedding").alias("query_vec"), F.coalesce("summary_embedding_model", F.lit("")).alias("query_model")
    )


def best_match(new: DataFrame, existing: DataFrame, least: float) -> DataFrame:
    """entity_id, new_id, old_id, cos: of each new vector (entity_id, new_id, vec) the closest existing one (entity_id, old_id, vec, created_at) of its entity, if close enough.

    The join is on the entity; the partial maximum runs before the shuffle.
    """
    from mnemosa.functions.vectors import cosine

    pairs = new.withColumnRenamed("vec", "_a").join(existing.withColumnRenamed("vec", "_b"), "entity_id").filter("new_id <> old_id")
    close = pairs.withColumn("cos", F.round(cosine("_a", "_b"), 6)).filter(F.col("cos") >= least)
    window = Window.partitionBy("entity_id", "new_id").orderBy(F.desc("cos"), F.desc("created_at"), F.asc("old_id"))
    return close.withColumn("_n", F.row_number().over(window)).filter("_n = 1").select("entity_id", "new_id", "old_id", "cos")


def best_match_within(facts: DataFrame, least: float) -> DataFrame:
    """As best_match with every vector (entity_id, uuid, vec, created_at) as new one against all others of its entity; exact, `least` above 0.

    An entity's vectors of one length are dealt into blocks, and each pair of blocks is one
    task's matrix product, so memory is bounded and a hot entity spans many tasks. The work
    grows with the square of an entity's facts, the shuffle with that square by the block's size.
    """
    rows = facts.filter(F.size("vec") > 0).select("entity_id", "uuid", "created_at", "vec", F.size("vec").alias("_dim"))
    sizes = rows.groupBy("entity_id", "_dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("_blocks"))
    dealt = rows.join(sizes, ["entity_id", "_dim"]).withColumn("_mine", F.pmod(F.xxhash64("uuid"), F.col("_blocks")).cast("int"))
    paired = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    paired = paired.withColumn("_low", F.least("_mine", "_other")).withColumn("_high", F.greatest("_mine", "_other")).drop("_other", "_blocks")

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        # In the order of preference among equals, so that the first maximum of a row is its match.
        rows = rows.sort_values(["created_at", "uuid"], ascending=[False, True], na_position="last", ignore_index=True)
        with np.errstate(all="ignore"):
            vecs = np.stack(rows["vec"]).astype(np.float64)
            vecs = np.nan_to_num(vecs / np.sqrt((vecs * vecs).sum(1, keepdims=True)), nan=0.0, posinf=0.0, neginf=0.0)
        low = rows["_mine"].to_numpy() == rows["_low"].to_numpy()
        sides = [(np.flatnonzero(low), np.flatnonzero(~low)), (np.flatnonzero(~low), np.flatnonzero(low))] if not low.all() else [(np.arange(len(rows)),) * 2]
        found = [pd.DataFrame({"entity_id": [], "new_id": [], "old_id": [], "cos": [], "created_at": rows["created_at"].iloc[:0]})]
        for new, old in sides:
            if not len(new) or not len(old):
                continue
            cos = np.round(vecs[new] @ vecs[old].T, 6)
            cos[new[:, None] == old[None, :]] = -1.0
            best = cos.argmax(1)
            top = cos[np.arange(len(new)), best]
            kept = top >= least
            match = rows.iloc[old[best[kept]]]
            found.append(pd.DataFrame({"entity_id": rows["entity_id"].iloc[0], "new_id": rows["uuid"].to_numpy()[new[kept]], "old_id": match["uuid"].to_numpy(), "cos": top[kept], "created_at": match["created_at"].to_numpy()}))
        return pd.concat(found[1:] or found).astype({c: object for c in ("entity_id", "new_id", "old_id")})

    types = dict(facts.dtypes)
    schema = f"entity_id string, new_id string, old_id string, cos double, created_at {types['created_at']}"
    close = paired.groupBy("entity_id", "_dim", "_low", "_high").applyInPandas(match, schema)
    window = Window.partitionBy("entity_id", "new_id").orderBy(F.desc("cos"), F.desc("created_at"), F.asc("old_id"))
    return close.withColumn("_n", F.row_number().over(window)).filter("_n = 1").select("entity_id", "new_id", "old_id", "cos")
