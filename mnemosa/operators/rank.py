"""Hybrid ranking: dense, lexical, entity and temporal channels, fused by reciprocal rank, for all queries at once.

Candidates and queries meet on `entity_id`. No step holds a query's candidates in one task:
corpus statistics and maxima are map-side combined aggregates joined back, and ranks are
cut by a bounded limit that also runs before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemosa.functions import text as X
from mnemosa.functions.vectors import admissible, cosine
from mnemosa.session import materialize

# Constants of the lexical score and of the fusion.
K1, B, RRF_K = 1.2, 0.75, 60
#: Scores are rounded before they are ranked, so that ties don't hang on the order of summation.
DIGITS = 6

CANDIDATE = ["id", "content", "created_at", "reference_time", "temporal_status", "confidence", "emotional_weight", "pinned", "thread_status", "engagement_score", "significance", "tag"]


@dataclass(frozen=True)
class RankOptions:
    limit: int = 200
    threshold: float = 0.05
    emotional_boost: float = 0.05
    pinned_boost: float = 1.10
    diversify: bool = False

    @property
    def window(self) -> int:
        return max(4 * self.limit, 100)


def with_query_parts(queries: DataFrame) -> DataFrame:
    """queries (query_id, entity_id, query, query_vec, query_model) with terms, entities, dates and intent."""
    return queries.withColumns(
        {"_terms": X.tokens("query"), "_entities": X.query_entities("query"), "_dates": X.query_dates("query"), "_intent": X.temporal_intent("query")}
    )


def bm25(candidates: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """`candidates` (query_id, content, _terms, ...) with `lexical`: Okapi BM25 over each query's own candidates, as a share of its best.

    A term that the query repeats counts again. If no candidate has a word, all scores are 0.
    """
    rows = candidates.withColumn("_words", X.tokens("content"))
    rows = rows.withColumns({"_len": F.size("_words"), "_tf": F.transform("_terms", lambda t: F.size(F.filter("_words", lambda w: w == t)))}).drop("_words")
    corpus = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"))
    hits = rows.select("query_id", F.posexplode("_tf").alias("_pos", "_hit")).filter("_hit > 0").groupBy("query_id", "_pos").agg(F.count(F.lit(1)).alias("_df"))
    frequencies = hits.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("_pos", "_df"))).alias("_dfs"))
    rows = rows.join(corpus, "query_id").join(frequencies, "query_id", "left")

    def part(tf: Column, pos: Column) -> Column:
        df = F.coalesce(F.try_element_at("_dfs", pos), F.lit(0))
        idf = F.log((F.col("_n") - df + 0.5) / (df + 0.5) + 1.0)
        return F.when(tf > 0, idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.try_divide(F.col("_len"), F.col("_avg"))))).otherwise(0.0)

    raw = F.aggregate(F.transform("_tf", part), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    rows = rows.withColumn("_raw", raw).drop("_tf", "_len", "_n", "_avg", "_dfs")
    best = rows.groupBy("query_id").agg(F.max("_raw").alias("_best"))
    return rows.join(best, "query_id").withColumn("lexical", F.round(F.when(F.col("_best") > 0, F.col("_raw") / F.col("_best")).otherwise(0.0), DIGITS)).drop("_raw", "_best")


def score(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Channel scores of every candidate for every query of its entity; written once, as four rankings read it."""
    joined = candidates.join(with_query_parts(queries), "entity_id")
    joined = joined.withColumns(
        {
            "dense": F.round(cosine(admissible("vec", "model", "query_vec", "query_model"), "query_vec"), DIGITS),
            "matches": X.entity_matches("_entities", "content"),
            "_boost": F.when(F.col("_intent") & (F.coalesce("reference_time", F.lit("")) != ""), X.temporal_boost("_dates", "_intent", "reference_time")),
            "confidence": F.when(F.col("confidence") <= 0, 1.0).otherwise(F.col("confidence")),
        }
    ).drop("vec", "model", "query_vec", "query_model", "_entities", "_dates", "query")
    rows = bm25(joined).drop("_terms")
    entity = F.when(F.col("matches") > 0, F.col("matches") + 0.35 * F.col("lexical") + 0.15 * F.col("dense")).otherwise(0.0)
    temporal = F.when(F.col("_intent") & F.col("_boost").isNotNull(), F.col("_boost") + 0.35 * F.col("matches") + 0.15 * F.col("lexical") + 0.1 * F.col("dense")).otherwise(0.0)
    rows = rows.withColumns({"entity_score": F.round(entity, DIGITS), "temporal_score": F.round(temporal, DIGITS)}).drop("_boost", "_intent", "content")
    return materialize(rows)


def fuse(scored: DataFrame, window: int) -> DataFrame:
    """query_id, id, fused, tie: reciprocal ranks summed over the channels, the first `window` per query."""
    newest = [F.desc("created_at"), F.asc("id")]
    ranked = None
    for i, channel in enumerate(("dense", "lexical", "entity_score", "temporal_score")):
        by = Window.partitionBy("query_id").orderBy(F.desc(channel), *newest)
        part = scored.filter(F.col(channel) > 0).select("query_id", "id", channel, "created_at").withColumn("_rank", F.row_number().over(by)).filter(F.col("_rank") <= window)
        part = part.select("query_id", "id", "_rank", F.lit(i).alias("_channel"))
        ranked = part if ranked is None else ranked.unionByName(part)
    fused = ranked.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("_rank"))), 9).alias("fused"), F.min(F.col("_channel") * 1_000_000 + F.col("_rank")).alias("tie"))
    top = Window.partitionBy("query_id").orderBy(F.desc("fused"), F.asc("tie"))
    return fused.withColumn("_rank", F.row_number().over(top)).filter(F.col("_rank") <= window).drop("_rank")


def _rounded(score: Column) -> Column:
    """Rounded with halves up, whatever the last bit of a half is."""
    return F.round(score + 1e-9, DIGITS)


def adjusted(options: RankOptions) -> Column:
    """The fused score as a share of the best, times and plus what a fact's state says."""
    out = F.col("_share")
    out = out * F.when(F.col("temporal_status") == "historical", 0.95).otherwise(1.0)
    out = out * F.when(F.col("confidence") < 1.0, 0.95 + 0.05 * F.col("confidence")).otherwise(1.0)
    out = out * (1.0 + options.emotional_boost * F.coalesce("emotional_weight", F.lit(0.0)))
    out = out * F.when(F.col("pinned"), options.pinned_boost).otherwise(1.0)
    out = out * F.when(F.col("thread_status") == "open", 1.03).otherwise(1.0)
    out = out * (1.0 + 0.02 * F.coalesce("engagement_score", F.lit(0.0)))
    return out + 0.1 * 0.15 * F.least(F.col("matches"), F.lit(2))


def rank(candidates: DataFrame, queries: DataFrame, options: RankOptions = RankOptions()) -> DataFrame:
    """query_id, entity_id, id, score, rank_no and the channel scores of the best candidates of every query.

    candidates: entity_id, vec, model and CANDIDATE. queries: query_id, entity_id, query,
    query_vec, query_model. The cut is made on the adjusted score; a thousandth of the
    significance is added after it.
    """
    scored = score(candidates, queries)
    fused = fuse(scored, options.window)
    rows = fused.join(scored, ["query_id", "id"])
    whole, best = Window.partitionBy("query_id"), [F.desc("score"), F.desc("fused"), F.asc("tie")]  # equal scores keep the fused order
    rows = rows.withColumn("_share", F.try_divide(F.col("fused"), F.max("fused").over(whole)))
    rows = rows.withColumn("score", _rounded(adjusted(options))).filter(F.col("score") >= options.threshold)
    rows = rows.withColumn("_no", F.row_number().over(whole.orderBy(*best))).filter(F.col("_no") <= options.limit)
    rows = rows.withColumn("score", _rounded(F.col("score") + 0.001 * F.col("significance")))
    if options.diversify:
        rows = diversify(rows)
    final = whole.orderBy(*best)
    keep = ["query_id", "entity_id", "id", "score", "rank_no", "dense", "lexical", "matches", "entity_score", "temporal_score", "tag"]
    return rows.withColumn("rank_no", F.row_number().over(final)).select(*keep)


def diversify(rows: DataFrame) -> DataFrame:
    """Scores of results beyond a tag's share of 60 % lowered by 15 %; lists of up to two stay."""
    whole, tags = Window.partitionBy("query_id"), Window.partitionBy("query_id", "tag")
    n = F.count(F.lit(1)).over(whole)
    nth = F.row_number().over(tags.orderBy(F.desc("score"), F.desc("fused"), F.asc("tie")))
    most = F.greatest(F.lit(1), F.floor(n * 0.6))
    return rows.withColumn("score", F.when((n > 2) & (nth > most), _rounded(F.col("score") * 0.85)).otherwise(F.col("score")))


def kneedle(ranked: DataFrame) -> DataFrame:
    """Results up to the point where scores bend most, if they drop sharply; at least ten. `ranked` as from rank."""
    whole = Window.partitionBy("query_id")
    n, top, low = F.count(F.lit(1)).over(whole), F.max("score").over(whole), F.min("score").over(whole)
    rows = ranked.withColumns({"_n": n, "_top": top, "_low": low})
    bend = (1.0 - F.try_divide(F.col("rank_no") - 1, F.col("_n") - 1)) - F.try_divide(F.col("score") - F.col("_low"), F.col("_top") - F.col("_low"))
    rows = rows.withColumn("_bend", F.round(bend, 9))
    best = rows.groupBy("query_id").agg(F.max("_bend").alias("_most"), F.max_by("rank_no", F.struct("_bend", -F.col("rank_no"))).alias("_at"))
    rows = rows.join(best, "query_id")
    cut = F.when((F.col("_n") <= 5) | (F.col("_top") - F.col("_low") < 1e-9) | (F.col("_most") < 0.3), F.col("_n")).otherwise(F.greatest(F.col("_at") - 1, F.least(F.lit(10), F.col("_n"))))
    return rows.filter(F.col("rank_no") <= cut).select(*ranked.columns)
