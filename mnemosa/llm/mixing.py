"""Sources mixed to target shares of all tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemosa.functions.keys import norm_key
from mnemosa.llm.tokens import TOKENIZERS, with_token_count
from mnemosa.operators.chunks import range_chunks, with_rank
from mnemosa.session import broadcast_if_small, materialize


def source_key(col: Column | str) -> Column:
    """A source's name as it is compared: without case and outer blanks, `-` as `_`."""
    return F.replace(norm_key(col), F.lit("-"), F.lit("_"))


def targets(mix: DataFrame) -> DataFrame:
    """source, weight, max_repeats of the sources that can come in: positive weight and cap (1 where null)."""
    cap = F.coalesce("max_repeats", F.lit(1))
    usable = mix.select(source_key("source").alias("source"), "weight", cap.alias("max_repeats"))
    usable = usable.filter("source IS NOT NULL AND weight > 0 AND max_repeats > 0")
    return usable.groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))


def sized(documents: DataFrame, mix: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """source, doc_id, n_tokens, _chunk of the documents of the named sources, in range chunks by size; written once."""
    named = broadcast_if_small(targets(mix).select("source"))
    rows = documents.select("doc_id", source_key("source").alias("source"), "text").join(named, "source", "left_semi")
    counted = materialize(with_token_count(rows.filter("text <> ''"), "text", vocabulary, folder).filter("n_tokens > 0"))  # once: range bounds read it too
    return range_chunks(counted, ["source"], ["n_tokens", "doc_id"])


def plan(docs: DataFrame, mix: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """source, weight, max_repeats, n_docs, n_tokens, copies: how often each source's documents come on average.

    Weights are scaled to the sources that have tokens. Without `total_tokens` the mixture is
    the largest in which every such source reaches its share within its cap; with it, caps
    bind and the reached shares tell. One row per source.
    """
    have = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    present = materialize(targets(mix).join(have, "source").coalesce(1))
    sums = present.agg(F.sum("weight").alias("w"), F.min(F.col("n_tokens") * F.col("max_repeats") / F.col("weight")).alias("most"))
    whole = sums.select("w").scalar()
    total = F.lit(float(total_tokens)) if total_tokens else sums.select("most").scalar() * whole
    copies = F.least(F.col("weight") / whole * total / F.col("n_tokens"), F.col("max_repeats").cast("double"))
    return present.withColumn("copies", copies)


def mix_sources(docs: DataFrame, quotas: DataFrame, seed: int = 7) -> DataFrame:
    """source, doc_id, copy_no, n_tokens: the mixture, by systematic sampling.

    Documents of a source lie in order of size; the prefix sum of their expected copies plus
    one random offset a source crosses an integer once for every copy. So no document comes
    more than ceil(copies) times, and small and large documents come in proportion. Prefix
    sums are carried over range chunks, so a source of any size is spread over tasks.
    """
    ranked = with_rank(docs, ["source"], ["n_tokens", "doc_id"])
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 32)) / float(1 << 32)
    joined = ranked.join(broadcast_if_small(quotas.select("source", "copies")), "source")
    crossed = F.floor(offset + F.col("rank") * F.col("copies")) - F.floor(offset + (F.col("rank") - 1) * F.col("copies"))
    times = joined.withColumn("_times", crossed).filter("_times > 0")
    return times.select("source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("copy_no"), "n_tokens")


def reached_shares(mixed: DataFrame, mix: DataFrame) -> DataFrame:
    """source, target_share, reached_share, n_rows, n_tokens of every target, those without documents at 0."""
    got = materialize(mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_tokens").alias("n_tokens")))
    total = got.agg(F.sum("n_tokens").alias("n")).scalar()
    out = targets(mix).join(got, "source", "left")
    n = F.coalesce("n_tokens", F.lit(0))
    return out.select("source", F.col("weight").alias("target_share"), F.coalesce(n / total, F.lit(0.0)).alias("reached_share"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), n.alias("n_tokens"))
