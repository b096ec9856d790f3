"""Text statistics of documents, and lists, tables and junk told from prose."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemosa.llm import boosting
from mnemosa.llm.profile import EXTRA, STATS, class_table, common_numbers, profile, profiler
from mnemosa.llm.quality_holdout import HOLDOUT, SEEDS
from mnemosa.session import materialize

#: Documents the classifier is fitted on at most, before weak labels are given.
SAMPLE = 8_000
#: How often each text labelled by hand for learning counts.
SEED_WEIGHT = 6
#: Most common words; the table is fixed and small.
COMMON_WORDS = 100_000

# What words and lines look like.
WORD = r"[\p{L}\p{M}\p{N}]+(?:['’-][\p{L}\p{M}\p{N}]+)*"
LINE = r"(?m)^.*\S.*$"
PUNCT_LINE = r"(?m)^.*[.!?…。！？][\"»”’')\]]*[ \t]*$"
SYMBOL = r"[^\p{L}\p{M}\p{N}\p{Z}\s\x{85}]"


def common_words(table: DataFrame) -> list[str]:
    """The different common words. The list goes to every task, so one beyond COMMON_WORDS is refused, not cut."""
    words = sorted(r.w for r in table.select(F.lower("word").alias("w")).filter("w IS NOT NULL").distinct().limit(COMMON_WORDS + 1).collect())
    if len(words) > COMMON_WORDS:
        raise ValueError(f"more than {COMMON_WORDS} common words")
    return words


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def statistics(documents: DataFrame, common: list[str]) -> DataFrame:
    """doc_id and STATS of every document; a null or blank text has 0 words and 0 in every ratio.

    Words are runs of letters, marks and digits, joined by inner apostrophes and hyphens; the
    symbol ratio is that of characters that are neither letter, mark, digit nor white space
    among all characters; lines without a visible character don't count.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", text.alias("text"), F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)).alias("_words"))
    return rows.select("doc_id", "text", *_stats("text", "_words", common)).drop("text")


def _stats(text: str, words: str, common: list[str]) -> list[Column]:
    n, chars = F.size(words), F.length(text)
    known = F.size(F.filter(words, lambda w: w.isin(*common))) if common else F.lit(0)
    letters = F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w))
    return [
        n.cast("bigint").alias("word_count"),
        _share(letters, n).alias("mean_word_length"),
        _share(F.regexp_count(text, F.lit(SYMBOL)), chars).alias("symbol_ratio"),
        _share(F.regexp_count(text, F.lit(PUNCT_LINE)), F.regexp_count(text, F.lit(LINE))).alias("punct_line_share"),
        _share(known, n).alias("common_word_share"),
    ]


def features(documents: DataFrame, common: list[str]) -> DataFrame:
    """doc_id, STATS and EXTRA of every document with a visible character; STATS as `statistics` has them, with each end of line as one character."""
    shared = documents.sparkSession.sparkContext.broadcast((class_table(), common_numbers(common)))
    key = dict(documents.dtypes)["doc_id"]
    return documents.filter("text IS NOT NULL").select("doc_id", "text").mapInArrow(profiler(shared), ", ".join([f"doc_id {key}", *(f"{c} double" for c in (*STATS, *EXTRA))]))


#: What the trees see: a script without known common words is as readable as one with.
NAMES = tuple(c for c in (*STATS, *EXTRA) if c != "common_word_share")


def weak_label(f: dict[str, float]) -> str | None:
    """What simple rules say of a document's statistics; None where they don't agree."""
    votes = set()
    structured = f["cells"] > 0.6 or f["marked"] > 0.6
    if f["cells"] > 0.6 and f["lines"] >= 2 and f["letters"] + f["digits"] > 0.15:
        votes.add("table")
    if f["marked"] > 0.6 and f["lines"] >= 2 and f["cells"] < 0.4:
        votes.add("list")
    bare = f["short"] > 0.55 and f["even"] < 0.65 and f["words_a_line"] < 7 and f["lines"] >= 4 and f["ends_a_word"] < 0.08
    bare = bare or f["short"] > 0.85 and f["ends_a_word"] == 0 and f["words_a_line"] < 5.5 and f["lines"] >= 4
    if bare and f["marked"] < 0.2 and f["cells"] < 0.2 and f["letters"] > 0.5 and f["broken"] == 0 and f["long_token"] < 0.1:
        votes.add("list")
    if f["common_word_share"] > 0.2 and f["marked"] < 0.4 and f["cells"] < 0.4 and f["broken"] < 0.01 and not bare and (f["short"] < 0.4 or f["even"] > 0.7 or f["words_a_line"] > 8):
        votes.add("prose")
    if f["foreign"] > 0.3 and f["symbol_ratio"] < 0.3 and not structured and f["broken"] == 0:
        votes.add("prose")
    noise = f["symbol_ratio"] > 0.5 or f["long_token"] > 0.4 or f["mixed"] > 0.5 or f["broken"] > 0.03 or f["no_vowel"] > 0.3 or f["hard"] > 0.3 or f["hex"] > 0.5
    one = f["lines"] < 2  # a single line is no table
    if f["marked"] < 0.6 and (f["cells"] < 0.3 or one) and f["foreign"] < 0.3 and f["common_word_share"] < 0.12 and noise:
        votes.add("junk")
    if f["broken"] > 0.04 or f["hex"] > 0.6 or f["letters"] + f["digits"] < (0.1 if f["cells"] < 0.6 else 0.02):
        votes = {"junk"}
    return votes.pop() if len(votes) == 1 else None


def train(rows: DataFrame, held: np.ndarray, seeds: np.ndarray) -> boosting.Boosted:
    """Trees fitted on weakly labelled rows of a bounded sample and SEEDS, calibrated on HOLDOUT (features as NAMES).

    The seeds stand for forms that a corpus may have few of, such as other scripts.
    """
    n = max(1, rows.count())
    drawn = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (1 << 20) * min(1.0, SAMPLE / n)).select("doc_id", *STATS, *EXTRA).toPandas().sort_values("doc_id")
    labels = [weak_label(r) for r in drawn[[*STATS, *EXTRA]].to_dict("records")]
    keep = [i for i, y in enumerate(labels) if y]
    x = np.concatenate([drawn[list(NAMES)].to_numpy(float)[keep], *[seeds] * SEED_WEIGHT])
    model = boosting.fit(x, [labels[i] for i in keep] + [k for k, _ in SEEDS] * SEED_WEIGHT)
    model.calibrate(held, [k for k, _ in HOLDOUT])
    return model


def classify(documents: DataFrame, common_table: DataFrame, fitted_on: DataFrame | None = None) -> DataFrame:
    """doc_id, kind (list, table, junk or prose) and its calibrated probability; blank and null texts are left out.

    The trees are fitted on a bounded sample of `fitted_on`, by default of the documents themselves.
    """
    spark = documents.sparkSession
    common = common_words(common_table)
    rows = materialize(features(documents, common))
    basis = rows if fitted_on is None else materialize(features(fitted_on, common))
    by_hand, _ = profile([t for _, t in (*HOLDOUT, *SEEDS)], class_table(), common_numbers(common))
    by_hand = by_hand[:, [(*STATS, *EXTRA).index(c) for c in NAMES]]
    model = spark.sparkContext.broadcast(train(basis, by_hand[: len(HOLDOUT)], by_hand[len(HOLDOUT) :]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i in range(len(NAMES))], axis=1) if len(b) else np.zeros((0, len(NAMES)))
            p = model.value.probabilities(x)
            kind = [model.value.classes[i] for i in p.argmax(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kind, pa.string()), pa.array(p.max(1) if len(p) else [], pa.float64())], names=["doc_id", "kind", "probability"])

    return rows.select("doc_id", *NAMES).mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, kind string, probability double")
