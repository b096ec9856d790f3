"""Scores of answers against truths, and diagnostics of what went wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemosa.functions import text as X


def score_answers(answers: DataFrame) -> DataFrame:
    """answers (question_id, category, predicted, truth, context, adversarial) with f1, exact_match, refusal and diagnostics."""
    # word lists first, as columns: inside a lambda an expression would be evaluated for every word
    words = {"_p": X.answer_tokens("predicted"), "_t": X.answer_tokens("truth"), "_kt": X.answer_tokens("truth", True), "_kc": X.answer_tokens("context", True), "_kp": X.answer_tokens("predicted", True)}
    rows = answers.withColumns(words)
    rows = rows.withColumns(
        {
            "f1": F.round(X.bag_f1(F.col("_p"), F.col("_t")), 6),
            "exact_match": X.normalized_answer("predicted") == X.normalized_answer("truth"),
            "refusal": X.is_refusal("predicted"),
            "n_keywords": F.size("_kt"),
            "n_in_context": X.bag_overlap(F.col("_kt"), F.col("_kc")),
            "n_in_answer": X.bag_overlap(F.col("_kt"), F.col("_kp")),
        }
    ).drop(*words)
    share = lambda c: F.round(F.when(F.col("n_keywords") > 0, F.col(c) / F.col("n_keywords")).otherwise(0.0), 6)
    open_ = ~F.col("adversarial") & (F.col("n_keywords") > 0)
    miss = open_ & (F.col("n_in_context") == 0)
    mismatch = open_ & ~F.col("refusal") & (F.col("f1") == 0) & (F.col("n_in_context") > 0) & (F.col("n_in_answer") == 0)
    return rows.withColumns({"context_coverage": share("n_in_context"), "answer_coverage": share("n_in_answer"), "retrieval_miss": miss, "format_mismatch": mismatch})


def category_scores(scored: DataFrame) -> DataFrame:
    """category (null: all but the adversarial), n_questions, mean_f1, exact_rate, refusal_rate."""
    rows = scored.withColumn("_f", F.expr("filter(array(category, if(adversarial, null, -1)), x -> x IS NOT NULL)")).withColumn("_c", F.explode("_f"))
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    out = rows.groupBy("_c").agg(F.count(F.lit(1)).alias("n_questions"), F.round(F.avg("f1"), 6).alias("mean_f1"), rate("exact_match").alias("exact_rate"), rate("refusal").alias("refusal_rate"))
    return out.select(F.when(F.col("_c") >= 0, F.col("_c")).cast("int").alias("category"), "n_questions", "mean_f1", "exact_rate", "refusal_rate")


def diagnostics_summary(scored: DataFrame) -> DataFrame:
    """One row: counts and rates of refusals, misses, mismatches and zero scores, and mean coverages, over answerable questions."""
    count = lambda c: F.count_if(c & ~F.col("adversarial"))
    open_ = F.when(~F.col("adversarial"), F.lit(1))
    n = F.count(open_)
    rows = scored.agg(
        F.count(F.lit(1)).alias("n_questions"), n.alias("n_answerable"), count(F.col("refusal")).alias("n_refusals"), count(F.col("retrieval_miss")).alias("n_retrieval_misses"),
        count(F.col("format_mismatch")).alias("n_format_mismatches"), count(F.col("f1") == 0).alias("n_zero_f1"),
        F.round(F.avg(open_ * F.col("context_coverage")), 6).alias("mean_context_coverage"), F.round(F.avg(open_ * F.col("answer_coverage")), 6).alias("mean_answer_coverage"),
    )
    return rows.withColumns({f"{c}_rate": F.round(F.try_divide(F.col(f"n_{c}"), "n_answerable"), 6) for c in ("refusals", "retrieval_misses", "format_mismatches", "zero_f1")})
