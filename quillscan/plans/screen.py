"""I20 — binary screening of essays end to end.

``essays -> H1/H2 -> H15-H22 -> score -> H59 -> D1 -> D2 [-> A8 JSON]``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.rounding import exact_round
from ..operators import screening as op

RESULT_COLUMNS = ["essay_id", "essay_label", "composite_score", "weighted_mean_prob",
                  "peak_sentence_prob", "dyslexic_ratio", "total_sentences",
                  "dyslexic_sentences", "borderline_sentences", "error"]


def scored_sentences(essays: DataFrame, threshold: float = K.SENTENCE_THRESHOLD,
                     probability: Column | None = None, keep_empty: bool = False) -> DataFrame:
    return op.score_sentences(op.explode_sentences(essays, keep_empty=keep_empty),
                              threshold, probability)


def _finish(r: DataFrame, rule: str, digits: int | None, keep: list[str]) -> DataFrame:
    comp, ratio = F.col("composite_score"), F.col("dyslexic_ratio")
    if rule == "production":
        label = op.essay_label(comp, ratio)
    elif rule == "notebook":
        label = op.essay_label_notebook(comp, ratio, F.col("weighted_mean_prob"))
    else:
        raise ValueError(f"unknown rule {rule!r}")
    ok = F.col("total_sentences") > 0

    def rnd(c: str) -> Column:
        # presentation has 3 places, by the exact value; checks have 6, as engines round them
        v = F.col(c) if digits is None else exact_round(F.col(c), digits) if digits <= 4 else F.round(F.col(c), digits)
        return F.when(ok, v).alias(c)

    return r.select(
        "essay_id",
        F.when(ok, label).alias("essay_label"),
        rnd("composite_score"), rnd("weighted_mean_prob"), rnd("peak_sentence_prob"),
        rnd("dyslexic_ratio"),
        F.when(ok, F.col("total_sentences")).cast("bigint").alias("total_sentences"),
        F.when(ok, F.col("dyslexic_sentences")).cast("bigint").alias("dyslexic_sentences"),
        F.when(ok, F.col("borderline_sentences")).cast("bigint").alias("borderline_sentences"),
        *keep,
        F.when(~ok, F.lit(K.NO_SENTENCE_ERROR)).alias("error"),
    )


def screen_essays(essays: DataFrame, threshold: float = K.SENTENCE_THRESHOLD,
                  rule: str = "production", digits: int | None = 3,
                  probability: Column | None = None) -> DataFrame:
    """Flat essay verdicts; essays without a valid sentence get an ``error`` record."""
    scored = scored_sentences(essays, threshold, probability, keep_empty=True)
    return _finish(op.screen_rollup(scored, threshold), rule, digits, [])


def screen_results_nested(essays: DataFrame, threshold: float = K.SENTENCE_THRESHOLD,
                          rule: str = "production") -> DataFrame:
    """I20 full result: the verdict plus the ordered sentence list (3-dp probabilities),
    built in the same single aggregation."""
    scored = scored_sentences(essays, threshold, keep_empty=True)
    sent = F.array_sort(F.collect_list(F.when(
        F.col("text").isNotNull(),
        F.struct(F.col("sent_pos"), F.col("text"),
                 exact_round(F.col("probability"), 3).alias("probability"), F.col("label"))))).alias("_s")
    r = op.screen_rollup(scored, threshold, extra=[sent])
    sentences = F.when(F.col("total_sentences") > 0, F.transform(
        "_s", lambda s: F.struct(s["text"].alias("text"), s["probability"].alias("probability"),
                                 s["label"].alias("label")))).alias("sentences")
    return _finish(r, rule, 3, [sentences])


def results_json(df: DataFrame, id_col: str = "essay_id") -> DataFrame:
    """One JSON document per essay (nulls dropped, like an error-only record)."""
    fields = [c for c in df.columns if c != id_col]
    return df.select(id_col, F.to_json(F.struct(*fields)).alias("json"))
