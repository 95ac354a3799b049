"""Sentence explode and the binary screening rollup (H1/H2 explode, D1-D4, H59-H61).

Plan shape: ``essays -> posexplode(sentences) -> features -> score -> groupBy(essay_id)``.
Sentences of an essay are produced in the essay's own input partition, so the
partial (map-side) aggregate already collapses them to one row per essay and the
only shuffle moves one small row per essay (hash on ``essay_id``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import features as fx
from ..functions import scoring as sc
from ..functions import text as tx


def explode_sentences(essays: DataFrame, splitter=tx.split_screening, keep_empty: bool = False,
                      text_col: str = "text", id_col: str = "essay_id") -> DataFrame:
    """``sentences(essay_id, sent_pos, text)``; ``keep_empty`` keeps essays with no sentence
    as one row with null position and text (so rollups can report them without a join)."""
    arr = essays.select(F.col(id_col).alias("essay_id"), splitter(F.col(text_col)).alias("_sents"))
    # Always the outer generator: for a plain one the optimizer infers a
    # "size(array) > 0" filter, which would evaluate the whole splitter twice.
    out = arr.select("essay_id", F.posexplode_outer("_sents").alias("sent_pos", "text"))
    return out if keep_empty else out.where(F.col("sent_pos").isNotNull())


def score_sentences(sentences: DataFrame, threshold: float = K.SENTENCE_THRESHOLD,
                    probability: Column | None = None) -> DataFrame:
    """I18 (fixed weights) + H59 + H61: probability, label and weight per sentence."""
    feats = fx.with_screen_features(sentences)
    p = probability if probability is not None else sc.screen_probability()
    return feats.select("essay_id", "sent_pos", "text", p.alias("probability"),
                        F.col("word_count").alias("weight")) \
        .withColumn("label", sc.sentence_label(F.col("probability"), threshold))


def screen_rollup(scored: DataFrame, threshold: float = K.SENTENCE_THRESHOLD,
                  extra: list[Column] | None = None) -> DataFrame:
    """Weighted mean, peak, composite, ratio and tier counts per essay.

    ``extra`` aggregates ride along in the same (single) aggregation."""
    p, w = F.col("probability"), F.col("weight")
    agg = scored.groupBy("essay_id").agg(
        *(extra or []),
        F.count("text").alias("total_sentences"),
        F.count(F.when(p >= threshold, 1)).alias("dyslexic_sentences"),
        F.count(F.when((p >= K.BORDERLINE_THRESHOLD) & (p < threshold), 1)).alias("borderline_sentences"),
        F.try_divide(F.sum(p * w), F.sum(w)).alias("weighted_mean_prob"),
        F.max(p).alias("peak_sentence_prob"),
        F.avg(p).alias("mean_prob"),
    )
    return agg.select(
        "*",
        (F.lit(K.COMPOSITE_MEAN_WEIGHT) * F.col("weighted_mean_prob")
         + F.lit(K.COMPOSITE_PEAK_WEIGHT) * F.col("peak_sentence_prob")).alias("composite_score"),
        F.try_divide(F.col("dyslexic_sentences").cast("double"), F.col("total_sentences")).alias("dyslexic_ratio"),
    )


def essay_label(composite: Column, ratio: Column) -> Column:
    """D2 (production): DYSLEXIC if composite >= 0.75 and ratio >= 0.40; BORDERLINE if >= 0.63."""
    return (F.when((composite >= K.ESSAY_DYSLEXIC_COMPOSITE) & (ratio >= K.ESSAY_DYSLEXIC_RATIO),
                   "DYSLEXIC ESSAY")
            .when(composite >= K.ESSAY_BORDERLINE_COMPOSITE, "BORDERLINE ESSAY")
            .otherwise("NORMAL ESSAY"))


def essay_label_notebook(composite: Column, ratio: Column, mean: Column) -> Column:
    """D3 (notebook rule): composite >= 0.55 or (ratio >= 0.2 and weighted mean >= 0.5); >= 0.45."""
    return (F.when((composite >= K.NB_DYSLEXIC_COMPOSITE)
                   | ((ratio >= K.NB_RATIO) & (mean >= K.NB_MEAN)), "DYSLEXIC ESSAY")
            .when(composite >= K.NB_BORDERLINE_COMPOSITE, "BORDERLINE ESSAY")
            .otherwise("NORMAL ESSAY"))


def essay_label_any(scored: DataFrame, threshold: float = K.SENTENCE_THRESHOLD) -> DataFrame:
    """D4 (baseline): flagged if any sentence >= threshold; confidence = plain mean."""
    p = F.col("probability")
    return scored.groupBy("essay_id").agg(
        F.max((p >= threshold).cast("int")).alias("_any"),
        F.avg(p).alias("confidence"),
        F.count("text").alias("total_sentences"),
        F.count(F.when(p >= threshold, 1)).alias("flagged_sentences"),
    ).select("essay_id",
             F.when(F.col("_any") == 1, "DYSLEXIC ESSAY").when(F.col("_any") == 0, "NORMAL ESSAY")
             .alias("essay_label"),
             "confidence", "total_sentences", "flagged_sentences")
