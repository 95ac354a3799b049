"""Fixed-weight sentence scorers and per-sentence rules (H59-H63, H73, H75, I18/I19 fixed form).

A trained model cannot be compared with SQL, so the SQL-checked flows score
sentences with fixed linear weights: a logistic model over the 8 screening
features and a softmax of five linear scores over structured ratios. The weights
live in one dict each, used both for the Spark expression and for the oracle SQL.
Trained-model scoring (Spark ML) lives in ``plans.models``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

# Logistic screening weights over H15-H22 (word_count unused).
SCREEN_WEIGHTS = {
    "intercept": -4.1937,
    "hal_ratio": -11.8713,
    "diacritic_ratio": 6.0371,
    "avg_word_len": -0.1039,
    "unique_char_ratio": 4.0193,
    "space_ratio": 3.9717,
    "has_english": 1.5171,
    "repeat_char_ratio": 24.8731,
}

# Softmax pattern weights: label -> {feature: weight}, over structured ratios.
PATTERN_WEIGHTS = {
    "Grammar": {"intercept": -1.1173, "bare_consonant_ending_ratio": 2.4391,
                "vowel_per_word": 0.2137, "sinhala_grapheme_ratio": 0.5519},
    "Normal": {"intercept": 0.3311, "vowel_diacritic_ratio": 1.3179,
               "consonant_ratio": 0.6173, "al_lakuna_ratio": -3.1117},
    "Phonetic": {"intercept": -2.0419, "confusable_consonant_ratio": 3.9271,
                 "vowel_length_imbalance": 0.7313},
    "Spelling": {"intercept": -0.6121, "al_lakuna_ratio": 5.8129,
                 "consonant_per_word": 0.1913, "vowel_diacritic_ratio": -1.4127},
    "Visual": {"intercept": -1.5077, "vowel_length_imbalance": 1.1931,
               "consonant_ratio": 0.9173, "sinhala_grapheme_ratio": 0.4519},
}


def linear(weights: dict[str, float], col=F.col) -> Column:
    z = F.lit(float(weights["intercept"]))
    for name, w in weights.items():
        if name != "intercept":
            z = z + F.lit(float(w)) * col(name).cast("double")
    return z


def screen_probability(col=F.col) -> Column:
    """Fixed-weight logistic probability ``1/(1+exp(-z))``."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-linear(SCREEN_WEIGHTS, col)))


def pattern_probabilities(col=F.col) -> dict[str, Column]:
    """Fixed-weight softmax, one probability column per label (alphabetical)."""
    z = {lab: linear(w, col) for lab, w in PATTERN_WEIGHTS.items()}
    denom = None
    for lab in K.PATTERN_LABELS:
        e = F.exp(z[lab])
        denom = e if denom is None else denom + e
    return {lab: F.exp(z[lab]) / denom for lab in K.PATTERN_LABELS}


def prob_col(label: str) -> str:
    return "p_" + label.lower()


# ----------------------------------------------------------------------------
# per-sentence rules
# ----------------------------------------------------------------------------

def sentence_label(p: Column, threshold: float = K.SENTENCE_THRESHOLD) -> Column:
    """DYSLEXIC >= t, BORDERLINE >= 0.50, else NORMAL."""
    return (F.when(p >= threshold, "DYSLEXIC")
            .when(p >= K.BORDERLINE_THRESHOLD, "BORDERLINE").otherwise("NORMAL"))


def sentence_label_binary(p: Column, threshold: float = K.SENTENCE_THRESHOLD) -> Column:
    """DYSLEXIC / NORMAL."""
    return F.when(p >= threshold, "DYSLEXIC").otherwise("NORMAL")


def max_prob(probs: list[Column]) -> Column:
    return F.greatest(*probs)


def confidence_weight(probs: list[Column], words: Column) -> Column:
    """0 if max <= 0.25 else 0.65*min((max-0.25)/0.75, 1) + 0.35*min(words/8, 1)."""
    m = max_prob(probs)
    margin = m - F.lit(K.WEIGHT_BASELINE)
    return F.when(margin <= 0, F.lit(0.0)).otherwise(
        F.lit(0.65) * F.least(margin / F.lit(1.0 - K.WEIGHT_BASELINE), F.lit(1.0))
        + F.lit(0.35) * F.least(words.cast("double") / F.lit(8.0), F.lit(1.0)))


def argmax_label(probs: dict[str, Column]) -> Column:
    """Arg-max label; ties go to the alphabetically first label."""
    labels = sorted(probs)
    arr = F.array(*[F.struct(probs[lab].alias("p"), F.lit(-i).alias("o"), F.lit(lab).alias("l"))
                    for i, lab in enumerate(labels)])
    return F.array_max(arr)["l"]


def is_dyslexic(probs: dict[str, Column], words: Column) -> Column:
    """Reliable length, not confidently Normal, best error label strong enough."""
    k = len(probs)
    top = argmax_label(probs)
    best_err = F.greatest(*[v for lab, v in probs.items() if lab != "Normal"])
    margin = best_err - F.lit(1.0 / k)
    confident_normal = (top == "Normal") & (probs["Normal"] > K.NORMAL_CONFIDENT)
    return (F.when(words < K.MIN_WORDS_FOR_RELIABLE, F.lit(False))
            .when(confident_normal, F.lit(False))
            .otherwise((margin >= K.RELIABLE_MARGIN) & (best_err >= K.STRONG_PATTERN_THRESHOLD)))


# Rule-profile (v1) weights: pattern -> {surface feature: weight}. Stands in for the
# learned-weights artifact (not shipped); ``plans.models.learn_weights`` fits one.
V1_WEIGHTS = {
    "Orthographic Instability": {"char_omission": 0.1873, "has_omission": 0.4127,
                                 "has_diacritic_loss": 0.5311, "char_addition": 0.0517},
    "Phonetic Confusion": {"char_substitution": 0.2291, "has_substitution": 0.3713,
                           "char_addition": 0.1419, "has_addition": 0.2237},
    "Word Boundary Confusion": {"word_count_diff": 0.4371, "has_spacing_issue": 0.3517,
                                "char_omission": 0.0213},
}
