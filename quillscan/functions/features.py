"""Script features of a sentence (operators H15-H48).

Screening features (8, H15-H22) and structured features (26, H23-H48) as
DataFrame projections. Counts are regex counts over code-point classes; the
three "adjacent equal" counts and the grapheme features work on arrays built
once in an earlier projection (common sub-expressions do not reach inside
lambdas, so base arrays are materialised as columns first).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from . import text as tx
from .script_counts import plain_counts

SCREEN_FEATURES = ["hal_ratio", "diacritic_ratio", "avg_word_len", "word_count",
                   "unique_char_ratio", "space_ratio", "has_english", "repeat_char_ratio"]

STRUCTURED_FEATURES = [
    "char_length", "word_count", "avg_word_length", "grapheme_count", "sinhala_grapheme_count",
    "sinhala_grapheme_ratio", "vowel_diacritic_count", "independent_vowel_count",
    "vowel_diacritic_ratio", "short_vowel_count", "long_vowel_count", "vowel_length_imbalance",
    "consonant_count", "consonant_ratio", "confusable_consonant_count",
    "confusable_consonant_ratio", "al_lakuna_count", "al_lakuna_ratio", "consecutive_al_lakuna",
    "repeated_graphemes", "repeated_chars", "repeated_words", "bare_consonant_endings",
    "bare_consonant_ending_ratio", "vowel_per_word", "consonant_per_word",
]


def count(c: Column, pattern: str) -> Column:
    """Regex match count as BIGINT."""
    return F.regexp_count(c, F.lit(pattern)).cast("bigint")


def ratio(num: Column, den: Column) -> Column:
    """Guarded division: 0.0 on a zero denominator."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def repeated_chars(c: Column) -> Column:
    """Adjacent equal characters (overlapping), e.g. ``aaa`` -> 2."""
    return count(c, r"(?s)(.)(?=\1)")


# ----------------------------------------------------------------------------
# screening features
# ----------------------------------------------------------------------------

def screen_feature_columns(t: Column) -> dict[str, Column]:
    """H15-H22 for one text column; ``n = max(len,1)``, ``nw = max(words,1)``."""
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    nw = F.greatest(tx.word_count(t), F.lit(1)).cast("double")
    word_chars = (F.length(t) - tx.whitespace_count(t)).cast("double")
    sinhala = F.regexp_extract_all(t, F.lit(K.SINHALA), 0)
    return {
        "hal_ratio": count(t, K.VIRAMA) / n,                                         # H15
        "diacritic_ratio": count(t, K.VOWEL_SIGN) / n,                               # H16
        "avg_word_len": word_chars / nw,                                             # H17
        "word_count": nw,                                                            # H18
        "unique_char_ratio": F.size(F.array_distinct(sinhala)).cast("double")
        / F.greatest(F.size(sinhala), F.lit(1)).cast("double"),                      # H19
        "space_ratio": (F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))) / n,  # H20
        "has_english": t.rlike(K.LATIN).cast("double"),                              # H21
        "repeat_char_ratio": repeated_chars(t) / n,                                  # H22
    }


def with_screen_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    cols = screen_feature_columns(F.col(text_col))
    return df.select("*", *[v.alias(k) for k, v in cols.items()])


# ----------------------------------------------------------------------------
# structured features
# ----------------------------------------------------------------------------

def _bare_ending(word: Column) -> Column:
    # the last cluster is bound: each test would find the word's clusters again
    return tx.bind(F.try_element_at(tx.sinhala_graphemes(tx.graphemes(word)), F.lit(-1)),
                   lambda last: F.coalesce(last.rlike(K.CONSONANT) & ~last.rlike(K.VOWEL_SIGN), F.lit(False)))


def with_structured_features(df: DataFrame, text_col: str = "text",
                             keep_base: bool = False) -> DataFrame:
    """Add H23-H48 (26 columns, in the fixed order) next to ``df``'s columns.

    Plain texts are counted in Arrow batches (``plain_counts``); the others, null in ``_p``, are
    the text ``_x`` that the expressions read here. ``keep_base`` keeps words and clusters of all."""
    counted = df.select("*", plain_counts(F.col(text_col)).alias("_p"))
    t = F.col(text_col)
    x = t if keep_base else F.col("_x")

    def of(name: str, exact: Column) -> Column:
        return F.coalesce(F.col(f"_p.{name}"), exact)

    base = counted.select("*", F.when(F.col("_p").isNull(), t).alias("_x")).select(
        "*",
        tx.words(x).alias("_w"),
        tx.graphemes(x).alias("_g"),
    ).select(
        "*",
        of("nw", F.size(F.col("_w")).cast("bigint")).alias("_nw"),
        of("nc", F.size(F.col("_g")).cast("bigint")).alias("_nc"),
        of("ns", F.size(tx.sinhala_graphemes(F.col("_g"))).cast("bigint")).alias("_ns"),
        of("ws", tx.whitespace_count(F.col("_x"))).alias("_ws"),
        *[of(name, count(F.col("_x"), pattern)).alias(f"_{name}") for name, pattern in (
            ("vd", K.VOWEL_SIGN), ("sv", K.SHORT_VOWEL), ("lv", K.LONG_VOWEL), ("cons", K.CONSONANT),
            ("al", K.VIRAMA), ("conf", K.CONFUSABLE))],
        of("bare", F.size(F.filter(F.col("_w"), _bare_ending)).cast("bigint")).alias("_bare"),
    )
    w, nw, nc, ns = F.col("_w"), F.col("_nw"), F.col("_nc"), F.col("_ns")
    vd, sv, lv, cons, al = F.col("_vd"), F.col("_sv"), F.col("_lv"), F.col("_cons"), F.col("_al")
    conf, bare = F.col("_conf"), F.col("_bare")    # read twice each
    feats = [
        F.length(t).cast("bigint").alias("char_length"),                              # H23
        nw.alias("word_count"),                                                        # H24
        ratio(F.length(t).cast("bigint") - F.col("_ws"), nw).alias("avg_word_length"),   # H25
        nc.alias("grapheme_count"),                                                    # H26
        ns.alias("sinhala_grapheme_count"),                                            # H27
        ratio(ns, nc).alias("sinhala_grapheme_ratio"),                                 # H28
        vd.alias("vowel_diacritic_count"),                                             # H29
        of("iv", count(F.col("_x"), K.INDEPENDENT_VOWEL)).alias("independent_vowel_count"),  # H30
        ratio(vd, ns).alias("vowel_diacritic_ratio"),                                  # H31
        sv.alias("short_vowel_count"),                                                 # H32
        lv.alias("long_vowel_count"),                                                  # H33
        ratio(F.abs(sv - lv), sv + lv).alias("vowel_length_imbalance"),                # H34
        cons.alias("consonant_count"),                                                 # H35
        ratio(cons, ns).alias("consonant_ratio"),                                      # H36
        conf.alias("confusable_consonant_count"),                                      # H37
        ratio(conf, cons).alias("confusable_consonant_ratio"),       # H38
        al.alias("al_lakuna_count"),                                                   # H39
        ratio(al, ns).alias("al_lakuna_ratio"),                                        # H40
        of("al2", count(F.col("_x"), K.VIRAMA + "(?=" + K.VIRAMA + ")")).alias("consecutive_al_lakuna"),  # H41
        of("rg", tx.adjacent_equal(F.col("_g"))).alias("repeated_graphemes"),  # H42
        of("rc", repeated_chars(F.col("_x"))).alias("repeated_chars"),  # H43
        of("rw", tx.adjacent_equal(w)).alias("repeated_words"),  # H44
        bare.alias("bare_consonant_endings"),                                          # H45
        ratio(bare, nw).alias("bare_consonant_ending_ratio"),                          # H46
        ratio(vd, nw).alias("vowel_per_word"),                                         # H47
        ratio(cons, nw).alias("consonant_per_word"),                                   # H48
    ]
    keep = [c for c in df.columns if c not in STRUCTURED_FEATURES]
    out = base.select(*keep, *feats, *(["_w", "_g"] if keep_base else []))
    return out
