"""Corpus operators: projection, filters, union, augmentation, labels, vocabulary check.

Operators A9, B1-B3, B5-B9, B13, D14, D17, D24, D26, G1, G2, H57, H58, I17.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from . import windows as win

# ----------------------------------------------------------------------------
# Clean sentences added to the binary corpus (20 entries, x20)
# ----------------------------------------------------------------------------
EXTRA_CLEAN = [
    "මගෙ අම්මාගේ නම මාරි",
    "අම්මා මට පාසල් වැඩ කියා දෙයි",
    "අම්මා මා පාසල් අවසන් වී ගෙදර එන තුරු මග බලා සිටියි",
    "අම්මා හරි ආදරෙයි මමත් අම්මාට ආදරෙයි",
    "මගෙ අම්මා හොඳ කෑම හදනවා",
    "අපේ ගෙදර හතර දෙනෙක් ඉන්නවා",
    "මගෙ තාත්තා උදේ වැඩට යනවා",
    "අපි සවසට එකට කෑම කනවා",
    "ගුරුතුමා අපට හොඳට කියා දෙනවා",
    "පාසලේ ළමයි ගෙවත්තේ ක්‍රීඩා කරනවා",
    "අද පාසලේ විද්‍යා පාඩමක් තිබුණා",
    "ගුරුතුමිය අපට ගණිත ප්‍රශ්න දුන්නා",
    "මම හැමදාම පාසලට කාලයට එනවා",
    "ඇය පාන්දරින්ම අවදි වී ආහාර පිළියෙල කර දෙයි",
    "ඔහු හැමදාම ඉක්මනට නිදා ගන්නවා",
    "අපි හැමෝම එකට ජීවත් වෙනවා",
    "ළමයා ඉතා හොඳට ඉගෙන ගන්නවා",
    "ගුරුවරයා ඉතා දයාබරයි",
    "අද ලස්සන දවසක්",
    "අහස නිල් පාටයි",
]
EXTRA_TIMES = 20


def select_shared(df: DataFrame, wanted: list[str]) -> DataFrame:
    """B1: keep the wanted columns that exist, in wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def to_labelled(df: DataFrame, col: str, label, out: str = "label") -> DataFrame:
    """B2: one column as ``text`` with a constant label."""
    return df.select(F.col(col).alias("text"), F.lit(label).alias(out))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """G1: bag union by name (missing columns become null)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def augment(extra: DataFrame, times: int = EXTRA_TIMES) -> DataFrame:
    """Replicate rows ``times`` times (explode of a sequence; no cross join)."""
    return extra.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def min_length(col: str, n: int, strict: bool = False) -> Column:
    """``length >= n`` (or ``> n``); null text fails."""
    c = F.length(F.col(col))
    return F.coalesce(c > n if strict else c >= n, F.lit(False))


def drop_junk(df: DataFrame, col: str) -> DataFrame:
    """Drop rows with HTML/JSON-looking spans; null text is kept here."""
    return df.where(~F.coalesce(F.col(col).rlike(K.JUNK), F.lit(False)))


def normalize_label(c: Column) -> Column:
    """Ordered substring rules on lower(strip(raw)); null -> "None"."""
    x = F.lower(F.btrim(F.coalesce(c.cast("string"), F.lit("None")), F.lit(K.PY_WS_CHARS)))
    out = F.lit(K.MACRO_DEFAULT)
    for words, label in reversed(K.MACRO_RULES):
        cond = reduce(lambda a, b: a | b, [x.contains(w) for w in words])
        out = F.when(cond, F.lit(label)).otherwise(out)
    return out


def value_counts(df: DataFrame, col: str, normalize: bool = False) -> DataFrame:
    """Counts per value (and share of the total)."""
    c = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    return win.share_of_total(c, "count", [], out="share") if normalize else c


def class_weights(df: DataFrame, label_col: str, out: str = "class_weight") -> DataFrame:
    """Balanced weight n / (k * n_c) per row, via joined group totals (no global window)."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_nc"))
    totals = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = counts.withColumn("_one", F.lit(1)).join(totals.withColumn("_one", F.lit(1)), "_one") \
        .select(F.col(label_col).alias("_class"), (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias(out))
    return df.join(w, F.col(label_col).eqNullSafe(F.col("_class")), "left").drop("_class")


def check_vocabulary(df: DataFrame, col: str, tags: DataFrame) -> DataFrame:
    """Rows whose tag is outside the closed vocabulary (left anti join)."""
    return df.where(F.col(col).isNotNull()).join(tags.select(F.col("tag").alias(col)), col, "left_anti")


def stage_counts(df: DataFrame, key: str, stages: dict[str, Column], dedup: str) -> DataFrame:
    """Rows that pass each stage's condition, then the distinct keys of the last one.

    One pass: rows are counted per key first, so the distinct count is a count of groups.
    """
    names = list(stages)
    per = df.groupBy(key).agg(*[F.count(F.when(c, 1)).alias(n) for n, c in stages.items()])
    one = per.agg(*[F.sum(n).alias(n) for n in names], F.count(F.when(F.col(names[-1]) > 0, 1)).alias(dedup))
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("stage"), F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias("rows"))
                                          for n in [*names, dedup]])).alias("s")).select("s.stage", "s.rows")
