"""Threshold tests: at, just under and just over every boundary."""
from pyspark.sql import functions as F

from quillscan.functions import scoring as sc
from quillscan.operators import corpus as co
from quillscan.operators import rules_v1 as rv
from quillscan.operators import screening as op


def _vals(spark, expr, values, typ="double"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r["r"] for r in df.select(expr.alias("r")).collect()]


def test_sentence_label(spark):
    got = _vals(spark, sc.sentence_label(F.col("x")), [0.49999, 0.50, 0.64999, 0.65, 0.9])
    assert got == ["NORMAL", "BORDERLINE", "BORDERLINE", "DYSLEXIC", "DYSLEXIC"]


def test_essay_label(spark):
    df = spark.createDataFrame([(0.75, 0.40), (0.75, 0.39), (0.63, 0.0), (0.6299, 0.9), (0.74, 0.9)],
                               "c double, r double")
    got = [r[0] for r in df.select(op.essay_label(F.col("c"), F.col("r"))).collect()]
    assert got == ["DYSLEXIC ESSAY", "BORDERLINE ESSAY", "BORDERLINE ESSAY", "NORMAL ESSAY", "BORDERLINE ESSAY"]


def test_confidence_and_dominance(spark):
    conf = _vals(spark, rv.normalize_confidence(F.col("x")), [0.125, 0.4, 0.695, 0.7, 0.005])
    assert [c["confidence_percent"] for c in conf] == [round(0.125 * 100), round(0.4 * 100),
                                                       round(0.695 * 100), round(0.7 * 100), round(0.005 * 100)]
    pct = [round(v * 100) for v in [0.125, 0.4, 0.695, 0.7, 0.005]]
    want = ["High" if x >= 70 else "Medium" if x >= 40 else "Low" for x in pct]
    assert [c["confidence_level"] for c in conf] == want
    dom = _vals(spark, rv.dominance_strength(F.col("x")), [0.39, 0.4, 0.59, 0.6])
    assert dom == ["Weak / Mixed", "Moderate", "Moderate", "Strong"]


def test_confidence_weight_and_is_dyslexic(spark):
    df = spark.createDataFrame([(0.25, 0.25, 0.2, 0.2, 0.1, 5), (0.5, 0.1, 0.1, 0.2, 0.1, 8),
                                (0.05, 0.75, 0.1, 0.05, 0.05, 3), (0.44, 0.2, 0.12, 0.12, 0.12, 2)],
                               "g double, n double, p double, s double, v double, w int")
    probs = {"Grammar": F.col("g"), "Normal": F.col("n"), "Phonetic": F.col("p"),
             "Spelling": F.col("s"), "Visual": F.col("v")}
    rows = df.select(sc.confidence_weight(list(probs.values()), F.col("w")).alias("cw"),
                     sc.is_dyslexic(probs, F.col("w")).alias("d")).collect()
    assert rows[0]["cw"] == 0.0
    assert abs(rows[1]["cw"] - (0.65 * (0.25 / 0.75) + 0.35)) < 1e-12
    assert rows[1]["d"] is True        # best error 0.5 >= 0.44 and margin 0.3 >= 0.1
    assert rows[2]["d"] is False       # confidently Normal
    assert rows[3]["d"] is False       # fewer than 3 words


def test_infer_pattern_ties_and_margin(spark):
    w = {"A": {"f": 1.0}, "B": {"f": 1.0}, "C": {"g": 0.2}}
    df = spark.createDataFrame([(1, 0), (0, 5)], "f int, g int")
    out = rv.label_sentences(df, w).select("writing_pattern", "explanation").collect()
    assert out[0]["writing_pattern"] == "Mixed Dyslexic Pattern"       # tie 1.0 vs 1.0
    assert out[0]["explanation"].endswith("Dominant contributing patterns: A, B.")
    assert out[1]["writing_pattern"] == "C"                            # 1.0 vs 0 -> gap >= 0.3


def test_normalize_label(spark):
    raw = ["Phonetic Confusion", " VISUAL_reversal ", "tense_error", "Spoken_case", "Spelling", "other", None]
    got = _vals(spark, co.normalize_label(F.col("x")), raw, "string")
    assert got == ["Phonetic", "Visual", "Grammar", "Grammar", "Spelling", "None", "None"]
