"""Edit counts and exact decimal rounding against plain Python."""
import random

from pyspark.sql import functions as F

from quillscan.functions import diff as dx
from quillscan.functions.rounding import exact_round, fixed_text


def test_edit_counts(spark):
    rows = [("abcd", "abd"), ("abcd", "abXd"), ("", "ab"), ("ab", ""), ("", ""), (None, "a"), ("aසb", "aසc")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [tuple(r.d) for r in df.select(dx.edit_counts(F.col("a"), F.col("b")).alias("d")).collect()]
    for (a, b), d in zip(rows, got):
        if a is not None:
            assert d == (max(0, len(b) - len(a)), max(0, len(a) - len(b)), sum(x != y for x, y in zip(a, b)))


def shortest(a, b):
    """(steps, gaps) of the best script, by the plain table."""
    row = [(j, j) for j in range(len(b) + 1)]
    for i, x in enumerate(a):
        new = [(i + 1, i + 1)]
        for j, y in enumerate(b):
            gap = min(row[j + 1], new[j])
            new.append(min((gap[0] + 1, gap[1] + 1), (row[j][0] + (x != y), row[j][1])))
        row = new
    return row[-1]


def test_aligned_counts(spark):
    """learned_weights: a character dropped near the front is one omission and no substitution."""
    rng = random.Random(5)
    rows = [("abcdefgh", "acdefgh"), ("abcdefgh", "abXcdefgh"), ("abcd", "abXd"), ("", "ab"), ("ab", ""), ("", ""), ("aසb", "aසc"), ("ab", "ba"), ("aa", "aaa")]
    rows += [tuple("".join(rng.choices("abc ", k=rng.randrange(12))) for _ in "ab") for _ in range(200)]
    df = spark.createDataFrame(rows + [(None, "a")], "a string, b string")
    got = [r.d and tuple(r.d) for r in df.select(dx.aligned_counts(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got[:3] == [(0, 1, 0), (1, 0, 0), (0, 0, 1)] and got[-1] is None
    for (a, b), (more, fewer, other) in zip(rows, got):
        assert more - fewer == len(b) - len(a) and (more + fewer + other, more + fewer) == shortest(a, b)


def test_exact_rounding(spark):
    rng = random.Random(3)
    values = [0.0, 0.125, 0.285, 0.0625, 0.375, 0.295, 0.305, 2.675, 94.995, 95.0, 0.5, 1 / 3, 99.99999] + [rng.random() * 100 for _ in range(500)]
    values += [k / 32 for k in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for d in (1, 2, 3, 4):
        got = df.select("x", exact_round(F.col("x"), d).alias("r"), fixed_text(F.col("x"), d).alias("t")).collect()
        assert all(r.r == round(r.x, d) and r.t == f"{r.x:.{d}f}" for r in got)


def test_diacritics_are_counted_without_patterns(spark):
    """H51 and H52 by lengths; null stays null."""
    from quillscan import constants as K
    from quillscan.functions import diff as dfx
    rows = [("කා", "ක"), ("ක", "කා"), ("කාේෙ", "කාේ"), ("", ""), (None, "කා"), ("කා", None), ("x\U0001F600ා", "x")]
    df = spark.createDataFrame(rows, "a string, b string")
    for points in (K.PAIR_DIACRITICS, K.PAIR_DIACRITICS_NB):
        n = lambda t: sum(ord(c) in points for c in t)
        out = df.select("a", "b", dfx.diacritic_loss(F.col("a"), F.col("b"), points).alias("loss"))
        assert "regexp" not in out._jdf.queryExecution().executedPlan().toString()
        assert [r.loss for r in out.collect()] == [None if a is None or b is None else n(a) > n(b) for a, b in rows]
