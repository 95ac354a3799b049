"""Boundary tests for splitting and text functions (hand-made rows)."""
import re
from pyspark.sql import functions as F

from quillscan.functions import features as fx
from quillscan.functions import script_counts as sc
from quillscan.functions import text as tx


def _one(spark, expr, value, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_split_screening_boundaries(spark):
    f = tx.split_screening(F.col("t"))
    assert _one(spark, f, None) is None
    assert _one(spark, f, "") == []
    assert _one(spark, f, "   \t ") == []
    assert _one(spark, f, "abc. abcd!x\r\nline two\rthird one") == ["abcd", "line two", "third one"]
    assert _one(spark, f, "  padded text  . no") == ["padded text"]
    # a lone sentence of 201 chars is chunked into 120 + 81; of 241 chars into 120 + 120 + 1
    assert [len(x) for x in _one(spark, f, "a" * 201)] == [120, 81]
    assert [len(x) for x in _one(spark, f, "b" * 241)] == [120, 120, 1]
    assert _one(spark, f, "c" * 200) == ["c" * 200]
    # two long sentences are never chunked
    assert [len(x) for x in _one(spark, f, "d" * 300 + ". " + "e" * 300)] == [300, 300]


def test_pattern_and_basic_splitters(spark):
    assert _one(spark, tx.split_pattern(F.col("t")), "one! two? three. four\nfive") == \
        ["one! two? three", "four", "five"]
    assert _one(spark, tx.split_basic(F.col("t")), "a.. b! c?") == ["a", "b", "c"]
    assert _one(spark, tx.split_lines(F.col("t")), " x \n\n  \ny") == ["x", "y"]


def test_words_follow_python_split(spark):
    s = "a b\tc  d e"
    assert _one(spark, tx.word_count(F.col("t")), s) == len(s.split())
    assert _one(spark, tx.words(F.col("t")), s) == s.split()


def test_stabilize_repetition(spark):
    assert _one(spark, tx.stabilize_repetition(F.col("t")), "aaaab bb cccc") == "aab bb cc"
    sinh = "ක්" * 4
    assert _one(spark, tx.stabilize_repetition(F.col("t")), sinh) == "ක්" * 2


def test_ngrams_match_python_analyzers(spark):
    texts = ["Hello  world\tagain", "ab", "a", "", "the cat the cat sat"]
    for t in texts:
        for kind, fn, lo, hi in [("char", tx.char_ngrams, 2, 4), ("char_wb", tx.char_wb_ngrams, 2, 5)]:
            got = sorted(_one(spark, fn(F.col("t"), lo, hi), t))
            assert got == sorted(_grams(t, kind, lo, hi)), (kind, t)
        got = sorted(_one(spark, tx.word_ngrams(F.col("t"), 1, 2), t))
        assert got == sorted(_grams(t, "word", 1, 2)), t


def _grams(text, kind, lo, hi):
    t = text.lower()
    if kind == "char":
        t = re.sub(r"\s\s+", " ", t)
        return [t[i:i + n] for n in range(lo, hi + 1) for i in range(len(t) - n + 1)]
    if kind == "char_wb":
        return [w[i:i + n] for w in (f" {x} " for x in t.split()) for n in range(lo, min(hi, len(w)) + 1) for i in range(len(w) - n + 1)]
    toks = re.findall(r"(?u)\b\w\w+\b", t)
    return [" ".join(toks[i:i + n]) for n in range(lo, hi + 1) for i in range(len(toks) - n + 1)]


def test_bare_endings_and_word_lengths(spark):
    """Each is worked out once a sentence, with the same values."""
    texts = ["ක කා ක්", " \t a bb  ccc ", "", "qා xක", "කq", "é ක‍ක", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    out = fx.with_structured_features(df)
    got = {r.i: (r.bare_consonant_endings, r.avg_word_length) for r in out.collect()}
    words = [t.split() if t else [] for t in texts]
    assert [got[i][0] for i in range(6)] == [2, 0, 0, 1, 1, 1]
    assert all(got[i][1] == (sum(map(len, w)) / len(w) if w else 0.0) for i, w in enumerate(words[:6])) and got[6][1] is None
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bare_consonant_endings") == 1 and "aggregate(" not in plan


def test_plain_counts_equal_the_expressions(spark, monkeypatch):
    """plain texts are counted in batches, the others and null by Java's clusters, with the same features."""
    import random
    r = random.Random(3)
    pools = ["කඛිී්ං‍‌ \r\n", "ක් ා", "ab ක්\x85\xa0é!", "කා؀ำ\U0001F468‍\U0001F469️가각 "]
    texts = ["".join(r.choice(p) for _ in range(n)) for p in pools for n in (1, 2, 3, 7, 20, 60) for _ in range(20)]
    texts += ["", None, " ", "a" * 50 + " " + "a" * 50 + " " + "a" * 49 + "b", "x" + "ා" * 40 + "x" + "ා" * 40, "\r\n\r\n්"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    plain = {r.i: r.p is not None for r in df.select("i", fx.plain_counts("text").alias("p")).collect()}
    assert all(plain[i] for i, t in enumerate(texts) if t is not None and not set(t) & set(pools[3][2:-1]) - {"‍"})
    assert not all(plain.values()) and not plain[texts.index(None)]
    got = sorted(fx.with_structured_features(df).collect())
    monkeypatch.setattr(fx, "plain_counts", lambda c: F.lit(None).cast("struct<" + ",".join(f"{n}:bigint" for n in sc.COUNTS) + ">"))
    assert got == sorted(fx.with_structured_features(df).collect())


def test_plain_counts_in_small_slices(spark, monkeypatch):
    import pyarrow as pa
    texts = pa.array(["ක ක", None, "", "කා කා", "\U0001F468", "a" * 9]).slice(1)
    whole = sc._count_slice(texts)
    monkeypatch.setattr(sc, "BATCH_BYTES", 4)
    parts = list(sc.slices(texts))
    assert len(parts) > 2 and pa.concat_arrays([sc._count_slice(p) for p in parts]).equals(whole)
    assert [p is not None for p in whole.to_pylist()] == [False, True, True, False, True]
