"""Null groups, junk spans, cache errors, quartiles, term counts, files and nested results."""
import os
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from data_paths import SF_SMALL
from quillscan.functions import text as tx
from quillscan.operators import corpus as co
from quillscan.operators import evaluate as ev
from quillscan.operators import vectorize as vz
from quillscan.operators import windows as win
from quillscan.plans import combined, corpus_builds, profile, screen
from quillscan.sources import files, tables


def test_null_groups_stay(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None), ("c", None), ("d", "x")], "k string, g string")
    assert win.stratified_split(df, "g", "k", 0.5).count() == 4
    assert win.folds(df, "g", "k", 2).count() == 4
    shares = win.share_of_total(spark.createDataFrame([("x", 1.0), (None, 3.0), (None, 1.0)], "g string, v double"), "v", ["g"])
    assert sorted(r.share for r in shares.collect()) == [0.25, 0.75, 1.0]
    assert all(r.class_weight == 1.0 for r in co.class_weights(df, "g").collect())


def test_junk_spans_end_at_line_feed_only(spark):
    rows = [("<a\rb>", True), ("<a\nb>", False), ("{a b}", True), ("<a\x85>", True), ("plain", False), (None, False)]
    df = spark.createDataFrame(rows, "t string, junk boolean")
    assert co.drop_junk(df, "t").where("junk").count() == 0 and co.drop_junk(df, "t").count() == 3


def test_cache_rebuilds_only_when_missing(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    path = str(tmp_path / "cache")
    assert corpus_builds.cached_dataset(spark, path, build).count() == 3
    assert corpus_builds.cached_dataset(spark, path, build).count() == 3 and len(built) == 1
    os.makedirs(tmp_path / "broken")
    (tmp_path / "broken" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        corpus_builds.cached_dataset(spark, str(tmp_path / "broken"), build)
    assert len(built) == 1


def test_describe(spark):
    rng = random.Random(1)
    for n in (1, 2, 5, 101):
        values = [rng.choice([0.5, 0.25, rng.random()]) for _ in range(n)]
        got = ev.describe(spark.createDataFrame([(v,) for v in values + [None]], "x double"), "x").first()
        s = sorted(values)
        for p, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
            i = (n - 1) * q
            want = s[int(i)] + (s[min(n - 1, int(i) + 1)] - s[int(i)]) * (i - int(i))
            assert abs(got[p] - want) < 1e-12
        assert got["count"] == n and abs(got["mean"] - statistics.fmean(values)) < 1e-12 and got["max"] == s[-1]
    assert ev.describe(spark.createDataFrame([], "x double"), "x").first()["count"] == 0


def test_term_counts(spark):
    texts = ["aabab", "", None, "a", "  xyz xyz "]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("g", tx.char_ngrams(F.col("t"), 1, 2))
    for r in df.withColumn("c", vz.term_counts(F.col("g"))).collect():
        assert {e.term: e.tf for e in r.c} == Counter(r.g or [])


def test_pairs_cover_all_sentences(spark):
    ess = tables.essays(spark, SF_SMALL)
    n = ess.select(F.size(tx.split_screening("text")).alias("n")).agg(F.sum("n")).first()[0]
    p = tables.pairs_from_essays(ess)
    assert p.count() == n == p.select("essay_id", "pos").distinct().count()


def test_files_round_trip(spark, tmp_path):
    df = screen.screen_essays(tables.essays(spark, SF_SMALL), digits=3)
    path = str(tmp_path / "csv")
    files.write_csv(df, path)
    back = files.read_csv(spark, path, df.schema)
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}


def test_essay_lookup_and_report(spark):
    ess = tables.essays(spark, SF_SMALL)
    one = combined.essay_sentences(ess, 3).collect()
    assert len(one) == 1 and one[0].essay_id == 3 and len(one[0].sentences) == one[0].total_sentences
    assert all(round(s.probability, 3) == s.probability for s in one[0].sentences)
    nested = profile.profile_results_nested(ess.where("essay_id = 3"))
    r, text = nested.first(), profile.report_text(nested).first().report
    assert text.startswith(f"Dominant Pattern: {r.dominant}\nSeverity Level: {r.severity}\nRisk Level: {r.risk_level}\nRisk Score: {r.risk_score:.2f}%\n")
    for k, v in r.distribution.items():
        assert f"{k}: {v:.3f}" in text
    for k, v in r.pattern_sentence_examples.items():
        assert len(v) == r.pattern_sentence_count[k]


def test_terms_outside_the_broadcast_part(spark, monkeypatch):
    """A vocabulary larger than its broadcast part loses no term, and documents' counts are not stored."""
    monkeypatch.setattr(vz, "COMMON_TERMS", 2)
    docs = spark.createDataFrame([(1, "aabab"), (2, "abc"), (3, "c c"), (4, "")], "doc_id long, text string")
    counts = docs.select("doc_id", vz.term_counts(tx.char_ngrams(F.col("text"), 1, 2)).alias("counts"))
    vocab = vz.fit_vocabulary(counts)
    got = {(r.doc_id, r["index"]): r.w for r in vz.weighted(counts, vocab).collect()}
    whole = {(r.doc_id, r["index"]): r.w for r in vz.weighted(counts, vocab, max_features=1).collect()}
    monkeypatch.setattr(vz, "COMMON_TERMS", 1 << 17)
    assert vocab.count() > 2 and got == {(r.doc_id, r["index"]): r.w for r in vz.weighted(counts, vocab).collect()} == whole


def test_grams_are_no_lambda_steps(spark):
    """n-grams come from Arrow batches."""
    df = spark.createDataFrame([("abc def",)], "t string")
    for g in (tx.char_ngrams(F.col("t"), 2, 4), tx.char_wb_ngrams(F.col("t"), 2, 5), tx.word_ngrams(F.col("t"))):
        plan = df.select(vz.term_counts(g))._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "lambdafunction" not in plan


def test_vocabulary_is_summed_by_batch(spark):
    """A term is one row a batch, not one a document, and the vocabulary stays the same."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["aabab", "abc", None, "c c", "", "ab"] * 5)], "doc_id long, text string").coalesce(1)
    grams = tx.char_ngrams(F.col("text"), 1, 2)
    rows = docs.select(F.explode(vz.batch_counts(grams)).alias("e")).select("e.*").collect()
    assert len(rows) == len({r.term for r in rows}) and {(r.df, r.tf) for r in rows if r.term == "ab"} == {(15, 20)}
    plain = vz.fit_vocabulary(docs.select("doc_id", vz.term_counts(grams).alias("counts")), 6, 5)
    assert sorted(vz.fit_gram_vocabulary(docs.select(grams.alias("grams")), 6, 5).collect()) == sorted(plain.collect())
    assert vz.fit_gram_vocabulary(docs.limit(0).select(grams.alias("grams"))).collect() == []


def test_pattern_corpus_drops_duplicates_once(spark):
    rows = [(1, 0, "ක්‍ෂ අ ආ ඇ", "ක අ ආ ඇ", "Spelling"), (1, 1, "ක්‍ෂ අ ආ ඈ", "ක අ ආ ඇ", "Grammar"),
            (2, 0, "ගම ගම ගම", None, "Spelling"), (2, 1, None, None, "Spelling"), (3, 0, "මල මල මල", "<a>", "Spelling"),
            (4, 0, None, "තල තල", "tense_error"), (5, 0, "සල සල සල", "සල", "unheard of")]
    pairs = spark.createDataFrame(rows, tables.PAIRS_SCHEMA)
    got = corpus_builds.pattern_corpus([pairs], keep_key=True)
    # the null text that comes first stays for the class Normal and leaves the others; junk goes
    assert sorted((r.row_key, r.dyslexic_sentence, r.macro_label) for r in got.collect()) == [
        ("d:0:1:0", "ක අ ආ ඇ", "Spelling"), ("d:0:4:0", "තල තල", "Grammar"),
        ("n:0:1:0", "ක්‍ෂ අ ආ ඇ", "Normal"), ("n:0:2:0", "ගම ගම ගම", "Normal"), ("n:0:5:0", "සල සල සල", "Normal")]
    assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString()


TEXTS = [None, "", " ", "a", "ab", "abab x", "  two  words ", "ක් කාක 😀 ab\x00c\x00", "zz zz zz y", "ab" * 300, "x\ty\u2003z", "One, two_3 ONE"]


@pytest.mark.parametrize("kind, lo, hi, slice_bytes", [("char", 1, 5, 1 << 19), ("char_wb", 2, 5, 20), ("word", 1, 2, 1)])
def test_grams_as_numbers(spark, monkeypatch, kind, lo, hi, slice_bytes):
    """N-grams counted as numbers are those of the array, term by term, and so are sums, found terms and digests."""
    import pyarrow as pa

    from quillscan.functions import grams as gr
    from quillscan.operators import vectorize as vz
    g = gr.Grams(kind, lo, hi, slice_bytes)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").coalesce(1)
    rows = df.select("doc_id", "text", g.source(F.col("text")).alias("source"), g(F.col("text")).alias("grams")).collect()
    want = {r.doc_id: Counter(r.grams or []) for r in rows}
    for counted in (g.counted, g._strings):
        term, row, terms = counted(pa.array([r.source for r in rows], pa.string()))
        got = {r.doc_id: Counter() for r in rows}
        for t, r in zip(term.tolist(), row.tolist()):
            got[rows[r].doc_id][terms[t].as_py()] += 1
        assert got == want and len(set(terms.to_pylist())) == len(terms)
    sums = {r.term: (r.df, r.tf, r.flagged) for r in vz.term_sums(df, F.col("text"), g, F.col("doc_id") % 2 == 0)
            .groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "tf", "flagged")]).collect()}
    every = set().union(*want.values())
    assert sums == {t: (sum(t in c for c in want.values()), sum(c[t] for c in want.values()), sum(t in c for i, c in want.items() if i % 2 == 0)) for t in every}
    arrays = df.select("doc_id", g(F.col("text")).alias("grams"))
    vocab = vz.fit_text_vocabulary(df, F.col("text"), g, 1, 40)
    assert sorted(vocab.collect()) == sorted(vz.fit_gram_vocabulary(arrays, 1, 40).collect())
    table = vocab.select("term", "index", "idf").orderBy("index").toArrow()
    found = [df.select("doc_id", c.alias("f")).collect() for c in (vz.found_grams(table, g)(g.source(F.col("text"))), vz.found_terms(table)(g(F.col("text"))))]
    assert found[0] == found[1]
    for common in (7, 1 << 17):             # with n-grams that no task has the weights of, and without
        monkeypatch.setattr(vz, "COMMON_TERMS", common)
        for sublinear in (True, False):
            twice = df.unionByName(df.where("doc_id < 6"))       # a document in two rows is one
            new = vz.text_summary(twice, F.col("text"), g, vocab, sublinear)
            old = vz.doc_summary(twice.select("doc_id", vz.term_counts(g(F.col("text"))).alias("counts")), vocab, sublinear)
            both = [{r.doc_id: (r.n_terms, round(r.sum_tfidf, 9), round(r.max_tfidf, 9)) for r in x.collect()} for x in (new, old)]
            assert both[0] == both[1] and both[0]


def test_grams_of_many_symbols():
    """An alphabet whose n-grams don't fit 63 bits gives the same terms."""
    import pyarrow as pa

    from quillscan.functions import grams as gr
    text = "".join(map(chr, range(0x4E00, 0x4E00 + 7000))) + "\U0001F600" * 3
    term, _, terms = gr.Grams("char", 2, 5).counted(pa.array([text]))
    assert Counter(terms.take(pa.array(term)).to_pylist()) == Counter(text[i:i + k] for k in range(2, 6) for i in range(len(text) - k + 1))
