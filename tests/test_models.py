"""Vectors and fitted models against plain re-computation from what was saved."""
import math

import pytest
from pyspark.sql import functions as F

from data_paths import SF_SMALL
from quillscan.operators import windows as win
from quillscan.plans import corpus_builds as cb
from quillscan.plans import models as md
from quillscan.sources import tables as tb


@pytest.fixture(scope="module")
def split(spark):
    essays = tb.essays(spark, SF_SMALL).where("essay_id < 12")
    corpus = cb.binary_corpus([tb.pairs_from_essays(essays)], cb.extra_clean(spark))
    return win.stratified_split(corpus, "label", "text", 0.2)


def test_binary_soft_vote(spark, split, tmp_path):
    vectors, ensembles = md.fit_binary(split, folds=2, max_iter=15)
    md.save_ensembles(ensembles, spark, str(tmp_path / "m"))
    loaded = md.load_ensembles(spark, str(tmp_path / "m"))
    scored = md.soft_vote(vectors, loaded).select("features", "probability").limit(30).collect()

    def margin(model, v):
        w = model.coefficients
        return sum(float(w[int(i)]) * x for i, x in zip(v.indices, v.values)) + model.intercept

    for r in scored:
        votes = [sum(1 / (1 + math.exp(-(a * margin(m, r.features) + b))) for m, a, b in e) / len(e) for e in ensembles]
        assert abs(sum(votes) / 2 - r.probability) < 1e-9
        blocks = [sum(x * x for i, x in zip(r.features.indices, r.features.values) if i < r.features.size - 8)]
        assert 0 <= blocks[0] <= 2 + 1e-9 and list(r.features.indices) == sorted(set(r.features.indices))


def test_tolerance():
    assert md.TOLERANCE == 1e-4


def test_rows_are_bounded_only_by_the_parameter(split):
    assert md.bounded(split, "text", 10 ** 6).count() == split.count()
    n = md.bounded(split, "text", 200).count()
    assert 100 < n < 300


def _widths(analyzers, rows, dense):
    return sum(a.fit(rows, "text").count() for a in analyzers) + len(dense)


def test_only_solver_rows_are_bounded(spark, split):
    """binary_model_eval: all test rows are scored, and all training rows make the vocabulary."""
    vectors, _ = md.fit_binary(split, folds=2, max_rows=200, max_iter=2)
    n = {r.is_test: r["count"] for r in vectors.groupBy("is_test").count().collect()}
    assert n[True] == split.where("is_test").count() and 100 < n[False] < 300
    assert vectors.first().features.size == _widths(md.BINARY, split.where("not is_test"), md.fx.SCREEN_FEATURES)


@pytest.mark.parametrize("fit_on_all", [True, False])
def test_only_solver_rows_are_bounded_pattern(spark, fit_on_all):
    """pattern_model_eval: the same, with vocabulary and scaling of the whole corpus or of its training part."""
    essays = tb.essays(spark, SF_SMALL).where("essay_id < 12")
    corpus = cb.pattern_corpus([tb.pairs_from_essays(essays)], keep_key=True)
    rows = win.stratified_split(corpus.withColumnRenamed("dyslexic_sentence", "text"), "macro_label", "row_key", 0.2)
    test, model = md.fit_pattern(corpus, folds=2, max_rows=200, max_iter=2, fit_on_all=fit_on_all)
    assert test.count() == rows.where("is_test").count()
    rows = rows if fit_on_all else rows.where("not is_test")
    assert test.first().features.size == _widths(md.PATTERN, rows, md.fx.STRUCTURED_FEATURES)
    means = md.vz.fit_scaler(md.fx.with_structured_features(rows, "text"), md.fx.STRUCTURED_FEATURES).first()
    assert all(abs(model.scaler[c][0] - means[f"{c}__mean"]) < 1e-9 for c in md.fx.STRUCTURED_FEATURES)


def test_pattern_probabilities(spark, tmp_path):
    essays = tb.essays(spark, SF_SMALL).where("essay_id < 12")
    corpus = cb.pattern_corpus([tb.pairs_from_essays(essays)], keep_key=True)
    test, model = md.fit_pattern(corpus, folds=2, max_iter=15)
    p = model.score(test.select("macro_label", "features")).collect()
    names = [f"p_{lab.lower()}" for lab in model.labels]
    assert p and all(abs(sum(r[n] for n in names) - 1) < 1e-9 and min(r[n] for n in names) >= 0 for r in p)

    model.save(spark, str(tmp_path / "pattern"))
    model.save(spark, str(tmp_path / "pattern"))  # written over
    again = md.PatternModel.load(spark, str(tmp_path / "pattern"))
    assert again.labels == model.labels and again.scaler == model.scaler
    rows = md.fx.with_structured_features(corpus.withColumnRenamed("dyslexic_sentence", "text"), "text").select("row_key", "text", *md.fx.STRUCTURED_FEATURES)
    scored = [{r.row_key: [r[n] for n in names] for r in m.probabilities(rows, ["row_key"], "text").collect()} for m in (model, again)]
    assert scored[0] and scored[0].keys() == scored[1].keys()
    assert all(abs(a - b) < 1e-9 for k in scored[0] for a, b in zip(scored[0][k], scored[1][k]))


def test_isotonic_step(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.5, 1.0, 2.0, 3.0, 9.0)], "x double")
    got = [r.y for r in df.select(md._step(F.col("x"), [0.0, 1.0, 3.0], [0.1, 0.5, 0.9]).alias("y")).collect()]
    assert [round(y, 9) for y in got] == [0.1, 0.1, 0.3, 0.5, 0.7, 0.9, 0.9]


def test_vectors_need_no_row_a_term(spark, tmp_path):
    """terms are found where the row is; rows of a repeated key make one vector."""
    rows = spark.createDataFrame([("a", "abab x", 1), ("b", "zz", 2), ("c", None, 3)], "k string, text string, n int")
    analyzer = md.Analyzer(lambda c: md.tx.char_ngrams(c, 1, 2), 100, 1)
    vocabulary = analyzer.fit(rows.where("k = 'a'"), "text")
    idf = {r.term: (r["index"], r.idf) for r in vocabulary.collect()}
    want = {}
    for t, tf in {"a": 2, "b": 2, "ab": 2, "ba": 1, " ": 1, "b ": 1, "x": 1, " x": 1}.items():
        want[idf[t][0]] = (1 + math.log(tf)) * idf[t][1]
    norm = math.sqrt(sum(w * w for w in want.values()))
    got = {r.k: r for r in md.vectorise(rows, ["k"], "text", [analyzer], [vocabulary], ["n"]).collect()}
    a = got["a"].features
    assert list(a.indices) == [*sorted(want), 8] and a.size == 9 and a.values[-1] == 1.0
    assert all(abs(x - want[i] / norm) < 1e-12 for i, x in zip(a.indices, a.values) if i < 8)
    assert [list(got[k].features.indices) for k in "bc"] == [[8], [8]] and got["c"].text is None
    twice = md.vectorise(rows.unionByName(rows), ["k"], "text", [analyzer], [vocabulary], ["n"], apart=True).collect()
    assert len(twice) == 3
    one = next(r for r in twice if r.k == "a")
    assert one.indices == [i for i in sorted(want) for _ in "12"] and abs(sum(x * x for x in one["values"]) - 1) < 1e-12
    plan = rows.select(md.vz.unit_rows(md.vz.found_terms(vocabulary.orderBy("index").toArrow())(analyzer.grams(F.col("text")))))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_weights_of_distinct_rows(spark, monkeypatch):
    """equal rows are one weighted row to the solver, with the result of the rows themselves."""
    stored, store = [], md.store
    monkeypatch.setattr(md, "store", lambda df, name: stored.append(store(df, name)) or stored[-1])
    names = md.K.SURFACE_FEATURES
    rows = [("abc"[i % 3], *[float((i * (j + 3)) // (i % 3 + 2) % 3) for j in range(len(names))]) for i in range(300)]
    rows += [("a", *[0.0] * len(names))] * 200
    data = spark.createDataFrame(rows, ["label", *names])
    got = {(r.pattern, r.feature): r.weight for r in md.learn_weights(spark, data).collect()}
    assert [t.count() for t in stored] == [len(set(rows))] and len(set(rows)) < len(rows)
    index = md.StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(data)
    x = md.VectorAssembler(inputCols=names, outputCol="x").transform(index.transform(data))
    plain = md.LogisticRegression(family="multinomial", labelCol="y", featuresCol="x", maxIter=1000, regParam=1.0 / len(rows)).fit(x)
    plain = plain.coefficientMatrix.toArray()
    assert all(abs(got[lab, f] - plain[i][j]) < 2e-2 for i, lab in enumerate("abc") for j, f in enumerate(names))


def test_pattern_rows_are_computed_once_and_measured(spark):
    """the corpus is computed once for split and features; moments of both sides, a row a feature even of no rows."""
    import statistics
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        made.add(1)
        return x
    texts = [f"ක{'ා' * (i % 4)} {'ab ' * (i % 3)}" for i in range(40)]
    corpus = spark.createDataFrame([(t, "ab"[i % 2], f"k{i}") for i, t in enumerate(texts)], "dyslexic_sentence string, macro_label string, row_key string")
    rows = md.split_pattern(corpus.withColumn("macro_label", seen("macro_label")))
    found, stats = rows.collect(), {r.feature: r for r in md.scaler_stats(rows).collect()}
    assert made.value == len(texts) and sum(r.is_test for r in found) == 8
    want = win.stratified_split(corpus, "macro_label", "row_key", 0.2).where("is_test").select("row_key").collect()
    assert {r.row_key for r in found if r.is_test} == {r.row_key for r in want}
    assert list(stats) == md.fx.STRUCTURED_FEATURES
    for side, part in (("train", [r for r in found if not r.is_test]), ("all", found)):
        for c in md.fx.STRUCTURED_FEATURES:
            v = [float(r[c]) for r in part]
            assert abs(stats[c][f"{side}_mean"] - statistics.fmean(v)) < 1e-9 and abs(stats[c][f"{side}_std"] - (statistics.pstdev(v) or 1.0)) < 1e-9
    none = md.scaler_stats(rows.limit(0)).collect()
    assert [r.feature for r in none] == md.fx.STRUCTURED_FEATURES and all(r.all_mean is None for r in none)


def test_features_stay_above_the_cap_of_a_class(spark, monkeypatch):
    """the capped class is a top-k, not a sort of all its rows with the features below its limit."""
    plans = []
    monkeypatch.setattr(md, "store", lambda df, *_: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    monkeypatch.setattr(win, "stored_split", lambda df, *_, tiebreak: df.withColumn("is_test", F.lit(False)))
    md.split_pattern(cb.pattern_corpus([tb.pairs(spark, SF_SMALL)], keep_key=True))
    assert plans[0].count("TakeOrderedAndProject") == 1 and plans[0].count("ArrowEvalPython") == 1 and "rangepartitioning" not in plans[0]


def test_solvers_take_all_training_rows(spark, monkeypatch):
    """No row of the training part is left out of the fits, whatever their number."""
    fitted = []
    monkeypatch.setattr(md, "store", lambda df, *_, **__: df)
    monkeypatch.setattr(md.Analyzer, "fit", lambda *_: None)
    monkeypatch.setattr(md, "vectorise", lambda rows, *_, **__: rows.withColumns({"features": F.lit(0), "doc": F.lit(0)}))
    monkeypatch.setattr(md, "at_once", lambda jobs, fits: fitted.append((jobs[0].args[0].count(), fits)) or jobs)
    rows = spark.range(0, 13_000, 1, 4).select(F.col("id").cast("string").alias("text"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 13 == 0).alias("is_test"))
    monkeypatch.setattr(md, "binary_rows", lambda split: split)
    md.fit_binary(rows, folds=2)
    named = rows.select("text", F.col("text").alias("row_key"), F.when(F.col("label") == 0, "a").otherwise("b").alias("macro_label"), "is_test")
    monkeypatch.setattr(md, "split_pattern", lambda _: named)
    monkeypatch.setattr(md, "pattern_scaler", lambda *_: {})
    md.fit_pattern(named, folds=2)
    assert fitted == [(12_000, 5)] * 2


def test_isotonic_maps_of_many_bounds(spark):
    """a map of as many bounds as a whole corpus gives, and maps of one bound, at and around their ends."""
    import numpy as np
    b = [i / 7 for i in range(30_000)]
    v = [i / 30_000 for i in range(30_000)]
    xs = [-1.0, 0.0, 0.05, 1000.01, b[-1], 1e9, float("nan")]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r.y for r in df.select(md._step(F.col("x"), b, v).alias("y")).collect()]
    assert np.allclose(got, [*np.interp(xs[:-1], b, v), v[-1]], atol=1e-12)
    assert [r.y for r in df.select(md._step(F.col("x"), [0.0], [0.3]).alias("y")).collect()] == [0.3] * len(xs)
