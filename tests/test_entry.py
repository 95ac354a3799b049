"""Driver contract smoke tests and stream = batch."""
import __spark_entry__ as E

from data_paths import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "essay_label" in df.columns


def test_oracles_have_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_stream_equals_batch(spark):
    from quillscan.plans.screen import screen_essays
    from quillscan.sources.tables import essays
    from quillscan.streaming.score_stream import stream_equals_batch_input
    ess = essays(spark, SF_SMALL)
    s = {tuple(r) for r in stream_equals_batch_input(spark, ess).select(*sorted(
        screen_essays(ess, digits=6).columns)).collect()}
    b = {tuple(r) for r in screen_essays(ess, digits=6).select(*sorted(
        screen_essays(ess, digits=6).columns)).collect()}
    assert s == b


def test_profile_properties(spark):
    from pyspark.sql import functions as F

    from quillscan.plans.profile import profile_essays
    from quillscan.sources.tables import essays
    p = profile_essays(essays(spark, SF_SMALL)).where(F.col("error").isNull())
    dist = sum(F.col(c) for c in ["dist_grammar", "dist_normal", "dist_phonetic", "dist_spelling", "dist_visual"])
    bad = p.where((F.abs(dist - 1) > 1e-9) | (F.col("risk_score") > 95) | (F.col("density_grammar") > 100))
    assert bad.count() == 0


def test_essays_without_sentences_are_reported(spark):
    """No text, an empty one and one of separators give the error row, not a division by zero."""
    from quillscan import constants as K
    from quillscan.plans import profile as prof
    from quillscan.plans.combined import full_analysis
    from quillscan.streaming.score_stream import stream_equals_batch_input
    ess = spark.createDataFrame([(1, None), (2, ""), (3, "..\n "), (4, "කාක ගාග. කාක ගාග තා")], "essay_id long, text string")
    flat = {r.essay_id: r for r in prof.profile_essays(ess, digits=6).collect()}
    assert sorted(flat) == [1, 2, 3, 4]
    for i in (1, 2, 3):
        given = {k: v for k, v in flat[i].asDict().items() if v is not None}   # what the SQL gives
        assert given == {"essay_id": i, "risk_level": K.RISK_DEFAULT, "dyslexic_ratio": 0.0, "weighted_dyslexic_ratio": 0.0, "error": K.NO_PATTERN_ERROR}
    assert flat[4].error is None and flat[4].total_sentence_count == 2
    assert {r.essay_id: r.report is None for r in prof.report_text(prof.profile_results_nested(ess)).collect()} == {1: True, 2: True, 3: True, 4: False}
    assert {r.essay_id: r.patterns.error for r in full_analysis(ess).collect()} == {i: r.error for i, r in flat.items()}
    streamed = stream_equals_batch_input(spark, ess, "patterns").select(*flat[4].asDict()).collect()
    assert {r.essay_id: tuple(r) for r in streamed} == {i: tuple(r) for i, r in flat.items()}
