"""Peeks, the bucketed essay store, dataset versions, and streams that are cut off."""
import uuid

import pytest
from pyspark.sql import functions as F

from data_paths import SF_SMALL
from quillscan.operators import peeks
from quillscan.plans import essay_store, versions
from quillscan.plans.profile import profile_essays
from quillscan.plans.screen import screen_essays
from quillscan.sources.tables import essays
from quillscan.streaming import score_stream as ss


def plan(df):
    df.collect()  # the final adaptive plan
    return df._jdf.queryExecution().toString()


def test_peeks_limit_before_the_shuffle(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 != 0, F.col("id") % 3).alias("kind"))
    got = peeks.sample_peek(rows, 4, ["id"], ["kind"])
    assert sorted((r.kind is None, r.kind or 0, r.place) for r in got.collect()) == sorted(
        (k == 0, k, i) for k in range(3) for i in range(1, 5))
    text = plan(got)
    assert text.index("WindowGroupLimit") < text.index("Exchange") or "Partial" in text
    assert peeks.sample_peek(rows.limit(0), 4, ["id"], ["kind"]).collect() == []
    assert [r.id for r in peeks.head(rows, 2, ["id"]).collect()] == [0, 1]
    assert [r.id for r in peeks.tail(rows, 2, ["id"]).collect()] == [999, 998]


def test_store_prunes_buckets_and_joins_without_exchange(spark):
    ess = essays(spark, SF_SMALL).unionByName(spark.createDataFrame([(-5, None), (-4, "")], "essay_id long, text string"))
    name = f"store_{uuid.uuid4().hex}"
    essay_store.write_store(ess, name, 8)
    whole = essay_store.essay_with_sentences(spark, name)
    text = plan(whole)
    assert "Exchange" not in text and "SortMergeJoin" in text
    assert whole.select("essay_id").distinct().count() == ess.count()
    one = essay_store.essay_with_sentences(spark, name, [17])
    assert "SelectedBucketsCount: 1 out of 8" in plan(one)
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in whole.where("essay_id = 17").collect()}
    none = essay_store.essay_with_sentences(spark, name, [-5]).collect()
    assert len(none) == 1 and none[0].text is None and none[0].essay_label is None


def test_versions(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None), (3, "")], "id long, t string")
    print_of = lambda df: versions.fingerprint(df).first()["fingerprint"]
    assert print_of(rows) == print_of(rows.orderBy(F.desc("id")).select("t", "id")) != print_of(rows.distinct())
    assert print_of(rows.limit(0)) == "0-0-0-0-0"
    built = []

    def build(df):
        built.append(1)
        return df.where("t is not null")

    base = str(tmp_path / "v")
    first, own = versions.versioned(rows, base, build)
    assert first.count() == 2 and versions.versioned(rows, base, build)[1] == own and len(built) == 1
    changed, other = versions.versioned(rows.unionByName(rows.limit(1)), base, build)
    assert other != own and changed.count() == 3 and first.count() == 2
    with pytest.raises(FileExistsError):
        versions.freeze(rows, own)
    cut = str(tmp_path / "cut")  # data without a manifest: an interrupted write
    rows.limit(1).write.parquet(f"{cut}/data")
    assert versions.manifest(spark, cut) is None
    versions.freeze(rows, cut)
    assert versions.manifest(spark, cut).rows == 4


def test_stream_restarts_after_a_crash_between_sink_and_checkpoint(spark, tmp_path, monkeypatch):
    ess = essays(spark, SF_SMALL)
    ess.repartition(3).write.parquet(str(tmp_path / "in"))
    source, sink, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    write, crashed = ss.write_epoch, []

    def crash_once(result, sink, epoch):
        write(result, sink, epoch)
        if epoch == 1 and not crashed:
            crashed.append(epoch)
            raise RuntimeError("lost after the sinks were written")

    monkeypatch.setattr(ss, "write_epoch", crash_once)
    with pytest.raises(Exception, match="lost after"):
        ss.score_stream(spark, source, sink, ckpt, "full", max_files_per_trigger=1)
    ss.score_stream(spark, source, sink, ckpt, "full", max_files_per_trigger=1)
    for name, batch in (("binary", screen_essays(ess, digits=6)), ("patterns", profile_essays(ess, digits=6))):
        got = spark.read.parquet(f"{sink}/{name}").select(*batch.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))


def test_stream_drops_essays_that_come_again(spark, tmp_path):
    ess = essays(spark, SF_SMALL).limit(20).cache()
    source = str(tmp_path / "in")
    ess.coalesce(1).write.parquet(source)
    ess.limit(5).coalesce(1).write.mode("append").parquet(source)
    ss.score_stream(spark, source, str(tmp_path / "out"), str(tmp_path / "ckpt"), "screen", 1, duplicates_within="1 hour")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_versions_derive_the_pairs_twice(spark, monkeypatch):
    """once for the fingerprint and once for the rows; the second version is made from the first."""
    from pyspark.sql import functions as F
    from quillscan.plans import registry
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        made.add(1)
        return x
    rows = [("abc", "ab", "Spelling", 1, 0), ("def", "df", None, 1, 1), (None, None, "other", None, None)]
    table = spark.createDataFrame(rows, "clean_sentence string, dyslexic_sentence string, error_type string, essay_id long, pos int")
    monkeypatch.setattr(registry.tb, "pairs", lambda *_: table.withColumn("error_type", seen("error_type")))
    got = {r.version: r.rows for r in registry.snapshot_versions(spark, "").collect()}
    assert got == {"all": 3, "tagged": 2} and made.value == 2 * len(rows)


def test_a_finished_version_is_not_read_again_for_its_fingerprint(spark, monkeypatch, tmp_path):
    """the second version is known by the first one's manifest, and lies where its rows' fingerprint says."""
    from quillscan.plans import registry
    calls = []
    real = registry.vs.fingerprint
    monkeypatch.setattr(registry.vs, "fingerprint", lambda df: calls.append(1) or real(df))
    table = spark.createDataFrame([("a\r\nb", "ab", "Spelling", 1, 0), ("def", "df", None, 1, 1)],
                                  "clean_sentence string, dyslexic_sentence string, error_type string, essay_id long, pos int")
    monkeypatch.setattr(registry.tb, "pairs", lambda *_: table)
    got = {r.version: r.rows for r in registry.snapshot_versions(spark, "").collect()}
    assert got == {"all": 2, "tagged": 1} and len(calls) == 3
    frozen, path = registry.vs.versioned(table, str(tmp_path / "all"), lambda df: df)
    known = registry.vs.manifest(spark, path)["fingerprint"]
    assert registry.vs.versioned(frozen, str(tmp_path / "b"), lambda df: df, known)[1] == registry.vs.versioned(frozen, str(tmp_path / "b"), lambda df: df)[1]
