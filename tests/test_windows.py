"""Ordering operators: consecutive numbering, keep-first, splits, prefix sums."""
from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from data_paths import SF_SMALL
from quillscan.operators import windows as win


def test_consecutive_index_matches_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5003).alias("k"), (F.col("id") % 3).alias("g"))
    got = win.consecutive_index(df, ["k"], group_col="g", partitions=7)
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1)
    assert got.join(ref, ["k", "g"]).where("row_index != rn").count() == 0
    assert got.count() == 5000


def test_keep_first_and_duplicates(spark):
    df = spark.createDataFrame([("x", 1, 2), ("x", 0, 5), (None, 3, 1), (None, 2, 9), ("y", 4, 4)],
                               "t string, label int, pos int")
    kept = {(r["t"], r["label"]) for r in win.keep_first(df, ["t"], ["pos"]).collect()}
    assert kept == {("x", 1), (None, 3), ("y", 4)}
    assert win.duplicate_count(df, ["t"]).first()["duplicates_removed"] == 2


def test_stratified_split_is_exact_and_disjoint(spark):
    df = spark.range(0, 1000).select(F.col("id").cast("string").alias("k"),
                                     (F.col("id") % 4 == 0).cast("int").alias("y"))
    s = win.stratified_split(df, "y", "k", 0.2)
    counts = {(r["y"], r["is_test"]): r["count"] for r in s.groupBy("y", "is_test").count().collect()}
    assert counts[(1, True)] == 50 and counts[(0, True)] == 150
    assert s.count() == 1000


def test_prefix_sum(spark):
    df = spark.createDataFrame([(float(i), i % 3) for i in range(50)], "s double, v int")
    got = {r["s"]: r["cum_before"] for r in win.prefix_sum(df, ["s"], "v", partitions=4).collect()}
    run = 0
    for i in range(50):
        assert got[float(i)] == run
        run += i % 3


def test_split_joins_no_row_with_its_label(spark):
    """A label's rows don't meet in one task: no join key is the label alone, null labels included."""
    rows = [(f"t{i}", [0, 1, None][i % 3]) for i in range(60)]
    got = win.stratified_split(spark.createDataFrame(rows, "text string, label int"), "label", "text", 0.2)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "_pid" in plan
    assert Counter(r.label for r in got.collect() if r.is_test) == {0: 4, 1: 4, None: 4}


def test_stored_split_is_the_exact_one(spark, tmp_path):
    """The same test rows, and no stored row goes through a shuffle or a checkpoint."""
    rows = [(None if i % 11 == 0 else "abc"[i % 3 % 2], f"text {i}") for i in range(700)] + [("one", "alone")]
    spark.createDataFrame(rows, "label string, text string").write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    for f in (0.0, 0.2, 0.5, 1.0):
        got = win.stored_split(df, "label", "text", f)
        assert sorted(map(str, got.collect())) == sorted(map(str, win.stratified_split(df, "label", "text", f).collect()))
        assert got.inputFiles() and "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert win.stored_split(df.limit(0), "label", "text").count() == 0


def test_ngram_documents_are_a_compressed_table(spark):
    from quillscan.plans import registry
    from quillscan.session import checkpoint_dir
    checkpoint_dir(spark)
    split = win.stratified_split(registry._binary(spark, SF_SMALL), "label", "text", 0.2)
    docs = registry._tfidf_docs(spark, SF_SMALL, "binary")
    assert docs.inputFiles() and all(f.endswith(".zstd.parquet") for f in docs.inputFiles())
    assert sorted(r.doc_id for r in docs.collect()) == sorted(r.text for r in split.where("not is_test").collect())
    assert registry._tfidf_docs(spark, SF_SMALL, "pattern").inputFiles()


def test_stored_split_with_repeated_and_null_keys(spark, tmp_path):
    """the numbers of test rows are the exact ones, and a key's rows are told apart by the tie-break."""
    rows = [("ab"[i % 2], None if i % 5 == 0 else f"k{i % 3}") for i in range(60)]
    spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "label string, key string, n long").write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    got, want = win.stored_split(df, "label", "key", 0.2, tiebreak="n"), win.stratified_split(df, "label", "key", 0.2)
    assert got.columns == ["label", "key", "is_test"]
    assert Counter(map(tuple, got.collect())) == Counter((r.label, r.key, r.is_test) for r in want.collect())


def test_stored_form_of_the_split(spark):
    """the same rows are test, of null labels, null keys and one row alone too; no row is moved."""
    rows = [(f"t{i}", "abc"[i % 3]) for i in range(100)] + [("lone", "d"), (None, "a"), *[(f"n{i}", None) for i in range(7)]]
    df = spark.createDataFrame(rows, "text string, label string").repartition(5)
    got = win.stratified_split(df, "label", "text", 0.2, stored=True)
    assert got.columns == ["text", "label", "is_test"] and "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, win.stratified_split(df, "label", "text", 0.2).collect()))
    assert win.stratified_split(df.limit(0), "label", "text", 0.2, stored=True).collect() == []
