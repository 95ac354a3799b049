"""Model fitting and scoring with Spark ML (operators I5-I7, I9-I11, I13, I14, I16-I19, A6, A7).

Text is vectorised once: vocabulary and idf are fitted on the training rows, weights are
sublinear tf times smooth idf with L2 rows, and a row's terms and dense features become
one sparse vector in the task that holds the row. The vectors are written to the shared
folder as a table, and all fits and folds read that. Solvers are MLlib's; the penalty is
1 / (C n), as in a linear model with penalty strength C.

Solvers and their calibration take all training rows; only a caller that gives ``max_rows``
bounds them, by a hash of their key. Vocabularies, idf, scaling and the scored test rows
cover all rows in any case.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import features as fx
from ..functions import text as tx  # noqa: F401
from ..functions.grams import Grams
from ..operators import corpus as co
from ..operators import vectorize as vz
from ..operators import windows as win
from ..session import checkpoint_dir

#: Training vectors of one task of a solver's step.
BLOCK_ROWS = 10_000
#: Blocks that fits take at the same time: so many fits of one block, each a chain of one-task jobs. Fits of this
#: many blocks or more follow one another, as a solver keeps its rows once more.
FITS_AT_ONCE = 10
FOLDS, PATTERN_FOLDS = 5, 3
LR_C, LR_ITER = 1.0, 1000
SVC_C, SVC_ITER = 0.5, 2000
PATTERN_C, PATTERN_ITER = 1.0, 5000
TOLERANCE = 1e-4


def bounded(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """All rows, or, if ``rows`` is given, about that many of them by a hash of ``key``."""
    if rows is None:
        return df
    n = df.count()
    return df if n <= rows else df.where(win.hash_unit(F.concat(F.col(key), F.lit("#fit"))) < rows / n)


# ---------------------------------------------------------------------------
# vectors
# ---------------------------------------------------------------------------

class Analyzer:
    """One TF-IDF block: n-grams (``Grams``, or a function to an array of them), vocabulary cap and least document frequency."""

    def __init__(self, grams, max_features: int, min_df: int = 2):
        self.grams, self.max_features, self.min_df = grams, max_features, min_df

    def fit(self, docs: DataFrame, text_col: str) -> DataFrame:
        if isinstance(self.grams, Grams):
            fitted = vz.fit_text_vocabulary(docs, F.col(text_col), self.grams, self.min_df, self.max_features)
        else:
            fitted = vz.fit_gram_vocabulary(docs.select(self.grams(F.col(text_col)).alias("grams")), self.min_df, self.max_features)
        return store(fitted.select("term", "index", "idf"), "vocabulary")

    def found(self, table: pa.Table, text: Column) -> Column:
        """The text's terms in ``table``, as ``vectorize.found_terms`` has them."""
        if isinstance(self.grams, Grams):
            return vz.found_grams(table, self.grams)(self.grams.source(text))
        return vz.found_terms(table)(self.grams(text))


BINARY = [Analyzer(Grams("char_wb", 2, 5), 60_000), Analyzer(Grams("word", 1, 2), 20_000)]
PATTERN = [Analyzer(Grams("char", 2, 5), 30_000)]


def store(df: DataFrame, name: str, schema: T.StructType | None = None, compression: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, read back (with ``schema``, if given)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(schema or df.schema).parquet(path)


def vectorise(rows: DataFrame, key: list[str], text_col: str, analyzers: list[Analyzer], vocabularies: list[DataFrame],
              dense: list[str], scaler: dict[str, tuple[float, float]] | None = None, apart: bool = False) -> DataFrame:
    """``rows`` with ``features``: the L2-normalised TF-IDF blocks, then the dense columns.

    The vocabularies are bounded by their analyzers and go to the tasks: a row's terms are found
    in them in Arrow batches where the row is. Only if keys repeat are rows shuffled: those of a
    key make one vector. ``apart``: in place of ``features``, the columns ``indices`` and
    ``values`` (TF-IDF) and ``dense``.
    """
    size, found = 0, []
    for a, v in zip(analyzers, vocabularies):
        table = v.select("term", (F.col("index") + size).cast("int").alias("index"), "idf").orderBy("index").toArrow()  # at most max_features rows
        found.append(a.found(table, F.col(text_col)))
        size = max(table["index"].to_pylist(), default=size - 1) + 1
    carried = [c for c in rows.columns if c not in key]
    blocks = [f"_e{b}" for b in range(len(analyzers))]
    if rows.groupBy(*key).count().where("count > 1").isEmpty():
        got = rows.select(*key, *carried, *[e.alias(b) for e, b in zip(found, blocks)])
    else:
        got = rows.select(*key, F.struct(*carried).alias("_row"), *[e.alias(b) for e, b in zip(found, blocks)])
        got = got.groupBy(*key).agg(F.first("_row").alias("_row"), *[F.flatten(F.collect_list(b)).alias(b) for b in blocks])
        got = got.select(*key, *[F.col(f"_row.{c}").alias(c) for c in carried], *blocks)
    got = got.select(*key, *carried, *[vz.unit_rows(F.col(b)).alias(b) for b in blocks])
    indices, values = (F.concat(*[F.col(f"{b}.{part}") for b in blocks]) for part in ("indices", "values"))

    def scaled(c: str) -> Column:
        mean, std = (scaler or {}).get(c, (0.0, 1.0))
        return (F.col(c).cast("double") - F.lit(mean)) / F.lit(std)

    if apart:
        parts = got.select(*key, *carried, indices.alias("indices"), values.alias("values"), F.array(*map(scaled, dense)).alias("dense"))
        return store(parts, "vectors")
    indices = F.concat(indices, F.array(*[F.lit(size + i) for i in range(len(dense))]))
    values = F.concat(values, F.array(*map(scaled, dense)))
    out = got.select(*key, *carried, F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size + len(dense)).cast("int").alias("size"),
                                              indices.alias("indices"), values.alias("values")).alias("features"))
    schema = T.StructType([T.StructField(f.name, VectorUDT() if f.name == "features" else f.dataType) for f in out.schema])
    return store(out, "vectors", schema)


# ---------------------------------------------------------------------------
# binary model (I2 + I3 + I5 + I9-I11, I18, H73)
# ---------------------------------------------------------------------------

def binary_rows(split: DataFrame) -> DataFrame:
    """(text, label, is_test) with the 8 screening features."""
    return fx.with_screen_features(split, "text")


def platt(margins: DataFrame) -> tuple[float, float]:
    """A one-feature logistic fit of ``label`` on ``margin``."""
    m = LogisticRegression(labelCol="label", featuresCol="_m", regParam=0.0).fit(
        VectorAssembler(inputCols=["margin"], outputCol="_m").transform(margins))
    return float(m.coefficients[0]), float(m.intercept)


@contextmanager
def training_blocks(train: DataFrame) -> Iterator[tuple[DataFrame, int]]:
    """(``train`` in blocks of up to ``BLOCK_ROWS`` rows, the number of fits to run at once); a single block is kept in memory."""
    blocks = max(1, -(-train.count() // BLOCK_ROWS))
    if blocks > 1:
        yield train.coalesce(blocks), max(1, FITS_AT_ONCE // blocks)
        return
    kept = train.coalesce(1).persist()
    try:
        yield kept, FITS_AT_ONCE
    finally:
        kept.unpersist()


def at_once(jobs: list, fits: int = FITS_AT_ONCE) -> list:
    """Results of the calls ``jobs``, run by ``fits`` threads of the driver that keep the caller's Spark properties."""
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(fits) as pool:
        return [f.result() for f in [pool.submit(inherit(job)) for job in jobs]]


def fit_member(train: DataFrame, k: int, svc: bool = False, max_iter: int | None = None) -> tuple:
    """The linear model of the folds other than ``k``, and a sigmoid of its margin on fold ``k``."""
    part = train.where(F.col("fold") != k)
    c, iterations = (SVC_C, SVC_ITER) if svc else (LR_C, LR_ITER)
    make = LinearSVC if svc else LogisticRegression
    model = make(labelCol="label", featuresCol="features", regParam=1.0 / (c * max(1, part.count())), maxIter=max_iter or iterations,
                 tol=TOLERANCE, standardization=False).fit(part)
    held = model.transform(train.where(F.col("fold") == k))
    return model, *platt(held.select("label", vector_to_array("rawPrediction")[1].alias("margin")))


def fit_calibrated(train: DataFrame, kinds=(False, True), folds: int = FOLDS, max_iter: int | None = None,
                   fits: int = FITS_AT_ONCE) -> list[list[tuple]]:
    """For every kind (False: logistic, True: linear SVM) the members of all folds.

    ``train`` has ``features``, ``label`` and ``fold``. An ensemble's probability is the mean
    over its folds. ``fits`` members are fitted at once.
    """
    members = at_once([partial(fit_member, train, k, svc, max_iter) for svc in kinds for k in range(folds)], fits)
    return [members[i * folds:(i + 1) * folds] for i in range(len(kinds))]


def soft_vote(df: DataFrame, ensembles: list[list[tuple]]) -> DataFrame:
    """I18 + H73: the mean of the ensembles' probabilities, each the mean of its folds."""
    keep, votes = df.columns, []
    for i, members in enumerate(ensembles):
        parts = []
        for j, (model, a, b) in enumerate(members):
            got = model.transform(df)
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * vector_to_array("rawPrediction")[1] + F.lit(b))))
            df = got.select(*df.columns, p.alias(f"_p{i}_{j}"))
            parts.append(F.col(f"_p{i}_{j}"))
        votes.append(sum(parts[1:], parts[0]) / F.lit(float(len(parts))))
    return df.select(*keep, (sum(votes[1:], votes[0]) / F.lit(float(len(votes)))).alias("probability"))


def fit_binary(split: DataFrame, folds: int = FOLDS, max_rows: int | None = None, max_iter: int | None = None) -> tuple[DataFrame, list[list[tuple]]]:
    """(vectors of the solvers' rows, all unless ``max_rows`` is given, and of all test rows, with label, is_test and fold; the two calibrated ensembles).

    Vocabulary and idf come from all training rows; a test row has no fold.
    """
    rows = store(binary_rows(split), "binary-rows")
    training = rows.where(~F.col("is_test"))
    vocabularies = [a.fit(training, "text") for a in BINARY]
    rows = win.folds(bounded(training, "text", max_rows), "label", "text", folds).unionByName(rows.where("is_test"), allowMissingColumns=True)
    vectors = vectorise(rows.withColumn("doc", F.col("text")), ["doc"], "text", BINARY, vocabularies, fx.SCREEN_FEATURES).drop("doc")
    with training_blocks(vectors.where(~F.col("is_test")).select("features", "label", "fold")) as (train, fits):
        return vectors, fit_calibrated(train, folds=folds, max_iter=max_iter, fits=fits)


# ---------------------------------------------------------------------------
# pattern model (I4 + I6 + I7 + I13 + I14 + I17 + I19)
# ---------------------------------------------------------------------------

class PatternModel:
    """Vocabulary, scaler, label order and the calibrated folds."""

    def __init__(self, vocabularies: list[DataFrame], scaler: dict, labels: list[str], members: list[tuple]):
        self.vocabularies, self.scaler, self.labels, self.members = vocabularies, scaler, labels, members

    def probabilities(self, rows: DataFrame, key: list[str], text_col: str) -> DataFrame:
        """``rows`` (with the structured features) with ``p_<label>`` for every label the fit knew."""
        return self.score(vectorise(rows, key, text_col, PATTERN, self.vocabularies, fx.STRUCTURED_FEATURES, self.scaler))

    def save(self, spark: SparkSession, path: str) -> None:
        """Vocabularies, scaler, label order, linear models and isotonic maps below ``path``; the manifest comes last."""
        for b, v in enumerate(self.vocabularies):
            v.write.mode("overwrite").parquet(f"{path}/vocabulary-{b}")
        spark.createDataFrame([(c, m, d) for c, (m, d) in self.scaler.items()], "feature string, mean double, std double") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/scaler")
        maps = []
        for f, (model, steps) in enumerate(self.members):
            model.write().overwrite().save(f"{path}/model-{f}")
            maps += [(f, i, bounds, values) for i, (bounds, values) in enumerate(steps)]
        spark.createDataFrame(maps, "fold int, label int, bounds array<double>, values array<double>") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/maps")
        spark.createDataFrame([(self.labels, len(self.vocabularies))], "labels array<string>, vocabularies int") \
            .write.mode("overwrite").parquet(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "PatternModel":
        manifest = spark.read.parquet(f"{path}/manifest").first()
        scaler = {r.feature: (r["mean"], r["std"]) for r in spark.read.parquet(f"{path}/scaler").collect()}  # a row a feature
        folds: dict[int, list[tuple]] = {}
        for r in spark.read.parquet(f"{path}/maps").orderBy("fold", "label").collect():  # a row a fold and label
            folds.setdefault(r["fold"], []).append((list(r["bounds"]), list(r["values"])))
        members = [(LogisticRegressionModel.load(f"{path}/model-{f}"), steps) for f, steps in folds.items()]
        vocabularies = [spark.read.parquet(f"{path}/vocabulary-{b}") for b in range(manifest["vocabularies"])]
        return cls(vocabularies, scaler, list(manifest["labels"]), members)

    def score(self, df: DataFrame) -> DataFrame:
        keep, sums = [c for c in df.columns if c != "features"], None
        for f, (model, maps) in enumerate(self.members):
            raw = vector_to_array("rawPrediction")
            df = model.transform(df).select(*df.columns, raw.alias("_raw"))
            df = df.select("*", *[_step(F.col("_raw")[i], *m).alias(f"_s{i}") for i, m in enumerate(maps)])
            step = [F.col(f"_s{i}") for i in range(len(maps))]
            total = sum(step[1:], step[0])
            share = [F.when(total > 0, s / total).otherwise(F.lit(1.0 / len(maps))) for s in step]
            df = df.select(*[c for c in df.columns if c != "_raw" and c not in [f"_s{i}" for i in range(len(maps))]], F.array(*share).alias(f"_p{f}"))
            sums = F.col(f"_p{f}") if sums is None else F.zip_with(sums, F.col(f"_p{f}"), lambda a, b: a + b)
        mean = F.transform(sums, lambda x: x / F.lit(float(len(self.members))))
        df = df.withColumn("_mean", mean)
        return df.select(*keep, *[F.col("_mean")[i].alias("p_" + lab.lower()) for i, lab in enumerate(self.labels)])


def _step(x: Column, bounds: list[float], values: list[float]) -> Column:
    """Piecewise linear isotonic map, constant outside its bounds."""
    if not bounds:
        return F.lit(0.0)
    b, v = np.array(bounds), np.array(values)

    # a map of all training rows has too many bounds for an expression with a literal for each
    @F.arrow_udf(T.DoubleType())
    def step(xs: pa.Array) -> pa.Array:
        x = xs.to_numpy(zero_copy_only=False)
        at = np.searchsorted(b, x, side="right")  # bounds up to x
        i = np.clip(at, 1, len(b) - 1) if len(b) > 1 else np.zeros(len(x), np.int64)
        with np.errstate(all="ignore"):
            inside = v[i - 1] + (v[i] - v[i - 1]) * (x - b[i - 1]) / (b[i] - b[i - 1])
        return pa.array(np.where(at == 0, v[0], np.where(at >= len(b), v[-1], inside)), pa.float64())

    return step(x)


def scaler_stats(rows: DataFrame, test_col: str = "is_test") -> DataFrame:
    """(feature, train_mean, train_std, all_mean, all_std) of the structured features, from one pass.

    A row becomes one row a feature inside its task, so the moments of the training rows and of all rows
    are a hash aggregate of few columns; a deviation of 0 becomes 1.
    """
    names = fx.STRUCTURED_FEATURES
    values = F.array(*[F.col(c).cast("double") for c in names])
    long = rows.select((~F.col(test_col)).alias("_train"), F.posexplode(values).alias("_at", "_all")) \
        .select("_at", "_all", F.when(F.col("_train"), F.col("_all")).alias("_train"))
    sides = ("train", "all")
    per = long.groupBy("_at").agg(*[f(f"_{side}").alias(f"{side}_{m}") for side in sides for m, f in (("mean", F.avg), ("std", F.stddev_pop))]) \
        .select("_at", *[c for side in sides for c in (
            F.col(f"{side}_mean"), F.when(F.col(f"{side}_std") == 0, F.lit(1.0)).otherwise(F.col(f"{side}_std")).alias(f"{side}_std"))])
    # every feature has its row, also without rows to measure
    found = per.agg(F.map_from_entries(F.collect_list(F.struct("_at", F.struct(*per.columns[1:])))).alias("_by"))
    return found.select(F.posexplode(F.array(*map(F.lit, names))).alias("_at", "feature"), "_by") \
        .select("feature", F.try_element_at("_by", F.col("_at")).alias("_s")).select("feature", "_s.*")


def idf_by_split(rows: DataFrame, analyzer: Analyzer, text_col: str = "text", test_col: str = "is_test") -> DataFrame:
    """(term, train_df, all_df, train_idf, all_idf) of terms in ``min_df`` rows or more, from one pass.

    A term's numbers of training rows and of all rows come from the same aggregate.
    """
    sums = vz.term_sums(rows, F.col(text_col), analyzer.grams, ~F.col(test_col))
    per = sums.groupBy("term").agg(F.sum("flagged").alias("train_df"), F.sum("df").alias("all_df"))
    n = rows.agg(F.count(F.when(~F.col(test_col), 1)).alias("train"), F.count("*").alias("all")).first()
    idf = lambda side: (F.log(F.lit(1.0 + n[side]) / (F.lit(1.0) + F.col(f"{side}_df"))) + F.lit(1.0)).alias(f"{side}_idf")
    return per.where(F.col("all_df") >= analyzer.min_df).select("term", "train_df", "all_df", idf("train"), idf("all"))


def split_pattern(corpus: DataFrame) -> DataFrame:
    """The pattern corpus with its structured features and the stratified test flag, stored.

    The corpus is computed once, and its rows aren't moved for the split; keys that come again are told
    apart by the row's number. It comes first, or the features would go below the cap of a class,
    whose rows would then be sorted whole."""
    rows = corpus.withColumnRenamed("dyslexic_sentence", "text")
    numbered = rows.withColumn("_n", F.monotonically_increasing_id())
    kept = store(fx.with_structured_features(numbered, "text"), "pattern-rows")
    split = win.stored_split(kept, "macro_label", "row_key", 0.2, tiebreak="_n")
    return split.select(*rows.columns, "is_test", *fx.STRUCTURED_FEATURES)


def pattern_scaler(rows: DataFrame, fit_on_all: bool = False) -> dict[str, tuple[float, float]]:
    side = "all" if fit_on_all else "train"
    return {r.feature: (r[f"{side}_mean"], r[f"{side}_std"]) for r in scaler_stats(rows).collect()}  # a row a feature


def pattern_vectors(corpus: DataFrame, fit_on_all: bool = False, label: str | None = None) -> DataFrame:
    """(key, label, dense, indices, values) of the 80 % training part, as oversampling (I8) takes them.

    ``label``: only that class; vocabulary and scaler come from the whole part nevertheless.
    """
    rows = split_pattern(corpus)
    train = rows.where(~F.col("is_test"))
    vocabularies = [a.fit(rows if fit_on_all else train, "text") for a in PATTERN]
    wanted = train if label is None else train.where(F.col("macro_label") == label)
    got = vectorise(wanted, ["row_key"], "text", PATTERN, vocabularies, fx.STRUCTURED_FEATURES, pattern_scaler(rows, fit_on_all), apart=True)
    return got.select(F.col("row_key").alias("key"), F.col("macro_label").alias("label"), "dense", "indices", "values")


def fit_pattern_member(train: DataFrame, k: int, labels: list[str], max_iter: int, single: bool = True) -> tuple:
    """The weighted multinomial model of the folds other than ``k``, and its isotonic maps on fold ``k``; ``single``: of one block."""
    # a single block is kept for the solver's steps: the weights are a join, which would deal it over all shuffle partitions
    part = co.class_weights(train.where(F.col("fold") != k), "macro_label").select("features", "label", "class_weight")
    part = part.coalesce(1).persist() if single else part
    model = LogisticRegression(family="multinomial", labelCol="label", featuresCol="features", weightCol="class_weight",
                               regParam=1.0 / (PATTERN_C * max(1, part.count())), maxIter=max_iter, tol=TOLERANCE,
                               standardization=False).fit(part)
    if single:
        part.unpersist()
    held = model.transform(train.where(F.col("fold") == k)).select("label", vector_to_array("rawPrediction").alias("raw")).persist()
    maps = []
    for i in range(len(labels)):
        m = IsotonicRegression().fit(held.select((F.col("label") == i).cast("double").alias("label"), F.col("raw")[i].alias("features")))
        maps.append((list(map(float, m.boundaries)), list(map(float, m.predictions))))
    held.unpersist()
    return model, maps


def fit_pattern(corpus: DataFrame, folds: int = PATTERN_FOLDS, max_rows: int | None = None,
                max_iter: int = PATTERN_ITER, fit_on_all: bool = False) -> tuple[DataFrame, PatternModel]:
    """I13 with balanced weights (I17) and 3-fold isotonic calibration.

    Returns the vectors of all test rows (``label`` as index, ``macro_label``) and the model.
    Vocabulary, idf and scaling come from all rows of the 80 % training part, or, with
    ``fit_on_all`` and as in the original, of the whole corpus; the linear models from the
    training part, whole unless ``max_rows`` is given.
    """
    rows = split_pattern(corpus)
    index = StringIndexer(inputCol="macro_label", outputCol="label", stringOrderType="alphabetAsc").fit(rows)         # I7
    rows = index.transform(rows)
    training = rows.where(~F.col("is_test"))
    vocabularies = [a.fit(rows if fit_on_all else training, "text") for a in PATTERN]
    scaler = pattern_scaler(rows, fit_on_all)                                                                         # D23
    rows = win.folds(bounded(training, "row_key", max_rows), "macro_label", "row_key", folds).unionByName(
        rows.where("is_test"), allowMissingColumns=True)
    vectors = vectorise(rows, ["row_key"], "text", PATTERN, vocabularies, fx.STRUCTURED_FEATURES, scaler)             # I6
    with training_blocks(vectors.where(~F.col("is_test")).select("features", "label", "macro_label", "fold")) as (train, fits):
        single = fits == FITS_AT_ONCE
        members = at_once([partial(fit_pattern_member, train, k, index.labels, max_iter, single) for k in range(folds)], fits)
    return vectors.where("is_test"), PatternModel(vocabularies, scaler, index.labels, members)


# ---------------------------------------------------------------------------
# learned v1 weights
# ---------------------------------------------------------------------------

def learn_weights(spark: SparkSession, features: DataFrame, label_col: str = "label", max_iter: int = 1000) -> DataFrame:
    """I16: multinomial LR coefficients per pattern x surface feature as a long table."""
    data = features.select(label_col, *[F.col(c).cast("double").alias(c) for c in K.SURFACE_FEATURES]) \
        .na.fill(0)
    # equal rows are one row with their number as weight: a step of the solver meets the distinct rows
    data = store(data.groupBy(*data.columns).agg(F.count(F.lit(1)).cast("double").alias("_n")), "weighted-rows")
    n, squares = data.agg(F.coalesce(F.sum("_n"), F.lit(0.0)), F.coalesce(F.sum(F.col("_n") * F.col("_n")), F.lit(0.0))).first()
    # the solver's variance of weighted rows divides by n - squares / n in place of n - 1; the penalty, which
    # is on coefficients times deviations, takes that back
    same = (n - squares / n) / (n - 1) if n > 1 else 1.0
    idx = StringIndexer(inputCol=label_col, outputCol="_y", stringOrderType="alphabetAsc").fit(data)
    va = VectorAssembler(inputCols=K.SURFACE_FEATURES, outputCol="_x")
    lr = LogisticRegression(family="multinomial", labelCol="_y", featuresCol="_x", weightCol="_n", maxIter=max_iter,
                            regParam=same / max(1.0, n))
    m = lr.fit(va.transform(idx.transform(data)))
    coef = m.coefficientMatrix.toArray()
    rows = [(lab, f, float(coef[i][j])) for i, lab in enumerate(idx.labels)
            for j, f in enumerate(K.SURFACE_FEATURES)]
    return spark.createDataFrame(rows, "pattern string, feature string, weight double")


def write_weights(weights: DataFrame, path: str) -> None:
    """Long-form weights as JSON lines."""
    weights.write.mode("overwrite").json(path)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("pattern string, feature string, weight double").json(path)


def save_ensembles(ensembles: list[list[tuple]], spark: SparkSession, path: str) -> None:
    """The fitted linear models and their sigmoids."""
    rows = []
    for i, members in enumerate(ensembles):
        for j, (model, a, b) in enumerate(members):
            model.write().overwrite().save(f"{path}/model-{i}-{j}")
            rows.append((i, j, type(model).__name__, a, b))
    spark.createDataFrame(rows, "ensemble int, fold int, kind string, a double, b double").write.mode("overwrite").parquet(f"{path}/sigmoids")


def load_ensembles(spark: SparkSession, path: str) -> list[list[tuple]]:
    kinds = {"LinearSVCModel": LinearSVCModel, "LogisticRegressionModel": LogisticRegressionModel}
    out: dict[int, list[tuple]] = {}
    for r in spark.read.parquet(f"{path}/sigmoids").orderBy("ensemble", "fold").collect():
        out.setdefault(r.ensemble, []).append((kinds[r.kind].load(f"{path}/model-{r.ensemble}-{r.fold}"), r.a, r.b))
    return list(out.values())
