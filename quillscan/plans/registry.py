"""Registered queries (name -> callable(spark, sf_dir)) and their DuckDB oracles.

Doubles are rounded to 6 places on both sides (the 2/3/4-place rounding of the
original output is a final presentation step with engine-specific tie rules).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sql_oracle as O
from ..functions import features as fx
from ..operators import screening as op
from ..sources import tables as tb
from . import profile as prof
from . import screen as scr

QUERIES: dict = {}
ORACLE: dict = {}
D = 6


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _r(c: str, digits: int = D):
    return F.round(F.col(c), digits).alias(c)


# ---------------------------------------------------------------------------
# I20 binary screening
# ---------------------------------------------------------------------------

@register("screen_essays", O.screen_essays(D))
def screen_essays(spark: SparkSession, sf: str) -> DataFrame:
    return scr.screen_essays(tb.essays(spark, sf), digits=D)


@register("screen_essays_notebook_rule", O.screen_essays(D, rule="notebook"))
def screen_essays_notebook_rule(spark: SparkSession, sf: str) -> DataFrame:
    return scr.screen_essays(tb.essays(spark, sf), rule="notebook", digits=D)


@register("screening_sentences", f"WITH {O.ESSAYS}, {O.screening_sentences()} "
          "SELECT essay_id, sent_pos, text, CAST(length(text) AS BIGINT) AS n_chars FROM sentences")
def screening_sentences(spark: SparkSession, sf: str) -> DataFrame:
    s = op.explode_sentences(tb.essays(spark, sf))
    return s.select("essay_id", "sent_pos", "text", F.length("text").cast("bigint").alias("n_chars"))


@register("screen_features", f"WITH {O.ESSAYS}, {O.screening_sentences()}, "
          f"f AS (SELECT essay_id, sent_pos, {O.screen_feature_select()} FROM sentences) "
          "SELECT essay_id, sent_pos, " + ", ".join(f"round({c}, {D}) AS {c}" for c in fx.SCREEN_FEATURES)
          + " FROM f")
def screen_features(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.with_screen_features(op.explode_sentences(tb.essays(spark, sf)))
    return s.select("essay_id", "sent_pos", *[_r(c) for c in fx.SCREEN_FEATURES])


@register("sentence_scores", f"WITH {O.scored_sentences_ctes()} "
          f"SELECT essay_id, sent_pos, round(probability, {D}) AS probability, "
          f"{O.sentence_label('probability')} AS label, weight FROM scored")
def sentence_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = scr.scored_sentences(tb.essays(spark, sf))
    return s.select("essay_id", "sent_pos", _r("probability"), "label", "weight")


# ---------------------------------------------------------------------------
# I21 pattern profile (v2)
# ---------------------------------------------------------------------------

@register("structured_features", f"WITH {O.ESSAYS}, {O.pattern_sentences()}, {O.structured_ctes()} "
          "SELECT essay_id, sent_pos, " + ", ".join(
              f"round({c}, {D}) AS {c}" if c.endswith(("ratio", "imbalance", "length", "per_word"))
              and c != "char_length" else c for c in fx.STRUCTURED_FEATURES) + " FROM sfeat")
def structured_features(spark: SparkSession, sf: str) -> DataFrame:
    s = prof.pattern_sentences(tb.essays(spark, sf), keep_empty=False)
    return s.select("essay_id", "sent_pos", *[
        _r(c) if c.endswith(("ratio", "imbalance", "length", "per_word")) and c != "char_length"
        else F.col(c) for c in fx.STRUCTURED_FEATURES])


@register("pattern_profile", O.profile_essays(D))
def pattern_profile(spark: SparkSession, sf: str) -> DataFrame:
    return prof.profile_essays(tb.essays(spark, sf), digits=D)


@register("pattern_profile_rounded", O.rounded_profile())
def pattern_profile_rounded(spark: SparkSession, sf: str) -> DataFrame:
    """The nested result's own rounding."""
    return prof.profile_results_nested(tb.essays(spark, sf)).select(
        "essay_id", "risk_score", "dyslexic_ratio", "weighted_dyslexic_ratio", "max_sentence_probability")


@register("pattern_examples", O.pattern_examples())
def pattern_examples(spark: SparkSession, sf: str) -> DataFrame:
    """D8 + F3: strong sentences per essay and pattern, the first three of them."""
    return prof.first_examples(prof.profile_results_nested(tb.essays(spark, sf)))


@register("essay_reports", O.essay_reports())
def essay_reports(spark: SparkSession, sf: str) -> DataFrame:
    """H74."""
    return prof.report_text(prof.profile_results_nested(tb.essays(spark, sf)))


# ---------------------------------------------------------------------------
# I22 / I25 rule-based profile (v1)
# ---------------------------------------------------------------------------
from ..functions import scoring as sc  # noqa: E402
from ..functions import text as tx  # noqa: E402
from .. import constants as K  # noqa: E402
from ..functions import diff as dfx  # noqa: E402
from . import rules as rl  # noqa: E402

_V1_LINE_COLS = ["essay_id", "sent_pos", "raw_sentence", "proxy_reference", "char_addition",
                 "char_omission", "char_substitution", "has_addition", "has_omission",
                 "has_substitution", "word_count_diff", "has_spacing_issue", "has_diacritic_loss",
                 "writing_pattern", "explanation"]


@register("proxy_reference", f"WITH {O.rule_lines_ctes(sc.V1_WEIGHTS)} "
          "SELECT essay_id, sent_pos, raw_sentence, proxy_reference FROM rule_lines")
def proxy_reference(spark: SparkSession, sf: str) -> DataFrame:
    s = op.explode_sentences(tb.essays(spark, sf), splitter=tx.split_lines)
    s = s.select("essay_id", "sent_pos", F.col("text").alias("raw_sentence"))
    return tx.with_proxy(s, "raw_sentence")


@register("rule_sentences_edit_twin", f"WITH {O.rule_lines_ctes(sc.V1_WEIGHTS)} "
          f"SELECT {', '.join(_V1_LINE_COLS)} FROM rule_lines")
def rule_sentences_edit_twin(spark: SparkSession, sf: str) -> DataFrame:
    return rl.rule_sentences(tb.essays(spark, sf), counts=dfx.edit_counts).select(*_V1_LINE_COLS)


@register("rule_profile_edit_twin", f"WITH {O.rule_lines_ctes(sc.V1_WEIGHTS)}, "
          + O.v1_profile_sql("rule_lines"))
def rule_profile_edit_twin(spark: SparkSession, sf: str) -> DataFrame:
    return rl.flat_profile(rl.rule_profile(tb.essays(spark, sf), counts=dfx.edit_counts))


@register("rule_sentences", f"WITH RECURSIVE {O.rule_lines_ctes(sc.V1_WEIGHTS, True)} "
          f"SELECT {', '.join(_V1_LINE_COLS)} FROM rule_lines")
def rule_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """I22, line by line: proxy (H11), exact runtime features (H54), pattern and explanation."""
    return rl.rule_sentences(tb.essays(spark, sf)).select(*_V1_LINE_COLS)


@register("rule_profile", f"WITH RECURSIVE {O.rule_lines_ctes(sc.V1_WEIGHTS, True)}, "
          + O.v1_profile_sql("rule_lines"))
def rule_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The essay profile over the exact features."""
    return rl.flat_profile(rl.rule_profile(tb.essays(spark, sf)))


_PAIR_COLS = ["essay_id", "pos", "clean_sentence", "dyslexic_sentence", "error_type"]


@register("pairs", f"WITH {O.pairs_ctes()} SELECT {', '.join(_PAIR_COLS)} FROM pairs")
def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return tb.pairs(spark, sf)


@register("pair_patterns_edit_twin", f"WITH {O.pair_patterns_ctes(sc.V1_WEIGHTS)} "
          "SELECT essay_id, pos, error_type, char_addition, char_omission, char_substitution, has_addition, "
          "has_omission, has_substitution, word_count_diff, has_spacing_issue, has_diacritic_loss, "
          "writing_pattern, explanation FROM pair_patterns")
def pair_patterns_edit_twin(spark: SparkSession, sf: str) -> DataFrame:
    return rl.pair_patterns(tb.pairs(spark, sf), counts=dfx.edit_counts).select(
        "essay_id", "pos", "error_type", "char_addition", "char_omission", "char_substitution", "has_addition",
        "has_omission", "has_substitution", "word_count_diff", "has_spacing_issue", "has_diacritic_loss",
        "writing_pattern", "explanation")


_SURFACE_COLS = ["essay_id", "pos", *K.SURFACE_FEATURES]


@register("pair_surface_features", f"WITH RECURSIVE {O.pair_features_ctes(K.PAIR_DIACRITICS, True)} SELECT {', '.join(_SURFACE_COLS)} FROM pf")
def pair_surface_features(spark: SparkSession, sf: str) -> DataFrame:
    """H49 + H53: the exact difference of every valid pair, with words and diacritics."""
    c, d = F.col("clean_sentence"), F.col("dyslexic_sentence")
    p = tb.pairs(spark, sf).where(rl.valid_text(c) & rl.valid_text(d))
    return rl.with_difference(p, ["essay_id", "pos"], dfx.matching_counts(c, d)).select("essay_id", "pos", *dfx.surface_features(c, d, F.col("_d"))).select(*_SURFACE_COLS)


_PATTERN_COLS = ["essay_id", "pos", "error_type", *K.SURFACE_FEATURES, "writing_pattern", "explanation"]


@register("pair_patterns", f"WITH RECURSIVE {O.pair_patterns_ctes(sc.V1_WEIGHTS, True)} SELECT {', '.join(_PATTERN_COLS)} FROM pair_patterns")
def pair_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Pattern and explanation of every valid pair, over the exact differences."""
    return rl.pair_patterns(tb.pairs(spark, sf)).select(*_PATTERN_COLS)


@register("pseudo_essay_profile", f"WITH {O.pair_patterns_ctes(sc.V1_WEIGHTS)}, "
          "blocks AS (SELECT CAST((row_number() OVER (ORDER BY essay_id, pos) - 1) // 5 AS BIGINT) AS essay_id, "
          "writing_pattern FROM pair_patterns), " + O.v1_profile_sql("blocks"))
def pseudo_essay_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rl.flat_profile(rl.pseudo_essay_profile(rl.pair_patterns(tb.pairs(spark, sf), counts=dfx.edit_counts)))


# ---------------------------------------------------------------------------
# I23 / I24 corpus builds, D14 / D17 / D26 counts
# ---------------------------------------------------------------------------
from ..operators import corpus as co  # noqa: E402
from ..operators import evaluate as ev  # noqa: E402
from ..operators import windows as win  # noqa: E402
from . import corpus_builds as cb  # noqa: E402


def _binary(spark, sf):
    return cb.binary_corpus([tb.pairs(spark, sf)], cb.extra_clean(spark))


def _pattern(spark, sf):
    return cb.pattern_corpus([tb.pairs(spark, sf), cb.pages_as_pairs(tb.read_table(spark, sf, "pages"))])


@register("binary_corpus", O.binary_corpus(co.EXTRA_CLEAN, co.EXTRA_TIMES))
def binary_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return _binary(spark, sf)


@register("binary_corpus_label_counts", "WITH b AS (" + O.binary_corpus(co.EXTRA_CLEAN, co.EXTRA_TIMES)
          + ") SELECT label, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share "
            "FROM b GROUP BY label")
def binary_corpus_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return co.value_counts(_binary(spark, sf), "label", normalize=True).withColumn("share", _r("share"))


@register("pattern_corpus", O.pattern_corpus(cb.NORMAL_CAP))
def pattern_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return _pattern(spark, sf)


@register("pattern_corpus_label_counts", "WITH p AS (" + O.pattern_corpus(cb.NORMAL_CAP)
          + ") SELECT macro_label, count(*) AS count FROM p GROUP BY macro_label")
def pattern_corpus_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return co.value_counts(_pattern(spark, sf), "macro_label")


@register("duplicate_count", f"WITH {O.pairs_ctes()} SELECT CAST(count(*) - count(DISTINCT "
          "coalesce(dyslexic_sentence, chr(0))) AS BIGINT) AS duplicates_removed, "
          "count(*) AS rows_before FROM pairs")
def duplicate_count(spark: SparkSession, sf: str) -> DataFrame:
    return win.duplicate_count(tb.pairs(spark, sf), ["dyslexic_sentence"])


@register("macro_labels", f"WITH {O.pairs_ctes()} SELECT essay_id, pos, error_type, "
          f"{O.normalize_label('error_type')} AS macro_label FROM pairs")
def macro_labels(spark: SparkSession, sf: str) -> DataFrame:
    p = tb.pairs(spark, sf)
    return p.select("essay_id", "pos", "error_type", co.normalize_label(F.col("error_type")).alias("macro_label"))


@register("v1_label_map", f"WITH {O.pairs_ctes()} SELECT essay_id, pos, error_type, CASE error_type "
          + " ".join(f"WHEN {O.q(k)} THEN {O.q(v)}" for k, v in __import__(
              'quillscan.constants', fromlist=['x']).V1_LABEL_MAP.items())
          + " END AS label FROM pairs WHERE error_type IN ("
          + ", ".join(O.q(k) for k in __import__('quillscan.constants', fromlist=['x']).V1_LABEL_MAP) + ")")
def v1_label_map(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import rules_v1 as rv
    m = rv.map_labels(tb.pairs(spark, sf).select("essay_id", "pos", "error_type"))
    return m.na.drop(subset=["label"])


@register("junk_filter", "WITH u AS (SELECT CAST(doc_id AS BIGINT) AS id, 'doc' AS kind, text FROM documents "
          "UNION ALL SELECT page_id, 'page', html FROM pages) SELECT id, kind FROM u WHERE NOT coalesce("
          f"regexp_matches(text, {O.q(__import__('quillscan.constants', fromlist=['x']).JUNK)}), false)")
def junk_filter(spark: SparkSession, sf: str) -> DataFrame:
    d = tb.read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("doc").alias("kind"),
                                                     "text")
    pg = tb.read_table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind"),
                                                  F.col("html").alias("text"))
    return co.drop_junk(co.union_all([d, pg]), "text").select("id", "kind")


# ---------------------------------------------------------------------------
# D18-D20 evaluation: labels.quality vs the essay composite score
# ---------------------------------------------------------------------------

def _eval_rows(spark, sf, threshold: float = 0.5):
    s = scr.screen_essays(tb.essays(spark, sf), digits=None).where(F.col("composite_score").isNotNull())
    lab = tb.read_table(spark, sf, "labels")
    j = lab.join(s, lab.doc_id == s.essay_id)
    return j.select(F.col("quality").cast("int").alias("label"),
                    (F.col("composite_score") >= threshold).cast("int").alias("prediction"),
                    F.col("composite_score").alias("probability"))


@register("confusion_matrix", f"WITH {O.eval_rows()} SELECT label, "
          "CAST(count(*) FILTER (WHERE prediction = 0) AS BIGINT) AS pred_0, "
          "CAST(count(*) FILTER (WHERE prediction = 1) AS BIGINT) AS pred_1 FROM ev GROUP BY label")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return ev.confusion_matrix(_eval_rows(spark, sf))


@register("roc_auc", f"WITH {O.eval_rows()}, s AS (SELECT probability AS score, "
          "count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM ev GROUP BY 1), "
          "c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
          "AS neg_below FROM s) SELECT round(sum(pos * (neg_below + neg * 0.5)) / (sum(pos) * sum(neg)), 6) AS roc_auc, "
          "CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives FROM c")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return ev.roc_auc(_eval_rows(spark, sf)).withColumn("roc_auc", _r("roc_auc"))


@register("classification_report", f"""WITH {O.eval_rows()},
cls AS (SELECT DISTINCT label AS c FROM ev UNION SELECT DISTINCT prediction FROM ev),
per AS (SELECT c, count(*) FILTER (WHERE label = c AND prediction = c) AS tp,
               count(*) FILTER (WHERE prediction = c) AS pp, count(*) FILTER (WHERE label = c) AS support
        FROM cls, ev GROUP BY c),
m AS (SELECT c, CASE WHEN pp > 0 THEN tp / pp ELSE 0.0 END AS precision,
             CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, support, tp FROM per),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m),
s AS (SELECT sum(tp) / sum(support) AS acc, sum(support) AS n, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
             sum(precision * support) / sum(support) AS wp, sum(recall * support) / sum(support) AS wr,
             sum(f1 * support) / sum(support) AS wf FROM f)
SELECT CAST(c AS VARCHAR) AS class, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1_score, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(acc, 6), CAST(n AS BIGINT) FROM s
UNION ALL SELECT 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), CAST(n AS BIGINT) FROM s
UNION ALL SELECT 'weighted avg', round(wp, 6), round(wr, 6), round(wf, 6), CAST(n AS BIGINT) FROM s""")
def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    r = ev.classification_report(_eval_rows(spark, sf))
    return r.select("class", _r("precision"), _r("recall"), _r("f1_score"), "support")


@register("describe_composite", f"""WITH {O.eval_rows()}
SELECT CAST(count(probability) AS BIGINT) AS count, round(avg(probability), 6) AS mean,
       round(stddev_samp(probability), 6) AS std, round(min(probability), 6) AS min,
       round(quantile_cont(probability, 0.25), 6) AS p25, round(quantile_cont(probability, 0.5), 6) AS p50,
       round(quantile_cont(probability, 0.75), 6) AS p75, round(max(probability), 6) AS max FROM ev""")
def describe_composite(spark: SparkSession, sf: str) -> DataFrame:
    d = ev.describe(_eval_rows(spark, sf), "probability")
    return d.select("count", *[_r(c) for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]])


@register("stratified_split", "WITH bc AS (" + O.binary_corpus(co.EXTRA_CLEAN, co.EXTRA_TIMES) + """),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(text), text) - 1 AS li,
             count(*) OVER (PARTITION BY label) AS n FROM bc)
SELECT text, label, li < ceil(n * 0.2) AS is_test FROM r""")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return win.stratified_split(_binary(spark, sf), "label", "text", 0.2, stored=True)


@register("label_folds", f"""WITH {O.pairs_ctes()},
pc AS (SELECT CAST(essay_id AS VARCHAR) || ':' || CAST(pos AS VARCHAR) AS pair, {O.normalize_label('error_type')} AS macro_label FROM pairs)
SELECT pair, macro_label, CAST((row_number() OVER (PARTITION BY macro_label ORDER BY md5(pair), pair) - 1) % 5 AS INTEGER) AS fold FROM pc""")
def label_folds(spark: SparkSession, sf: str) -> DataFrame:
    pair = F.concat_ws(":", F.col("essay_id").cast("string"), F.col("pos").cast("string"))
    p = tb.pairs(spark, sf).select(pair.alias("pair"), co.normalize_label(F.col("error_type")).alias("macro_label"))
    return win.folds(p, "macro_label", "pair", 5)


@register("class_weights", f"""WITH {O.pairs_ctes()},
pc AS (SELECT {O.normalize_label('error_type')} AS macro_label FROM pairs),
c AS (SELECT macro_label, count(*) AS nc FROM pc GROUP BY 1)
SELECT macro_label, round((SELECT sum(nc) FROM c) / ((SELECT count(*) FROM c) * nc), 6) AS class_weight, nc AS count FROM c""")
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    p = tb.pairs(spark, sf).select(co.normalize_label(F.col("error_type")).alias("macro_label"))
    w = co.class_weights(p, "macro_label")
    return w.groupBy("macro_label").agg(F.round(F.first("class_weight"), D).alias("class_weight"),
                                        F.count(F.lit(1)).alias("count"))


@register("pseudo_essays", """SELECT CAST((row_number() OVER (ORDER BY conv_id, turn) - 1) // 5 AS BIGINT) AS essay_id,
  conv_id, turn FROM conversations""")
def pseudo_essays(spark: SparkSession, sf: str) -> DataFrame:
    c = tb.read_table(spark, sf, "conversations").select("conv_id", "turn")
    return win.pseudo_essay_id(c, ["conv_id", "turn"], 5)


@register("pseudo_essay_texts", f"""WITH b AS (SELECT CAST((row_number() OVER (ORDER BY conv_id, turn) - 1) // 5 AS BIGINT) AS essay_id,
  row_number() OVER (ORDER BY conv_id, turn) AS pos, text FROM conversations)
SELECT essay_id, string_agg(text, '. ' ORDER BY pos) AS text, count(*) AS n_sentences FROM b GROUP BY essay_id""")
def pseudo_essay_texts(spark: SparkSession, sf: str) -> DataFrame:
    c = tb.read_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    b = win.consecutive_index(c, ["conv_id", "turn"], out="pos")
    b = b.withColumn("essay_id", F.floor(F.col("pos") / 5).cast("bigint"))
    return win.concat_sentences(b, "essay_id", "pos", "text")


@register("screen_essays_any_sentence", f"""WITH {O.ESSAYS},
sb AS (SELECT essay_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda s: {O.strip('s')}),
                                    lambda s: s <> '') AS s FROM essays),
st AS (SELECT essay_id, unnest(s) AS text FROM sb),
f AS (SELECT essay_id, text, {O.screen_feature_select()} FROM st),
p AS (SELECT essay_id, {O.screen_probability()} AS probability FROM f)
SELECT essay_id, CASE WHEN max(probability) >= 0.65 THEN 'DYSLEXIC ESSAY' ELSE 'NORMAL ESSAY' END AS essay_label,
       round(avg(probability), 6) AS confidence, count(*) AS total_sentences,
       count(*) FILTER (WHERE probability >= 0.65) AS flagged_sentences FROM p GROUP BY essay_id""")
def screen_essays_any_sentence(spark: SparkSession, sf: str) -> DataFrame:
    s = op.explode_sentences(tb.essays(spark, sf), splitter=tx.split_basic)
    r = op.essay_label_any(op.score_sentences(s))
    return r.withColumn("confidence", _r("confidence"))


# ---------------------------------------------------------------------------
# I1-I4 TF-IDF (long form), D22 / B14 / F4 vocabulary, C7 join
# ---------------------------------------------------------------------------
from ..functions import grams as gr  # noqa: E402
from ..operators import vectorize as vz  # noqa: E402
from ..session import checkpoint_dir  # noqa: E402

_BIN_TRAIN_SQL = ("SELECT text AS doc_id, text FROM (WITH bc AS (" + O.binary_corpus(co.EXTRA_CLEAN, co.EXTRA_TIMES)
                  + "), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(text), text) - 1 AS li, "
                  "count(*) OVER (PARTITION BY label) AS n FROM bc) SELECT text FROM r WHERE NOT (li < ceil(n * 0.2)))")
_PAT_SQL = "SELECT row_key AS doc_id, dyslexic_sentence AS text FROM (" + O.pattern_corpus(cb.NORMAL_CAP, True) + ")"

TFIDF_SPECS = {
    # name: (docs, n-grams, oracle's source list, oracle's n-grams, min_df, max_features, sublinear)
    "char_tfidf_2_4": ("binary", gr.Grams("char", 2, 4), O.char_source("text"), O.char_grams(2, 4), 1, None, False),
    "char_wb_tfidf_2_5": ("binary", gr.Grams("char_wb", 2, 5), O.char_wb_source("text"), O.char_wb_grams(2, 5), 2, 60000, True),
    "word_tfidf_1_2": ("binary", gr.Grams("word", 1, 2), O.word_source("text"), O.word_grams(), 2, 20000, True),
    "char_tfidf_2_5": ("pattern", gr.Grams("char", 2, 5), O.char_source("text"), O.char_grams(2, 5), 2, 30000, True),
}


def _tfidf_docs(spark, sf, kind):
    """The documents, from a table: compressed, it is a fraction of a checkpoint."""
    from . import models as md
    if kind == "binary":
        d = win.stored_split(md.store(_binary(spark, sf), "binary-rows", compression="zstd"), "label", "text", 0.2)
        return d.where(~F.col("is_test")).select(F.col("text").alias("doc_id"), "text")
    p = cb.pattern_corpus([tb.pairs(spark, sf), cb.pages_as_pairs(tb.read_table(spark, sf, "pages"))],
                          keep_key=True)
    return md.store(p.select(F.col("row_key").alias("doc_id"), F.col("dyslexic_sentence").alias("text")), "pattern-docs", compression="zstd")


def _tfidf(spark, sf, name):
    """(documents, vocabulary): the documents are stored once, for fit and transform; counts, many times their size, are made anew."""
    kind, grams, _, _, min_df, cap, _ = TFIDF_SPECS[name]
    checkpoint_dir(spark)
    docs = _tfidf_docs(spark, sf, kind)
    return docs, vz.fit_text_vocabulary(docs, F.col("text"), grams, min_df, cap)


def _make_tfidf(name):
    kind, grams, source, gsql, min_df, cap, sub = TFIDF_SPECS[name]
    docs_sql = _BIN_TRAIN_SQL if kind == "binary" else _PAT_SQL
    ctes = O.tfidf_ctes(docs_sql, source, gsql, min_df, cap, sub)

    def vocab_q(spark, sf):
        vocab = _tfidf(spark, sf, name)[1]
        return vocab.select("term", F.col("df").cast("bigint"), F.col("total_tf").cast("bigint"),
                            _r("idf"), F.col("index").cast("bigint"))

    def summary_q(spark, sf):
        docs, vocab = _tfidf(spark, sf, name)
        summ = vz.text_summary(docs, F.col("text"), grams, vocab, sublinear=sub)
        return summ.select("doc_id", F.col("n_terms").cast("bigint"), _r("sum_tfidf"), _r("max_tfidf"))

    register(name.replace("tfidf", "vocabulary"), f"WITH {ctes} {O.vocabulary_select()}")(vocab_q)
    register(name, f"WITH {ctes} {O.summary_select()}")(summary_q)


for _n in TFIDF_SPECS:
    _make_tfidf(_n)


# ---------------------------------------------------------------------------
# Models (rows-only checks): I9/I10/I11/I18 binary, I13/I19 pattern, I16 weights
# ---------------------------------------------------------------------------

@register("binary_model_eval")
def binary_model_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Calibrated LR and linear SVM, soft vote, report on the test split."""
    from . import models as md
    split = win.stratified_split(_binary(spark, sf), "label", "text", 0.2, stored=True)
    vectors, ensembles = md.fit_binary(split)
    scored = md.soft_vote(vectors.where("is_test").select("label", "features"), ensembles)
    pred = scored.select("label", (F.col("probability") >= 0.5).cast("int").alias("prediction"))
    return ev.classification_report(pred)


def _fit_pattern(spark, sf):
    from . import models as md
    return md.fit_pattern(_pattern_corpus(spark, sf))


@register("pattern_model_eval")
def pattern_model_eval(spark: SparkSession, sf: str) -> DataFrame:
    """I13 + I14: report of the calibrated pattern model on its test split (H75 by the largest probability)."""
    test, model = _fit_pattern(spark, sf)
    p = model.score(test.select("macro_label", "features"))
    best = F.array_max(F.array(*[F.struct(F.col("p_" + lab.lower()).alias("p"), F.lit(-i).alias("o"), F.lit(lab).alias("l"))
                                 for i, lab in enumerate(model.labels)]))
    return ev.classification_report(p.select(F.col("macro_label").alias("label"), best["l"].alias("prediction")))


@register("pattern_model_profile")
def pattern_model_profile(spark: SparkSession, sf: str) -> DataFrame:
    """I13 + I14 fitted on the pattern corpus, then I21 with the model's probabilities."""
    _, model = _fit_pattern(spark, sf)
    sents = prof.pattern_sentences(tb.essays(spark, sf), keep_empty=True)
    probs = model.probabilities(sents, ["essay_id", "sent_pos"], "text")
    known = {lab: f"p_{lab.lower()}" for lab in model.labels}
    cols = {lab: F.when(F.col("text").isNotNull(), F.col(known[lab]) if lab in known else F.lit(0.0)) for lab in prof.LABELS}
    return _profile_from(probs, cols)


def _profile_from(feats: DataFrame, cols) -> DataFrame:
    from ..functions import scoring as scx
    s = feats.select("essay_id", "sent_pos", "text", "word_count", *[c.alias(scx.prob_col(l)) for l, c in cols.items()])
    pc = {lab: F.col(scx.prob_col(lab)) for lab in prof.LABELS}
    wc = F.col("word_count")
    sp = s.select("*", scx.confidence_weight(list(pc.values()), wc).alias("weight"),
                  scx.is_dyslexic(pc, wc).alias("is_dyslexic"), scx.max_prob(list(pc.values())).alias("max_prob"),
                  scx.argmax_label(pc).alias("top_label"))
    return prof.finish_profile(prof.profile_rollup(sp), digits=D)


_TRAIN_SQL = ("SELECT row_key, macro_label FROM (SELECT row_key, macro_label, row_number() OVER (PARTITION BY macro_label ORDER BY md5(row_key), row_key) - 1 AS place, "
              "count(*) OVER (PARTITION BY macro_label) AS n FROM corpus) WHERE NOT (place < ceil(n * 0.2))")
_SCALED_SQL = ", ".join(f"(t.{c} - s.{c}_m) / s.{c}_d" for c in fx.STRUCTURED_FEATURES)
_SCALER_SQL = ", ".join(f"avg({c}) AS {c}_m, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS {c}_d" for c in fx.STRUCTURED_FEATURES)


@register("smote_neighbours", f"""WITH corpus AS MATERIALIZED ({O.pattern_corpus(cb.NORMAL_CAP, True)}),
parted AS MATERIALIZED ({_TRAIN_SQL}),
{O.tfidf_ctes("SELECT row_key AS doc_id, dyslexic_sentence AS text FROM corpus SEMI JOIN parted USING (row_key)", O.char_source("text"), O.char_grams(2, 5), 2, 30000, True)},
named AS (SELECT row_key, dyslexic_sentence AS text FROM corpus SEMI JOIN parted USING (row_key)), {O.structured_ctes("named", "row_key, text")},
scaler AS (SELECT {_SCALER_SQL} FROM sfeat),
train AS MATERIALIZED (SELECT row_key AS k FROM parted WHERE macro_label = 'Normal'),
dense AS MATERIALIZED (SELECT k, [{_SCALED_SQL}]::DOUBLE[] AS x FROM train JOIN sfeat t ON t.row_key = k CROSS JOIN scaler s),
part AS MATERIALIZED (SELECT doc_id AS k, term, tfidf FROM vec JOIN train ON k = doc_id),
size AS (SELECT k, coalesce(sum(tfidf * tfidf), 0) AS s FROM train LEFT JOIN part USING (k) GROUP BY k),
dots AS (SELECT a.k AS a, b.k AS b, sum(a.tfidf * b.tfidf) AS dot FROM part a JOIN part b USING (term) WHERE a.k <> b.k GROUP BY a.k, b.k),
far AS (SELECT p.k AS key, q.k AS neighbour, round(greatest(pow(list_distance(p.x, q.x), 2) + u.s + v.s - 2 * coalesce(dot, 0), 0), 9) AS d2
        FROM dense p JOIN dense q ON p.k <> q.k JOIN size u ON u.k = p.k JOIN size v ON v.k = q.k LEFT JOIN dots ON a = p.k AND b = q.k)
SELECT key, CAST(rank AS INTEGER) AS rank, neighbour, round(sqrt(d2), 6) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY d2, neighbour) AS rank FROM far) WHERE rank <= 3""")
def smote_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The 3 nearest training rows of the same class, for the whole class Normal."""
    from ..operators import resample as rs
    return rs.neighbours(_pattern_vectors(spark, sf, "Normal"), 3).select("key", "rank", "neighbour", _r("distance"))


def _pattern_corpus(spark, sf):
    return cb.pattern_corpus([tb.pairs(spark, sf), cb.pages_as_pairs(tb.read_table(spark, sf, "pages"))], keep_key=True)


def _pattern_vectors(spark, sf, label=None):
    from . import models as md
    return md.pattern_vectors(_pattern_corpus(spark, sf), label=label)


_STATS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, " + ", ".join(
        f"round(avg({c}) {w}, 6) AS {s}_mean, round(CASE WHEN stddev_pop({c}) {w} = 0 THEN 1.0 ELSE stddev_pop({c}) {w} END, 6) AS {s}_std"
        for s, w in (("train", "FILTER (WHERE train)"), ("all", "FILTER (WHERE true)"))) + " FROM marked" for c in fx.STRUCTURED_FEATURES)


@register("scaler_stats", f"""WITH corpus AS MATERIALIZED ({O.pattern_corpus(cb.NORMAL_CAP, True)}), parted AS MATERIALIZED ({_TRAIN_SQL}),
named AS (SELECT row_key, dyslexic_sentence AS text FROM corpus), {O.structured_ctes("named", "row_key, text")},
marked AS MATERIALIZED (SELECT f.*, p.row_key IS NOT NULL AS train FROM sfeat f LEFT JOIN parted p ON p.row_key = f.row_key) {_STATS_SQL}""")
def scaler_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Moments of the 26 features over the training part and over all rows, from one scan."""
    from . import models as md
    return md.scaler_stats(md.split_pattern(_pattern_corpus(spark, sf))).select(
        "feature", *[_r(c) for c in ("train_mean", "train_std", "all_mean", "all_std")])


@register("idf_by_split", f"""WITH corpus AS MATERIALIZED ({O.pattern_corpus(cb.NORMAL_CAP, True)}), parted AS MATERIALIZED ({_TRAIN_SQL}),
cl AS MATERIALIZED (SELECT row_key, p.row_key IS NOT NULL AS train, {O.char_source("text")} AS c FROM (SELECT row_key, dyslexic_sentence AS text FROM corpus) LEFT JOIN parted p USING (row_key)),
gr AS (SELECT DISTINCT row_key, train, unnest({O.char_grams(2, 5)}) AS term FROM cl),
st AS (SELECT term, count(*) FILTER (WHERE train) AS train_df, count(*) AS all_df FROM gr GROUP BY term HAVING count(*) >= 2)
SELECT term, train_df, all_df, round(ln((1.0 + (SELECT count(*) FROM parted)) / (1.0 + train_df)) + 1.0, 6) AS train_idf,
       round(ln((1.0 + (SELECT count(*) FROM corpus)) / (1.0 + all_df)) + 1.0, 6) AS all_idf FROM st""")
def idf_by_split(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequencies and idf over the training part and over all rows, from one shuffle."""
    from . import models as md
    rows = md.split_pattern(_pattern_corpus(spark, sf)).select("text", "is_test")
    return md.idf_by_split(rows, md.PATTERN[0]).select("term", "train_df", "all_df", _r("train_idf"), _r("all_idf"))


@register("smote_class_counts", f"""WITH corpus AS ({O.pattern_corpus(cb.NORMAL_CAP, True)}),
n AS (SELECT macro_label AS label, count(*) AS given FROM ({_TRAIN_SQL}) GROUP BY macro_label)
SELECT label, given, CAST((SELECT max(given) FROM n) - given AS BIGINT) AS made, (SELECT max(given) FROM n) AS total FROM n""")
def smote_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    """I8 + D24: rows a class after oversampling the training part of the pattern corpus."""
    from ..operators import resample as rs
    return rs.class_counts(rs.oversample(_pattern_vectors(spark, sf), 3))


@register("learned_weights")
def learned_weights(spark: SparkSession, sf: str) -> DataFrame:
    """I16: LR coefficients per v1 pattern x surface feature, from C1-labelled pairs."""
    from ..operators import rules_v1 as rv
    from . import models as md
    p = rv.map_labels(tb.pairs(spark, sf)).na.drop(subset=["label"])
    c, d = F.col("clean_sentence"), F.col("dyslexic_sentence")
    feats = rl.with_difference(p.where(rl.valid_text(c) & rl.valid_text(d)), ["essay_id", "pos"], dfx.matching_counts(c, d)).select("label", *dfx.surface_features(c, d, F.col("_d")))
    return md.learn_weights(spark, feats)


# ---------------------------------------------------------------------------
# A8 nested results through JSON, H51, H58, H60
# ---------------------------------------------------------------------------

@register("screen_results_json", f"WITH {O.scored_sentences_ctes()} SELECT essay_id, CAST(sent_pos AS INTEGER) AS place, text, "
          f"round(probability, 3) AS probability, {O.sentence_label('probability')} AS label FROM scored")
def screen_results_json(spark: SparkSession, sf: str) -> DataFrame:
    """Nested results as JSON documents, read back and laid out by sentence."""
    docs = scr.results_json(scr.screen_results_nested(tb.essays(spark, sf)))
    back = F.from_json("json", "sentences array<struct<text:string,probability:double,label:string>>")
    return docs.select("essay_id", F.posexplode(back["sentences"]).alias("place", "s")).select(
        "essay_id", "place", "s.text", "s.probability", "s.label")


@register("sentence_labels_binary", f"WITH {O.scored_sentences_ctes()} SELECT essay_id, sent_pos, "
          "CASE WHEN probability >= 0.65 THEN 'DYSLEXIC' ELSE 'NORMAL' END AS label FROM scored")
def sentence_labels_binary(spark: SparkSession, sf: str) -> DataFrame:
    s = scr.scored_sentences(tb.essays(spark, sf))
    return s.select("essay_id", "sent_pos", sc.sentence_label_binary(F.col("probability")).alias("label"))


@register("dominant_merged_counts", f"WITH {O.rule_lines_ctes(sc.V1_WEIGHTS)}, p AS (WITH {O.v1_profile_sql('rule_lines')}), "
          "m AS (SELECT CASE WHEN dominant_pattern IN ('Word Boundary Confusion', 'Mixed Essay Pattern') THEN 'Mixed Dyslexic Pattern' "
          "ELSE dominant_pattern END AS dominant_pattern FROM p) SELECT dominant_pattern, count(*) AS count FROM m GROUP BY 1")
def dominant_merged_counts(spark: SparkSession, sf: str) -> DataFrame:
    """H58 over the rule-based profile with the stand-in ``edit_counts``, counted."""
    from ..operators import rules_v1 as rv
    p = rl.rule_profile(tb.essays(spark, sf), counts=dfx.edit_counts)
    return co.value_counts(p.select(rv.merge_rare(F.col("dominant_pattern")).alias("dominant_pattern")), "dominant_pattern")


def _loss_sql(points):
    cls = O.K.char_class(points)
    return f"{O.cnt('clean_sentence', cls)} > {O.cnt('dyslexic_sentence', cls)}"


@register("pair_diacritic_loss", f"WITH {O.pairs_ctes()} SELECT essay_id, pos, {_loss_sql(O.K.PAIR_DIACRITICS)} AS loss, "
          f"{_loss_sql(O.K.PAIR_DIACRITICS_NB)} AS loss_notebook FROM pairs")
def pair_diacritic_loss(spark: SparkSession, sf: str) -> DataFrame:
    """H51 (14 characters) and H52 (15 characters)."""
    from .. import constants as KK
    from ..functions import diff as dfx
    a, b = F.col("clean_sentence"), F.col("dyslexic_sentence")
    return tb.pairs(spark, sf).select("essay_id", "pos", dfx.diacritic_loss(a, b, KK.PAIR_DIACRITICS).alias("loss"),
                                      dfx.diacritic_loss(a, b, KK.PAIR_DIACRITICS_NB).alias("loss_notebook"))


# ---------------------------------------------------------------------------
# C5 / C6 combined, J1 streaming
# ---------------------------------------------------------------------------
from . import combined as cmb  # noqa: E402


@register("full_analysis", f"""WITH b AS ({O.screen_essays(D)}), p AS ({O.profile_essays(D)})
SELECT b.essay_id, b.essay_label, b.composite_score, b.error AS binary_error, p.risk_score, p.risk_level,
       p.dominant, p.error AS pattern_error FROM b JOIN p ON b.essay_id = p.essay_id""")
def full_analysis(spark: SparkSession, sf: str) -> DataFrame:
    r = cmb.full_analysis(tb.essays(spark, sf), digits=D)
    return r.select("essay_id", "binary.essay_label", "binary.composite_score",
                    F.col("binary.error").alias("binary_error"), "patterns.risk_score", "patterns.risk_level",
                    "patterns.dominant", F.col("patterns.error").alias("pattern_error"))


@register("gated_analysis", f"""WITH b AS ({O.screen_essays(D)}), p AS ({O.profile_essays(D)})
SELECT b.*, CASE WHEN b.essay_label <> 'NORMAL ESSAY' THEN p.risk_score END AS risk_score,
       CASE WHEN b.essay_label <> 'NORMAL ESSAY' THEN p.risk_level END AS risk_level,
       CASE WHEN b.essay_label <> 'NORMAL ESSAY' THEN p.dominant END AS dominant
FROM b LEFT JOIN p ON b.essay_id = p.essay_id""")
def gated_analysis(spark: SparkSession, sf: str) -> DataFrame:
    return cmb.gated_analysis(tb.essays(spark, sf), digits=D)


@register("stream_screen_essays", O.screen_essays(D))
def stream_screen_essays(spark: SparkSession, sf: str) -> DataFrame:
    """The screening flow over the essays table read as a stream (must equal batch)."""
    from ..streaming.score_stream import stream_equals_batch_input
    return stream_equals_batch_input(spark, tb.essays(spark, sf), "screen")


@register("sentence_ngram_counts", f"""WITH {O.ESSAYS}, {O.screening_sentences()}
SELECT essay_id, sent_pos,
  md5(array_to_string({O.char_grams(2, 4)}, '|')) AS char_2_4,
  md5(array_to_string({O.char_wb_grams(2, 5).replace('(c,', '(wb,')}, '|')) AS char_wb_2_5,
  md5(array_to_string({O.word_grams().replace('c[', 'wd[').replace('(c', '(wd')}, '|')) AS word_1_2,
  CAST(len(list_distinct(regexp_extract_all(text, {O.q(__import__('quillscan.constants', fromlist=['x']).SINHALA)}))) AS BIGINT) AS n_distinct_sinhala
FROM (SELECT *, {O.char_source('text')} AS c, {O.char_wb_source('text')} AS wb, {O.word_source('text')} AS wd FROM sentences)""")
def sentence_ngram_counts(spark: SparkSession, sf: str) -> DataFrame:
    """H12-H14 (digests of the n-grams in order) + G3 over every screening sentence."""
    s = op.explode_sentences(tb.essays(spark, sf))
    from ..functions import features as fxx
    return s.select("essay_id", "sent_pos",
                    F.md5(F.array_join(tx.char_ngrams(F.col("text"), 2, 4), "|")).alias("char_2_4"),
                    F.md5(F.array_join(tx.char_wb_ngrams(F.col("text"), 2, 5), "|")).alias("char_wb_2_5"),
                    F.md5(F.array_join(tx.word_ngrams(F.col("text"), 1, 2), "|")).alias("word_1_2"),
                    F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(fxx.K.SINHALA), 0)))
                    .cast("bigint").alias("n_distinct_sinhala"))


@register("error_types_outside_vocabulary", f"""WITH {O.pairs_ctes()}
SELECT essay_id, pos, error_type FROM pairs WHERE error_type IS NOT NULL AND error_type NOT IN ("""
          + ", ".join(O.q(t) for t in __import__('quillscan.constants', fromlist=['x']).ERROR_TAGS) + ")")
def error_types_outside_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose error tag is outside the closed tag vocabulary."""
    from .. import constants as KK
    tags = spark.createDataFrame([(t,) for t in KK.ERROR_TAGS], "tag string")
    return co.check_vocabulary(tb.pairs(spark, sf).select("essay_id", "pos", "error_type"), "error_type", tags)


@register("binary_corpus_stage_counts", f"""WITH {O.pairs_ctes()},
u AS (SELECT dyslexic_sentence AS text FROM pairs UNION ALL SELECT clean_sentence FROM pairs
      UNION ALL SELECT t FROM (SELECT unnest(range({co.EXTRA_TIMES})) AS r), (VALUES """
          + ", ".join(f"({O.q(t)})" for t in co.EXTRA_CLEAN) + f""") v(t)),
f AS (SELECT text FROM u WHERE length(text) >= 4)
SELECT 'union' AS stage, CAST(count(*) AS BIGINT) AS rows FROM u
UNION ALL SELECT 'min_length', CAST(count(*) AS BIGINT) FROM f
UNION ALL SELECT 'dedup', CAST(count(DISTINCT text) AS BIGINT) FROM f""")
def binary_corpus_stage_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Row counts after union (G1+G2), the length filter (B3) and keep-first."""
    return cb.binary_stage_counts([tb.pairs(spark, sf)], cb.extra_clean(spark))


# ---------------------------------------------------------------------------
# D21 synthetic-essay accuracy: 5 test sentences -> essay -> notebook rule
# ---------------------------------------------------------------------------
_SYNTH_SRC = ("synth_in AS (WITH bc AS (" + O.binary_corpus(co.EXTRA_CLEAN, co.EXTRA_TIMES) + "), "
              "r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(text), text) - 1 AS li, "
              "count(*) OVER (PARTITION BY label) AS n FROM bc), "
              "t AS (SELECT text, label FROM r WHERE li < ceil(n * 0.2)), "
              "o AS (SELECT *, row_number() OVER (ORDER BY md5(text), text) - 1 AS pos, count(*) OVER () AS nt FROM t) "
              "SELECT CAST(pos // 5 AS BIGINT) AS essay_id, pos, text, label FROM o WHERE (pos // 5) * 5 < nt - 5), "
              "synth AS (SELECT essay_id, string_agg(text, '. ' ORDER BY pos) AS text, "
              "avg(label) >= 0.5 AS truth FROM synth_in GROUP BY essay_id)")


@register("synthetic_essay_accuracy", "WITH v AS (" + O.screen_essays(D, "notebook", _SYNTH_SRC, "synth") + ") "
          "SELECT CAST(count(*) AS BIGINT) AS essays, round(avg(CASE WHEN (coalesce(v.essay_label, '') = "
          "'DYSLEXIC ESSAY') = (SELECT truth FROM (" + "WITH " + _SYNTH_SRC + " SELECT * FROM synth) s "
          "WHERE s.essay_id = v.essay_id) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM v")
def synthetic_essay_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of 5 test sentences (all full groups before the last 5 rows), rebuilt
    as '. '-joined essays (D25), screened with the notebook rule (D3), compared with the
    majority label; BORDERLINE counts as not dyslexic."""
    test = win.stratified_split(_binary(spark, sf), "label", "text", 0.2, stored=True).where(F.col("is_test")) \
        .select("text", "label").withColumn("_h", F.md5("text"))
    n = test.count()
    idx = win.consecutive_index(test, ["_h", "text"], out="pos")
    grp = idx.withColumn("essay_id", F.floor(F.col("pos") / 5).cast("bigint")).where(F.col("essay_id") * 5 < n - 5)
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    synth = grp.groupBy("essay_id").agg(F.concat_ws(". ", F.transform(parts, lambda x: x["text"])).alias("text"),
                                        (F.avg("label") >= 0.5).alias("truth"))
    synth = synth.checkpoint(eager=True)
    v = scr.screen_essays(synth.select("essay_id", "text"), rule="notebook", digits=None)
    j = v.join(synth.select("essay_id", "truth"), "essay_id")
    hit = (F.coalesce(F.col("essay_label"), F.lit("")) == "DYSLEXIC ESSAY") == F.col("truth")
    return j.agg(F.count(F.lit(1)).cast("bigint").alias("essays"),
                 F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), D).alias("accuracy"))


# ---------------------------------------------------------------------------
# Streams of the pattern and combined calls, peeks, the bucketed store, versions
# ---------------------------------------------------------------------------
import uuid  # noqa: E402

from ..operators import peeks as pk  # noqa: E402
from ..session import checkpoint_dir  # noqa: E402
from . import essay_store as es  # noqa: E402
from . import versions as vs  # noqa: E402


@register("stream_pattern_profile", O.profile_essays(D))
def stream_pattern_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The pattern flow over the essays table read as a stream."""
    from ..streaming.score_stream import stream_equals_batch_input
    return stream_equals_batch_input(spark, tb.essays(spark, sf), "patterns")


@register("stream_full_analysis", ORACLE["full_analysis"])
def stream_full_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """J1 + C5: one stream with a sink for each result, the sinks joined by essay."""
    from ..streaming.score_stream import staged_stream
    out = staged_stream(spark, tb.essays(spark, sf), "full")
    b, p = spark.read.parquet(f"{out}/binary"), spark.read.parquet(f"{out}/patterns")
    return b.select("essay_id", "essay_label", "composite_score", F.col("error").alias("binary_error")).join(
        p.select("essay_id", "risk_score", "risk_level", "dominant", F.col("error").alias("pattern_error")), "essay_id")


_PEEK = 5
_PEEK_SQL = "SELECT essay_id, CAST(pos AS INTEGER) AS pos, error_type, dyslexic_sentence"


@register("sample_peek", f"""WITH {O.pairs_ctes()}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY error_type ORDER BY
md5(essay_id || ':' || pos), essay_id, pos) AS INTEGER) AS place FROM pairs) {_PEEK_SQL}, place FROM r WHERE place <= {_PEEK}""")
def sample_peek(spark: SparkSession, sf: str) -> DataFrame:
    """random pairs of each error type (a sampling operator)."""
    rows = tb.pairs(spark, sf).select("essay_id", "pos", "error_type", "dyslexic_sentence")
    return pk.sample_peek(rows, _PEEK, ["essay_id", "pos"], ["error_type"])


@register("head_peek", f"WITH {O.pairs_ctes()} {_PEEK_SQL} FROM pairs ORDER BY essay_id, pos LIMIT {_PEEK}")
def head_peek(spark: SparkSession, sf: str) -> DataFrame:
    """the first pairs (a top-k report)."""
    return pk.head(tb.pairs(spark, sf).select("essay_id", "pos", "error_type", "dyslexic_sentence"), _PEEK, ["essay_id", "pos"])


@register("tail_peek", f"WITH {O.pairs_ctes()} {_PEEK_SQL} FROM pairs ORDER BY essay_id DESC, pos DESC LIMIT {_PEEK}")
def tail_peek(spark: SparkSession, sf: str) -> DataFrame:
    """the last pairs (a top-k report)."""
    return pk.tail(tb.pairs(spark, sf).select("essay_id", "pos", "error_type", "dyslexic_sentence"), _PEEK, ["essay_id", "pos"])


_STORE_SQL = f"""WITH b AS ({O.screen_essays(D)}), {O.scored_sentences_ctes()}
SELECT b.essay_id, b.essay_label, b.composite_score, b.total_sentences, CAST(s.sent_pos AS INTEGER) AS sent_pos, s.text,
       round(s.probability, {D}) AS probability, CASE WHEN s.probability IS NOT NULL THEN {O.sentence_label('s.probability')} END AS label
FROM b LEFT JOIN scored s ON s.essay_id = b.essay_id"""


def _store(spark: SparkSession, sf: str) -> str:
    name = f"store_{uuid.uuid4().hex}"
    es.write_store(tb.essays(spark, sf), name, int(spark.conf.get("spark.sql.shuffle.partitions")), D)
    return name


def _store_rows(rows: DataFrame) -> DataFrame:
    return rows.select("essay_id", "essay_label", "composite_score", "total_sentences", F.col("sent_pos").cast("int").alias("sent_pos"),
                       "text", _r("probability"), "label")


@register("essay_with_sentences", _STORE_SQL)
def essay_with_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """C4: every essay's verdict next to each of its sentences, joined inside the buckets."""
    return _store_rows(es.essay_with_sentences(spark, _store(spark, sf)))


@register("essay_lookup", _STORE_SQL + " WHERE b.essay_id IN ((SELECT min(essay_id) FROM b), (SELECT max(essay_id) FROM b))")
def essay_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Two essays, the first and the last, looked up in the bucketed store of all of them."""
    name = _store(spark, sf)
    ends = spark.table(f"{name}_essays").agg(F.min("essay_id"), F.max("essay_id")).first()
    return _store_rows(es.essay_with_sentences(spark, name, sorted({i for i in ends if i is not None})))


_VERSION_COLS = ["clean_sentence", "dyslexic_sentence", "error_type", "essay_id", "pos"]
_DIGEST_SQL = "md5(" + " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in _VERSION_COLS) + ")"


def _version_sql(name: str, rows: str) -> str:
    lanes = [f"CAST(coalesce(sum(CAST('0x' || substr(d, {8 * i + 1}, 8) AS BIGINT)), 0) AS BIGINT)" for i in range(vs.LANES)]
    return (f"SELECT '{name}' AS version, count(*) AS rows, concat_ws('-', count(*), {', '.join(lanes)}) AS fingerprint "
            f"FROM (SELECT {_DIGEST_SQL} AS d FROM {rows})")


@register("snapshot_versions", f"WITH {O.pairs_ctes()} " + _version_sql("all", "pairs") + " UNION ALL "
          + _version_sql("tagged", "pairs WHERE error_type IS NOT NULL"))
def snapshot_versions(spark: SparkSession, sf: str) -> DataFrame:
    """A3 + A4: the pairs and their tagged part frozen as versions; what the manifests say."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/versions-{uuid.uuid4().hex}"
    pairs = tb.pairs(spark, sf).select(*_VERSION_COLS)
    frozen, everything = vs.versioned(pairs, f"{base}/all", lambda df: df)
    # the frozen rows have the pairs' content, so the pairs needn't be derived again
    tagged = vs.versioned(frozen, f"{base}/tagged", lambda df: df.where(F.col("error_type").isNotNull()),
                          known=vs.manifest(spark, everything)["fingerprint"])[1]
    found = [("all", everything), ("tagged", tagged)]
    made = [spark.read.parquet(f"{path}/manifest").select(F.lit(name).alias("version"), "rows", "fingerprint") for name, path in found]
    return made[0].unionByName(made[1])
