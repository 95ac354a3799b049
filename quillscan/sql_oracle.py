"""Independent DuckDB SQL for the SQL-checkable queries (the correctness oracle).

These strings are written against the driver's views (``documents``, ``labels``,
``pages``, ``conversations`` ...) and re-derive the test views (``essays``,
``pairs``) in DuckDB's own dialect, so the oracle shares no execution path with
the Spark side. Values that must be the same (regex classes, thresholds, weights)
come from the same constant tables.
"""

from __future__ import annotations

from . import constants as K
from .functions import scoring as sc
from .sources import tables as tb


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def cnt(t: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({t}, {q(pattern)})) AS BIGINT)"


def strip(t: str) -> str:
    return f"regexp_replace({t}, {q('^' + K.PY_WS + '+|' + K.PY_WS + '+$')}, '', 'g')"


def nwords(t: str) -> str:
    return cnt(t, K.NON_WS + "+")


def words(t: str) -> str:
    return f"regexp_extract_all({t}, {q(K.NON_WS + '+')})"


def ratio(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) = 0 THEN 0.0::DOUBLE ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END)"


def adjacent_chars(t: str) -> str:
    return (f"CAST(len(list_filter(range(2, length({t}) + 1), "
            f"lambda i: substring({t}, i, 1) = substring({t}, i - 1, 1))) AS BIGINT)")


def graphemes(t: str) -> str:
    return (f"list_transform(range(1, length_grapheme({t}) + 1), "
            f"lambda i: substring_grapheme({t}, i, 1))")


def adjacent_list(a: str) -> str:
    return (f"CAST(len(list_filter(range(2, len({a}) + 1), "
            f"lambda i: {a}[i] = {a}[i - 1])) AS BIGINT)")


ESSAYS = (f"essays AS (SELECT doc_id AS essay_id, "
          f"translate(lower(text), {q(tb.TRANSLIT_SRC)}, {q(tb.TRANSLIT_DST)}) AS text FROM documents)")


def split_screening(t: str) -> str:
    norm = f"regexp_replace({t}, '\\r\\n|\\r', chr(10), 'g')"
    kept = (f"list_filter(list_transform(regexp_split_to_array({norm}, {q(K.SCREEN_SPLIT)}), "
            f"lambda s: {strip('s')}), lambda s: length(s) >= {K.MIN_SENTENCE_CHARS})")
    return kept


def screening_sentences(src: str = "essays") -> str:
    """CTEs ``sent_kept``, ``sent_arr``, ``sentences(essay_id, sent_pos, text)``."""
    return f"""
sent_kept AS (SELECT essay_id, {split_screening('text')} AS k FROM {src}),
sent_arr AS (
  SELECT essay_id,
         CASE WHEN len(k) = 1 AND length(k[1]) > {K.LONG_SENTENCE_CHARS}
              THEN list_transform(range(0, length(k[1]), {K.CHUNK_CHARS}),
                                  lambda i: substring(k[1], i + 1, {K.CHUNK_CHARS}))
              ELSE k END AS s
  FROM sent_kept),
sentences AS (
  SELECT essay_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS sent_pos, unnest(s) AS text
  FROM sent_arr)"""


def pattern_sentences(src: str = "essays") -> str:
    """CTE ``psent(essay_id, sent_pos, text)`` with the pattern splitter (H4)."""
    return f"""
psent_arr AS (
  SELECT essay_id, list_filter(list_transform(regexp_split_to_array(text, {q(K.PATTERN_SPLIT)}),
                                              lambda s: {strip('s')}), lambda s: s <> '') AS s
  FROM {src}),
psent AS (
  SELECT essay_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS sent_pos, unnest(s) AS text
  FROM psent_arr)"""


def screen_feature_select(t: str = "text") -> str:
    n = f"CAST(greatest(length({t}), 1) AS DOUBLE)"
    nw = f"CAST(greatest({nwords(t)}, 1) AS DOUBLE)"
    ws = cnt(t, K.PY_WS)
    sin = f"regexp_extract_all({t}, {q(K.SINHALA)})"
    return f"""
  {cnt(t, K.VIRAMA)} / {n} AS hal_ratio,
  {cnt(t, K.VOWEL_SIGN)} / {n} AS diacritic_ratio,
  CAST(length({t}) - {ws} AS DOUBLE) / {nw} AS avg_word_len,
  {nw} AS word_count,
  CAST(len(list_distinct({sin})) AS DOUBLE) / CAST(greatest(len({sin}), 1) AS DOUBLE) AS unique_char_ratio,
  {cnt(t, ' ')} / {n} AS space_ratio,
  CAST(regexp_matches({t}, {q(K.LATIN)}) AS DOUBLE) AS has_english,
  {adjacent_chars(t)} / {n} AS repeat_char_ratio"""


def linear(weights: dict) -> str:
    parts = [dbl(weights["intercept"])]
    for k, v in weights.items():
        if k != "intercept":
            parts.append(f"{dbl(v)} * {k}")
    return " + ".join(parts)


def screen_probability() -> str:
    return f"1.0::DOUBLE / (1.0::DOUBLE + exp(-({linear(sc.SCREEN_WEIGHTS)})))"


def scored_sentences_ctes(src_cte: str = ESSAYS, src: str = "essays") -> str:
    return src_cte + "," + screening_sentences(src) + f""",
feats AS (SELECT essay_id, sent_pos, text, {screen_feature_select()} FROM sentences),
scored AS (SELECT essay_id, sent_pos, text, {screen_probability()} AS probability,
                  word_count AS weight FROM feats)"""


def sentence_label(p: str, t: float = K.SENTENCE_THRESHOLD) -> str:
    return (f"CASE WHEN {p} >= {t} THEN 'DYSLEXIC' WHEN {p} >= {K.BORDERLINE_THRESHOLD} "
            f"THEN 'BORDERLINE' ELSE 'NORMAL' END")


def screen_essays(digits: int = 6, rule: str = "production", src_cte: str = ESSAYS,
                  src: str = "essays") -> str:
    t = K.SENTENCE_THRESHOLD
    if rule == "production":
        label = (f"CASE WHEN composite_score IS NULL THEN NULL WHEN composite_score >= {K.ESSAY_DYSLEXIC_COMPOSITE} AND dyslexic_ratio >= "
                 f"{K.ESSAY_DYSLEXIC_RATIO} THEN 'DYSLEXIC ESSAY' WHEN composite_score >= "
                 f"{K.ESSAY_BORDERLINE_COMPOSITE} THEN 'BORDERLINE ESSAY' ELSE 'NORMAL ESSAY' END")
    else:
        label = (f"CASE WHEN composite_score IS NULL THEN NULL WHEN composite_score >= {K.NB_DYSLEXIC_COMPOSITE} OR (dyslexic_ratio >= "
                 f"{K.NB_RATIO} AND weighted_mean_prob >= {K.NB_MEAN}) THEN 'DYSLEXIC ESSAY' WHEN composite_score >= "
                 f"{K.NB_BORDERLINE_COMPOSITE} THEN 'BORDERLINE ESSAY' ELSE 'NORMAL ESSAY' END")
    return f"""WITH {scored_sentences_ctes(src_cte, src)},
agg AS (
  SELECT essay_id, count(*) AS total_sentences,
         count(*) FILTER (WHERE probability >= {t}) AS dyslexic_sentences,
         count(*) FILTER (WHERE probability >= {K.BORDERLINE_THRESHOLD} AND probability < {t}) AS borderline_sentences,
         sum(probability * weight) / sum(weight) AS weighted_mean_prob,
         max(probability) AS peak_sentence_prob, avg(probability) AS mean_prob
  FROM scored GROUP BY essay_id),
r AS (
  SELECT *, {K.COMPOSITE_MEAN_WEIGHT} * weighted_mean_prob + {K.COMPOSITE_PEAK_WEIGHT} * peak_sentence_prob AS composite_score,
         CAST(dyslexic_sentences AS DOUBLE) / total_sentences AS dyslexic_ratio
  FROM agg)
SELECT e.essay_id,
       {label} AS essay_label,
       round(composite_score, {digits}) AS composite_score,
       round(weighted_mean_prob, {digits}) AS weighted_mean_prob,
       round(peak_sentence_prob, {digits}) AS peak_sentence_prob,
       round(dyslexic_ratio, {digits}) AS dyslexic_ratio,
       CAST(total_sentences AS BIGINT) AS total_sentences,
       CAST(dyslexic_sentences AS BIGINT) AS dyslexic_sentences,
       CAST(borderline_sentences AS BIGINT) AS borderline_sentences,
       CASE WHEN r.essay_id IS NULL THEN {q(K.NO_SENTENCE_ERROR)} END AS error
FROM {src} e LEFT JOIN r ON e.essay_id = r.essay_id"""


# ---------------------------------------------------------------------------
# structured features (H23-H48) and the v2 pattern profile
# ---------------------------------------------------------------------------

def structured_base(src: str, keep: str = "essay_id, sent_pos, text") -> str:
    """SELECT with base lists ``w`` (words) and ``g`` (graphemes) and class counts."""
    return f"""SELECT {keep}, {words('text')} AS w, {graphemes('text')} AS g,
       {cnt('text', K.VOWEL_SIGN)} AS vd, {cnt('text', K.SHORT_VOWEL)} AS sv,
       {cnt('text', K.LONG_VOWEL)} AS lv, {cnt('text', K.CONSONANT)} AS cons,
       {cnt('text', K.VIRAMA)} AS al, {cnt('text', K.CONFUSABLE)} AS conf,
       {cnt('text', K.INDEPENDENT_VOWEL)} AS iv
FROM {src}"""


def structured_select() -> str:
    """Feature expressions over a ``structured_base`` row."""
    nw, nc = "CAST(len(w) AS BIGINT)", "CAST(len(g) AS BIGINT)"
    ns = f"CAST(len(list_filter(g, lambda x: regexp_matches(x, {q(K.SINHALA)}))) AS BIGINT)"
    bare_word = (f"list_filter({graphemes('x')}, lambda y: regexp_matches(y, {q(K.SINHALA)}))")
    bare = (f"CAST(len(list_filter(w, lambda x: coalesce(regexp_matches(({bare_word})[-1], {q(K.CONSONANT)}) "
            f"AND NOT regexp_matches(({bare_word})[-1], {q(K.VOWEL_SIGN)}), false))) AS BIGINT)")
    consec = (f"CAST(len(list_filter(range(2, length(text) + 1), lambda i: substring(text, i, 1) = chr(3530) "
              f"AND substring(text, i - 1, 1) = chr(3530))) AS BIGINT)")
    return f"""CAST(length(text) AS BIGINT) AS char_length,
  {nw} AS word_count,
  {ratio(f'sum_wlen', nw)} AS avg_word_length,
  {nc} AS grapheme_count,
  {ns} AS sinhala_grapheme_count,
  {ratio(ns, nc)} AS sinhala_grapheme_ratio,
  vd AS vowel_diacritic_count,
  iv AS independent_vowel_count,
  {ratio('vd', ns)} AS vowel_diacritic_ratio,
  sv AS short_vowel_count,
  lv AS long_vowel_count,
  {ratio('abs(sv - lv)', 'sv + lv')} AS vowel_length_imbalance,
  cons AS consonant_count,
  {ratio('cons', ns)} AS consonant_ratio,
  conf AS confusable_consonant_count,
  {ratio('conf', 'cons')} AS confusable_consonant_ratio,
  al AS al_lakuna_count,
  {ratio('al', ns)} AS al_lakuna_ratio,
  {consec} AS consecutive_al_lakuna,
  {adjacent_list('g')} AS repeated_graphemes,
  {adjacent_chars('text')} AS repeated_chars,
  {adjacent_list('w')} AS repeated_words,
  {bare} AS bare_consonant_endings,
  {ratio(bare, nw)} AS bare_consonant_ending_ratio,
  {ratio('vd', nw)} AS vowel_per_word,
  {ratio('cons', nw)} AS consonant_per_word"""


def structured_ctes(src: str = "psent", keep: str = "essay_id, sent_pos, text") -> str:
    return f"""sbase0 AS ({structured_base(src, keep)}),
sbase AS (SELECT *, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS sum_wlen FROM sbase0),
sfeat AS (SELECT {keep}, {structured_select()} FROM sbase)"""


def pattern_probs() -> str:
    """Softmax over the five linear scores (columns p_<label>)."""
    z = {lab: f"exp({linear(w)})" for lab, w in sc.PATTERN_WEIGHTS.items()}
    den = " + ".join(f"z_{lab.lower()}" for lab in K.PATTERN_LABELS)
    zs = ", ".join(f"{z[lab]} AS z_{lab.lower()}" for lab in K.PATTERN_LABELS)
    ps = ", ".join(f"z_{lab.lower()} / ({den}) AS p_{lab.lower()}" for lab in K.PATTERN_LABELS)
    return zs, ps


def profile_essays(digits: int = 6) -> str:
    labs = [lab.lower() for lab in K.PATTERN_LABELS]
    errs = [lab.lower() for lab in K.ERROR_LABELS]
    zs, ps = pattern_probs()
    maxp = "greatest(" + ", ".join(f"p_{x}" for x in labs) + ")"
    best_err = "greatest(" + ", ".join(f"p_{x}" for x in errs) + ")"
    # arg-max with ties to the first label in alphabetical order
    top = "CASE " + " ".join(
        f"WHEN p_{x} = {maxp} THEN {q(lab)}" for x, lab in zip(labs, K.PATTERN_LABELS)) + " END"
    k = len(labs)
    weight = (f"CASE WHEN {maxp} - {K.WEIGHT_BASELINE} <= 0 THEN 0.0::DOUBLE ELSE "
              f"0.65 * least(({maxp} - {K.WEIGHT_BASELINE}) / {1.0 - K.WEIGHT_BASELINE}, 1.0) "
              f"+ 0.35 * least(word_count / 8.0, 1.0) END")
    is_dys = (f"CASE WHEN word_count < {K.MIN_WORDS_FOR_RELIABLE} THEN false "
              f"WHEN ({top}) = 'Normal' AND p_normal > {K.NORMAL_CONFIDENT} THEN false "
              f"ELSE ({best_err} - {1.0 / k!r} >= {K.RELIABLE_MARGIN} AND {best_err} >= {K.STRONG_PATTERN_THRESHOLD}) END")
    rel = f"word_count >= {K.MIN_WORDS_FOR_RELIABLE}"
    agg = [
        "count(*) AS total_sentence_count",
        f"count(*) FILTER (WHERE {rel}) AS reliable_sentence_count",
        f"count(*) FILTER (WHERE {rel} AND is_dys) AS dyslexic_sentence_count",
        f"coalesce(sum(weight) FILTER (WHERE {rel}), 0) AS tcw",
        f"coalesce(sum(weight) FILTER (WHERE {rel} AND is_dys), 0) AS wds",
        "greatest(max(maxp), 0) AS maxp",
        "coalesce(sum(weight) FILTER (WHERE weight > 0), 0) AS tw",
    ]
    for x in labs:
        agg.append(f"coalesce(sum(p_{x} * weight) FILTER (WHERE weight > 0), 0) AS ws_{x}")
        agg.append(f"sum(p_{x}) AS us_{x}")
    for x in errs:
        agg.append(f"count(*) FILTER (WHERE p_{x} > {K.STRONG_PATTERN_THRESHOLD}) AS count_{x}")
    raw = ", ".join(f"CASE WHEN tw > 0 THEN ws_{x} ELSE us_{x} END AS r_{x}" for x in labs)
    rsum = " + ".join(f"r_{x}" for x in labs)
    dist = ", ".join(f"r_{x} / (CASE WHEN ({rsum}) = 0 THEN 1.0 ELSE ({rsum}) END) AS dist_{x}" for x in labs)
    ranked = ("list_sort([" + ", ".join(
        f"{{'s': dist_{x}, 'o': {-i}, 'l': {q(lab)}}}" for i, (x, lab) in enumerate(zip(labs, K.PATTERN_LABELS)))
        + "], 'DESC')")
    dens = ", ".join(f"CAST(count_{x} AS DOUBLE) / total_sentence_count * 100.0 AS density_{x}" for x in errs)
    expl = "CASE top_l " + " ".join(f"WHEN {q(k_)} THEN {q(v)}" for k_, v in K.PATTERN_EXPLANATIONS.items()) + " ELSE '' END"
    mixed = f"(top_s - sec_s) < {K.MIXED_GAP}"
    dominant = (f"CASE WHEN {mixed} THEN 'No clear dominant pattern detected. The essay shows overlapping "
                f"characteristics of ' || top_l || ' and ' || sec_l || ' patterns.' "
                f"ELSE top_l || ' Pattern Dominant (' || printf('%.2f', top_s) || ')' END")
    explanation = (f"CASE WHEN {mixed} THEN 'The writing demonstrates mixed indicators, with ' || top_l || ' (' "
                   f"|| printf('%.2f', top_s) || ') and ' || sec_l || ' (' || printf('%.2f', sec_s) || ') appearing closely.' "
                   f"ELSE {expl} END")
    severity = (f"CASE WHEN top_s > {K.SEVERITY_LEVELS[0][0]} THEN {q(K.SEVERITY_LEVELS[0][1])} "
                f"WHEN top_s > {K.SEVERITY_LEVELS[1][0]} THEN {q(K.SEVERITY_LEVELS[1][1])} ELSE {q(K.SEVERITY_DEFAULT)} END")
    wratio = "CASE WHEN tcw > 0 THEN wds / tcw ELSE 0.0 END"
    dratio = "CASE WHEN reliable_sentence_count > 0 THEN CAST(dyslexic_sentence_count AS DOUBLE) / reliable_sentence_count ELSE 0.0 END"
    pboost = "CASE WHEN top_s > 0.40 THEN (top_s - 0.33) * 40.0 ELSE 0.0 END"
    sboost = "CASE " + " ".join(f"WHEN maxp > {t} THEN {b}" for t, b in K.SEVERITY_BOOSTS) + " ELSE 0.0 END"
    strong = " + ".join(f"(CASE WHEN density_{x} > 10 THEN 1 ELSE 0 END)" for x in errs)
    risk = f"least(({wratio}) * 100.0 + ({pboost}) + ({sboost}) + (CASE WHEN ({strong}) >= 2 THEN 5.0 ELSE 0.0 END), {K.RISK_CAP})"
    level = "CASE " + " ".join(f"WHEN risk > {t} THEN {q(n)}" for t, n in K.RISK_LEVELS) + f" ELSE {q(K.RISK_DEFAULT)} END"
    d = digits
    out = ", ".join([
        "e.essay_id", "dominant", "severity", "explanation", f"round(risk, {d}) AS risk_score",
        f"{level} AS risk_level",
        *[f"round(dist_{x}, {d}) AS dist_{x}" for x in labs],
        *[f"CAST(count_{x} AS BIGINT) AS count_{x}" for x in errs],
        *[f"round(density_{x}, {d}) AS density_{x}" for x in errs],
        f"round({dratio}, {d}) AS dyslexic_ratio", f"round({wratio}, {d}) AS weighted_dyslexic_ratio",
        "CAST(dyslexic_sentence_count AS BIGINT) AS dyslexic_sentence_count",
        "CAST(reliable_sentence_count AS BIGINT) AS reliable_sentence_count",
        "CAST(total_sentence_count AS BIGINT) AS total_sentence_count",
        f"round(maxp, {d}) AS max_sentence_probability",
        f"CASE WHEN r3.essay_id IS NULL THEN {q(K.NO_PATTERN_ERROR)} END AS error",
    ])
    return f"""WITH {ESSAYS}, {pattern_sentences()},
{structured_ctes()},
sz AS (SELECT essay_id, sent_pos, text, word_count, {zs} FROM sfeat),
sp AS (SELECT essay_id, sent_pos, text, word_count, {ps} FROM sz),
sw AS (SELECT *, {weight} AS weight, {is_dys} AS is_dys, {maxp} AS maxp FROM sp),
agg AS (SELECT essay_id, {', '.join(agg)} FROM sw GROUP BY essay_id),
r1 AS (SELECT *, {raw} FROM agg),
r2 AS (SELECT *, {dist}, {dens} FROM r1),
r2b AS (SELECT *, {ranked} AS rk FROM r2),
r3 AS (SELECT *, rk[1].l AS top_l, rk[1].s AS top_s, rk[2].l AS sec_l, rk[2].s AS sec_s FROM r2b),
r4 AS (SELECT *, {dominant} AS dominant, {explanation} AS explanation, {severity} AS severity,
              {risk} AS risk FROM r3)
SELECT {out} FROM essays e LEFT JOIN r4 r3 ON e.essay_id = r3.essay_id"""


def pattern_examples(first: int = 3) -> str:
    """The number of strong sentences per essay and pattern, and the first of them by place."""
    zs, ps = pattern_probs()
    names = ", ".join(q(lab) for lab in K.ERROR_LABELS)
    values = ", ".join(f"p_{lab.lower()}" for lab in K.ERROR_LABELS)
    return f"""WITH {ESSAYS}, {pattern_sentences()},
{structured_ctes()},
sz AS (SELECT essay_id, sent_pos, text, {zs} FROM sfeat),
sp AS (SELECT essay_id, sent_pos, text, {ps} FROM sz),
strong AS (SELECT essay_id, sent_pos, text, unnest([{names}]) AS pattern, unnest([{values}]) AS p FROM sp)
SELECT essay_id, pattern, count(*) AS n_examples, array_to_string(list(text ORDER BY sent_pos)[1:{first}], chr(10)) AS first_examples
FROM strong WHERE p > {K.STRONG_PATTERN_THRESHOLD} GROUP BY essay_id, pattern"""


def rounded_profile() -> str:
    """Presentation rounding (half-even by the exact binary value): 2 places of the risk, 4 of ratios."""
    fixed = lambda c, n: f"CAST(printf('%.{n}f', {c}) AS DOUBLE) AS {c}"
    ratios = ["dyslexic_ratio", "weighted_dyslexic_ratio", "max_sentence_probability"]
    return f"SELECT essay_id, {fixed('risk_score', 2)}, {', '.join(fixed(c, 4) for c in ratios)} FROM ({profile_essays(12)})"


def essay_reports() -> str:
    dist = " || chr(10) || ".join(f"'{lab}: ' || printf('%.3f', dist_{lab.lower()})" for lab in K.PATTERN_LABELS)
    dens = " || chr(10) || ".join(f"'{lab}: ' || printf('%.1f', density_{lab.lower()}) || '%'" for lab in K.ERROR_LABELS)
    order = "CASE pattern " + " ".join(f"WHEN {q(lab)} THEN {i}" for i, lab in enumerate(K.ERROR_LABELS)) + " END"
    return f"""WITH prof AS ({profile_essays(12)}), ex AS ({pattern_examples()}),
lists AS (SELECT essay_id, string_agg(chr(10) || pattern || ' Pattern Sentences:' || chr(10) || '- '
          || replace(first_examples, chr(10), chr(10) || '- '), chr(10) ORDER BY {order}) AS body FROM ex GROUP BY essay_id)
SELECT p.essay_id, CASE WHEN error IS NULL THEN 'Dominant Pattern: ' || dominant || chr(10) || 'Severity Level: ' || severity || chr(10)
       || 'Risk Level: ' || risk_level || chr(10) || 'Risk Score: ' || printf('%.2f', risk_score) || '%' || chr(10)
       || chr(10) || 'Explanation:' || chr(10) || explanation || chr(10) || chr(10) || 'Pattern Distribution:' || chr(10) || {dist} || chr(10)
       || chr(10) || 'Pattern Density (% of essay strongly affected):' || chr(10) || {dens} || chr(10)
       || chr(10) || 'Strong Pattern Sentences:' || chr(10) || coalesce(body, '') END AS report
FROM prof p LEFT JOIN lists l ON l.essay_id = p.essay_id"""


# ---------------------------------------------------------------------------
# pairs view, rule-based (v1) flows with the edit twin
# ---------------------------------------------------------------------------

def pairs_cte() -> str:
    """CTE ``pairs(essay_id, pos, clean_sentence, dyslexic_sentence, error_type)`` (needs sentences)."""
    ph_src = "".join(chr(c) for c in [0x0D9A, 0x0D9C, 0x0DA0, 0x0DAD, 0x0DB6, 0x0DC0, 0x0DC3])
    ph_dst = "".join(chr(c) for c in [0x0D9B, 0x0D9D, 0x0DA1, 0x0DAE, 0x0DB8, 0x0DC2, 0x0DC4])
    return f"""
pair_k AS (SELECT essay_id, sent_pos AS pos, text AS clean, substring(md5(text), 1, 1) AS k FROM sentences),
pairs AS (
  SELECT essay_id, pos, clean AS clean_sentence,
    CASE WHEN k IN ('0','1','2','3') THEN replace(clean, chr(3530), '')
         WHEN k IN ('4','5','6','7') THEN translate(clean, {q(ph_src)}, {q(ph_dst)})
         WHEN k IN ('8','9','a') THEN substring(clean, 2, 1) || substring(clean, 1, 1) || substring(clean, 3)
         WHEN k IN ('b','c') THEN substring(clean, 1, length(clean) - 1)
         WHEN k = 'd' THEN replace(clean, ' ', '')
         ELSE clean END AS dyslexic_sentence,
    CASE WHEN k IN ('0','1','2','3') THEN 'Spelling' WHEN k IN ('4','5','6','7') THEN 'phonetic_confusion'
         WHEN k IN ('8','9','a') THEN 'Visual Scrambling' WHEN k IN ('b','c') THEN 'tense_error'
         WHEN k = 'd' THEN 'Spoken_case' WHEN k = 'e' THEN 'other' END AS error_type
  FROM pair_k)"""


def pairs_ctes() -> str:
    return ESSAYS + "," + screening_sentences() + "," + pairs_cte()


def twin_features(a: str, b: str, loss_sql: str) -> str:
    common = f"least(length({a}), length({b}))"
    sub = (f"CAST(len(list_filter(range(1, {common} + 1), lambda i: substring({a}, i, 1) <> "
           f"substring({b}, i, 1))) AS BIGINT)")
    add = f"CAST(greatest(length({b}) - length({a}), 0) AS BIGINT)"
    omi = f"CAST(greatest(length({a}) - length({b}), 0) AS BIGINT)"
    wd = f"CAST(abs({nwords(a)} - {nwords(b)}) AS BIGINT)"
    return (f"{add} AS char_addition, {omi} AS char_omission, {sub} AS char_substitution, "
            f"{add} > 0 AS has_addition, {omi} > 0 AS has_omission, {sub} > 0 AS has_substitution, "
            f"{wd} AS word_count_diff, {wd} > 0 AS has_spacing_issue, {loss_sql} AS has_diacritic_loss")


def matching_ctes(src: str, a: str, b: str) -> str:
    """CTE ``diffs(a, b, add_, omit_, swap_, matched)`` of the distinct unequal pairs of ``src`` (needs WITH RECURSIVE).

    Runs of equal characters on a diagonal, then the longest one of each stretch, round by round.
    """
    ahead = ("coalesce(nullif(list_position(list_transform(range(least(ahi - i - n, bhi - j - n)), lambda p: x[i + n + p + 1] = y[j + n + p + 1]), false), 0) - 1, "
             "least(ahi - i - n, bhi - j - n))")
    back = ("coalesce(nullif(list_position(list_transform(range(least(i - alo, j - blo)), lambda p: x[i - p] = y[j - p]), false), 0) - 1, "
            "least(i - alo, j - blo))")
    part = lambda alo, ahi, blo, bhi: (f"{{'alo': {alo}, 'ahi': {ahi}, 'blo': {blo}, 'bhi': {bhi}, "  # noqa: E731
                                       f"'leaf': ({alo} >= {ahi} OR {blo} >= {bhi})}}")
    return f"""
dpairs AS MATERIALIZED (SELECT row_number() OVER () AS id, a, b, string_split(a, '') AS x, string_split(b, '') AS y FROM (
    SELECT DISTINCT {a} AS a, {b} AS b FROM {src} WHERE {a} <> {b} AND {a} <> '' AND {b} <> '')),
dx AS (SELECT id, unnest(range(len(x))) AS i, unnest(x) AS c FROM dpairs),
dy AS (SELECT *, count(*) OVER (PARTITION BY id, c) AS often FROM (SELECT id, len(y) AS size, unnest(range(len(y))) AS j, unnest(y) AS c FROM dpairs)),
dm AS (SELECT dx.id, i, j FROM dx JOIN dy USING (id, c) WHERE NOT (size >= 200 AND often > size // 100 + 1)),
druns AS MATERIALIZED (SELECT id, min(i) AS ri, min(j) AS rj, count(*) AS rn FROM (
    SELECT *, i - row_number() OVER (PARTITION BY id, i - j ORDER BY i) AS g FROM dm) GROUP BY id, i - j, g),
dspans(id, alo, ahi, blo, bhi, leaf) AS (
  SELECT id, 0::BIGINT, len(x), 0::BIGINT, len(y), false FROM dpairs
  UNION ALL
  SELECT id, u.alo, u.ahi, u.blo, u.bhi, u.leaf FROM (
    SELECT id, unnest(CASE WHEN n = 0 THEN [{{'alo': alo, 'ahi': ahi, 'blo': blo, 'bhi': bhi, 'leaf': true}}]
                           ELSE [{part('alo', 'i', 'blo', 'j')}, {part('i + n', 'ahi', 'j + n', 'bhi')}] END) AS u
    FROM (SELECT id, alo, ahi, blo, bhi, i - back AS i, j - back AS j, n + back + ahead AS n FROM (
      SELECT *, CASE WHEN len(y) >= 200 THEN {ahead} ELSE 0 END AS ahead, CASE WHEN len(y) >= 200 THEN {back} ELSE 0 END AS back FROM (
        SELECT id, alo, ahi, blo, bhi, coalesce(best.n, 0) AS n, coalesce(-best.i, alo) AS i, coalesce(-best.j, blo) AS j FROM (
          SELECT s.id, alo, ahi, blo, bhi, max(CASE WHEN rn IS NOT NULL THEN struct_pack(
                   n := least(rn, ahi - ri, bhi - rj) - greatest(0, alo - ri, blo - rj),
                   i := -(ri + greatest(0, alo - ri, blo - rj)), j := -(rj + greatest(0, alo - ri, blo - rj))) END) AS best
          FROM dspans s LEFT JOIN druns r ON r.id = s.id AND least(rn, ahi - ri, bhi - rj) > greatest(0, alo - ri, blo - rj)
          WHERE NOT leaf GROUP BY ALL)) JOIN dpairs USING (id))))),
diffs AS (SELECT a, b, CAST(coalesce(sum(CASE WHEN alo = ahi THEN bhi - blo END), 0) AS BIGINT) AS add_,
                 CAST(coalesce(sum(CASE WHEN blo = bhi THEN ahi - alo END), 0) AS BIGINT) AS omit_,
                 CAST(coalesce(sum(CASE WHEN alo < ahi AND blo < bhi THEN greatest(ahi - alo, bhi - blo) END), 0) AS BIGINT) AS swap_,
                 length(a) - CAST(sum(ahi - alo) AS BIGINT) AS matched
          FROM dspans JOIN dpairs USING (id) WHERE leaf GROUP BY id, a, b)"""


def exact_features(src: str, a: str, b: str, loss_sql: str, runtime: bool = False) -> str:
    """SELECT of ``src`` with the nine exact features (joins ``diffs``)."""
    wd = f"CAST(abs({nwords(a)} - {nwords(b)}) AS BIGINT)"
    lone_a, lone_b = f"CASE WHEN {b} = '' THEN length({a}) ELSE 0 END", f"CASE WHEN {a} = '' THEN length({b}) ELSE 0 END"
    add = f"coalesce(length({b}) - matched, {lone_b})" if runtime else f"coalesce(add_, {lone_b})"
    omit = f"coalesce(length({a}) - matched, {lone_a})" if runtime else f"coalesce(omit_, {lone_a})"
    swap = "0" if runtime else "coalesce(swap_, 0)"
    return (f"SELECT {src}.*, CAST({add} AS BIGINT) AS char_addition, CAST({omit} AS BIGINT) AS char_omission, CAST({swap} AS BIGINT) AS char_substitution, "
            f"{add} > 0 AS has_addition, {omit} > 0 AS has_omission, {swap} > 0 AS has_substitution, "
            f"{wd} AS word_count_diff, {wd} > 0 AS has_spacing_issue, {loss_sql} AS has_diacritic_loss "
            f"FROM {src} LEFT JOIN diffs ON diffs.a = {a} AND diffs.b = {b}")


def v1_scores_and_label(weights: dict) -> tuple[str, str, str]:
    """(score columns, pattern expression, explanation expression) over a features row."""
    pats = sorted(weights)
    score_cols = ", ".join(
        f"(0.0::DOUBLE" + "".join(f" + CAST({f} AS BIGINT) * {dbl(w)}" for f, w in weights[p].items())
        + f") AS s{i}" for i, p in enumerate(pats))
    ranked = "list_sort([" + ", ".join(
        f"{{'s': s{i}, 'o': {-i}, 'l': {q(p)}}}" for i, p in enumerate(pats)) + "], 'DESC')"
    pattern = (f"CASE WHEN rk[1].s < {K.V1_MIN_SCORE} THEN 'No Dominant Pattern' "
               f"WHEN rk[1].s - rk[2].s >= {K.V1_DOMINANCE_MARGIN} THEN rk[1].l ELSE 'Mixed Dyslexic Pattern' END")
    base = "CASE writing_pattern " + " ".join(
        f"WHEN {q(k_)} THEN {q(v)}" for k_, v in K.V1_EXPLANATIONS.items()) + " ELSE '' END"
    contrib = "list_slice(list_transform(list_filter(rk, lambda e: e.s > 0), lambda e: e.l), 1, 2)"
    expl = (f"{base} || CASE WHEN writing_pattern = 'Mixed Dyslexic Pattern' AND len({contrib}) > 0 "
            f"THEN {q(K.MIXED_SUFFIX)} || array_to_string({contrib}, ', ') || '.' ELSE '' END")
    return score_cols + f", {ranked} AS rk", pattern, expl


def v1_profile_sql(src: str, id_col: str = "essay_id", digits: int = 6) -> str:
    pats = K.V1_PATTERNS
    cols = [p.lower().replace(" ", "_") for p in pats]
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE writing_pattern = {q(p)}) AS BIGINT) AS {c}"
                       for p, c in zip(pats, cols))
    mx = "greatest(" + ", ".join(cols) + ")"
    dominant = "CASE " + " ".join(f"WHEN {c} = {mx} THEN {q(p)}" for p, c in zip(pats, cols)) + " END"
    strength = (f"CASE WHEN confidence >= {K.DOMINANCE_LEVELS[0][0]} THEN {q(K.DOMINANCE_LEVELS[0][1])} "
                f"WHEN confidence >= {K.DOMINANCE_LEVELS[1][0]} THEN {q(K.DOMINANCE_LEVELS[1][1])} "
                f"ELSE {q(K.DOMINANCE_DEFAULT)} END")
    pct = "CAST(round_even(confidence * 100, 0) AS BIGINT)"
    level = (f"CASE WHEN {pct} >= {K.CONFIDENCE_LEVELS[0][0]} THEN {q(K.CONFIDENCE_LEVELS[0][1])} "
             f"WHEN {pct} >= {K.CONFIDENCE_LEVELS[1][0]} THEN {q(K.CONFIDENCE_LEVELS[1][1])} "
             f"ELSE {q(K.CONFIDENCE_DEFAULT)} END")
    return f"""pc AS (SELECT {id_col}, {counts} FROM {src} GROUP BY {id_col}),
pd AS (SELECT *, {dominant} AS dominant_pattern, {mx} AS max_count, {' + '.join(cols)} AS total_sentences FROM pc),
pe AS (SELECT *, CAST(max_count AS DOUBLE) / total_sentences AS confidence FROM pd)
SELECT {id_col}, {', '.join(cols)}, dominant_pattern, max_count, total_sentences,
       {strength} AS dominance_strength, round(confidence, {digits}) AS confidence,
       {pct} AS confidence_percent, {level} AS confidence_level
FROM pe"""


def rule_lines_ctes(weights: dict, exact: bool = False) -> str:
    ws = K.PY_WS
    scores, pattern, expl = v1_scores_and_label(weights)
    loss = f"{cnt('raw_sentence', K.RUNTIME_DIACRITIC)} < {cnt('proxy_reference', K.RUNTIME_DIACRITIC)}"
    pair = ("raw_sentence", "proxy_reference")
    lf = (f"{matching_ctes('lp', *pair)},\nlf AS ({exact_features('lp', *pair, loss, True)})" if exact
          else f"lf AS (SELECT *, {twin_features(*pair, loss)} FROM lp)")
    return f"""{ESSAYS},
la AS (SELECT essay_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: {strip('s')}),
                                    lambda s: s <> '') AS s FROM essays),
lines AS (SELECT essay_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS sent_pos, unnest(s) AS raw_sentence FROM la),
ln AS (SELECT *, regexp_replace({strip('nfc_normalize(raw_sentence)')}, {q(ws + '+')}, ' ', 'g') AS n1 FROM lines),
lg AS (SELECT *, {graphemes('n1')} AS g FROM ln),
lp AS (SELECT essay_id, sent_pos, raw_sentence,
              array_to_string(list_filter(g, lambda x, i: NOT (i >= 3 AND x = g[i - 1] AND x = g[i - 2])), '')
              AS proxy_reference FROM lg),
{lf},
ls AS (SELECT *, {scores} FROM lf),
lw AS (SELECT *, {pattern} AS writing_pattern FROM ls),
rule_lines AS (SELECT *, {expl} AS explanation FROM lw)"""


def pair_features_ctes(code_points, exact: bool = False) -> str:
    """CTE ``pf``: the valid pairs with the nine surface features."""
    cls = K.char_class(code_points)
    loss = f"{cnt('clean_sentence', cls)} > {cnt('dyslexic_sentence', cls)}"
    valid = lambda c: f"({c} IS NOT NULL AND length({c}) >= 3 AND NOT regexp_matches({c}, '[{{}}]'))"
    pair = ("clean_sentence", "dyslexic_sentence")
    pf = (f"{matching_ctes('pv', *pair)},\npf AS ({exact_features('pv', *pair, loss)})" if exact else
          f"pf AS (SELECT essay_id, pos, clean_sentence, dyslexic_sentence, error_type, {twin_features(*pair, loss)} FROM pv)")
    return f"""{pairs_ctes()},
pv AS MATERIALIZED (SELECT * FROM pairs WHERE {valid(pair[0])} AND {valid(pair[1])}),
{pf}"""


def pair_patterns_ctes(weights: dict, exact: bool = False) -> str:
    scores, pattern, expl = v1_scores_and_label(weights)
    return f"""{pair_features_ctes(K.PAIR_DIACRITICS_NB, exact)},
ps AS (SELECT *, {scores} FROM pf),
pw AS (SELECT *, {pattern} AS writing_pattern FROM ps),
pair_patterns AS (SELECT *, {expl} AS explanation FROM pw)"""


# ---------------------------------------------------------------------------
# corpus builds (I23, I24) and evaluation
# ---------------------------------------------------------------------------

def binary_corpus(extra: list[str], times: int) -> str:
    vals = ", ".join(f"({i}, {q(t)})" for i, t in enumerate(extra))
    return f"""WITH {pairs_ctes()},
ex AS (SELECT * FROM (VALUES {vals}) t(idx, text)),
exr AS (SELECT idx, text, unnest(range({times})) AS rep FROM ex),
u AS (
  SELECT dyslexic_sentence AS text, 1 AS label, 0 AS side, 0 AS rep, essay_id, pos FROM pairs
  UNION ALL SELECT clean_sentence, 0, 1, 0, essay_id, pos FROM pairs
  UNION ALL SELECT text, 0, 2, rep, idx, 0 FROM exr),
f AS (SELECT * FROM u WHERE length(text) >= {K.MIN_SENTENCE_CHARS}),
k AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY side, rep, essay_id, pos) AS rn FROM f)
SELECT text, CAST(label AS INTEGER) AS label FROM k WHERE rn = 1"""


def normalize_label(c: str) -> str:
    x = f"lower(trim(coalesce({c}, 'None'), {q(K.PY_WS_CHARS)}))"
    parts = []
    for words_, label in K.MACRO_RULES:
        cond = " OR ".join(f"contains({x}, {q(w)})" for w in words_)
        parts.append(f"WHEN {cond} THEN {q(label)}")
    return "CASE " + " ".join(parts) + f" ELSE {q(K.MACRO_DEFAULT)} END"


def pattern_corpus(cap: int, keep_key: bool = False) -> str:
    return f"""WITH {pairs_ctes()},
pg AS (SELECT page_id AS essay_id, 0 AS pos, CAST(NULL AS VARCHAR) AS clean_sentence, html AS dyslexic_sentence,
              CAST(NULL AS VARCHAR) AS error_type, 1 AS corpus FROM pages
       UNION ALL SELECT page_id, 1, NULL, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, 'Grammar', 1
       FROM pages WHERE regexp_extract(html, '<title>([^<]*)</title>', 1) <> ''),
u AS (SELECT essay_id, pos, clean_sentence, dyslexic_sentence, error_type, 0 AS corpus FROM pairs
      UNION ALL SELECT * FROM pg),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dyslexic_sentence ORDER BY corpus, essay_id, pos) AS rn
                     FROM u) WHERE rn = 1),
j AS (SELECT * FROM d WHERE NOT coalesce(regexp_matches(dyslexic_sentence, {q(K.JUNK)}), false)),
l AS (SELECT *, {normalize_label('error_type')} AS macro_label FROM j),
n AS (SELECT clean_sentence AS dyslexic_sentence, 'Normal' AS macro_label,
             concat_ws(':', 'n', CAST(corpus AS VARCHAR), CAST(essay_id AS VARCHAR), CAST(pos AS VARCHAR)) AS row_key FROM l
      WHERE clean_sentence IS NOT NULL AND length(clean_sentence) > 5
      ORDER BY md5(clean_sentence), clean_sentence, row_key LIMIT {cap}),
y AS (SELECT dyslexic_sentence, macro_label,
             concat_ws(':', 'd', CAST(corpus AS VARCHAR), CAST(essay_id AS VARCHAR), CAST(pos AS VARCHAR)) AS row_key
      FROM l WHERE macro_label <> {q(K.MACRO_DEFAULT)}),
pcorp AS (SELECT * FROM y WHERE dyslexic_sentence IS NOT NULL UNION ALL SELECT * FROM n)
SELECT {'*' if keep_key else 'dyslexic_sentence, macro_label'} FROM pcorp"""


def eval_rows(threshold: float = 0.5) -> str:
    """CTE ``ev(label, prediction, probability)``: labels.quality vs the essay composite score."""
    return f"""{screen_essays_cte()},
ev AS (SELECT CAST(l.quality AS INTEGER) AS label,
              CAST(s.composite_score >= {threshold} AS INTEGER) AS prediction,
              s.composite_score AS probability
       FROM labels l JOIN sres s ON l.doc_id = s.essay_id WHERE s.composite_score IS NOT NULL)"""


def screen_essays_cte() -> str:
    body = screen_essays(digits=15)
    return body.replace("WITH ", "", 1).rsplit("SELECT e.essay_id", 1)[0].rstrip() + \
        ",\nsres AS (SELECT essay_id, composite_score FROM r)"


# ---------------------------------------------------------------------------
# TF-IDF (I1-I4)
# ---------------------------------------------------------------------------

def _windows_sql(chars: str, lo: int, hi: int) -> str:
    """All windows of lo..hi entries of a list of characters."""
    return (f"flatten(list_transform(range({lo}, {hi} + 1), lambda n: list_transform(range(1, len({chars}) - n + 2), "
            f"lambda i: array_to_string({chars}[i:i + n - 1], ''))))")


def char_source(t: str) -> str:
    """Cleaned text as a list of characters, to be bound as a column ``c``."""
    return f"string_split(regexp_replace(lower({t}), {q(K.PY_WS + K.PY_WS + '+')}, ' ', 'g'), '')"


def char_grams(lo: int, hi: int) -> str:
    return _windows_sql("c", lo, hi)


def char_wb_source(t: str) -> str:
    """Padded words as lists of characters, to be bound as a column ``c``."""
    return (f"list_transform(regexp_extract_all(lower({t}), {q(K.NON_WS + '+')}), lambda x: string_split(' ' || x || ' ', ''))")


def char_wb_grams(lo: int, hi: int) -> str:
    return f"flatten(list_transform(c, lambda ww: {_windows_sql('ww', lo, hi)}))"


def word_source(t: str) -> str:
    return f"regexp_extract_all(lower({t}), {q(r'[\p{L}\p{N}_]{2,}')})"


def word_grams() -> str:
    return "list_concat(c, list_transform(range(1, len(c)), lambda i: c[i] || ' ' || c[i + 1]))"


def tfidf_ctes(docs_sql: str, source: str, grams: str, min_df: int, max_features: int | None, sublinear: bool) -> str:
    limit = f"ORDER BY total_tf DESC, term ASC LIMIT {max_features}" if max_features else ""
    w = "(1 + ln(tf))" if sublinear else "CAST(tf AS DOUBLE)"
    return f"""docs AS ({docs_sql}),
cl AS MATERIALIZED (SELECT doc_id, {source} AS c FROM docs),
gr AS (SELECT doc_id, unnest({grams}) AS term FROM cl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM gr GROUP BY doc_id, term),
st AS (SELECT term, count(*) AS df, sum(tf) AS total_tf FROM tf GROUP BY term HAVING count(*) >= {min_df}),
vc AS (SELECT * FROM st {limit}),
vocab AS (SELECT term, df, total_tf, ln((1.0 + (SELECT count(*) FROM docs)) / (1.0 + df)) + 1.0 AS idf,
                 row_number() OVER (ORDER BY term) - 1 AS index FROM vc),
wt AS (SELECT tf.doc_id, tf.term, {w} * v.idf AS w FROM tf JOIN vocab v ON tf.term = v.term),
nm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM wt GROUP BY doc_id),
vec AS (SELECT wt.doc_id, wt.term, CASE WHEN norm > 0 THEN w / norm ELSE 0.0 END AS tfidf
        FROM wt JOIN nm ON wt.doc_id = nm.doc_id)"""


def vocabulary_select() -> str:
    return ("SELECT term, CAST(df AS BIGINT) AS df, CAST(total_tf AS BIGINT) AS total_tf, round(idf, 6) AS idf, "
            "CAST(index AS BIGINT) AS index FROM vocab")


def summary_select() -> str:
    return ("SELECT doc_id, CAST(count(*) AS BIGINT) AS n_terms, round(sum(tfidf), 6) AS sum_tfidf, "
            "round(max(tfidf), 6) AS max_tfidf FROM vec GROUP BY doc_id")
