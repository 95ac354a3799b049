"""Fixed values the results depend on.

Everything here is a value that must be equal to the original system's for the
results to agree: code-point classes, thresholds, label vocabularies and texts.
Regex classes use the ``\\x{HHHH}`` form, which both Java regex (Spark) and RE2
(DuckDB, used by the SQL oracle) understand, so one constant serves both engines.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# Unicode classes
# --------------------------------------------------------------------------

# Characters Python's str.split()/str.strip() treat as whitespace.
PY_WS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
NON_WS = PY_WS.replace("[", "[^", 1)
# The same set as a plain string, for translate()/btrim() (much cheaper than a regex class).
PY_WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
               + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")

SINHALA = r"[\x{0D80}-\x{0DFF}]"                 # Sinhala block
VIRAMA_CHAR = "්"                            # al-lakuna / hal kirima
VIRAMA = r"\x{0DCA}"
VOWEL_SIGN = r"[\x{0DCF}-\x{0DDF}]"              # dependent vowel signs
INDEPENDENT_VOWEL = r"[\x{0D85}-\x{0D96}]"
CONSONANT = r"[\x{0D9A}-\x{0DC6}]"
LATIN = r"[a-zA-Z]"

# Confusable consonant pairs, as code points (the code points are the behaviour).
CONFUSABLE_PAIRS = [
    (0x0D9A, 0x0D9B), (0x0D9C, 0x0D9D), (0x0DA0, 0x0DA1), (0x0DA4, 0x0DA5),
    (0x0DA7, 0x0DA8), (0x0DAA, 0x0DAB), (0x0DAD, 0x0DAE), (0x0DB0, 0x0DB1),
    (0x0DB3, 0x0DB4), (0x0DB5, 0x0DB7), (0x0DB6, 0x0DB8), (0x0DB9, 0x0DBA),
    (0x0DC0, 0x0DC2), (0x0DC3, 0x0DC4),
]
# Short / long vowel sign pairs.
SHORT_LONG_PAIRS = [
    (0x0DCF, 0x0DD0), (0x0DD2, 0x0DD3), (0x0DD4, 0x0DD6), (0x0DD9, 0x0DDA), (0x0DDC, 0x0DDD),
]
# Diacritic set of the pair-diff features (14 characters).
PAIR_DIACRITICS = [0x0DCF, 0x0DD0, 0x0DD1, 0x0DD2, 0x0DD3, 0x0DD4, 0x0DD6, 0x0DD8,
                   0x0DD9, 0x0DDA, 0x0DDC, 0x0DDD, 0x0D82, 0x0D83]
# Diacritic set of the batch notebook variant (15 characters).
PAIR_DIACRITICS_NB = [0x0DCF, 0x0DD0, 0x0DD1, 0x0DD2, 0x0DD3, 0x0DD4, 0x0DD6, 0x0DD9,
                      0x0DDA, 0x0DDC, 0x0DDD, 0x0DDE, 0x0D82, 0x0D83, 0x0DCA]
# Diacritic range of the runtime (raw vs proxy) features.
RUNTIME_DIACRITIC = r"[\x{0DCA}-\x{0DDF}]"


def char_class(code_points) -> str:
    """Regex character class for a list of code points (``\\x{..}`` form)."""
    return "[" + "".join("\\x{%04X}" % c for c in code_points) + "]"


CONFUSABLE = char_class(sorted({c for p in CONFUSABLE_PAIRS for c in p}))
SHORT_VOWEL = char_class([a for a, _ in SHORT_LONG_PAIRS])
LONG_VOWEL = char_class([b for _, b in SHORT_LONG_PAIRS])

# Sentence delimiters.
SCREEN_SPLIT = r"[.!?\x{0964}\n]+"     # screening splitter: runs of . ! ? danda LF
PATTERN_SPLIT = r"[.\n\x{0964}]+"      # pattern splitter: runs of . LF danda
BASIC_SPLIT = r"[.!?]"                 # baseline splitter: single . ! ?
JUNK = r"<[^\n]*?>|\{[^\n]*?\}"        # HTML / JSON looking spans within a line

# --------------------------------------------------------------------------
# Screening thresholds
# --------------------------------------------------------------------------
MIN_SENTENCE_CHARS = 4
LONG_SENTENCE_CHARS = 200
CHUNK_CHARS = 120
SENTENCE_THRESHOLD = 0.65
BORDERLINE_THRESHOLD = 0.50
COMPOSITE_MEAN_WEIGHT = 0.6
COMPOSITE_PEAK_WEIGHT = 0.4
ESSAY_DYSLEXIC_COMPOSITE = 0.75
ESSAY_DYSLEXIC_RATIO = 0.40
ESSAY_BORDERLINE_COMPOSITE = 0.63
NO_SENTENCE_ERROR = "No valid sentences found."

# Notebook essay rule.
NB_DYSLEXIC_COMPOSITE = 0.55
NB_RATIO = 0.2
NB_MEAN = 0.5
NB_BORDERLINE_COMPOSITE = 0.45

# --------------------------------------------------------------------------
# Pattern profile (v2)
# --------------------------------------------------------------------------
PATTERN_LABELS = ["Grammar", "Normal", "Phonetic", "Spelling", "Visual"]   # alphabetical
ERROR_LABELS = ["Grammar", "Phonetic", "Spelling", "Visual"]
MIN_WORDS_FOR_RELIABLE = 3
STRONG_PATTERN_THRESHOLD = 0.44
WEIGHT_BASELINE = 0.25
RELIABLE_MARGIN = 0.10
NORMAL_CONFIDENT = 0.70
MIXED_GAP = 0.08
NO_PATTERN_ERROR = "No valid sentences detected."

PATTERN_EXPLANATIONS = {
    "Spelling": ("Frequent orthographic inconsistencies including omissions "
                 "and unstable word forms."),
    "Phonetic": ("Phonetic substitutions where words are written "
                 "based on sound rather than standard orthography."),
    "Visual": ("Visual-based errors such as letter reversals "
               "and grapheme misordering."),
    "Grammar": ("Grammatical inconsistencies including tense misuse "
                "and agreement errors."),
}

# Texts of a verdict, around the labels and scores.
MIXED_DOMINANT = ["No clear dominant pattern detected. The essay shows overlapping characteristics of ", " and ", " patterns."]
CLEAR_DOMINANT = [" Pattern Dominant (", ")"]
MIXED_EXPLANATION = ["The writing demonstrates mixed indicators, with ", " (", ") and ", " (", ") appearing closely."]

SEVERITY_LEVELS = [(0.45, "High Pattern Dominance"), (0.35, "Moderate Pattern Presence")]
SEVERITY_DEFAULT = "Mild Pattern Indicators"
SEVERITY_BOOSTS = [(0.85, 8.0), (0.75, 4.0), (0.65, 2.0)]
RISK_LEVELS = [(65, "High Writing Pattern Risk"), (45, "Moderate Writing Pattern Risk"),
               (25, "Low-Moderate Writing Pattern Risk")]
RISK_DEFAULT = "Low Writing Pattern Risk"
RISK_CAP = 95.0

# --------------------------------------------------------------------------
# Rule-based profile (v1)
# --------------------------------------------------------------------------
V1_PATTERNS = ["Mixed Dyslexic Pattern", "No Dominant Pattern", "Orthographic Instability",
               "Phonetic Confusion", "Word Boundary Confusion"]            # alphabetical
V1_MIN_SCORE = 0.5
V1_DOMINANCE_MARGIN = 0.3
V1_EXPLANATIONS = {
    "Orthographic Instability": (
        "Frequent character-level writing instability was detected, "
        "such as omissions, repetitions, or diacritic inconsistencies."),
    "Phonetic Confusion": (
        "Phonetic-level confusion was observed due to substitutions "
        "between phonetically similar characters."),
    "Word Boundary Confusion": (
        "Word boundary issues were detected, including incorrect spacing "
        "or merging/splitting of words."),
    "Mixed Dyslexic Pattern": (
        "Multiple dyslexic writing behaviors were observed without a single "
        "clearly dominant pattern."),
    "No Dominant Pattern": "No strong dyslexic writing pattern was detected.",
}
MIXED_SUFFIX = " Dominant contributing patterns: "

# Raw error type -> v1 pattern (exact, case sensitive).
V1_LABEL_MAP = {
    "phonetic_confusion": "Phonetic Confusion",
    "Phonetic Confusion": "Phonetic Confusion",
    "phonetic": "Phonetic Confusion",
    "grammar": "Orthographic Instability",
    "Grammar": "Orthographic Instability",
    "Spelling": "Orthographic Instability",
    "visual_scrambling": "Word Boundary Confusion",
    "Visual Scrambling": "Word Boundary Confusion",
    "visual_reversal": "Word Boundary Confusion",
}

# Pair-diff feature order.
SURFACE_FEATURES = ["char_addition", "char_omission", "char_substitution", "has_addition",
                    "has_omission", "has_substitution", "word_count_diff",
                    "has_spacing_issue", "has_diacritic_loss"]

CONFIDENCE_LEVELS = [(70, "High"), (40, "Medium")]
CONFIDENCE_DEFAULT = "Low"
DOMINANCE_LEVELS = [(0.6, "Strong"), (0.4, "Moderate")]
DOMINANCE_DEFAULT = "Weak / Mixed"

# Merge of two rare v1 classes in the older profiling notebook.
RARE_PATTERNS = ["Word Boundary Confusion", "Mixed Essay Pattern"]
RARE_TARGET = "Mixed Dyslexic Pattern"

# Macro-label rules, applied in order to lower(strip(raw)).
MACRO_RULES = [
    (("phonetic", "confusion"), "Phonetic"),
    (("visual", "scrambling", "reversal"), "Visual"),
    (("grammar", "tense", "case", "spoken"), "Grammar"),
    (("spelling",), "Spelling"),
]
MACRO_DEFAULT = "None"

# Closed error-tag vocabulary (declared by the original system as a schema).
ERROR_TAGS = ["spelling_error", "missing_diacritic", "extra_diacritic", "letter_omission",
              "letter_addition", "order_swap", "merged_words", "fragmented_words",
              "spacing_issue", "repeated_letters", "irregular_structure"]
