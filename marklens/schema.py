"""Names, fixed values and table schemas shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the scoring scale and the review protocol.
SCORE_MIN, SCORE_MAX, SCORE_STEP = 1.0, 5.0, 0.5
LARGE_ERROR = 1.0
PRIMARY_BUDGET = 0.2
BUDGETS = (0.1, 0.2, 0.3)
THRESHOLDS = (0.5, 1.0, 1.5)
SMALL_GROUP = 20
ELIGIBLE_STATUS = "not_flagged"
PRIVACY_STATUSES = ("flagged", "not_flagged", "unresolved_raw_id_link")
SPLITS = ("model_train", "validation", "official_test")
TARGETS = ("V", "G")
MODELS = ("linear", "forest")

# Fixed order of the per-document features.
FEATURES = (
    "word_count",
    "sentence_count",
    "mean_sentence_length",
    "mtld",
    "mattr",
    "mean_word_frequency",
    "mean_word_length",
    "lexical_density",
    "noun_diversity",
    "detected_grammar_errors_per_100_words",
    "detected_error_free_sentence_ratio",
    "complex_sentence_ratio",
    "estimated_clauses_per_sentence",
    "subordinate_clause_ratio",
)
EXTRA_FEATURES = (
    "content_word_low_frequency_ratio",
    "content_word_frequency_p25",
    "content_lemma_mattr",
    "detected_misspellings_per_100_words",
    "detected_spelling_rule_diversity",
    "detected_grammar_rule_diversity",
    "detected_repeated_grammar_rule_ratio",
    "mean_dependency_distance",
    "mean_sentence_tree_depth",
)

# Fixed tag sets of the syntax features.
CONTENT_POS = ("NOUN", "PROPN", "VERB", "ADJ", "ADV")
NOUN_POS = ("NOUN", "PROPN")
CLAUSE_POS = ("VERB", "AUX")
SUBORDINATE_DEPS = ("advcl", "ccomp", "xcomp", "acl", "relcl", "csubj", "csubjpass")
MAIN_DEPS = ("ROOT", "conj")

CORPUS_SCHEMA = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("prompt_id", T.StringType()),
        T.StructField("y_v", T.DoubleType()),
        T.StructField("y_g", T.DoubleType()),
    ]
)
TOKEN_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("sent_id", T.IntegerType()),
        T.StructField("tok_i", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("lemma", T.StringType()),
        T.StructField("pos", T.StringType()),
        T.StructField("dep", T.StringType()),
        T.StructField("head_i", T.IntegerType()),
        T.StructField("char_start", T.LongType()),
        T.StructField("char_end", T.LongType()),
        T.StructField("is_alpha", T.BooleanType()),
    ]
)
PREDICTION_COLUMNS = {
    ("V", "linear"): "lin_v",
    ("V", "forest"): "for_v",
    ("G", "linear"): "lin_g",
    ("G", "forest"): "for_g",
}
TRUTH_COLUMNS = {"V": "y_v", "G": "y_g"}
