"""How the driver tables stand in for the labelled review corpora.

These definitions are shared by the Spark plans and (as SQL text) by the
oracles, so both sides compute the same synthetic columns.
"""
from ..functions.charsets import CharSet
from ..functions.constants import LATIN_RANGES

# Keep range of the script-specific cleaners on the en/fr/de/es driver text.
KEEP = CharSet(LATIN_RANGES)
# The same set as the body of a regex class, for the SQL oracles.
KEEP_SQL = KEEP.members()
# Stop list used on the driver text (a parameter of T7; the Bengali list is
# the default of the library functions).
FIXTURE_STOP_WORDS = [
    "the", "and", "of", "to", "in", "is", "on", "for", "with",
    "le", "la", "les", "de", "des", "et", "du", "un", "une",
    "der", "die", "das", "und", "ein",
    "el", "los", "las", "y", "que", "en",
]
STOP_SHARE = 0.2  # tokens in more than this share of the documents form the stop table
PEEK_POSITIONS = [29, 34, 390]
HEAD_ROWS = 5
N_LOGITS = 10  # logit j of a stored vector is the sum of x_i cos(i j), i and j from 1
VECTOR_DIM = 64
TOKEN_DIM = 16  # token vectors: entry i of id t is ((t (2 i + 1) + i) mod 101 - 50) / 64
VECTORS_PER_DOC = 8  # stored vectors vec_id // 8 stand in for the token vectors of one document
TWO_CLASS_NAMES = {0: "Negative", 1: "Positive"}

# SQL forms of the synthetic columns (valid in Spark SQL and DuckDB).
RAW_NEWS_LABEL_SQL = "CASE WHEN toxic = 1 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END"
PRED_SQL = "CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END"

# Configurations that are really trained (M7): model, dataset, class count, feature size, class weights, rule of the
# second split, epochs, learning rate, weight decay. Full-batch training, so the batch is the whole train split.
GRID = [
    ("frozen-plain", "embeddings", 10, 64, False, "floor", 5, 0.05, 0.0),
    ("frozen-decay", "embeddings", 10, 64, False, "round", 5, 0.05, 0.01),
    ("hashed-small", "documents", 2, 64, False, "floor", 5, 0.1, 0.0),
    ("hashed-weighted", "documents", 2, 256, True, "floor", 5, 0.1, 0.0),
    ("hashed-three", "documents", 3, 256, True, "round", 5, 0.1, 0.001),
]
BATCH_EPOCHS = 3  # epochs of the mini-batch run
GRID_COLUMNS = ("model", "dataset", "classes", "feature_size", "weighted", "rule", "epochs", "learning_rate", "weight_decay")
