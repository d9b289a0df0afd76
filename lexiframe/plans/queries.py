"""The registered queries: each reads the driver tables and returns a DataFrame.

Column names match the SQL oracles in :mod:`lexiframe.plans.oracle`; doubles
that come out of floating-point sums are rounded to 6 places and id arrays
are rendered as space-separated text so the comparison is exact.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import (
    BATCH_SIZE, MAX_LEN, NEWS_LABEL_SWAP,
    TEST_SEED, TEST_SHARE, VALID_SEED, VALID_TRAIN_SHARE,
)
from ..functions.scoring import argmax, cross_entropy
from ..functions.timefmt import (
    format_count, format_decimal, format_elapsed, format_percent, split_minutes_seconds,
)
from ..operators import encode as E
from ..operators import evaluate as A
from ..operators import shape as P
from ..operators import splits as D
from ..operators.training import token_hashes
from ..session import materialize, read_table, spread
from .fixtures import (
    BATCH_EPOCHS, FIXTURE_STOP_WORDS, GRID, GRID_COLUMNS, HEAD_ROWS, KEEP, N_LOGITS, PEEK_POSITIONS, PRED_SQL, RAW_NEWS_LABEL_SQL,
    STOP_SHARE, TOKEN_DIM, TWO_CLASS_NAMES, VECTOR_DIM, VECTORS_PER_DOC,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def _ids_text(c) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


# ---------------------------------------------------------------- shared plans

def book_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """T1 -> T2 -> T6/T7 -> T5 on every document, one column per stage."""
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return (docs.select("doc_id", T.delete_newlines("text").alias("t1_no_newlines"))
            .withColumn("t2_keep_range", T.replace_outside("t1_no_newlines", KEEP))
            .withColumn("n_tokens", F.size(T.tokenize("t2_keep_range", spaces_only=True)).cast("int"))
            .withColumn("t7_no_stop", T.remove_stop_words("t2_keep_range", FIXTURE_STOP_WORDS, spaces_only=True))
            .withColumn("t5_final", T.drop_chars("t7_no_stop"))
            .withColumn("is_empty", T.is_empty("t5_final")))


def comment_cleaned(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """T3 -> T4 -> T5 (T9) with one column per stage and the F4 flag."""
    return (df.select(*keys, T.remove_emojis(text).alias("t3_no_emoji"))
            .withColumn("t4_keep_only", T.keep_only("t3_no_emoji", KEEP))
            .withColumn("t5_final", T.drop_chars("t4_keep_only"))
            .withColumn("is_empty", T.is_empty("t5_final")))


def doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of the cleaned book text (T8 then T5)."""
    return book_cleaned(spark, sf).select("doc_id", T.tokenize("t5_final", spaces_only=True).alias("tokens"))


def written_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_tokens`` for several readers: the texts are cleaned once and written as text, which packs into fewer bytes
    than lists of tokens; each reader splits them."""
    texts = materialize(book_cleaned(spark, sf).select("doc_id", "t5_final"), "clean-texts")
    return texts.select("doc_id", T.tokenize("t5_final", spaces_only=True).alias("tokens"))


def test_split(spark: SparkSession, sf: str, written: bool = True) -> DataFrame:
    """(doc_id, split) of D1. Consumers get it written once (a narrow key
    table) instead of recomputing the split plan in every branch that reads it."""
    docs = read_table(spark, sf, "documents").select("doc_id")
    sp = D.train_test_split(docs, "doc_id", TEST_SHARE, TEST_SEED)
    return materialize(sp, "split-keys") if written else sp


def vocab_table(spark: SparkSession, sf: str) -> DataFrame:
    return E.build_vocab(doc_tokens(spark, sf), "tokens")


def encoded(spark: SparkSession, sf: str, pad: bool = True) -> DataFrame:
    toks = written_tokens(spark, sf)
    vocab = materialize(E.build_vocab(toks, "tokens"), "vocab")
    return E.encode(toks, "doc_id", "tokens", vocab, MAX_LEN, pad=pad)


def stop_table(spark: SparkSession, sf: str) -> DataFrame:
    """Stop words by rule: tokens of more than ``STOP_SHARE`` of the documents."""
    toks = materialize(doc_tokens(spark, sf), "tokens")
    in_docs = (toks.select(F.explode_outer(F.array_distinct("tokens")).alias("word")).where(F.col("word").isNotNull())
               .groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    return in_docs.where(F.col("n") > STOP_SHARE * toks.count()).select("word")


def event_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """events as per-example training metrics: epoch = day, loss = value,
    correct = not an error, phase = seeded 15 % hash split (D4)."""
    ev = read_table(spark, sf, "events")
    day0 = ev.select(F.min(F.to_date("ts"))).scalar()
    m = ev.select("event_id", "ts", "user_id", "event_type",
                  (F.datediff(F.to_date("ts"), day0) + 1).cast("int").alias("epoch"),
                  F.col("value").alias("loss"),
                  (F.col("event_type") != "error").alias("is_correct"))
    return D.hash_split(m, "event_id", 0.15, VALID_SEED, "valid", "train", "phase")


def _history(spark: SparkSession, sf: str) -> DataFrame:
    h = A.epoch_history(event_metrics(spark, sf))
    h = A.mark_improvements(h, "valid_loss")
    return h.select(
        "epoch",
        F.round("train_loss", 6).alias("train_loss"), F.round("train_acc", 6).alias("train_acc"),
        F.round("valid_loss", 6).alias("valid_loss"), F.round("valid_acc", 6).alias("valid_acc"),
        format_elapsed("train_secs").alias("train_time"), format_elapsed("valid_secs").alias("valid_time"),
        "improved")


def _logits(spark: SparkSession, sf: str) -> DataFrame:
    """Logits of the whole stored vector under the fixed cosine weights."""
    emb = read_table(spark, sf, "embeddings")
    x = F.transform("embedding", lambda v: v.cast("double"))
    logit = F.transform(F.sequence(F.lit(1), F.lit(N_LOGITS)), lambda j: F.aggregate(
        F.zip_with(x, F.sequence(F.lit(1), F.size(x)), lambda v, i: v * F.cos(i * j)), F.lit(0.0), lambda a, v: a + v))
    return emb.select("vec_id", logit.alias("logits"), F.col("label").alias("target"))


def _doc_predictions(spark: SparkSession, sf: str) -> DataFrame:
    labels = read_table(spark, sf, "labels")
    return labels.select(F.col("quality").alias("target"), F.expr(PRED_SQL).cast("int").alias("pred"))


# ---------------------------------------------------------------- queries

@register("union_corpora")
def q_union_corpora(spark: SparkSession, sf: str) -> DataFrame:
    """Two corpora stacked with a constant label each, renumbered."""
    docs = read_table(spark, sf, "documents")
    conv = read_table(spark, sf, "conversations")
    a = P.add_label(P.rename(docs.select("doc_id", "text"), {"text": "Data", "doc_id": "k1"}), 0) \
        .withColumns({"k2": F.lit(0).cast("long"), "_part": F.lit(0), "corpus": F.lit("documents")})
    b = P.add_label(P.rename(P.drop(conv, "role"), {"text": "Data", "conv_id": "k1", "turn": "k2"}), 1) \
        .withColumns({"_part": F.lit(1), "corpus": F.lit("conversations")})
    u = P.union_corpora([a.select("_part", "corpus", "k1", "k2", "Data", "Sentiment"),
                         b.select("_part", "corpus", "k1", "k2", "Data", "Sentiment")])
    r = P.renumber(u, ["k1", "k2"], part_col="_part")
    return r.select("row_id", "corpus", "Data", "Sentiment")


@register("index_aligned_join")
def q_index_aligned_join(spark: SparkSession, sf: str) -> DataFrame:
    """Texts and labels re-attached by key (outer)."""
    x = read_table(spark, sf, "documents").select("doc_id", F.col("text").alias("Data"))
    y = read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("Sentiment"))
    return P.index_aligned_join(x, y, "doc_id").select("doc_id", "Data", "Sentiment")


@register("two_class_variant")
def q_two_class_variant(spark: SparkSession, sf: str) -> DataFrame:
    """Raw news coding recoded by a simultaneous swap, neutral rows dropped."""
    lab = read_table(spark, sf, "labels").select(
        "doc_id", F.expr(RAW_NEWS_LABEL_SQL).cast("int").alias("raw_label"))
    rec = P.recode(lab.withColumn("Sentiment", F.col("raw_label")), NEWS_LABEL_SWAP)
    docs = read_table(spark, sf, "documents").select("doc_id")
    return P.drop_class(docs.join(rec, "doc_id"), 2).select("doc_id", "raw_label", "Sentiment")


@register("clean_book")
def q_clean_book(spark: SparkSession, sf: str) -> DataFrame:
    """T1 T2 T6 U4 T7 T8 T5 F4, one column per stage."""
    return book_cleaned(spark, sf)


@register("clean_comment")
def q_clean_comment(spark: SparkSession, sf: str) -> DataFrame:
    """T3 T4 T5 T9 F2 F4 on documents."""
    return comment_cleaned(spread(read_table(spark, sf, "documents"), "doc_id"), ["doc_id"])


@register("clean_conversations")
def q_clean_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """T9 on the second corpus (conversation turns)."""
    return comment_cleaned(spread(read_table(spark, sf, "conversations"), "conv_id", "turn"), ["conv_id", "turn"])


@register("label_distribution")
def q_label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """A1: rows and non-empty cleaned rows per label."""
    clean = book_cleaned(spark, sf).select("doc_id", "is_empty")
    lab = read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("Sentiment"))
    return A.label_distribution(clean.join(lab, "doc_id"), "Sentiment",
                                [F.sum((~F.col("is_empty")).cast("long")).alias("n_nonempty")])


@register("test_target_counts")
def q_test_target_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A2: count of each target value in the test split."""
    sp = test_split(spark, sf).where(F.col("split") == "test")
    lab = read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("target"))
    return A.label_distribution(sp.join(lab, "doc_id"), "target")


@register("table_profile")
def q_table_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Dtype and non-null count of every column of labels right-joined to documents."""
    lab = read_table(spark, sf, "labels")
    docs = read_table(spark, sf, "documents")
    return P.column_profile(lab.join(docs, "doc_id", "right"))


@register("row_peek")
def q_row_peek(spark: SparkSession, sf: str) -> DataFrame:
    """The first rows (top-k) and rows at given positions, in key order."""
    docs = read_table(spark, sf, "documents").select("doc_id", F.col("text").alias("Data"))
    top = P.head(docs, HEAD_ROWS, ["doc_id"])
    top = P.renumber(top, ["doc_id"], name="pos").withColumn("kind", F.lit("head"))
    pos = P.renumber(docs, ["doc_id"], name="pos", positions=PEEK_POSITIONS) \
        .withColumn("kind", F.lit("iloc"))
    return top.unionByName(pos).select("kind", "pos", "doc_id", "Data")


@register("split_train_test")
def q_split_train_test(spark: SparkSession, sf: str) -> DataFrame:
    """Exact seeded 85/15 split (test = ceil(0.15 n))."""
    return test_split(spark, sf, written=False).select("doc_id", "split")


def _valid_split(spark: SparkSession, sf: str, rule: str) -> DataFrame:
    return D.train_valid_split(test_split(spark, sf), "doc_id", VALID_TRAIN_SHARE, VALID_SEED, rule, unique=True)


@register("split_valid_floor")
def q_split_valid_floor(spark: SparkSession, sf: str) -> DataFrame:
    """Train part split again, train = floor(0.85 n)."""
    return _valid_split(spark, sf, "floor").select("doc_id", "split")


@register("split_valid_round")
def q_split_valid_round(spark: SparkSession, sf: str) -> DataFrame:
    """D3: train part split again, train = round-half-even(0.85 n)."""
    return _valid_split(spark, sf, "round").select("doc_id", "split")


@register("split_hash")
def q_split_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Stateless approximate split by a 32-bit hash threshold."""
    docs = read_table(spark, sf, "documents").select("doc_id")
    return D.hash_split(docs, "doc_id", TEST_SHARE, TEST_SEED)


@register("split_shares")
def q_split_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and share of each of the three splits."""
    return D.split_shares(_valid_split(spark, sf, "floor"))


@register("vocab")
def q_vocab(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus vocabulary, most frequent first."""
    return vocab_table(spark, sf)


@register("encode")
def q_encode(spark: SparkSession, sf: str) -> DataFrame:
    """Padded ids and masks per document."""
    enc = encoded(spark, sf)
    return enc.select("doc_id", "n_tokens", _ids_text(F.col("input_ids")).alias("input_ids"),
                      _ids_text(F.col("attention_mask")).alias("attention_mask"))


@register("decode")
def q_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Ids back to tokens (padding dropped through the mask)."""
    toks = written_tokens(spark, sf)
    # read by the lookup and the reverse lookup: written once
    vocab = materialize(E.build_vocab(toks, "tokens"), "vocab")
    enc = E.encode(toks, "doc_id", "tokens", vocab, MAX_LEN)
    dec = E.decode(enc, "doc_id", "input_ids", vocab)
    return dec.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def encoded_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, n_tokens): length of each encoded row, straight from the tokens
    (``E.encoded_length``; the vocabulary lookup cannot change a length)."""
    return doc_tokens(spark, sf).select("doc_id", E.encoded_length("tokens", MAX_LEN).alias("n_tokens"))


@register("max_length")
def q_max_length(spark: SparkSession, sf: str) -> DataFrame:
    """Longest encoded row among the train rows."""
    tr = test_split(spark, sf).where(F.col("split") == "train")
    return E.max_length(encoded_lengths(spark, sf).join(tr, "doc_id"))


def _batched_input(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, n_tokens, split): a narrow key table, written once because
    batching reads it several times (range sample, rows, counts)."""
    return materialize(encoded_lengths(spark, sf).join(test_split(spark, sf), "doc_id"), "batch-keys")


@register("bucket_batches")
def q_bucket_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Length-sorted batches and each batch's padded length."""
    b = E.bucket_batches(_batched_input(spark, sf), "doc_id", "n_tokens", BATCH_SIZE)
    return b.select("doc_id", "split", "n_tokens", "batch_id", "pad_to")


@register("batch_padded")
def q_batch_padded(spark: SparkSession, sf: str) -> DataFrame:
    """E8 applied: every document's ids padded to the longest row of its
    length-sorted batch (E11), with the attention mask (E9)."""
    toks = written_tokens(spark, sf)
    vocab = materialize(E.build_vocab(toks, "tokens"), "vocab")
    enc = E.encode(toks, "doc_id", "tokens", vocab, MAX_LEN, pad=False)
    lens = toks.select("doc_id", E.encoded_length("tokens", MAX_LEN).alias("n_tokens"))
    keys = materialize(lens.join(test_split(spark, sf), "doc_id"), "batch-keys")
    b = E.bucket_batches(keys, "doc_id", "n_tokens", BATCH_SIZE).select("doc_id", "split", "batch_id", "pad_to")
    padded = E.with_padding(enc.join(b, "doc_id"), F.col("pad_to"))
    return padded.select("doc_id", "split", "batch_id", "pad_to",
                         _ids_text(F.col("input_ids")).alias("input_ids"),
                         _ids_text(F.col("attention_mask")).alias("attention_mask"))


@register("sequential_batches")
def q_sequential_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed-size batches in key order."""
    b = E.sequential_batches(test_split(spark, sf), "doc_id", BATCH_SIZE)
    return b.select("doc_id", "split", "batch_id")


@register("random_batches")
def q_random_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed-size batches in seeded random order."""
    b = E.random_batches(test_split(spark, sf), "doc_id", BATCH_SIZE, VALID_SEED)
    return b.select("doc_id", "split", "batch_id")


@register("padding_waste")
def q_padding_waste(spark: SparkSession, sf: str) -> DataFrame:
    """E8 report: padded cells per split under length-sorted batches."""
    b = E.bucket_batches(_batched_input(spark, sf), "doc_id", "n_tokens", BATCH_SIZE)
    return E.padding_waste(b)


@register("label_index")
def q_label_index(spark: SparkSession, sf: str) -> DataFrame:
    """Label vocabulary by descending frequency (orders' priorities; train-split quality labels)."""
    pri = E.label_index(read_table(spark, sf, "orders").select(F.col("o_orderpriority").alias("label")), "label")
    tr = test_split(spark, sf).where(F.col("split") == "train")
    q = read_table(spark, sf, "labels").join(tr, "doc_id").select(F.col("quality").cast("string").alias("label"))
    qi = E.label_index(q, "label")
    return (pri.withColumn("source", F.lit("orders"))
            .unionByName(qi.withColumn("source", F.lit("labels")))
            .select("source", "label", F.col("n").cast("long").alias("n"), "idx"))


@register("label_index_apply")
def q_label_index_apply(spark: SparkSession, sf: str) -> DataFrame:
    """E12 applied: every order gets the index of its priority (label vocabulary
    fitted on the orders themselves, broadcast as a bounded table)."""
    orders = read_table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("label"))
    idx = E.label_index(orders.select("label"), "label")
    return E.apply_label_index(orders, idx, "label").select("o_orderkey", "label", "idx")


@register("argmax_accuracy")
def q_argmax_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted class per row (first maximum) and correctness."""
    p = A.predict(_logits(spark, sf), "logits", "target")
    return p.select("vec_id", "target", "pred", "is_correct")


@register("accuracy")
def q_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """A4: accuracy over the whole table."""
    p = _logits(spark, sf).withColumn("pred", argmax("logits"))
    return A.accuracy(p).withColumn("accuracy", F.round("accuracy", 6))


@register("batch_mean_metrics")
def q_batch_mean_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """A5: mean of per-batch means next to the row-weighted figures (batches of 32 by key)."""
    p = A.predict(_logits(spark, sf), "logits", "target")
    b = E.sequential_batches(p, "vec_id", BATCH_SIZE, split_col=None)
    m = A.batch_mean_metrics(b)
    return m.select("n_rows", "n_batches", *[F.round(c, 6).alias(c) for c in
                                             ("accuracy", "mean_batch_accuracy", "loss", "mean_batch_loss")])


@register("cross_entropy")
def q_cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Per-row cross-entropy of the logits against the target."""
    lg = _logits(spark, sf)
    return lg.select("vec_id", "target", F.round(cross_entropy("logits", "target"), 6).alias("loss"))


@register("confusion")
def q_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """Confusion counts."""
    return A.confusion(_doc_predictions(spark, sf))


def _rounded_report(rep: DataFrame) -> DataFrame:
    return rep.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_score", "support")])


@register("classification_report")
def q_classification_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per-class precision / recall / F1 / support with averages."""
    return _rounded_report(A.classification_report(A.confusion(_doc_predictions(spark, sf)), TWO_CLASS_NAMES))


@register("classification_report_reference")
def q_classification_report_reference(spark: SparkSession, sf: str) -> DataFrame:
    """A8 with the predictions passed as the true labels (the original call order)."""
    return _rounded_report(A.classification_report(A.confusion(_doc_predictions(spark, sf)),
                                                   TWO_CLASS_NAMES, orientation="reference"))


@register("history")
def q_history(spark: SparkSession, sf: str) -> DataFrame:
    """A10 A9(running) T10 P13: epoch history with loss, accuracy and times per phase."""
    return _history(spark, sf)


@register("best_epoch")
def q_best_epoch(spark: SparkSession, sf: str) -> DataFrame:
    """First epoch with the lowest validation loss, and the last epoch."""
    h = A.epoch_history(event_metrics(spark, sf))
    b = A.best_epoch(h)
    return b.select("best_epoch", F.round("best_loss", 6).alias("best_loss"),
                    F.round("best_acc", 6).alias("best_acc"), "last_epoch",
                    F.round("last_acc", 6).alias("last_acc"))


@register("history_long")
def q_history_long(spark: SparkSession, sf: str) -> DataFrame:
    """History as plot series (epoch, series, value)."""
    h = _history(spark, sf)
    return P.unpivot_series(h, "epoch", ["train_loss", "train_acc", "valid_loss", "valid_acc"])


@register("duplicate_keys")
def q_duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Key check before a column is used as the row index: conversation ids
    occur once per turn, so each repeated id is reported with its count."""
    conv = read_table(spark, sf, "conversations").select("conv_id")
    return P.duplicate_keys(conv, "conv_id").select("conv_id", F.col("n").cast("long").alias("n"))


@register("class_weights")
def q_class_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Inverse class frequency."""
    lab = read_table(spark, sf, "labels").select(F.col("quality").alias("Sentiment"))
    w = A.class_weights(lab)
    return w.select("Sentiment", F.col("n").cast("long").alias("n"), F.round("weight", 9).alias("weight"))


def run_keys(spark: SparkSession, sf: str, dataset: str, rule: str) -> DataFrame:
    """Narrow keys of a dataset with their phase (D1, then D2 or D3), written once; both class variants' labels."""
    if dataset == "embeddings":
        rows, key = read_table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("int").alias("label10")), "vec_id"
    else:
        lab = read_table(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("label2"),
                                                     F.expr(RAW_NEWS_LABEL_SQL).cast("int").alias("label3"))
        rows, key = read_table(spark, sf, "documents").select("doc_id").join(lab, "doc_id"), "doc_id"
    first = materialize(D.train_test_split(rows, key, TEST_SHARE, TEST_SEED), "run-split")
    return materialize(D.train_valid_split(first, key, VALID_TRAIN_SHARE, VALID_SEED, rule, unique=True)
                       .withColumnRenamed("split", "phase"), "run-keys")


def run_examples(spark: SparkSession, sf: str, dataset: str) -> DataFrame:
    """M7: the examples that all configurations of a dataset share, written once: features (embeddings) or token hashes
    (documents), the labels of every class count, phase_<rule> per rule of the second split and weight_<classes>_<rule>
    for the weighted ones."""
    configs = [dict(zip(GRID_COLUMNS, c)) for c in GRID if c[1] == dataset]
    keys = None
    for rule in dict.fromkeys(c["rule"] for c in configs):
        one = run_keys(spark, sf, dataset, rule)
        key = one.columns[0]
        for k in sorted({c["classes"] for c in configs if c["rule"] == rule and c["weighted"]}):
            weights = A.class_weights(one.where("phase = 'train'"), f"label{k}").select(f"label{k}", F.col("weight").alias(f"weight_{k}_{rule}"))
            one = one.join(F.broadcast(weights), f"label{k}", "left").fillna(1.0, [f"weight_{k}_{rule}"])
        one = one.withColumnRenamed("phase", f"phase_{rule}")
        keys = one if keys is None else keys.join(one.drop(*[c for c in one.columns if c.startswith("label")]), key)
    if dataset == "embeddings":
        source = read_table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("features"))
    else:
        labelled = doc_tokens(spark, sf).join(read_table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
        source = labelled.select("doc_id", token_hashes(F.col("tokens")).alias("hashes"))
    return materialize(source.join(keys, key).drop(key), "run-examples")


def grid_heads(dataset: str) -> tuple[list[str], list]:
    """Names and heads of a dataset's configurations over the columns of :func:`run_examples`."""
    from ..operators.training import Head, Settings
    configs = [dict(zip(GRID_COLUMNS, c)) for c in GRID if c[1] == dataset]
    return [c["model"] for c in configs], [
        Head(f"label{c['classes']}", c["classes"], c["feature_size"], Settings(c["epochs"], c["learning_rate"], c["weight_decay"]),
             f"weight_{c['classes']}_{c['rule']}" if c["weighted"] else None, f"phase_{c['rule']}") for c in configs]


def run_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every configuration of the grid trained, saved with its history, loaded again;
    one row per run and epoch with the run's constants and split shares. The configurations of a dataset advance
    together: one scan of its examples an epoch."""
    from ..operators.training import HISTORY, fit_many, load_checkpoint, run_rows, save_checkpoint
    from ..session import scratch_path
    rows, keys = [], [*GRID_COLUMNS, "optimizer", "loss_function", "best_epoch"]
    for dataset in dict.fromkeys(c[1] for c in GRID):
        configs = [dict(zip(GRID_COLUMNS, c)) for c in GRID if c[1] == dataset]
        heads = grid_heads(dataset)[1]
        for c, head, run in zip(configs, heads, fit_many(run_examples(spark, sf, dataset), heads)):
            path = scratch_path(spark, "run-checkpoint")
            save_checkpoint(spark, run, head.settings, path)
            run, settings = load_checkpoint(spark, path)
            rows += run_rows(run, c | {"optimizer": settings.optimizer, "loss_function": settings.loss_function,
                                       "best_epoch": run.best_epoch}, keys)
    kinds = "string, string, int, int, boolean, string, int, double, double, string, string, int".split(", ")
    table = spark.createDataFrame(rows, ", ".join(f"{k} {t}" for k, t in zip(keys, kinds)) + ", " + HISTORY)
    total = F.col("n_train") + F.col("n_valid") + F.col("n_test")
    return table.withColumns({f"{p}_share": F.round(F.col(f"n_{p}") / total, 6) for p in ("train", "valid", "test")})


def run_results(spark: SparkSession, sf: str) -> DataFrame:
    """One row per run: its test figures at the best epoch."""
    return run_grid(spark, sf).where(F.col("epoch") == F.col("best_epoch"))


@register("run_ranking")
def q_run_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Trained runs ranked by test accuracy within (dataset, class variant). What SQL can state: the groups'
    sizes, and that ranks are 1..n and follow the accuracy."""
    r = materialize(A.rank_runs(run_results(spark, sf)), "ranked-runs")
    other = r.select("dataset", "classes", F.col("test_acc").alias("acc2"), F.col("rank").alias("rank2"))
    follows = (r.join(other, ["dataset", "classes"]).groupBy("dataset", "classes").agg(
        F.bool_and((F.col("rank") >= F.col("rank2")) | (F.col("test_acc") >= F.col("acc2"))).alias("ranks_follow_accuracy"),
        F.max("rank").alias("last_rank"), F.countDistinct("rank").alias("n_runs"),
        F.bool_and(F.col("test_acc").between(0, 1)).alias("rates_in_range"), F.max("n_test").alias("n_test")))
    return follows.select("dataset", "classes", "n_runs", "last_rank", "n_test", "ranks_follow_accuracy", "rates_in_range")


@register("format_times")
def q_format_times(spark: SparkSession, sf: str) -> DataFrame:
    """Elapsed time texts and formatted counts per epoch and phase."""
    m = event_metrics(spark, sf)
    g = m.groupBy("epoch", "phase").agg(
        F.count(F.lit(1)).alias("n"), F.sum((~F.col("is_correct")).cast("long")).alias("n_err"),
        A.elapsed_seconds(F.min("ts"), F.max("ts")).alias("secs"), F.avg("loss").alias("loss"))
    mins, secs = split_minutes_seconds("secs")
    return g.select("epoch", "phase", format_count("n").alias("n_events_text"),
                    format_percent("n_err", "n").alias("error_share_text"),
                    format_decimal("loss", 3).alias("loss_text"),
                    format_elapsed("secs").alias("elapsed_text"), mins.alias("minutes"), secs.alias("seconds"))


@register("max_pool")
def q_max_pool(spark: SparkSession, sf: str) -> DataFrame:
    """M4 M5: the vectors of one document max-pooled and mean-pooled, concatenated, with tanh, as long rows."""
    from ..operators.models import pooled_vectors
    emb = read_table(spark, sf, "embeddings").withColumn("doc", F.floor(F.col("vec_id") / VECTORS_PER_DOC).cast("long"))
    pv = pooled_vectors(emb, "embedding", ["doc"], VECTOR_DIM)
    long = pv.select("doc", F.posexplode(F.arrays_zip("features", "tanh")).alias("feature", "v"))
    return long.select("doc", F.col("feature").cast("int").alias("feature"), F.round("v.features", 6).alias("value"),
                       F.round("v.tanh", 6).alias("tanh_value"))


@register("pooled_tokens")
def q_pooled_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """M4 M5 over E2: every document's ids looked up in a table of token vectors (a formula of the id; its 64ths add up exactly, so the means need no rounding), max- and mean-pooled
    where the mask is 1, with tanh, as long rows."""
    from ..operators.pooling import pooled_tokens
    toks = written_tokens(spark, sf)
    vocab = materialize(E.build_vocab(toks, "tokens"), "vocab")
    enc = E.encode(toks, "doc_id", "tokens", vocab, MAX_LEN)
    ids = vocab.select("id").unionByName(spark.range(E.Specials().reserved).select(F.col("id").cast("int").alias("id")))
    table = ids.select("id", F.transform(F.sequence(F.lit(0), F.lit(TOKEN_DIM - 1)), lambda i: (
        (F.col("id").cast("long") * (2 * i + 1) + i) % 101 - 50) / F.lit(64.0)).alias("vector"))
    pv = pooled_tokens(enc, "doc_id", table, TOKEN_DIM)
    long = pv.select("doc_id", "n_pooled", F.posexplode(F.arrays_zip("features", "tanh")).alias("feature", "v"))
    return long.select("doc_id", "n_pooled", F.col("feature").cast("int").alias("feature"), F.col("v.features").alias("value"),
                       F.round("v.tanh", 6).alias("tanh_value"))


# ---------------------------------------------------------------- models (M*)

@register("score_table")
def q_score_table(spark: SparkSession, sf: str) -> DataFrame:
    """M1: plug-in scorer over Arrow batches (the fixed cosine weights over all dimensions)."""
    from ..operators.models import LinearScorer, score_table
    emb = read_table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("target"), "embedding")
    s = score_table(emb, "embedding", ["vec_id"], LinearScorer.cosine(VECTOR_DIM, N_LOGITS), target="target")
    return s.select("vec_id", "target", "pred", F.round("loss", 6).alias("loss"))


@register("score_encoded")
def q_score_encoded(spark: SparkSession, sf: str) -> DataFrame:
    """M1 over E2: every document's ids and mask through a plug-in scorer, in micro-batches of near-equal length."""
    from ..operators.models import ModularScorer, score_encoded
    toks = written_tokens(spark, sf)
    enc = E.encode(toks, "doc_id", "tokens", E.build_vocab(toks, "tokens"), MAX_LEN, pad=False)
    lab = read_table(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("target"))
    s = score_encoded(enc, ["doc_id", "n_tokens"], ModularScorer(3), target="target", labels=lab, on="doc_id")
    return s.select("doc_id", "n_tokens", "target", "pred", F.round("loss", 6).alias("loss"))


@register("run_resume")
def q_run_resume(spark: SparkSession, sf: str) -> DataFrame:
    """M6 M7: the runs of the documents stopped after two epochs, saved with the optimiser's state, loaded and resumed,
    against the same runs without a stop: differences of every epoch's losses, and of the last weights."""
    import numpy as np
    from ..operators.training import fit_many, load_checkpoint, save_checkpoint
    from ..session import scratch_path
    names, heads = grid_heads("documents")
    examples = run_examples(spark, sf, "documents")
    back, rows = [], []
    for head, run in zip(heads, fit_many(examples, heads, until=2)):
        path = scratch_path(spark, "run-stopped")
        save_checkpoint(spark, run, head.settings, path)
        back.append(load_checkpoint(spark, path)[0])
    for name, a, b in zip(names, fit_many(examples, heads), fit_many(examples, heads, back)):
        same = np.array_equal(a.next.weights, b.next.weights) and np.array_equal(a.next.second, b.next.second)
        rows += [(name, x["epoch"], x["n_train"], y["n_valid"], x["train_loss"] - y["train_loss"], x["valid_loss"] - y["valid_loss"],
                  same) for x, y in zip(a.history, b.history)]
    return spark.createDataFrame(rows, "model string, epoch int, n_train long, n_valid long, train_difference double, "
                                       "valid_difference double, same_weights boolean")


@register("run_batch_metrics")
def q_run_batch_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """A run over mini-batches in seeded random order, one row per epoch and batch. What SQL can state: which rows
    are in which batch, how often each batch is seen, and that the A5 mean of the train batches' losses falls."""
    from ..operators.minibatch import deal_batches, epoch_means, fit_batches
    from ..operators.training import Head, Settings
    vectors = read_table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("features"))
    examples = vectors.join(run_keys(spark, sf, "embeddings", "floor"), "vec_id")
    head = Head("label10", 10, VECTOR_DIM, Settings(BATCH_EPOCHS, 0.01))
    batches = deal_batches(examples, "vec_id", head, BATCH_SIZE, VALID_SEED)
    run = fit_batches(batches, head, seed=VALID_SEED)
    means = epoch_means(run.metrics).where("phase = 'train'")
    learned = means.agg((F.max_by("mean_batch_loss", "epoch") < F.min_by("mean_batch_loss", "epoch")).alias("learned"))  # one row
    keys = batches.select("phase", "batch_id", F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + r["k"]).alias("key_sum"))
    seen = run.metrics.where("phase <> 'test'").join(keys, ["phase", "batch_id"]).join(F.broadcast(learned))
    return seen.select("epoch", "phase", "batch_id", "n_rows", "key_sum", F.col("accuracy").between(0, 1).alias("rate_in_range"), "learned")


def _checked_report(rep: DataFrame, trained: DataFrame) -> DataFrame:
    """What SQL can state of a fitted model's report: supports, that all figures are rates and agree, and that the model
    learned: on its ``trained`` rows (target, pred) the mean recall of the classes is above that of any constant guess."""
    accuracy = rep.where(F.col("class") == "accuracy").select(F.col("precision").alias("acc"))
    rates = F.least("precision", "recall", "f1_score") >= 0
    rates &= F.greatest("precision", "recall", "f1_score") <= 1
    # support-weighted recall is the accuracy
    agree = (F.col("class") != "weighted avg") | (F.abs(F.col("recall") - F.col("acc")) < 1e-9)
    recalls = trained.groupBy("target").agg(F.avg((F.col("pred") == F.col("target")).cast("int")).alias("recall"))
    learned = recalls.agg((F.avg("recall") > 1 / F.count(F.lit(1))).alias("learned"))
    return (rep.join(F.broadcast(accuracy)).join(F.broadcast(learned)).where((F.col("class") != "accuracy") & (F.col("support") > 0))
            .select("class", F.round("support", 6).alias("support"), rates.alias("rates_in_range"), agree.alias("agrees"), "learned"))


@register("train_frozen")
def q_train_frozen(spark: SparkSession, sf: str) -> DataFrame:
    """M2 + A7/A8: classifier on stored vectors (train split), report on the test split."""
    from ..operators.models import train_frozen
    emb = read_table(spark, sf, "embeddings")
    sp = materialize(D.train_test_split(emb, "vec_id", TEST_SHARE, TEST_SEED), "frozen-input")
    _, scored = train_frozen(sp, "embedding", "label", "vec_id")
    judged = materialize(scored.select("split", F.col("label").cast("int").alias("target"), "pred"), "frozen-scored")
    return _checked_report(A.classification_report(A.confusion(judged.where("split = 'test'"))), judged.where("split = 'train'"))


@register("train_text")
def q_train_text(spark: SparkSession, sf: str) -> DataFrame:
    """Text pipeline on cleaned documents with class weights, saved,
    reloaded and evaluated on the test split. Narrow labelled keys are split
    first and written; the cleaned text is joined to them once."""
    from ..operators.models import load_model, save_model, text_pipeline
    from ..session import scratch_path
    lab = read_table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    keys = read_table(spark, sf, "documents").select("doc_id").join(lab, "doc_id")
    keys = materialize(D.train_test_split(keys, "doc_id", TEST_SHARE, TEST_SEED), "text-model-keys")
    # written once: the IDF fit, the LR fit and the test transform all read it
    data = materialize(doc_tokens(spark, sf).join(keys, "doc_id"), "text-model-input")
    train = data.where(F.col("split") == "train")
    train = train.join(A.class_weights(train, "label").select("label", "weight"), "label")
    model = text_pipeline().fit(train.sortWithinPartitions("doc_id"))
    path = scratch_path(spark, "text-model")
    save_model(model, path)
    judged = materialize(load_model(path).transform(data).select(
        "split", F.col("label").cast("int").alias("target"), F.col("prediction").cast("int").alias("pred")), "text-model-scored")
    return _checked_report(A.classification_report(A.confusion(judged.where("split = 'test'")), TWO_CLASS_NAMES),
                           judged.where("split = 'train'"))


# ---------------------------------------------------------------- sources and sinks (S*, K*)

def _cleaned_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with outer spaces (T2) and empty ones (T5)."""
    return book_cleaned(spark, sf).select("doc_id", "t2_keep_range", "t5_final")


@register("io_csv_roundtrip")
def q_io_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned texts written as CSV with a header and read back."""
    from ..session import scratch_path
    from ..sources import read_csv_header, write_csv
    path = scratch_path(spark, "csv")
    write_csv(_cleaned_texts(spark, sf), path)
    return read_csv_header(spark, path, "doc_id long, t2_keep_range string, t5_final string")


@register("io_indexed_roundtrip")
def q_io_indexed_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Renumbered cleaned texts written with their row index and read back by index."""
    from ..session import scratch_path
    from ..sources import read_csv_indexed, write_csv_indexed
    path = scratch_path(spark, "indexed")
    write_csv_indexed(P.renumber(materialize(_cleaned_texts(spark, sf), "cleaned-texts"), ["doc_id"]).drop("doc_id"), path)
    return read_csv_indexed(spark, path, "t2_keep_range string, t5_final string")


@register("io_lines_roundtrip")
def q_io_lines_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Texts in a header-less, tab-separated, quoted file, read back as column ``Data`` with a constant label."""
    from ..session import scratch_path
    from ..sources import read_delimited, write_csv
    path = scratch_path(spark, "lines")
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    write_csv(docs.select("text"), path, header=False, sep="\t")
    return P.add_label(read_delimited(spark, path), 1)


@register("io_positional_roundtrip")
def q_io_positional_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Fields bound by position (header names ignored), labels kept as strings, unlabelled texts kept."""
    from ..session import scratch_path
    from ..sources import read_positional_csv, write_csv
    path = scratch_path(spark, "positional")
    lab = read_table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("Sentiment"))
    docs = read_table(spark, sf, "documents").select("doc_id", F.col("text").alias("Data"))
    write_csv(P.index_aligned_join(docs, lab, "doc_id").select("Data", "Sentiment"), path)
    return read_positional_csv(spark, path)


@register("io_csv_ranges")
def q_io_csv_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """S1-S4 on large files: quoted CSV whose texts hold newlines, read by ranges with one quote bit each."""
    from ..session import scratch_path
    from ..sources import write_csv
    from ..sources.ranges import read_csv_ranges
    path = scratch_path(spark, "ranges")
    write_csv(spread(read_table(spark, sf, "documents").select("doc_id", "text", "source"), "doc_id"), path)
    return read_csv_ranges(spark, path, "doc_id long, text string, source string")


@register("io_fields")
def q_io_fields(spark: SparkSession, sf: str) -> DataFrame:
    """S4 with processing: a positional CSV read as key, encoded cleaned text and indexed label, vocabulary and
    label index learned from the file."""
    from ..session import scratch_path
    from ..sources import Field, LabelField, TextField, learn_fields, read_fields, write_csv
    path = scratch_path(spark, "fields")
    lab = read_table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("Sentiment"))
    docs = spread(read_table(spark, sf, "documents").select("doc_id", F.col("text").alias("Data")), "doc_id")
    write_csv(docs.join(lab, "doc_id", "left").select("doc_id", "Data", "Sentiment"), path)
    fields = learn_fields(spark, path, {
        "doc_id": Field(0, "long"),
        "input_ids": TextField(1, lambda c: T.drop_chars(T.clean_book(c, KEEP, FIXTURE_STOP_WORDS)),
                               lambda c: T.tokenize(c, spaces_only=True), MAX_LEN),
        "label": LabelField(2)})
    rows = read_fields(spark, path, fields)
    return rows.select("doc_id", _ids_text(F.col("input_ids")).alias("input_ids"), "label")


@register("io_stop_words")
def q_io_stop_words(spark: SparkSession, sf: str) -> DataFrame:
    """A stop list derived from the corpus by document frequency, written
    as a CRLF text file, then read back word by word."""
    from ..session import scratch_path
    from ..sources import read_stop_words
    path = scratch_path(spark, "stopwords")
    words = stop_table(spark, sf).select(F.col("word").alias("value"))
    words.write.mode("overwrite").option("lineSep", "\r\n").text(path)
    return read_stop_words(spark, path)


@register("io_corpus_partition")
def q_io_corpus_partition(spark: SparkSession, sf: str) -> DataFrame:
    """A labelled corpus stored by (dataset, variant, split), one of which is read back; the others are pruned."""
    from ..session import scratch_path
    from ..sources import read_partitioned, write_partitioned
    path = scratch_path(spark, "corpus")
    lab = read_table(spark, sf, "labels").select("doc_id", F.expr(RAW_NEWS_LABEL_SQL).cast("int").alias("raw"))
    lab = P.recode(lab.withColumn("Sentiment", F.col("raw")), NEWS_LABEL_SWAP).drop("raw")
    rows = read_table(spark, sf, "documents").select("doc_id", F.col("text").alias("Data")).join(
        test_split(spark, sf), "doc_id").join(lab, "doc_id")
    three = rows.withColumn("variant", F.lit("3class"))
    corpus = three.unionByName(P.drop_class(three, 2).withColumn("variant", F.lit("2class")))
    write_partitioned(corpus.withColumn("dataset", F.lit("documents")), path, ("dataset", "variant", "split"))
    back = read_partitioned(spark, path, dataset="documents", variant="2class", split="test")
    return back.select("doc_id", "Data", "Sentiment", "dataset", "variant", "split")


@register("results_roundtrip")
def q_results_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Run results with their constants and split shares written under (model, classes,
    dataset) partitions; one dataset read back with partition pruning."""
    from ..session import scratch_path
    from ..sources import read_partitioned, write_partitioned
    path = scratch_path(spark, "results")
    write_partitioned(run_results(spark, sf), path)
    back = read_partitioned(spark, path, dataset="documents")
    return back.select("model", "classes", "dataset", "feature_size", "weighted", "epochs", "optimizer", "learning_rate",
                       "weight_decay", "loss_function", "n_train", "n_valid", "n_test", "train_share", "valid_share", "test_share")


@register("report_roundtrip")
def q_report_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """K4: the classification report written under its run key and read back."""
    from ..session import scratch_path
    from ..sources import read_partitioned, write_partitioned
    path = scratch_path(spark, "report")
    rep = q_classification_report(spark, sf).withColumns(
        {"model": F.lit("synthetic"), "classes": F.lit(2), "dataset": F.lit("documents")})
    write_partitioned(rep, path)
    return read_partitioned(spark, path, model="synthetic").select(
        "class", "precision", "recall", "f1_score", "support")


# ---------------------------------------------------------------- streaming and SQL surface

@register("stream_clean_comment")
def q_stream_clean_comment(spark: SparkSession, sf: str) -> DataFrame:
    """T9 on a file stream (availableNow trigger): each micro-batch is spread when
    under-partitioned, cleaned by the batch cleaner and written to its own folder."""
    from ..streaming.stream import clean_comment_stream, run_available_batches, source
    s = source(spark, sf, "documents").select("doc_id", "text")
    out = run_available_batches(s, lambda b: clean_comment_stream(b, ["doc_id"], KEEP), "stream-clean", "doc_id")
    return spark.read.parquet(out).select("doc_id", "t3_no_emoji", "t4_keep_only", "t5_final", "is_empty")


@register("stream_label_counts")
def q_stream_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A1 as a streaming aggregation (complete mode, written per micro-batch)."""
    from ..session import scratch_path
    from ..streaming.stream import finish, label_counts_stream, source
    path = scratch_path(spark, "stream-counts")
    s = source(spark, sf, "labels").select(F.col("quality").alias("Sentiment"))

    def sink(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(path + "/data")

    finish(label_counts_stream(s, "Sentiment").writeStream.outputMode("complete").foreachBatch(sink)
           .option("checkpointLocation", path + "/_checkpoint").trigger(availableNow=True).start())
    return spark.read.parquet(path + "/data")


@register("sql_functions")
def q_sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    """P5 via SQL: the cleaners registered as SQL-bodied functions and called from spark.sql."""
    from ..functions.sql import register_sql_functions
    register_sql_functions(spark, KEEP, FIXTURE_STOP_WORDS, prefix="lf_")
    spread(read_table(spark, sf, "documents"), "doc_id").createOrReplaceTempView("lf_documents")
    return spark.sql("SELECT doc_id, lf_t8_clean_book(text) AS t8_book, lf_t9_clean_comment(text) AS t9_comment "
                     "FROM lf_documents")


@register("io_review_table")
def q_io_review_table(spark: SparkSession, sf: str) -> DataFrame:
    """A review sheet exported to Parquet (stored index, ``Review`` column)
    read back with the index as ``row_id`` and the text renamed to ``Data``."""
    from ..session import scratch_path
    from ..sources import read_review_table
    path = scratch_path(spark, "reviews")
    lab = read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("Sentiment"))
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    P.index_aligned_join(docs, lab, "doc_id").select(F.col("doc_id").alias("_idx"), F.col("text").alias("Review"), "Sentiment") \
        .write.mode("overwrite").parquet(path)
    return read_review_table(spark, path).select("row_id", "Data", "Sentiment")


@register("stop_words_table")
def q_stop_words_table(spark: SparkSession, sf: str) -> DataFrame:
    """U4 (table form): stop words held in a table (tokens of many documents) removed from the cleaned text."""
    stop = materialize(stop_table(spark, sf), "stop-table")
    t2 = book_cleaned(spark, sf).select("doc_id", "t2_keep_range")
    return P.remove_stop_words_table(t2, "doc_id", "t2_keep_range", stop, out="t7_no_stop", spaces_only=True)


@register("split_sizes")
def q_split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """P10: shape of each split (rows, columns) of the labelled corpus."""
    docs = read_table(spark, sf, "documents")
    return P.shape(docs.join(_valid_split(spark, sf, "floor"), "doc_id"), "split")


@register("regex_tokenize")
def q_regex_tokenize(spark: SparkSession, sf: str) -> DataFrame:
    """E1 built-in: the same tokens with ``regexp_extract_all`` (stays in the JVM)."""
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    toks = docs.select("doc_id", T.tokenize_regex("text").alias("tokens"))
    return toks.select("doc_id", F.size("tokens").cast("int").alias("n_tokens"),
                       F.array_join("tokens", " ").alias("tokens"))


@register("run_history_table")
def q_run_history_table(spark: SparkSession, sf: str) -> DataFrame:
    """Per trained run its epoch history and constants, written under (model, classes, dataset)
    partitions and read back. What SQL can state: sizes, constants, the loss of the zero weights every run
    starts with (the log of the class count), and that the best epoch's validation loss is the lowest."""
    from ..session import scratch_path
    from ..sources import read_partitioned, write_partitioned
    path = scratch_path(spark, "run-history")
    write_partitioned(run_grid(spark, sf), path)
    back = read_partitioned(spark, path)
    best = back.where(F.col("epoch") == F.col("best_epoch")).select("model", F.col("valid_loss").alias("lowest"))
    first = back.where(F.col("epoch") == 1).select("model", F.col("train_loss").alias("first_loss"))
    last = back.where(F.col("epoch") == F.col("epochs")).select("model", F.col("train_loss").alias("last_loss"))
    return back.join(best, "model").join(first, "model").join(last, "model").select(
        (F.col("last_loss") < F.col("first_loss")).alias("learned"), "model", "classes", "dataset", "epoch", F.when(F.col("epoch") == 1, F.round("train_loss", 6)).alias("start_loss"),
        (F.col("valid_loss") >= F.col("lowest")).alias("best_is_lowest"),
        F.col("train_acc").between(0, 1).alias("rates_in_range"), "n_train", "n_valid", "n_test",
        "optimizer", "learning_rate", "weight_decay", "loss_function")


STREAM_BATCHES = 4  # micro-batches that a streamed table is dealt into


def _streamed(spark: SparkSession, table: DataFrame, key: str, tables, name: str, sources: list[DataFrame]) -> str:
    """``table`` as files, streamed in ``STREAM_BATCHES`` micro-batches into ``tables``; the last micro-batch is replayed.
    The files are as many as the scans of ``sources``, which it is made of, have partitions, so that none grows with the input."""
    from ..session import scratch_path
    from ..streaming.partials import forget_last_commit, run_partials
    from ..streaming.stream import source
    folder = scratch_path(spark, name)
    each = -(-sum(t.rdd.getNumPartitions() for t in sources) // STREAM_BATCHES)  # files of a micro-batch
    table.repartition(STREAM_BATCHES * each, key).write.parquet(f"{folder}/rows.parquet")
    stream = source(spark, folder, "rows", table.schema, max_files=each)
    out = run_partials(stream, tables, f"{name}-state")
    forget_last_commit(spark, out)
    return run_partials(stream, tables, name, out)


@register("stream_confusion")
def q_stream_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """A7 on a stream: confusion counts merged over micro-batches, one of them replayed."""
    from ..streaming.partials import confusion_partials, state
    rows = read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("target"), F.expr(PRED_SQL).cast("int").alias("pred"))
    part = confusion_partials()
    return state(spark, _streamed(spark, rows, "doc_id", {"confusion": part}, "stream-confusion", [rows]), "confusion", part, rows)


@register("stream_report")
def q_stream_report(spark: SparkSession, sf: str) -> DataFrame:
    """A8 on a stream: the classification report of the merged confusion counts."""
    return _rounded_report(A.classification_report(q_stream_confusion(spark, sf), TWO_CLASS_NAMES))


@register("stream_profile")
def q_stream_profile(spark: SparkSession, sf: str) -> DataFrame:
    """P10 P11 E10 on a stream: rows, non-null values per column and the longest row of documents with their labels."""
    from ..streaming.partials import profile_partials, profile_rows, state
    scans = [read_table(spark, sf, "labels"), read_table(spark, sf, "documents")]
    rows = scans[0].join(scans[1], "doc_id", "right")
    part = profile_partials(rows.columns, F.length("text").cast("long"))
    merged = state(spark, _streamed(spark, rows, "doc_id", {"profile": part}, "stream-profile", scans), "profile", part, rows)
    longest = merged.select(F.lit("longest text").alias("column_name"), F.lit("bigint").alias("dtype"), F.col("max_len").alias("non_null"), "n_rows")
    return profile_rows(merged, rows.dtypes).unionByName(longest)
