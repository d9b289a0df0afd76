"""Corpus encoding (E1-E14): vocabulary, token ids, specials, truncation,
padding, masks, label index and batch assignment.

Vocabulary lookups run in Arrow batches on the flat token buffer while the
vocabulary is within a checked size (:mod:`lexiframe.operators.lookup`): no
shuffle and no regrouping. Of a larger vocabulary the most frequent entries are looked up the same way; only what
they lack is exploded, joined by shuffle and put back, and a row moves once, as its ids. Batch numbers come
from :func:`lexiframe.operators.ranking.ordered_index`, never from a window over
one partition.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import lookup as L
from .ranking import ordered_index
from .splits import seeded_hash

LABELS_IN_ONE_TASK = 1_000_000  # labels that one window may number


@dataclass(frozen=True)
class Specials:
    pad: int = 0
    unk: int = 1
    cls: int = 2
    sep: int = 3
    names: tuple[str, str, str, str] = ("<pad>", "<unk>", "<s>", "</s>")

    @property
    def reserved(self) -> int:
        return 4


def build_vocab(df: DataFrame, tokens: str | Column, max_size: int | None = None,
                specials: Specials = Specials(), min_count: int = 1) -> DataFrame:
    """All tokens, most frequent first (ties by token), ids after the reserved ones.

    Counting is a map-side combined aggregate, so a very frequent token costs
    one partial count per partition. Ids come from range partitions
    (``ordered_index``). ``max_size`` keeps only the most frequent ones.
    """
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    # explode_outer + a filter on the output: a plain explode makes Catalyst
    # infer ``size(tokens) > 0`` and push it below the scan-side exchange,
    # which evaluates the whole cleaning chain behind ``tokens`` twice more.
    counts = (df.select(F.explode_outer(t).alias("token")).where(F.col("token").isNotNull())
              .groupBy("token").agg(F.count(F.lit(1)).alias("count")))
    if min_count > 1:
        counts = counts.where(F.col("count") >= min_count)
    if max_size is not None:
        counts = counts.orderBy(F.desc("count"), F.asc("token")).limit(max_size)
    ranked = ordered_index(counts.select((-F.col("count")).alias("_less"), "token"), ["_less", "token"], name="_idx")
    return ranked.select("token", (F.col("_idx") + specials.reserved).cast("int").alias("id"),
                         (-F.col("_less")).cast("long").alias("count"))


def encode(df: DataFrame, key: str, tokens: str | Column, vocab: DataFrame, max_len: int,
           specials: Specials = Specials(), pad: bool = True) -> DataFrame:
    """Tokens -> (input_ids, attention_mask, n_tokens) per ``key``.

    Truncation keeps ``max_len - 2`` tokens so that start and end ids fit.
    Unknown tokens map to ``specials.unk``. With ``pad`` every row is padded to
    ``max_len`` (E7); otherwise ids keep their own length (pad per batch, E8).
    NULL tokens give NULL ids.
    """
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    table = L.small_table(vocab, "token", "id")
    out = (_encode_batches(df, key, t, table, max_len, specials) if table is not None
           else _encode_large(df, key, t, vocab, max_len, specials))
    out = out.withColumn("n_tokens", F.when(F.col("input_ids").isNotNull(), F.size("input_ids")))
    return with_padding(out, max_len, specials) if pad else out


def _encode_batches(df: DataFrame, key: str, tokens: Column, table: pa.Table, max_len: int, specials: Specials) -> DataFrame:
    """Ids by a lookup of each batch's flat token buffer."""
    shared = df.sparkSession.sparkContext.broadcast(L.TokenTable(L.column(table, "token"), L.column(table, "id").to_numpy()))

    @F.arrow_udf("array<int>")
    def ids(lists: pa.Array) -> pa.Array:
        values, lengths, valid = L.flat(lists)
        at, kept = L.heads(lengths, max_len - 2)
        body = shared.value.ids_of(values.take(pa.array(at)), specials.unk)
        total = np.where(valid, kept + 2, 0)
        ends = np.cumsum(total)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        inner = np.ones(len(out), bool)
        starts, lasts = (ends - total)[valid], ends[valid] - 1
        out[starts], out[lasts] = specials.cls, specials.sep
        inner[starts] = inner[lasts] = False
        out[inner] = body
        return L.lists_of(pa.array(out), total, valid)

    return df.select(key, ids(tokens).alias("input_ids"))


def _rare_found(rare: DataFrame, vocab: DataFrame, bound: int | None, on: str, value: str) -> DataFrame:
    """_rid, _at, _found: a row's looked-up entries of ``rare`` (_rid, _pos, ``on``) beyond the hot part, in any order."""
    cold = vocab if bound is None else vocab.where(F.col("id") > bound)
    looked = rare.join(cold.select(F.col("token").alias("_token"), F.col("id").alias("_id")), on)
    found = looked.groupBy("_rid").agg(F.collect_list(F.struct("_pos", F.col(value).alias("v"))).alias("_f"))
    return found.select("_rid", F.col("_f._pos").alias("_at"), F.col("_f.v").alias("_found"))


def _encode_large(df: DataFrame, key: str, tokens: Column, vocab: DataFrame, max_len: int, specials: Specials) -> DataFrame:
    """Ids with a vocabulary too large to send to every task: its most frequent tokens by batches, the others by a join.

    Rows are told apart by a number that is written with them, not by ``key``: a repeated key must not merge rows into
    one unbounded group."""
    bound, table = L.hot_part(vocab, "token", "id")
    shared = df.sparkSession.sparkContext.broadcast(L.TokenTable(L.column(table, "token"), L.column(table, "id").to_numpy()))
    absent = np.iinfo(np.int32).min

    @F.arrow_udf("struct<ids: array<tinyint>, rare: array<string>>")
    def hot(lists: pa.Array) -> pa.Array:
        values, lengths, valid = L.flat(lists)
        ids = shared.value.ids_of(values, absent)
        open_ = ids == absent
        each = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[open_], minlength=len(lengths))
        return pa.StructArray.from_arrays([L.packed(np.where(open_, 0, ids + (ids >= 0)), lengths, valid),
                                           L.lists_of(values.filter(pa.array(open_)), each, valid)], ["ids", "rare"])

    @F.arrow_udf("array<int>")
    def filled(lists: pa.Array, at: pa.Array, found: pa.Array) -> pa.Array:
        numbers, lengths, valid = L.unpacked(lists)
        missing = numbers == 0
        ids = np.where(missing, specials.unk, numbers - ((numbers > 0) | (numbers == absent))).astype(np.int32)
        ids[L.gaps(missing, lengths, at)] = L.flat(found)[0].to_numpy(zero_copy_only=False)
        return L.lists_of(pa.array(ids), lengths, valid)

    first = df.select(key, hot(F.slice(tokens, 1, max_len - 2)).alias("_e"))
    first = materialize(first.withColumn("_rid", F.monotonically_increasing_id()), "encoded-hot")
    rare = first.select("_rid", F.posexplode("_e.rare").alias("_pos", "_token")).where(F.col("_token").isNotNull())
    found = _rare_found(rare, vocab, bound, "_token", "_id")
    rows = first.select(key, "_rid", F.col("_e.ids").alias("_ids")).join(found, "_rid", "left")
    body = rows.select(key, filled("_ids", "_at", "_found").alias("_body"))
    return body.select(key, F.concat(F.array(F.lit(specials.cls)), "_body", F.array(F.lit(specials.sep))).alias("input_ids"))


def encoded_length(tokens: str | Column, max_len: int) -> Column:
    """Length of the row :func:`encode` produces: one id per kept token (after
    E6 truncation to ``max_len - 2``) plus the start and end ids (E5). It does
    not depend on the vocabulary, so consumers that need only lengths (E8,
    E10, E11) compute it per row, with no lookup. NULL tokens have no length."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.when(t.isNotNull(), F.least(F.size(t), F.lit(max_len - 2)) + 2).cast("int")


def with_padding(df: DataFrame, length: int | Column, specials: Specials = Specials(),
                 ids: str = "input_ids", n: str = "n_tokens") -> DataFrame:
    """Pad ids to ``length`` and add the 1/0 attention mask."""
    ln = F.lit(length) if isinstance(length, int) else length
    n_pad = F.greatest(ln - F.col(n), F.lit(0))
    return df.withColumns({
        ids: F.concat(F.col(ids), F.array_repeat(F.lit(specials.pad), n_pad)),
        "attention_mask": F.concat(F.array_repeat(F.lit(1), F.col(n)), F.array_repeat(F.lit(0), n_pad)),
    })


def decode(df: DataFrame, key: str, ids: str, vocab: DataFrame, specials: Specials = Specials(),
           mask: str | None = "attention_mask", out: str = "tokens") -> DataFrame:
    """Ids -> tokens (specials by name), dropping padded positions when a mask is
    given; an id without a token is its number. NULL ids give NULL tokens."""
    table = L.small_table(vocab, "token", "id")
    if table is None:
        return _decode_large(df, key, ids, vocab, specials, mask, out)
    known = dict(zip((specials.pad, specials.unk, specials.cls, specials.sep), specials.names))
    numbers = np.concatenate([L.column(table, "id").to_numpy(), np.array(list(known), np.int32)]).astype(np.int32)
    names = pa.concat_arrays([L.column(table, "token").cast(pa.string()), pa.array(list(known.values()), pa.string())])
    shared = df.sparkSession.sparkContext.broadcast(L.IdTable(numbers, names))

    @F.arrow_udf("array<string>")
    def tokens(lists: pa.Array, masks: pa.Array) -> pa.Array:
        values, lengths, valid = L.flat(lists)
        kept = L.flat(masks)[0].to_numpy() == 1
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[kept], minlength=len(lengths))
        values = values.filter(pa.array(kept)).cast(pa.int32())
        text = shared.value.names_of(values)
        return L.lists_of(pc.coalesce(text, values.cast(pa.string())), lengths, valid)

    on = F.col(mask) if mask else F.transform(ids, lambda _: F.lit(1))
    return df.select(key, tokens(F.col(ids), on).alias(out))


def _decode_large(df: DataFrame, key: str, ids: str, vocab: DataFrame, specials: Specials, mask: str | None,
                  out: str) -> DataFrame:
    """Tokens with a vocabulary too large to send to every task: the smallest ids by batches, the others by a join. Rows
    move as ids; their texts are put together after the join."""
    bound, table = L.hot_part(vocab, "token", "id")
    known = dict(zip((specials.pad, specials.unk, specials.cls, specials.sep), specials.names))
    numbers = np.concatenate([L.column(table, "id").to_numpy(), np.array(list(known), np.int32)]).astype(np.int32)
    names = pa.concat_arrays([L.column(table, "token").cast(pa.string()), pa.array(list(known.values()), pa.string())])
    shared = df.sparkSession.sparkContext.broadcast(L.IdTable(numbers, names))
    least = np.iinfo(np.int64).min if bound is None else bound

    @F.arrow_udf("array<string>")
    def texts(lists: pa.Array, at: pa.Array, found: pa.Array) -> pa.Array:
        values, lengths, valid = L.flat(lists)
        values = values.cast(pa.int32())
        rare = pc.greater(values.cast(pa.int64()), least).fill_null(False).to_numpy(zero_copy_only=False)
        which = np.full(len(values), -1)
        which[L.gaps(rare, lengths, at)] = np.arange(len(at.flatten()))
        joined = L.flat(found)[0].take(pa.array(which, mask=which < 0))
        return L.lists_of(pc.coalesce(joined, shared.value.names_of(values), values.cast(pa.string())), lengths, valid)

    zipped = F.arrays_zip(F.col(ids).alias("i"), *([F.col(mask).alias("m")] if mask else []))
    kept = F.transform(F.filter(zipped, lambda z: z["m"] == 1) if mask else zipped, lambda z: z["i"])
    first = materialize(df.select(key, kept.alias("_ids")).withColumn("_rid", F.monotonically_increasing_id()), "decoded-ids")
    rare = first.select("_rid", F.posexplode(F.filter("_ids", lambda i: i > F.lit(int(least)))).alias("_pos", "_id"))
    found = _rare_found(rare, vocab, bound, "_id", "_token")
    return first.join(found, "_rid", "left").select(key, texts("_ids", "_at", "_found").alias(out))


def plugin_tokenize(df: DataFrame, key: str, text: str, tokenizer, out: str = "tokens") -> DataFrame:
    """E1 plug-in: tokenise with any Python tokeniser (sub-word models included) over
    Arrow batches. The tokeniser is broadcast once and called once per batch with a
    list of texts; it returns one token list per text. Rules that a regular expression
    can state stay in the JVM (``functions.text.tokenize_regex``)."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    @F.arrow_udf("array<string>")
    def tokens(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value(texts.to_pylist()), type=pa.list_(pa.string()))

    return df.select(key, tokens(F.col(text)).alias(out))


def max_length(df: DataFrame, n: str = "n_tokens") -> DataFrame:
    """Longest encoded row."""
    return df.agg(F.max(n).cast("int").alias("max_len"))


def sequential_batches(df: DataFrame, key: str, batch_size: int, split_col: str | None = "split",
                       out: str = "batch_id") -> DataFrame:
    """Batches of ``batch_size`` in key order per split; the last batch may be short."""
    parts = [split_col] if split_col else []
    r = ordered_index(df, [key], parts, "_idx")
    return r.withColumn(out, F.floor(F.col("_idx") / batch_size).cast("long")).drop("_idx")


def random_batches(df: DataFrame, key: str, batch_size: int, seed: int = 1234,
                   split_col: str | None = "split", out: str = "batch_id") -> DataFrame:
    """Batches in seeded pseudo-random order (``md5(seed:key)``, ties by key)."""
    parts = [split_col] if split_col else []
    r = ordered_index(df.withColumn("_h", seeded_hash(key, seed)), ["_h", key], parts, "_idx")
    return r.withColumn(out, F.floor(F.col("_idx") / batch_size).cast("long")).drop("_idx", "_h")


def bucket_batches(df: DataFrame, key: str, length: str, batch_size: int,
                   split_col: str | None = "split", out: str = "batch_id") -> DataFrame:
    """E11 + E8: batches of near-equal length (order ``(length, key)``) and each
    batch's padded length (its longest row).

    The range partitions are cut on the whole ``(length, key)`` tuple, so even
    if every row has the same (truncated) length the work stays spread.
    """
    parts = [split_col] if split_col else []
    r = ordered_index(df, [length, key], parts, "_idx")
    r = r.withColumn(out, F.floor(F.col("_idx") / batch_size).cast("long")).drop("_idx")
    w = Window.partitionBy(*parts, out)
    return r.withColumn("pad_to", F.max(length).over(w).cast("int"))


def padding_waste(batches: DataFrame, length: str = "n_tokens", pad_to: str = "pad_to",
                  split_col: str | None = "split") -> DataFrame:
    """Share of padded cells after E8 (pads / all cells) per split."""
    g = batches.groupBy(split_col) if split_col else batches.groupBy()
    return g.agg(F.sum(F.col(pad_to) - F.col(length)).cast("long").alias("pad_cells"),
                 F.sum(pad_to).cast("long").alias("cells")).withColumn(
        "waste", F.round(F.col("pad_cells") / F.col("cells"), 6))


def label_index(df: DataFrame, label: str, out: str = "idx") -> DataFrame:
    """Label -> index by descending frequency, ties by label ascending
    (``StringIndexer(stringOrderType="frequencyDesc")``). Labels beyond
    ``LABELS_IN_ONE_TASK`` (counted) are numbered by range partitions."""
    c = materialize(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")), "label-counts")
    if c.count() > LABELS_IN_ONE_TASK:
        less = c.withColumn("_less", -F.col("n"))
        return ordered_index(less, ["_less", label], name=out).drop("_less").withColumn(out, F.col(out).cast("int"))
    w = Window.orderBy(F.desc("n"), F.asc(label))
    return c.withColumn(out, (F.row_number().over(w) - 1).cast("int"))


def apply_label_index(df: DataFrame, index: DataFrame, label: str, out: str = "idx") -> DataFrame:
    """Attach the label index to rows (unseen labels get ``n_labels``, like ``handleInvalid='keep'``)."""
    n_labels = index.count()
    return df.join(index.select(label, out), on=label, how="left").withColumn(
        out, F.coalesce(F.col(out), F.lit(int(n_labels))).cast("int"))
