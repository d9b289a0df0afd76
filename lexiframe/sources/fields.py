"""S4 with processing: a table bound by position whose fields state how they are read.

A field names its position in the file and what becomes of it: a text field its cleaner, tokeniser, vocabulary and
start/end/pad ids, a label field its index, any other field its type. :func:`read_fields` compiles all of them into one
projection over the scan; no Python runs and nothing is shuffled while the tables are within ``INLINE_ENTRIES`` and
``INLINE_BYTES`` (both measured first). Such a table is one constant of the plan, an array of small maps by the token's hash. A larger vocabulary is joined by shuffle (:mod:`lexiframe.operators.encode`), a
larger label index by a join whose kind Spark picks.

NULL texts give NULL ids and NULL labels a NULL index; a label outside the index gets the number of known labels. Equal rows
stay as many as they are. An empty file gives no rows.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import encode as E
from .readers import read_positional_csv

INLINE_ENTRIES = 200_000
INLINE_BYTES = 4 << 20
PER_BUCKET = 4  # entries that a look-up compares, on average


@dataclass(frozen=True)
class Field:
    """A field kept as it is, cast to ``dtype``."""
    position: int
    dtype: str = "string"


@dataclass(frozen=True)
class TextField:
    """A text field: cleaned, tokenised and, when it has a vocabulary (token, id), encoded with start and end ids,
    at most ``max_len`` ids a row; ``pad`` fills every row to ``max_len``. Without a vocabulary it gives its tokens."""
    position: int
    cleaner: Callable[[Column], Column] | None = None
    tokenizer: Callable[[Column], Column] = T.tokenize
    max_len: int = 512
    pad: bool = False
    specials: E.Specials = E.Specials()
    vocab: DataFrame | None = None

    def tokens(self, raw: Column) -> Column:
        return self.tokenizer(self.cleaner(raw) if self.cleaner else raw)


@dataclass(frozen=True)
class LabelField:
    """A label field: its number in ``index`` (label, idx), by falling frequency when learned."""
    position: int
    index: DataFrame | None = None


AnyField = Field | TextField | LabelField


def _raw(spark: SparkSession, path: str, fields: Mapping[str, AnyField], empty_is_null: bool) -> DataFrame:
    """The wanted positions of the file as strings, column ``f<position>``; the scan reads no other field."""
    wanted = sorted({f.position for f in fields.values()})
    if not fields or wanted[0] < 0:
        raise ValueError("fields need positions from 0")
    names = tuple(f"f{i}" for i in range(wanted[-1] + 1))
    return read_positional_csv(spark, path, names, empty_is_null).select(*[f"f{i}" for i in wanted])


def learn_fields(spark: SparkSession, path: str, fields: Mapping[str, AnyField], empty_is_null: bool = False) -> dict[str, AnyField]:
    """The same fields with the vocabularies and label indexes that they lack, learned from the file at ``path``
    (a training file); :func:`read_fields` then applies them to that file and to others."""
    raw = _raw(spark, path, fields, empty_is_null)
    out = dict(fields)
    for name, f in fields.items():
        col = F.col(f"f{f.position}")
        if isinstance(f, TextField) and f.vocab is None:
            out[name] = replace(f, vocab=E.build_vocab(raw, f.tokens(col), specials=f.specials).select("token", "id"))
        elif isinstance(f, LabelField) and f.index is None:
            labels = raw.select(col.alias("label")).where(col.isNotNull())
            out[name] = replace(f, index=E.label_index(labels, "label").select("label", "idx"))
    return out


def inline_table(table: DataFrame, key: str, value: str) -> Callable[[Column], Column] | None:
    """A look-up key -> value (NULL if absent) that needs no join, or None if the table is beyond the limits."""
    n, size = table.agg(F.count(F.lit(1)), F.sum(F.octet_length(key))).first()
    if n > INLINE_ENTRIES or (size or 0) > INLINE_BYTES:
        return None
    buckets = n // PER_BUCKET + 1
    place = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    entries = table.where(F.col(key).isNotNull()).select(place.alias("b"), F.struct(F.col(key).alias("k"), F.col(value).alias("v")).alias("e"))
    filled = table.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(
        entries.groupBy("b").agg(F.collect_list("e").alias("es")), "b", "left")
    none = F.array().cast(f"array<struct<k:{table.schema[key].dataType.simpleString()},v:{table.schema[value].dataType.simpleString()}>>")
    maps = F.transform(F.array_sort(F.collect_list(F.struct("b", F.coalesce("es", none).alias("es")))),
                       lambda x: F.map_from_entries(x["es"]))
    # a subquery cannot stand inside a lambda; parsing a literal is folded once, when the plan is optimised
    kinds = ", ".join(table.schema[c].dataType.simpleString() for c in (key, value))
    maps = F.from_json(F.lit(filled.agg(F.to_json(maps)).first()[0]), f"array<map<{kinds}>>")
    return lambda t: F.try_element_at(F.get(maps, F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int")), t)


def _encoded(f: TextField, tokens: Column, id_of: Callable[[Column], Column]) -> Column:
    s = f.specials
    body = F.transform(F.slice(tokens, 1, f.max_len - 2), lambda t: F.coalesce(id_of(t), F.lit(s.unk)))
    ids = F.concat(F.array(F.lit(s.cls)), body, F.array(F.lit(s.sep)))
    return F.when(tokens.isNotNull(), ids)


def read_fields(spark: SparkSession, path: str, fields: Mapping[str, AnyField], empty_is_null: bool = False) -> DataFrame:
    """One column per field, in the order of ``fields``, from the CSV at ``path`` (header skipped, its names ignored)."""
    raw = _raw(spark, path, fields, empty_is_null)
    columns: dict[str, Column] = {}
    shuffled: list[tuple[str, TextField]] = []
    joined: list[tuple[str, LabelField]] = []
    for name, f in fields.items():
        col = F.col(f"f{f.position}")
        if isinstance(f, TextField):
            look = inline_table(f.vocab, "token", "id") if f.vocab is not None else None
            if look is not None:
                columns[name] = _encoded(f, f.tokens(col), look)
            else:
                columns[name] = f.tokens(col)
                if f.vocab is not None:
                    shuffled.append((name, f))
        elif isinstance(f, LabelField) and f.index is not None:
            look = inline_table(f.index, "label", "idx")
            if look is not None:
                rest = F.lit(f.index.count()).cast("int")
                columns[name] = F.when(col.isNotNull(), F.coalesce(look(col), rest))
            else:
                columns[name] = col
                joined.append((name, f))
        else:
            columns[name] = col.cast(f.dtype) if isinstance(f, Field) else col
    out = raw.select(*[c.alias(n) for n, c in columns.items()])
    for name, f in joined:
        index = f.index.select(F.col("label").alias(name), F.col("idx").alias("_idx"))
        rest = F.lit(f.index.count()).cast("int")
        out = out.join(index, name, "left").withColumn(name, F.when(F.col(name).isNotNull(), F.coalesce("_idx", rest))).drop("_idx")
    for name, f in shuffled:
        others = F.struct(*[F.col(n) for n in columns if n != name], F.lit(0).alias("_"))
        rows = out.select(others.alias("_row"), F.col(name).alias("_tokens"))
        ids = E.encode(rows, "_row", F.col("_tokens"), f.vocab, f.max_len, f.specials, pad=False)
        out = ids.select("_row.*", F.col("input_ids").alias(name)).drop("_")
    padded = {n: F.concat(n, F.array_repeat(F.lit(f.specials.pad), F.greatest(f.max_len - F.size(n), F.lit(0))))
              for n, f in fields.items() if isinstance(f, TextField) and f.vocab is not None and f.pad}
    return out.select(*[padded.get(n, F.col(n)).alias(n) for n in columns])
