"""Mixing sources to target weights by weighted fair queueing.

Targets share the total size by the weights; a target never exceeds
``max_repeats`` times its source's size, and what is over is shared again by
weight until no target is above (the fixed point is found directly: sources in
ascending order of cap / weight are capped while the level of the others is
above theirs).

Each source is a queue: its documents in the order of a salted hash, repeated
up to ``max_repeats`` times. A copy's virtual finish time is the size of its
queue up to and including it divided by the target, so all sources reach their
targets at time 1. All copies are range-sorted by finish time and taken until
the next one would exceed the total size. Whole documents are taken, so a
source ends within about one document of its target.

Hot sources: queues are running totals over range partitions of (source, hash,
id, row), so one source spreads over many tasks. Only narrow rows move; the
text is read once. The cut-off is one row.

Defined results: the size of a null text is 0; a document of size 0, or any
document when all sizes are 0, is taken 0 times; sources order by code point, a
null source is last and a source of its own; repeated rows and repeated or null
ids are rows of their own; an empty table gives no rows; reruns agree up to
which of several fully equal rows gets a count.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import running_total

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SOURCES_IN_ONE_TASK = 100_000
SEED = "mix-1"


def words(text: str | Column) -> Column:
    """Number of words of a text, null as 0."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def ordered_sources(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Add ``weight`` (``weights`` repeated over the sources by code point, null last) and ``start``, the
    size of the sources before, to rows of (source, source_size).

    Sources are names, few beside documents: up to SOURCES_IN_ONE_TASK of them (counted) are ordered by
    one window, more by range partitions."""
    sizes = materialize(sizes, "mix-sources").withColumn("__null", F.col("source").isNull())
    order = ["__null", "source"]
    if sizes.count() <= SOURCES_IN_ONE_TASK:
        upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = (sizes.withColumn("__rank", F.row_number().over(Window.orderBy(*order)))
                  .withColumn("__upto", F.sum("source_size").over(upto)))
    else:
        ranked = running_total(sizes.withColumn("__one", F.lit(1).cast("long")), order, "__one", "__rank", "mix-ranks")
        ranked = running_total(ranked, order, "source_size", "__upto", "mix-starts")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return ranked.select("source", "source_size", F.get(cycle, ((F.col("__rank") - 1) % len(weights)).cast("int")).alias("weight"),
                         (F.col("__upto") - F.col("source_size")).alias("start"))


def water_fill(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Add ``target`` to rows of (source, source_size, weight > 0).

    Each round caps the sources whose share is above ``max_repeats`` times
    their size and shares what they leave; one aggregate a round (three
    numbers reach the driver), until no further source is above."""
    cap = (F.col("source_size") * F.lit(max_repeats)).cast("double")
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level, n_capped = (total or 0) / (weights or 1.0), 0
    while True:
        above = cap < F.lit(level) * F.col("weight")
        n, capped, w = sources.where(above).agg(F.count("*"), F.sum(cap), F.sum("weight")).first()
        if n == n_capped:
            break
        level, n_capped = (total - capped) / (weights - w), n
    return sources.withColumn("target", F.when(above, cap).otherwise(F.lit(level) * F.col("weight")))


def mix(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every document row."""
    narrow = materialize(docs.select(
        "doc_id", "source", words("text").alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("hash")),
        "mix-sizes")
    return queue(narrow, weights, max_repeats)


def queue(narrow: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, *keep: str) -> DataFrame:
    """The mix of rows of (doc_id, source, size, hash), with the columns ``keep``."""
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = water_fill(materialize(ordered_sources(sizes, weights), "mix-weights"), max_repeats)
    rows = narrow.withColumn("__null", F.col("source").isNull())
    order = ["__null", "source", "hash", "doc_id", "size"]
    queued = running_total(rows, order, "size", "__queue", "mix-queues")
    # a document's place in its own queue: the running total less the sources before it
    starts = targets.select(F.col("source").alias("__source"), "source_size", "target", "start")
    queued = materialize(
        queued.join(starts, F.col("source").eqNullSafe(F.col("__source")))
        .select(*keep, "doc_id", "source", "size", "hash", "source_size", "target",
                (F.col("__queue") - F.col("start")).alias("__done")), "mix-queued")
    finish = (F.col("__epoch") * F.col("source_size") + F.col("__done")) / F.col("target")
    copies = (queued.where(F.col("size") > 0)
              .select("doc_id", "source", "size", "hash", "source_size", "target", "__done",
                      F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("__epoch"))
              .select(finish.alias("finish"), "hash", "doc_id", "__done", "size"))
    tie = ["finish", "hash", "doc_id", "__done", "size"]
    total = queued.agg(F.sum("size").alias("__total"))
    fits = (running_total(copies, tie, "size", "__taken", "mix-copies")
            .join(F.broadcast(total)).where(F.col("__taken") <= F.col("__total")))
    last = fits.agg(F.max(F.struct("finish", "hash", "doc_id", "__done")).alias("__last"))  # the cut-off, one row
    key = [F.struct(((F.lit(e) * F.col("source_size") + F.col("__done")) / F.col("target")).alias("finish"),
                    "hash", "doc_id", "__done") for e in range(max_repeats)]
    n = sum(((F.col("size") > 0) & (k <= F.col("__last"))).cast("int") for k in key)
    return (queued.join(F.broadcast(last))
            .withColumn("copies", F.coalesce(n, F.lit(0)))
            .select(*keep, "doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).cast("long").alias("taken")))


def resample(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """The mixed documents, all columns (of any name): every document as many times as the mix takes it.

    Rows of one id, source and text are one document here, taken as often as all of them together."""
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    narrow = materialize(docs.select(
        text.alias("__text"), "doc_id", "source", words("text").alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                          F.xxhash64("text").cast("string"))).alias("hash")), "mix-sizes")
    copies = (queue(narrow, weights, max_repeats, "__text").where("copies > 0")
              .groupBy(F.col("__text").alias("its_text"), F.col("doc_id").alias("its_id"), F.col("source").alias("its_source"))
              .agg(F.sum("copies").cast("int").alias("copies")))
    # the document's columns stand in one, so that no name of theirs meets one of this join
    rows = docs.select(F.struct(*docs.columns).alias("row"), text.alias("key"), F.col("doc_id").alias("id"), F.col("source").alias("src"))
    met = rows.join(copies, (F.col("key") == F.col("its_text")) & F.col("id").eqNullSafe(F.col("its_id"))
                    & F.col("src").eqNullSafe(F.col("its_source")))
    once = met.dropDuplicates(["key", "id", "src"])
    return once.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
