"""Language-model scoring with a probabilistic suffix tree over words.

The tree's states are contexts of up to ``depth`` words. The root is the unigram model with 0.1 added to every count.
Below it, a context s of at least ``min_context`` occurrences holds the symbols that followed it at least ``min_next``
times, and what it saves over the longest kept suffix s' of it decides whether it stays: with d the discount,

    lambda(s) = 1 - sum(n(s x) - d) / n(s)                    the mass that s leaves to s'
    P(x | s)  = (n(s x) - d) / n(s) + lambda(s) P(x | s')     x held by s;  lambda(s) P(x | s') for any other x
    gain(s)   = sum n(s x) log2 P(x | s) / P(x | s') + (n(s) - sum n(s x)) log2 lambda(s)

(n(s) times the divergence of the two next-symbol distributions, in bits) must reach ``gain`` bits for each number the
state stores. Every distribution sums to one over all symbols, the unseen ones included. A token is scored by the
longest kept state that is a suffix of what precedes it in its text; since P(x | s) = P(x | s') times a factor of the
state and perhaps one of the pair, a text's log probability is a sum of looked-up numbers: its words', its states' and
its pairs'.

Symbols and sequences are 64-bit hashes: two of V symbols meet with probability V^2 / 2^65. All counts cover all
training texts. Per level one scan counts the sequences whose context is frequent enough, each as the pair (sequence without its
last symbol, sequence without its first): a task sorts and adds up what it holds and sends it on as sorted, delta-coded
packs, one a bucket. A bucket holds whole contexts, but the sequences of a context that alone fills an eighth of a bucket
(at most eight per bucket are) are dealt one by one, so buckets are bounded. Scans are narrowed by a bitmap
of a fixed size (8 MB), which misses nothing; joins then are exact.

The model grows with the corpus. While its keys are within ``BROADCAST_KEYS`` (measured first) scoring texts look them up
in their own tasks; beyond it the ``TOP_KEYS`` most frequent are looked up there and the others asked for: a task sends the
keys that a bitmap holds possible, a pair only behind a state, as sorted packs with the numbers of their texts, the bucket
of a key answers with one sum a text, and no text moves. Both give the same sums. Shuffle files go as soon as the table
made from them is written.

Defined results: a null or empty text is its end token alone; a null ``doc_id`` is held out; repeated rows count and
score once per row; without training texts every token has probability 1 of the root (0.1 / 0.1); a text is held whole
in one task (about 60 bytes a word beside the text). Other columns are not read.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import range_partitions
from ..session import materialize
from .common import byte_slices, mix64, utf8
from .shingles import word_hashes

DEPTH, MIN_CONTEXT, MIN_NEXT, DISCOUNT, GAIN = 2, 32, 4, 0.75, 4.0
BROADCAST_KEYS = 1 << 24  # 12 bytes a key in every worker
TOP_KEYS = 1 << 22  # of a larger model, the same
BITS = 26  # of a bitmap
PAIR_BITS = 28  # of the bitmap of a larger model's pairs
STEP = 1 << 20  # text bytes of a numpy step
ROWS = 1024  # of an Arrow batch
HELD = 1_000_000  # sequences a task adds up at a time
ASKED = 1 << 18  # keys a task asks for at a time
BUCKET_KEYS = 4_000_000
CHUNK_ROWS = 1 << 16
WORD, PAIR, STATE = 0, 1, 2  # kinds of looked-up numbers
TEXTS = 3  # kind of the records that hold a chunk's texts' own sums
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
END = np.uint64(0x51AFE11E57E2D0E5)
_CHAIN = np.uint64(0xD1342543DE82EF95)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learned from: crc32(doc_id as text) mod 10 is 0 (a null id counts as held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(True))


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts end to end, offsets): hashes of the words, A-Z lower-cased, and END after each text."""
    raw, off = utf8(column)
    h, at = word_hashes(_LOWER[raw], off)
    out = np.full(len(h) + len(off) - 1, END, np.uint64)
    n = np.diff(at)
    out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
    return out, at + np.arange(len(at))


def _longer(context: np.ndarray, lower: np.ndarray, level: int) -> np.ndarray:
    """Hash of the sequences of ``level`` + 1 symbols, from those without their last and without their first symbol."""
    return mix64(context * _CHAIN + lower + np.uint64(level))


def chains(w: np.ndarray, off: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per level 0..depth: positions with that many symbols before them in their text; and for each the hash of those
    and its own symbol, of those alone (the context), and of the sequence without its first symbol."""
    place = np.arange(len(w)) - np.repeat(off[:-1], np.diff(off))
    none = np.zeros(len(w), np.uint64)
    out = [(np.arange(len(w)), w, none, w)]
    whole = w
    for k in range(1, depth + 1):
        at = np.flatnonzero(place >= k)
        context, lower = whole[at - 1], whole[at]
        whole = none.copy()
        whole[at] = _longer(context, lower, k)
        out.append((at, whole[at], context, lower))
    return out


def _written(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` in Arrow batches of few rows; the shuffle files behind the table, which nothing reads again, go at once."""
    conf, own = df.sparkSession.conf, {CLEANED: "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(ROWS)}
    before = {key: conf.get(key, None) for key in own}
    try:
        for key, value in own.items():
            conf.set(key, value)
        return materialize(df, name)
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def _drop(*tables: DataFrame) -> None:
    """Delete tables that ``_written`` made, once what is made of them is written."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Bitmap:
    """Which hashes may be among some: 2^``size`` bits whatever their number."""

    def __init__(self, keys: DataFrame, size: int = BITS):
        bit = F.col("key").bitwiseAND(F.lit((1 << size) - 1))
        words = _written(keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at"))
                         .agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")), "tree-bits")
        self.size, self.bits = size, np.zeros(1 << (size - 6), np.uint64)
        for low in range(0, len(self.bits), 1 << 20):  # rows fetched at most
            some = words.where((F.col("at") >= low) & (F.col("at") < low + (1 << 20))).toArrow()
            self.bits[some.column("at").to_numpy()] = some.column("bits").to_numpy().view(np.uint64)
        _drop(words)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        low = keys & np.uint64((1 << self.size) - 1)
        return (self.bits[low >> np.uint64(6)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)


def _planes(values: np.ndarray) -> bytes:
    """64-bit values by byte planes: the high, mostly equal bytes stand together."""
    return zlib.compress(np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _values(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64)


def pack(context: np.ndarray, lower: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Sequences by rising context, as differences of the contexts, suffixes and counts."""
    return [_planes(np.diff(context, prepend=np.uint64(0))), _planes(lower), _planes(counts)]


def unpack(context: bytes, lower: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.cumsum(_values(context), dtype=np.uint64), _values(lower), _values(counts).astype(np.int64)


def count_sequences(texts: DataFrame, level: int, least: int, buckets: int, contexts: Bitmap | None = None,
                    hot: np.ndarray | None = None) -> DataFrame:
    """key, context, lower, n: sequences of ``level`` + 1 symbols in ``texts`` (text) that occur at least ``least`` times
    and whose first ``level`` symbols may be in ``contexts``; ``hot`` ones of these are spread over the buckets."""
    bits = max(1, (buckets - 1).bit_length())
    shared = texts.sparkSession.sparkContext.broadcast(contexts)

    def packs(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key = np.concatenate([h[0] for h in held])
        _, at, counts = np.unique(key, return_index=True, return_counts=True)
        lower = key[at]
        deal, context = lower, np.zeros(len(at), np.uint64)
        if level:
            del key
            context, lower = (np.concatenate([h[i] for h in held])[at] for i in (1, 2))
            deal = np.where(np.isin(context, hot), deal, mix64(context))
        of = (deal >> np.uint64(64 - bits)).astype(np.int32)
        order = np.lexsort((context, of))
        of, context, lower, counts = of[order], context[order], lower[order], counts[order]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        packed = [pack(context[a:b], lower[a:b], counts[a:b]) for a, b in zip(first, np.r_[first[1:], len(of)])]
        return pa.RecordBatch.from_arrays([pa.array(of[first]), *[pa.array(c, pa.binary()) for c in zip(*packed)]],
                                          names=["bucket", "context", "lower", "counts"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for part in byte_slices(b.column(0), STEP):
                found = chains(*symbols(part), level)[level][1:] if level else symbols(part)[:1]
                if shared.value is not None:
                    on = shared.value(found[1])
                    found = tuple(f[on] for f in found)
                if len(found[0]):
                    held.append(found)
                    size += len(found[0])
                if size >= HELD:
                    yield packs(held)
                    held, size = [], 0
        if size:
            yield packs(held)

    def merge(table: pa.Table) -> pa.Table:
        rows = zip(*(table.column(c).to_pylist() for c in ("context", "lower", "counts")))
        context, lower, counts = (np.concatenate(c) for c in zip(*(unpack(*r) for r in rows)))
        key = lower if level == 0 else _longer(context, lower, level)
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        n = np.add.reduceat(counts[order], first)
        at, n = order[first][n >= least], n[n >= least]
        return pa.table([*(pa.array(c[at].view(np.int64)) for c in (key, context, lower)), pa.array(n)],
                        names=["key", "context", "lower", "n"])

    return (texts.select("text").mapInArrow(scan, "bucket int, context binary, lower binary, counts binary")
            .groupBy("bucket").applyInArrow(merge, "key long, context long, lower long, n long"))


@dataclass(frozen=True)
class SuffixTree:
    """words: key, n (all training symbols); values: kind (PAIR or STATE), key, value (what it adds to log10 P), n."""
    words: DataFrame
    values: DataFrame
    depth: int
    n: int
    distinct: int

    def root(self, n: np.ndarray) -> np.ndarray:
        """log10 of the root's probability of symbols that occurred ``n`` times."""
        return np.log10((n + 0.1) / (self.n + 0.1 * (self.distinct + 1)))


def fit(texts: DataFrame, depth: int = DEPTH, min_context: int = MIN_CONTEXT, min_next: int = MIN_NEXT,
        discount: float = DISCOUNT, gain: float = GAIN) -> SuffixTree:
    """The tree of the training ``texts`` (text). ``min_next`` is at most ``min_context``."""
    tasks = max(range_partitions(texts), texts.rdd.getNumPartitions())
    words = _written(count_sequences(texts, 0, 1, 4 * tasks).select("key", "n"), "tree-words")
    n, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(tasks, -(-n // BUCKET_KEYS))
    counted, above = {}, words
    for k in range(1, depth + 1):
        contexts = Bitmap(above.where(F.col("n") >= min_context))
        # at most eight a bucket: their counts add up to n or less
        hot = above.where(F.col("n") * 8 * buckets > n).select("key").toArrow().column("key").to_numpy().view(np.uint64)
        counted[k] = above = _written(count_sequences(texts, k, min_next, buckets, contexts, hot), f"tree-counts-{k}")

    # the sequences of the level above: as contexts (n) and as suffixes (p, the probability under the longest kept state)
    upper = words.select("key", "n", ((F.col("n") + 0.1) / (n + 0.1 * (distinct + 1))).alias("p"))
    values, tables = [], []
    for k in range(1, depth + 1):
        level, upper, made = _level(counted[k], upper, min_context, min_next, discount, gain, k)
        values.append(level)
        tables += made
    whole = _written(reduce(DataFrame.unionAll, values), "tree-values")
    _drop(*tables)
    return SuffixTree(words, whole, depth, n, distinct)


def _level(pairs: DataFrame, upper: DataFrame, min_context: int, min_next: int, discount: float, gain: float,
           k: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(values of the states and pairs that level k keeps; key, n, p of its pairs; the tables behind these).
    ``pairs`` is deleted."""
    contexts = upper.where(F.col("n") >= min_context).select(F.col("key").alias("context"), F.col("n").alias("total"))
    # a sequence is at most as frequent as the one without its first symbol
    suffixes = upper.where(F.col("n") >= min_next).select(F.col("key").alias("lower"), F.col("p").alias("above"))
    left = (pairs.groupBy("context").agg(F.sum(F.col("n") - discount).alias("explicit")).join(contexts, "context")
            .select("context", "total", (1 - F.col("explicit") / F.col("total")).alias("left")))
    own = (F.col("n") - discount) / F.col("total") + F.col("left") * F.col("above")
    held = _written(pairs.join(left, "context").join(suffixes, "lower").select(
        "key", "context", "n", "total", "left", "above", own.alias("own")), f"tree-held-{k}")
    _drop(pairs)
    saved = (F.sum(F.col("n") * F.log2(F.col("own") / F.col("above")))
             + (F.first("total") - F.sum("n")) * F.log2(F.first("left")))
    states = _written(held.groupBy("context").agg(saved.alias("saved"), F.count(F.lit(1)).alias("stored"), F.first("left").alias("left"), F.first("total").alias("total"))
                         .where(F.col("saved") >= gain * (F.col("stored") + 1)).select("context", "left", "total"), f"tree-states-{k}")
    marks = states.select("context", F.lit(True).alias("kept"))
    judged = held.select("key", "context", "n", "left", "above", "own").join(marks, "context", "left").select(
        "key", "n", F.when(F.col("kept"), F.col("own")).otherwise(F.col("above")).alias("p"),
        F.when(F.col("kept"), F.log10(F.col("own") / F.col("above") / F.col("left"))).cast("float").alias("value"))
    judged = _written(judged, f"tree-judged-{k}")
    _drop(held)
    values = (judged.where(F.col("value").isNotNull()).select(F.lit(PAIR).alias("kind"), "key", "value", "n")
              .unionAll(states.select(F.lit(STATE).alias("kind"), F.col("context").alias("key"),
                                      F.log10("left").cast("float").alias("value"), F.col("total").alias("n"))))
    return values, judged.select("key", "n", "p"), [states, judged]


def _collected(df: DataFrame, value: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``size`` rows of ``df`` (key, ``value``) as arrays by rising key, fetched by key ranges of about a million rows
    so that the driver holds little beside them."""
    keys, values, at = np.empty(size, np.int64), None, 0
    step = -(-(1 << 64) // max(1, size >> 20))
    for low in range(-1 << 63, 1 << 63, step):
        table = df.where((F.col("key") >= low) & (F.col("key") <= min(low + step, 1 << 63) - 1)).select("key", value).toArrow()
        found = table.column("key").to_numpy()
        order = np.argsort(found, kind="stable")
        numbers = table.column(value).to_numpy()
        values = np.empty(size, numbers.dtype) if values is None else values
        keys[at:at + len(found)], values[at:at + len(found)] = found[order], numbers[order]
        at += len(found)
    return keys, values


def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the values of ``keys``, 0 where absent; which are there)."""
    known, values = table
    if not len(known) or not len(keys):
        return np.zeros(len(keys), values.dtype), np.zeros(len(keys), bool)
    some, back = np.unique(keys.view(np.int64), return_inverse=True)
    at = np.minimum(np.searchsorted(known, some), len(known) - 1)
    found = known[at] == some
    return np.where(found, values[at], 0)[back], found[back]


def _look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    return _find(table, keys)[0]


def _per_text(off: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.bincount(np.searchsorted(off, at, side="right") - 1, weights=values, minlength=len(off) - 1)


SCORES = ("n_tokens", "n_known", "base_score", "score")


def _kept(keep: tuple[str, ...]) -> tuple[Column, list[str]]:
    """The kept columns as one, so that no name of theirs meets one of this module's; and how to unfold it."""
    return (F.struct(*keep).alias("kept"), ["kept.*"]) if keep else (F.lit(0).alias("kept"), [])


def score(docs: DataFrame, tree: SuffixTree, keep: tuple[str, ...] = (), limit: int = BROADCAST_KEYS) -> DataFrame:
    """``keep`` columns of ``docs`` (text), n_tokens, n_known, base_score (the root's) and score: log10 probabilities."""
    values = tree.values
    sizes = {r["kind"]: r["count"] for r in values.groupBy("kind").count().collect()}  # two rows
    if tree.distinct + sum(sizes.values()) <= limit:
        return _score_in_place(docs, tree, values, sizes, keep)
    return _score_by_asking(docs, tree, values, keep, min(limit, TOP_KEYS))


def _tables(words: DataFrame, values: DataFrame, n: int, sizes: dict[int, int]) -> list:
    """Broadcast tables of the counts of ``words`` (key, n; ``n`` or less each) and of the values of the pairs and states."""
    context = words.sparkSession.sparkContext
    counts = words.withColumn("n", F.col("n").cast("int")) if n < 1 << 31 else words
    return [context.broadcast(_collected(counts, "n", sizes.get(WORD, 0))),
            *(context.broadcast(_collected(values.where(F.col("kind") == kind), "value", sizes.get(kind, 0)))
              for kind in (PAIR, STATE))]


def _score_in_place(docs: DataFrame, tree: SuffixTree, values: DataFrame, sizes: dict[int, int], keep: tuple[str, ...]) -> DataFrame:
    words, pairs, states = _tables(tree.words, values, tree.n, sizes | {WORD: tree.distinct})
    depth, root = tree.depth, SuffixTree(None, None, tree.depth, tree.n, tree.distinct).root  # the frames stay on the driver

    def texts(column: pa.Array) -> Iterator[list[np.ndarray]]:
        for part in byte_slices(column, STEP):
            w, off = symbols(part)
            n = _look_up(words.value, w)
            every = np.arange(len(w))
            base = _per_text(off, every, root(n))
            total = base.copy()
            for at, keys, contexts, _ in chains(w, off, depth)[1:]:
                total += _per_text(off, at, _look_up(pairs.value, keys).astype(np.float64) + _look_up(states.value, contexts))
            yield [np.diff(off), _per_text(off, every, n > 0).astype(np.int64), base, total]

    @F.arrow_udf("struct<n_tokens:bigint,n_known:bigint,base_score:double,score:double>")
    def scores(text: pa.Array) -> pa.Array:
        parts = list(texts(text)) or [[np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2]
        return pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)],
                                          names=list(SCORES))

    kept, unfold = _kept(keep)
    return docs.select(kept, scores(F.col("text")).alias("scores")).select(*unfold, "scores.*")


def _rank() -> Column:
    """Of a key's frequency: some thousand ranks at most."""
    return F.floor(F.log2("n") * 16)


def _cut(known: DataFrame, most: int) -> int:
    """The least rank so that at most ``most`` keys have it or a higher one."""
    ranks = known.groupBy(_rank().alias("rank")).count().orderBy(F.desc("rank")).toArrow()
    fit = np.flatnonzero(np.cumsum(ranks.column("count").to_numpy()) <= most)
    return int(ranks.column("rank")[fit[-1]].as_py()) if len(fit) else 64 * 16


def _by_bucket(keys: np.ndarray, more: np.ndarray, bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, keys, what belongs to them) of every bucket: the keys mixed and rising, packed."""
    mixed = mix64(keys)
    order = np.argsort(mixed, kind="stable")
    mixed, more = mixed[order], more[order]
    of = (mixed >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    for a, b in zip(first, np.r_[first[1:], len(of)]):
        yield int(of[a]), _planes(np.diff(mixed[a:b], prepend=np.uint64(0))), _planes(more[a:b])


def _score_by_asking(docs: DataFrame, tree: SuffixTree, values: DataFrame, keep: tuple[str, ...], most: int) -> DataFrame:
    """The same sums: the ``most`` frequent keys looked up in place, the others asked for and answered per text."""
    spark, depth = docs.sparkSession, tree.depth
    known = (tree.words.select(F.lit(WORD).alias("kind"), "key", F.col("n").cast("double").alias("value"), "n")
             .unionAll(values.select("kind", "key", F.col("value").cast("double"), "n")))
    cut = _cut(known.select("n"), most)
    top, rare = _rank() >= cut, _rank() < cut
    sizes = {r["kind"]: r["count"] for r in known.where(top).groupBy("kind").count().collect()}  # three rows
    words, pairs, states = _tables(tree.words.where(top), values.where(top), tree.n, sizes)
    may_be = spark.sparkContext.broadcast({
        kind: Bitmap(values.where(rare & (F.col("kind") == kind)).select("key"), size) for kind, size in ((PAIR, PAIR_BITS), (STATE, BITS))})
    root = SuffixTree(None, None, depth, tree.n, tree.distinct).root
    bits = max(1, (-(-tree.n // (2 * BUCKET_KEYS)) - 1).bit_length())
    names = ["bucket", "chunk", "kind", "keys", "more"]

    def records(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                                          names=names)

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            kind, key, value = (table.column(c).to_numpy() for c in ("kind", "key", "value"))
            return records([(bucket, -1, k, keys, more) for k in (WORD, PAIR, STATE) if (on := kind == k).any()
                            for bucket, keys, more in _by_bucket(key[on].view(np.uint64), value[on].view(np.uint64), bits)])

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b)
            if size >= HELD:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        chunk = TaskContext.get().partitionId() << 32
        kept, sums, asked, rows, size = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            own = pa.table([pa.chunked_array(kept), *(pa.array(np.concatenate(c)) for c in zip(*sums))], names=["kept", *SCORES])
            with (out := pa.BufferOutputStream()), pa.ipc.new_stream(out, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                to.write_table(own)
            bucket = int(mix64(np.array([chunk], np.uint64))[0] >> np.uint64(64 - bits))
            found = [(bucket, chunk, TEXTS, out.getvalue().to_pybytes(), b"")]
            for kind in (WORD, PAIR, STATE):
                mine = [(k, r) for x, k, r in asked if x == kind and len(k)]
                if mine:
                    found += [(bucket, chunk, kind, *pack) for bucket, *pack in _by_bucket(*(np.concatenate(c) for c in zip(*mine)), bits)]
            return records(found)

        for b in batches:
            at_row = 0
            for part in byte_slices(b.column(1), STEP):
                w, off = symbols(part)
                n, there = _find(words.value, w)
                every = np.arange(len(w))
                text = np.repeat(np.arange(rows, rows + len(part)), np.diff(off))  # within the chunk, of every symbol
                base = _per_text(off, every, root(n))
                total = base.copy()
                asked.append((WORD, w[~there], text[~there]))
                for at, keys, contexts, _ in chains(w, off, depth)[1:]:
                    value, there = _find(states.value, contexts)
                    ask = ~there & may_be.value[STATE](contexts)
                    asked.append((STATE, contexts[ask], text[at[ask]]))
                    behind = there | ask  # only kept states have pairs
                    total += _per_text(off, at, value.astype(np.float64))
                    at, keys = at[behind], keys[behind]
                    value, there = _find(pairs.value, keys)
                    ask = ~there & may_be.value[PAIR](keys)
                    asked.append((PAIR, keys[ask], text[at[ask]]))
                    total += _per_text(off, at, value.astype(np.float64))
                sums.append((np.diff(off), _per_text(off, every, n > 0).astype(np.int64), base, total))
                kept.append(b.column(0).take(pa.array(np.arange(at_row, at_row + len(part)))))  # a slice would hold the texts
                at_row, rows = at_row + len(part), rows + len(part)
                size += sum(len(k) for _, k, _ in asked[-1 - 2 * depth:])
                if size >= ASKED or rows >= CHUNK_ROWS:
                    yield flush()
                    kept, sums, asked, rows, size, chunk = [], [], [], 0, 0, chunk + 1
        if rows:
            yield flush()

    def answer(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in names[:3]), table.column("keys"), table.column("more")))
        told = {}
        for kind in (WORD, PAIR, STATE):
            mine = [(np.cumsum(_values(keys.as_py()), dtype=np.uint64), _values(more.as_py()).view(np.float64)) for _, chunk, k, keys, more in rows if chunk < 0 and k == kind]
            key, value = (np.concatenate(c) for c in zip(*mine)) if mine else (np.zeros(0, np.uint64), np.zeros(0))
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
            told[kind] = key, root(value) - root(np.zeros(1)) if kind == WORD else value
        out = []
        for bucket, chunk, kind, keys, more in rows:
            if chunk < 0:
                continue
            if kind == TEXTS:
                out.append((bucket, chunk, kind, keys.as_py(), b"", b""))
                continue
            key, value = told[kind]
            if not len(key):
                continue
            asked, text = np.cumsum(_values(keys.as_py()), dtype=np.uint64), _values(more.as_py())
            at = np.minimum(np.searchsorted(key, asked), len(key) - 1)
            hit = key[at] == asked
            some, back, many = np.unique(text[hit], return_inverse=True, return_counts=True)
            if len(some):
                sums = np.bincount(back, weights=value[at[hit]], minlength=len(some))
                out.append((bucket, chunk, kind, _planes(np.diff(some, prepend=np.uint64(0))), _planes(sums.view(np.uint64)),
                            _planes(many) if kind == WORD else b""))
        columns = list(zip(*out)) or [[]] * 6
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 3))],
                        names=["bucket", "chunk", "kind", "texts", "sums", "many"])

    def finish(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "texts", "sums", "many"))), reverse=True)
        own = pa.ipc.open_stream(rows[0][2]).read_all()
        n_tokens, n_known, base, total = (own.column(c).to_numpy().copy() for c in SCORES)
        for kind, _, texts, sums, many in rows[1:]:
            at, more = np.cumsum(_values(texts), dtype=np.uint64).astype(np.int64), _values(sums).view(np.float64)
            total[at] += more
            if kind == WORD:
                base[at] += more
                n_known[at] += _values(many).astype(np.int64)
        return pa.table([own.column("kept"), *(pa.array(c) for c in (n_tokens, n_known, base, total))], names=["kept", *SCORES])

    kept, unfold = _kept(keep)
    rows = docs.select(kept, "text")
    schema = "bucket int, chunk long, kind int, keys binary, more binary"
    asked = rows.mapInArrow(scan, schema).unionAll(known.where(rare).select("kind", "key", "value").mapInArrow(model, schema))
    told = asked.groupBy("bucket").applyInArrow(answer, "bucket int, chunk long, kind int, texts binary, sums binary, many binary")
    scored = rows.select("kept", *(F.lit(0).cast(t).alias(c) for c, t in zip(SCORES, ("long", "long", "double", "double")))).schema
    return _written(told.groupBy("chunk").applyInArrow(finish, scored), "tree-scores").select(*unfold, *SCORES)


def score_documents(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document, learned from the others."""
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    limit = settings.pop("limit", BROADCAST_KEYS)
    tree = fit(rows.where(~F.col("held_out")).select("text"), **settings)
    return score(rows, tree, ("doc_id", "held_out"), limit).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tree.n).cast("long").alias("train_tokens"), "base_score", "score")
