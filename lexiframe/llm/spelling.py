"""Spelling variant grouping by a dictionary of trie-node pairs.

Words go into two tries, one of the words and one of the reversed words, whose nodes are numbered. The split of a
word before position i is the pair (node of the prefix, node of the suffix that is left); the word without its
position i is the pair (node of the prefix before i, node of the suffix after i). So two words differ

* by one inserted or deleted code point, if a skipped pair of the longer equals a split pair of the shorter;
* by one replaced code point, if a skipped pair of both at the same place is equal.

Both are one join on two integers, exact without a comparison of strings. The words of one pair differ in one code
point only, so a pair holds at most one split word and as many skipping words as the alphabet has letters (90), and a
summary of the pair (how many, the two best) tells each of its words its neighbours: none are listed two by two.
A skipped position counts as a deletion only where it starts a run of equal letters, so no neighbour counts twice.

Numbering without one task: words are range-partitioned and sorted, equal prefixes stand together, and each task
numbers the nodes of its range. A range shares with the one before only prefixes of its first word, so the
first and last word of every range (two rows a range) settle the shared nodes.

Counting reads each text once in slices cut between words; a task adds up before the shuffle. Rounds
of pointer jumping find the roots: n at least doubles with every step, so few are needed.

Defined results: a null or empty text has no words; a null ``doc_id`` reads as empty text in the rule of the deleted
code point; repeated rows count again; words of any length are kept whole (a word of n letters makes 2n + 1 pairs);
ties go to the word that is smaller in code-point order; no words give no rows. Other columns are not read.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import range_partitions
from ..session import materialize

RUN = re.compile("[a-zÀ-ÿ]+")
BETWEEN = re.compile("[^a-zÀ-ÿ]")
SLICE = 1 << 20  # characters searched at a time
HELD = 200_000  # distinct words a task adds up before it hands them on
MODULUS = 97
SKIP, SPLIT = 0, 1


def _slices(text: str) -> Iterator[tuple[int, int]]:
    """Borders of pieces of about SLICE characters that cut no run."""
    at = 0
    while at < len(text):
        end = at + SLICE
        cut = BETWEEN.search(text, end) if end < len(text) else None
        end = cut.end() if cut else len(text)
        yield at, end
        at = end


def runs_of(doc_id: int | None, text: str) -> Counter:
    """The document's words with their counts: lower-cased runs, some without one code point by the rule of the hash."""
    lowered = text.encode("utf-8").lower().decode("utf-8")  # bytes: A-Z only
    found: Counter = Counter()
    for a, b in _slices(lowered):
        found.update(RUN.findall(lowered, a, b))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in found.items():
        h = zlib.crc32(run.encode("utf-8"), start)
        if h % MODULUS == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        out[run] += n
    return out


def count_words(docs: DataFrame, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """word, n: the words of ``docs`` (doc_id, text) of at least ``min_length`` code points and ``min_count`` occurrences."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush():
            words = list(total)
            out = pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n": pa.array(total.values(), pa.int64())})
            total.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):
                if text.is_valid:
                    for word, n in runs_of(doc_id.as_py(), text.as_py()).items():
                        if len(word) >= min_length:
                            total[word] += n
                    if len(total) >= HELD:
                        yield flush()
        yield flush()

    parts = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def shared_prefix(a: str, b: str) -> int:
    """Number of leading code points that both have."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def number_nodes(words: DataFrame, word: str, path: str, rank: str | None = None) -> DataFrame:
    """``words`` with ``path``: the number of the trie node of every prefix of ``word`` (array<long>, the empty prefix
    first), and optionally ``rank``, the position in code-point order. ``word`` must be distinct and not null."""
    names = words.columns
    at = names.index(word)
    ranged = words.repartitionByRange(range_partitions(words), word).sortWithinPartitions(word)
    schema = (ranged.withColumn("part_", F.lit(0)).withColumn("rank_", F.lit(0).cast("long"))
              .withColumn("path_", F.array().cast("array<long>")).withColumn("end_", F.lit(False)).schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers of this range's own: the first word's prefixes are 0..length, new nodes follow in order. ``end_`` marks
        the range's last row."""
        from pyspark import TaskContext
        pid, last, on, nodes, seen, held = TaskContext.get().partitionId(), None, [], 0, 0, None

        def marked(batch: pa.RecordBatch, final: bool) -> pa.RecordBatch:
            ends = np.zeros(batch.num_rows, bool)
            ends[-1] = final
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends)], schema=schema_)

        schema_ = None
        for b in batches:
            if not b.num_rows:
                continue
            paths = []
            for w in b.column(at).to_pylist():
                same = shared_prefix(last, w) if last is not None else -1
                on = on[:same + 1] + list(range(nodes, nodes + len(w) - same))
                nodes += len(w) - same
                paths.append(on)
                last = w
            columns = [*b.columns, pa.array(np.full(b.num_rows, pid, np.int32)), pa.array(np.arange(seen, seen + b.num_rows)),
                       pa.array(paths, pa.list_(pa.int64()))]
            seen += b.num_rows
            if held is not None:
                yield marked(held, False)
            held = pa.RecordBatch.from_arrays(columns, names=[*names, "part_", "rank_", "path_"])
            schema_ = held.schema.append(pa.field("end_", pa.bool_()))
        if held is not None:
            yield marked(held, True)

    own = materialize(ranged.mapInArrow(walk, schema), "trie-nodes")
    # two rows a range, whatever the number of words
    borders = own.where(F.col("end_") | (F.col("rank_") == 0)).select("part_", "rank_", word, "path_", "end_").collect()
    nodes = dict(own.groupBy("part_").agg(F.max(F.element_at("path_", -1)).alias("top")).collect())
    settled, node_base, word_base = _settle(borders, {p: top + 1 for p, top in nodes.items()}, word)
    shared = words.sparkSession.sparkContext.broadcast((settled, node_base, word_base))

    @F.arrow_udf("struct<path:array<bigint>,rank:bigint>")
    def globally(part: pa.Array, rank_: pa.Array, path_: pa.Array) -> pa.Array:
        settled, node_base, word_base = shared.value
        parts, ranks = part.to_numpy().astype(np.int64), rank_.to_numpy().copy()
        lengths = path_.value_lengths().to_numpy()
        flat, of = path_.flatten().to_numpy().copy(), np.repeat(parts, lengths)
        for p in np.unique(parts):
            ranks[parts == p] += word_base[p]
            mine = np.flatnonzero(of == p)
            local = flat[mine]
            old = local < len(settled[p])
            flat[mine] = np.where(old, settled[p][np.where(old, local, 0)] if len(settled[p]) else 0, local + node_base[p])
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(ranks)],
                                          names=["path", "rank"])

    both = own.withColumn("both_", globally("part_", "rank_", "path_"))
    return both.select(*names, F.col("both_.path").alias(path), *([F.col("both_.rank").alias(rank)] if rank else []))


def _settle(borders: Sequence, nodes: dict[int, int], word: str):
    """Per range: the final numbers of the prefixes it shares with the range before (its own numbers 0..c), the
    number added to its other nodes, and the words before it."""
    first = {r["part_"]: r[word] for r in borders if r["rank_"] == 0}
    end = {r["part_"]: r for r in borders if r["end_"]}
    settled, node_base, word_base = {}, {}, {}
    total_nodes = total_words = 0
    before: tuple[str, np.ndarray] | None = None  # the last word so far and the final numbers of its prefixes
    for p in sorted(first):
        same = shared_prefix(before[0], first[p]) + 1 if before else 0
        settled[p] = before[1][:same] if before else np.zeros(0, np.int64)
        node_base[p], word_base[p] = total_nodes, total_words
        own = np.array(end[p]["path_"], np.int64)
        old = own < same
        before = (end[p][word], np.where(old, settled[p][np.where(old, own, 0)] if same else 0, own + total_nodes))
        total_nodes += nodes[p]
        total_words += end[p]["rank_"] + 1
    return settled, node_base, word_base


def node_pairs(words: DataFrame) -> DataFrame:
    """Every split and every skipped position of the words (rank, n, word, forward, backward: node paths) as integers:
    prefix, suffix (nodes), kind (SKIP or SPLIT), starts (the skipped letter starts a run of its like), n, rank."""
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, held = 0, np.cumsum(pc.list_value_length(b.column("forward")).to_numpy())
            while at < b.num_rows:  # about 100,000 nodes at a time, one word at least
                stop = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + 100_000, side="right")))
                yield _pairs_of(b.slice(at, stop - at))
                at = stop

    return words.select("rank", "n", "word", "forward", "backward").mapInArrow(
        pairs, "prefix long, suffix long, kind int, starts boolean, n long, rank long")


def _pairs_of(b: pa.RecordBatch) -> pa.RecordBatch:
    rank, n = b.column("rank").to_numpy(), b.column("n").to_numpy()
    paths = [(np.asarray(f.values), np.asarray(s.values)[::-1]) for f, s in zip(b.column("forward"), b.column("backward"))]
    letters = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in b.column("word").to_pylist()]
    size = np.array([len(w) for w in letters])
    starts = [np.r_[True, w[1:] != w[:-1]][:len(w)] for w in letters]
    columns = [
        np.concatenate([f[:-1] for f, _ in paths] + [f for f, _ in paths]),
        np.concatenate([s[1:] for _, s in paths] + [s for _, s in paths]),
        np.repeat(np.array([SKIP, SPLIT], np.int32), [size.sum(), size.sum() + len(size)]),
        np.concatenate([*starts, np.zeros(size.sum() + len(size), bool)]),
        np.concatenate([np.repeat(n, size), np.repeat(n, size + 1)]),
        np.concatenate([np.repeat(rank, size), np.repeat(rank, size + 1)]),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["prefix", "suffix", "kind", "starts", "n", "rank"])


def _summaries(prefix, suffix, kind, starts, n, rank) -> pa.RecordBatch:
    """What the pairs tell their words: (rank, near, best_n, best). Rows come by pair, skipping words first, by falling n
    and rising rank."""
    count = len(prefix)
    first = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (suffix[1:] != suffix[:-1])]) if count else np.zeros(0, int)
    group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, count]))
    skip = kind == SKIP
    skips = np.bincount(group[skip], minlength=len(first))
    out = []
    # replaced: each skipping word of a pair has all others near, the best of them is the pair's first or second
    on = np.flatnonzero(skip & (skips[group] > 1))
    lead = first[group[on]]
    other = np.where(on == lead, lead + 1, lead)
    out.append((rank[on], skips[group[on]] - 1, n[other], rank[other]))
    # inserted and deleted: the pair's split word is near each skipping word whose letter starts a run
    split_at = np.full(len(first), -1)
    split_at[group[~skip]] = np.flatnonzero(~skip)
    longer = np.flatnonzero(starts & (split_at[group] >= 0)) if count else np.zeros(0, int)
    shorter = split_at[group[longer]]
    out.append((rank[longer], np.ones(len(longer), np.int64), n[shorter], rank[shorter]))
    owner, at, many = np.unique(group[longer], return_index=True, return_counts=True)
    out.append((rank[split_at[owner]], many, n[longer[at]], rank[longer[at]]))
    cols = [np.concatenate([o[i] for o in out]).astype(np.int64) for i in range(4)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["rank", "near", "best_n", "best"])


def near_words(pairs: DataFrame, tasks: int) -> DataFrame:
    """rank, n_near, best_n, best (rank): of every word with a near word, how many it has and the one of largest n
    (ties: smallest rank)."""
    ordered = (pairs.repartition(tasks, "prefix", "suffix")
               .sortWithinPartitions("prefix", "suffix", "kind", F.desc("n"), "rank"))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] | None = None  # the last pair's rows, which may go on in the next batch
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            cols = cols if left is None else [np.concatenate(p) for p in zip(left, cols)]
            if not len(cols[0]):
                continue
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            cut = len(same) - int(same.sum())
            left = [c[cut:] for c in cols]
            yield _summaries(*(c[:cut] for c in cols))
        if left is not None:
            yield _summaries(*left)

    told = ordered.mapInArrow(tell, "rank long, near long, best_n long, best long")
    return (told.groupBy("rank").agg(F.sum("near").alias("n_near"),
                                     F.max(F.struct("best_n", (-F.col("best")).alias("best"))).alias("top"))
            .select("rank", "n_near", F.col("top.best_n").alias("best_n"), (-F.col("top.best")).alias("best")))


def _roots(links: DataFrame) -> DataFrame:
    """rank, root: where following ``links`` (rank -> form) ends, by pointer jumping."""
    table = materialize(links.select("rank", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = table.select(F.col("rank").alias("root"), F.col("root").alias("beyond"))
        joined = table.join(on, "root", "left")
        table = materialize(joined.select("rank", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")),
                            "spelling-roots")
        if table.where("moved").isEmpty():
            return table.drop("moved")
        table = table.drop("moved")


def group_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct ``words`` (word, n).

    form: the near word of largest n if that is at least ``ratio`` (2 or more) times the word's n, else null."""
    forward = number_nodes(words.select("word", "n"), "word", "forward", "rank")
    backward = number_nodes(forward.withColumn("drow", F.reverse("word")), "drow", "backward").drop("drow")
    table = materialize(backward, "spelling-words")
    near = near_words(node_pairs(table), range_partitions(words))
    names = table.select("rank", "word", "n")
    marked = materialize(
        names.join(near, "rank", "left").select(
            "rank", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            *[F.when(F.col("best_n") >= ratio * F.col("n"), F.col(c)).alias(f) for c, f in (("best", "form"), ("best_n", "form_n"))]),
        "spelling-forms")
    links = marked.where(F.col("form").isNotNull()).select("rank", "form")
    ends = links.join(_roots(links), "rank")
    form_names = names.select(F.col("rank").alias("form"), F.col("word").alias("form_word"))
    root_names = names.select(F.col("rank").alias("root"), F.col("word").alias("root_word"))
    named = ends.join(form_names, "form").join(root_names, "root").select("rank", "form_word", "root_word")
    return marked.join(named, "rank", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, min_length: int = 5, min_count: int = 3, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of ``docs`` (doc_id, text)."""
    return group_variants(materialize(count_words(docs, min_length, min_count), "spelling-counts"), ratio)
