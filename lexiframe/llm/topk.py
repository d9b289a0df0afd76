"""Exact top-k search by inner product: term-at-a-time accumulation.

Vectors are turned into integers, and a vector is a sparse row of (term =
dimension, weight) without its zeros. Rows are packed into blocks of at most
``block`` rows. For a block of queries and a block of candidates, the
candidates' postings of one term after the other (ids and weights) are
scattered, times the query weights of the term, into a dense score array;
partition selection then keeps each query's k best. A task carries a running
best list per query block, so that one short list per task goes on to the
merge.

The stated query set meets all candidates block by block: both sides list the
other's block numbers, and the pair (query block, candidate block) is an
ordinary equi-join key, so the work spreads evenly however skewed the ids are.
Blocks are written once under the shared checkpoint folder.

Defined results: a vector that is null, or has a null or non-finite component,
takes no part, nor does a row without id; vectors of other lengths share the
terms they have; an empty vector scores 0; scores are exact 64-bit integers: products whose sums might leave that range
are added up as Python integers, and a component or a listed score that no long can hold raises OverflowError; rows with
the query's own id are its own; a repeated query id is answered once per row; ties go to
the smaller id; no queries or no candidates give no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

SCALE = 256
BLOCK_ROWS = 2048
BLOCK_TERMS = 1 << 20  # entries of a block at most (unless one row has more)


def _postings(rows: np.ndarray, terms: np.ndarray, weights: np.ndarray):
    """Entries ordered by term: (terms, border offsets, rows, weights)."""
    order = np.argsort(terms, kind="stable")
    rows, terms, weights = rows[order], terms[order], weights[order]
    firsts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
    return terms[firsts], np.r_[firsts, len(terms)], rows, weights


BLOCK_SCHEMA = "ids array<long>, rows array<int>, terms array<int>, weights array<long>"


def _pack(vectors: DataFrame, block: int) -> DataFrame:
    """Blocks of the vectors (id, v: array<double>), at most ``block`` rows each."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = entries = 0

        def flush():
            cols = [np.concatenate(c) for c in zip(*parts)]
            return pa.RecordBatch.from_pydict(
                {"ids": pa.array([np.concatenate(ids)], pa.list_(pa.int64())),
                 "rows": pa.array([cols[0]], pa.list_(pa.int32())), "terms": pa.array([cols[1]], pa.list_(pa.int32())),
                 "weights": pa.array([cols[2]], pa.list_(pa.int64()))})

        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                vec_ids, v = part.column(0).to_numpy(), part.column(1)
                lens = np.diff(v.offsets.to_numpy())
                flat = v.flatten()
                values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
                row = np.repeat(np.arange(len(lens)), lens)
                term = np.arange(len(values)) - np.repeat(np.cumsum(lens) - lens, lens)
                ok = np.ones(len(lens), bool)
                ok[row[~np.isfinite(values)]] = False
                with np.errstate(invalid="ignore", over="ignore"):
                    whole = np.floor(values * SCALE)
                keep = ok[row] & (whole != 0)
                if (np.abs(whole[keep]) >= 2.0**63).any():
                    raise OverflowError("a component of a vector times 256 does not fit a long")
                place = np.cumsum(ok) - 1
                if held and (held + ok.sum() > block or entries + keep.sum() > BLOCK_TERMS):
                    yield flush()
                    ids, parts, held, entries = [], [], 0, 0
                ids.append(vec_ids[ok])
                parts.append(((place[row[keep]] + held).astype(np.int32), term[keep].astype(np.int32),
                              whole[keep].astype(np.int64)))
                held += int(ok.sum())
                entries += int(keep.sum())
        if held:
            yield flush()

    return vectors.mapInArrow(pack, BLOCK_SCHEMA)


def _numbered(blocks: DataFrame, name: str, column: str) -> tuple[DataFrame, int]:
    """The blocks, written once, numbered 0..n-1 by the order of their tasks; and n."""
    stored = materialize(blocks.withColumn("__at", F.monotonically_increasing_id()), name)
    at = stored.select("__at").withColumn(column, F.row_number().over(Window.orderBy("__at")) - 1)  # one row a block
    n = at.count()
    return stored.join(at, "__at").drop("__at"), n


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, ties to the smaller id, best first."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    some = np.arange(len(scores))
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= kth)  # all ties of the k-th stay until ids decide
    return some[np.lexsort((ids[some], ~scores[some].astype(np.int64)))][:k]


def _longs(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object and any(not -2**63 <= s < 2**63 for s in scores):
        raise OverflowError("a score does not fit a long")
    return scores.astype(np.int64)


def accumulate(queries, candidates, n_q: int, n_c: int) -> np.ndarray:
    """(n_c, n_q) inner products, term at a time: the postings of a term, times the queries' weights for it, are
    scattered into the score rows of its candidates. Both arguments are (rows, terms, weights).

    Scores are 32-bit while no partial sum can leave that range, then 64-bit, then Python integers."""
    q_terms, q_ends, q_rows, q_weights = _postings(*queries)
    c_terms, c_ends, c_rows, c_weights = _postings(*candidates)
    def largest(w: np.ndarray) -> int:
        return max(int(w.max(initial=0)), -int(w.min(initial=0)))

    most = largest(q_weights) * largest(c_weights) * min(len(q_terms), len(c_terms))
    kind = np.int32 if most < 2**31 else np.int64 if most < 2**63 else object
    q_weights, c_weights = q_weights.astype(kind), c_weights.astype(kind)
    scores = np.zeros((n_c, n_q), kind)
    _, in_q, in_c = np.intersect1d(q_terms, c_terms, assume_unique=True, return_indices=True)
    for i, j in zip(in_q, in_c):
        at_q, at_c = slice(q_ends[i], q_ends[i + 1]), slice(c_ends[j], c_ends[j + 1])
        rows, weights = c_rows[at_c], c_weights[at_c, None]
        if 2 * (at_q.stop - at_q.start) >= n_q:  # most queries have the term: whole score rows
            full = np.zeros(n_q, kind)
            full[q_rows[at_q]] = q_weights[at_q]
            if len(rows) == n_c:
                scores += weights[np.argsort(rows)] * full
            else:
                scores[rows] += weights * full
        else:
            scores[rows[:, None], q_rows[at_q]] += weights * q_weights[at_q]
    return scores


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]] = {}
        for b in batches:
            for r in range(b.num_rows):
                col = {n: b.column(i)[r] for i, n in enumerate(b.schema.names)}
                arrays = {n: np.asarray(c.values) for n, c in col.items() if n != "qb"}
                qb, q_ids, c_ids = col["qb"].as_py(), arrays["q_ids"], arrays["ids"]
                scores = accumulate(*([arrays[p + n] for n in ("rows", "terms", "weights")] for p in ("q_", "")),
                                    len(q_ids), len(c_ids)).T.copy()
                mine = best.setdefault(qb, (q_ids, [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q_ids]))[1]
                own = np.isin(q_ids, c_ids)
                for q in range(len(q_ids)):
                    ids, score = c_ids, scores[q]
                    if own[q]:
                        other = c_ids != q_ids[q]
                        ids, score = ids[other], score[other]
                    top = _best(score, ids, k)
                    ids, score = np.r_[mine[q][0], ids[top]], np.r_[mine[q][1], _longs(score[top])]
                    top = _best(score, ids, k)
                    mine[q] = ids[top], score[top]
        for qb, (q_ids, lists) in best.items():
            n = [len(i) for i, _ in lists]
            if sum(n):
                yield pa.RecordBatch.from_pydict({
                    "qb": pa.array(np.full(sum(n), qb, np.int64)), "q": pa.array(np.repeat(np.arange(len(n)), n).astype(np.int32)),
                    "query_id": pa.array(np.repeat(q_ids, n)), "vec_id": pa.array(np.concatenate([i for i, _ in lists])),
                    "score": pa.array(np.concatenate([s for _, s in lists]))})

    return search


def search(vectors: DataFrame, is_query: Column, k: int = 5, block: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of all rows for each row that ``is_query`` picks.

    ``vectors``: vec_id and embedding."""
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    v = [F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")]
    candidates, n_c = _numbered(_pack(rows.select(*v), block), "topk-candidates", "cb")
    # few queries per scan partition: bring them together so that blocks are full
    picked = rows.where(is_query)
    n_q = picked.count()
    queries, n_q = _numbered(_pack(picked.select(*v).repartition(max(1, -(-n_q // block)), "id"), block), "topk-queries", "qb")
    queries = queries.select("qb", *[F.col(c).alias(f"q_{c}") for c in ("ids", "rows", "terms", "weights")])

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>"))

    # blocks by (query block, candidate block); a task sees several and keeps one list per query
    pairs = candidates.withColumn("qb", every(n_q)).join(queries.withColumn("cb", every(n_c)), ["qb", "cb"])
    lists = pairs.drop("cb").mapInArrow(_search(k), "qb long, q int, query_id long, vec_id long, score long")
    order = Window.partitionBy("qb", "q").orderBy(F.desc("score"), "vec_id")
    return (lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
