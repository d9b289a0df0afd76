"""Removal of repeated byte strings by a sampled, range-partitioned suffix sort.

Every byte covered by a ``WIDTH``-byte string that also starts earlier (in an
earlier document, or earlier in the same one) is a repeat. All suffixes of a
corpus are far more than its bytes, so the suffixes that are sorted are those
that any repeat must contain:

1. *Sampling by content.* In every WIDTH-byte window the positions whose
   ``LEAD``-byte hash is the least are anchors (about one byte in 35). Equal
   windows have equal anchors at equal offsets, so a repeat shows up as two
   anchors with one hash; anchors whose hash occurs once are dropped. Exact
   copies are found by digest and need no suffixes.
2. *Suffix sort.* For the others the suffix (WIDTH bytes from the anchor) and
   the ``BACK`` bytes before it are range-partitioned by their leading tokens
   with sampled splitters; equal leads never part. Each bucket sorts the
   suffixes, and the reversed bytes before them, by multikey quicksort (8 bytes
   a key) and takes longest common prefixes of neighbours. The window that
   starts o bytes before an anchor equals another one exactly if the suffixes
   share WIDTH - o bytes and the bytes before share o; so the buckets' classes
   decide, byte for byte, for each of the BACK + 1 windows through an anchor,
   whether an earlier one is equal.
3. *Hot leads.* A lead with more than ``GROUP`` anchors is not held in one task:
   its windows are digested; a task passes on the earliest place of each digest
   it meets (the others are repeats), and a partially aggregated minimum, joined
   back, finds the earliest of all.
4. The repeated windows through one anchor overlap, so each anchor gives one
   interval; a document's intervals are merged where its text is cut.

Only documents that have something to compare or to cut move their text: a
bitmap of hashed ids (a bounded number of rows, whatever the input) is
broadcast to leave out the others.

Results are judged on the input, not on what is left. Defined results: a null
text counts as empty; texts under WIDTH bytes stay whole; order is by doc_id,
null last; rows of one id are ordered by digest, of fully equal rows one is the
first; matches never cross documents.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import range_partitions
from ..session import materialize
from .common import may_hold, mix64, text_batches, utf8

WIDTH = 100
LEAD = 32
BACK = WIDTH - LEAD  # offsets of a window's start before an anchor: 0..BACK
SPAN = BACK + 1  # hashes per window
GROUP = 100_000
PIECE = 1 << 19
ROWS_OUT = 8192
DECIDE = 16_384  # rows of a bucket decided together, at least
DIGESTS = 100_000  # window digests and repeats a task holds
BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP = _powers(BASE, PIECE + 4 * WIDTH)
_DOWN = _powers(pow(BASE, -1, 1 << 64), PIECE + 4 * WIDTH)


# ---- anchors -----------------------------------------------------------------

def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i:i + width] for every i with a whole stretch, by doubling."""
    have = 1
    while have * 2 <= width:
        x = op(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return op(x[:-rest], x[rest:]) if rest else x


def anchors(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of one text's bytes, ascending."""
    n = len(text)
    if n < WIDTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, hashes = [], []
    for a in range(0, n - LEAD + 1, PIECE):
        lo = max(0, a - SPAN + 1)  # windows through the piece start here at the earliest
        hi = min(n, a + PIECE + SPAN - 1 + LEAD - 1)
        part = text[lo:hi]
        p = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _UP[:len(part)], out=p[1:])
        h = mix64((p[LEAD:] - p[:-LEAD]) * _DOWN[:len(part) - LEAD + 1])
        least = _sliding(h, SPAN, np.minimum)  # per window
        padded = np.zeros(len(h) + SPAN - 1, np.uint64)
        padded[SPAN - 1:SPAN - 1 + len(least)] = least
        chosen = _sliding(padded, SPAN, np.maximum) == h  # the least of some window through it
        first, last = a - lo, min(len(h), a - lo + PIECE)
        found = np.flatnonzero(chosen[first:last]) + first
        at.append(found + lo)
        hashes.append(h[found])
    return np.concatenate(at), np.concatenate(hashes)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> anchors, to meet by hash and salt. A hash that occurs several times in one stretch of
    documents is known to repeat (its positions go out inverted); one of its anchors stands for all there
    (salt 0), the others get salts of their own, so a hot hash costs the exchange one row a stretch."""
    for b in batches:
        ids = b.column(0).to_numpy()
        raw, off = utf8(b.column(1))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        for i in range(len(ids)):
            at, h = anchors(raw[off[i]:off[i + 1]])
            out.append((h, np.full(len(at), ids[i], np.int64), at))
            held += len(at)
            if held >= ROWS_OUT or i == len(ids) - 1:
                h, d, at = (np.concatenate(c) for c in zip(*out))
                _, first, place, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                stands = np.zeros(len(h), bool)
                stands[first] = True
                own = mix64(d.view(np.uint64) + mix64(at.astype(np.uint64))) >> np.uint64(34)
                salt = np.where(stands, 0, own.astype(np.int32) + 1).astype(np.int32)
                at = np.where((times > 1)[place], ~at, at)
                for k in range(0, len(h), 8 * ROWS_OUT):
                    s = slice(k, k + 8 * ROWS_OUT)
                    yield pa.RecordBatch.from_arrays([pa.array(h[s].view(np.int64)), pa.array(salt[s]), pa.array(d[s]), pa.array(at[s])],
                                                     names=["h", "salt", "id", "pos"])
                out, held = [], 0


# ---- contexts -------------------------------------------------------------------

def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, positions) -> one row per anchor: suffix then the bytes before it, reversed, zero-padded to width."""
    reach = np.concatenate([np.arange(WIDTH), -1 - np.arange(BACK)])
    for b in batches:
        raw, off = utf8(b.column(1))
        for i, doc in enumerate(b.column(0).to_pylist()):
            text = raw[off[i]:off[i + 1]]
            n = len(text)
            padded = np.concatenate([np.zeros(BACK, np.uint8), text, np.zeros(WIDTH, np.uint8)])
            every = np.sort(np.asarray(b.column(2)[i].values))
            for k in range(0, len(every), ROWS_OUT):
                pos = every[k:k + ROWS_OUT]
                ctx = padded[pos[:, None] + BACK + reach]
                size = ctx.shape[1]
                data = pa.Array.from_buffers(pa.binary(), len(pos), [
                    None, pa.py_buffer(np.arange(0, size * len(pos) + 1, size, dtype=np.int32)), pa.py_buffer(ctx.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [data, pa.array(np.full(len(pos), doc, np.int64)), pa.array(pos),
                     pa.array(np.minimum(n - pos, WIDTH).astype(np.int32)), pa.array(np.minimum(pos, BACK).astype(np.int32))],
                    names=["ctx", "id", "pos", "after", "before"])


CONTEXT = "ctx binary, id long, pos long, after int, before int"


def multikey_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the byte rows, longest common prefix of each with the one before it in that order).

    Multikey quicksort with 8-byte keys: rows that tie on the keys so far, and only those, are sorted by the next."""
    n, width = rows.shape
    wide = -(-width // 8) * 8
    padded = np.zeros((n, wide), np.uint8)
    padded[:, :width] = rows
    keys = padded.view(">u8").astype(np.uint64)
    order = np.argsort(keys[:, 0], kind="stable")
    new = np.ones(n, bool)
    new[1:] = keys[order[1:], 0] != keys[order[:-1], 0]
    for k in range(1, keys.shape[1]):
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(new)[at]
        word = keys[order[at], k]
        order[at] = order[at][np.lexsort((word, group))]
        word = keys[order[at], k]
        new[at[1:]] |= (word[1:] != word[:-1])
    same = rows[order[1:]] == rows[order[:-1]]
    common = np.zeros(n, np.int64)
    common[1:] = np.where(same.all(axis=1), width, same.argmin(axis=1))
    return order, common


def repeated_windows(ctx: np.ndarray, doc: np.ndarray, pos: np.ndarray, after: np.ndarray, before: np.ndarray
                     ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, least offset, greatest offset) of the anchors with a window that also occurs at an earlier anchor."""
    n = len(doc)
    time = np.lexsort((pos, doc))
    ctx, after, before = ctx[time], after[time], before[time]
    forward, forward_common = multikey_order(ctx[:, :WIDTH])
    backward, backward_common = multikey_order(ctx[:, WIDTH:])
    low, high = np.full(n, BACK + 1), np.full(n, -1)
    ahead, behind = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(BACK + 1):
        valid = np.flatnonzero((before >= o) & (after >= WIDTH - o))
        if len(valid) < 2:
            continue
        ahead[forward] = np.cumsum(forward_common < WIDTH - o)
        behind[backward] = np.cumsum(backward_common < o)
        window = ahead[valid] * (n + 1) + behind[valid]
        by = np.argsort(window, kind="stable")  # rows are in order of time, so the first of a run is the earliest
        again = by[1:][window[by[1:]] == window[by[:-1]]]
        rows = valid[again]
        low[rows] = np.minimum(low[rows], o)
        high[rows] = np.maximum(high[rows], o)
    rows = np.flatnonzero(high >= 0)
    return time[rows], low[rows], high[rows]


def _bucket_intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts ordered by lead -> (id, start, end) of repeated bytes; groups of one lead are decided together,
    as many groups at a time as fill DECIDE rows."""
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0

    def decide(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        ctx, doc, pos, after, before = (np.concatenate(c) for c in zip(*parts))
        at, low, high = repeated_windows(ctx, doc, pos, after, before)
        return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(pos[at] - high), pa.array(pos[at] - low + WIDTH)],
                                          names=["id", "start", "end"])

    for b in batches:
        if b.num_rows == 0:
            continue
        raw, _ = utf8(b.column(0))
        held.append((raw.reshape(b.num_rows, WIDTH + BACK), *(b.column(i).to_numpy() for i in range(1, 5))))
        rows += b.num_rows
        if rows < DECIDE:
            continue
        # everything before the last lead of this batch is complete
        ctx = held[-1][0]
        changed = np.flatnonzero((ctx[1:, :LEAD] != ctx[:-1, :LEAD]).any(axis=1))
        if len(changed):
            done = int(changed[-1]) + 1
            yield decide(held[:-1] + [tuple(c[:done] for c in held[-1])])
            held = [tuple(c[done:] for c in held[-1])]
        elif len(held) > 1 and (held[-2][0][-1, :LEAD] != ctx[0, :LEAD]).any():
            yield decide(held[:-1])
            held = held[-1:]
        rows = sum(len(h[1]) for h in held)
    if held:
        yield decide(held)


def _window_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts -> per digest of a window its earliest place in this task, and the other places, known to
    be repeats, as merged intervals without a digest. The table of digests is bounded."""
    schema = pa.schema([("digest", pa.binary()), ("id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
    earliest: dict[bytes, tuple[int, int]] = {}
    again: list[tuple[int, int]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        places = list(earliest.values())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(earliest), pa.binary()), pa.array([i for i, _ in places], pa.int64()),
             pa.array([s for _, s in places], pa.int64()), pa.array([s + WIDTH for _, s in places], pa.int64())], schema=schema)
        merged: list[list[int]] = []
        for i, start in sorted(set(again)):
            if merged and merged[-1][0] == i and start <= merged[-1][2]:
                merged[-1][2] = start + WIDTH
            else:
                merged.append([i, start, start + WIDTH])
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(merged), pa.binary()), *(pa.array([m[k] for m in merged], pa.int64()) for k in range(3))], schema=schema)
        earliest.clear()
        again.clear()

    for b in batches:
        raw, _ = utf8(b.column(0))
        ctx = raw.reshape(-1, WIDTH + BACK)
        line = np.concatenate([ctx[:, WIDTH:][:, ::-1], ctx[:, :WIDTH]], axis=1)  # back to text order
        doc, pos, after, before = (b.column(i).to_pylist() for i in range(1, 5))
        for i in range(len(doc)):
            whole = line[i].tobytes()
            for o in range(max(0, WIDTH - after[i]), before[i] + 1):
                place = (doc[i], pos[i] - o)
                digest = hashlib.md5(whole[BACK - o:BACK - o + WIDTH]).digest()
                first = earliest.setdefault(digest, place)
                if place < first:
                    earliest[digest] = place
                    again.append(first)
                elif place > first:
                    again.append(place)
            if len(earliest) + len(again) > DIGESTS:
                yield from flush()
    yield from flush()


# ---- the corpus -----------------------------------------------------------------

def _contexts(docs: DataFrame, found: DataFrame) -> DataFrame:
    per_doc = found.groupBy("id").agg(F.collect_list("pos").alias("positions"))
    return (may_hold(docs, found, "id").join(per_doc, "id").select("id", "text", "positions")
            .mapInArrow(_context_rows, CONTEXT))


def _identified(docs: DataFrame) -> DataFrame:
    """(id, doc_id, text) with ids that are unique and ascend in the order of the documents.

    A unique doc_id without nulls serves itself; otherwise rows are range-sorted and numbered, and written once."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    doc_id = F.col("doc_id").cast("long")
    most, rows, known = docs.groupBy(doc_id.alias("d")).agg(F.count("*").alias("n")).agg(
        F.max("n"), F.sum("n"), F.sum(F.when(F.col("d").isNotNull(), F.col("n")))).first()
    if (most or 0) <= 1 and rows == known:
        return docs.select(doc_id.alias("id"), doc_id.alias("doc_id"), text)
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.md5("text")]
    ranged = docs.select(doc_id.alias("doc_id"), text).repartitionByRange(range_partitions(docs), *order)
    return materialize(ranged.sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()), "suffix-docs")


def intervals(docs: DataFrame, copies: DataFrame, group: int = GROUP) -> DataFrame:
    """(id, start, end): repeated bytes of documents (id, text) that are not among ``copies`` (id); intervals may overlap."""
    found = docs.select("id", "text").mapInArrow(_anchor_rows, "h long, salt int, id long, pos long")
    met = F.count("*").over(Window.partitionBy("h", "salt")) > 1
    found = found.withColumn("met", met).where("met or pos < 0").select(
        "h", "id", F.when(F.col("pos") < 0, F.bitwise_not("pos")).otherwise(F.col("pos")).alias("pos"))
    found = materialize(found, "suffix-anchors")
    hot = materialize(found.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > group), "suffix-hot")
    found = found.join(copies, "id", "left_anti").join(hot, "h", "left")
    lead = F.substring("ctx", 1, LEAD)
    usual = _contexts(docs, found.where(F.col("n").isNull()))
    out = (usual.repartitionByRange(range_partitions(docs), lead).sortWithinPartitions(lead)
           .mapInArrow(_bucket_intervals, "id long, start long, end long"))
    if not hot.isEmpty():
        windows = _contexts(docs, found.where(F.col("n").isNotNull())).mapInArrow(
            _window_places, "digest binary, id long, start long, end long")
        windows = materialize(windows, "suffix-windows")
        places = windows.where(F.col("digest").isNotNull())
        first = materialize(places.groupBy("digest").agg(F.min(F.struct("id", "start")).alias("first")).where(
            F.col("first").isNotNull()), "suffix-first")
        again = places.join(first, "digest").where(F.struct("id", "start") > F.col("first"))
        out = (out.unionByName(again.select("id", "start", "end"))
               .unionByName(windows.where(F.col("digest").isNull()).select("id", "start", "end")))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, spans) -> id, kept bytes, merged spans."""
    schema = pa.schema([("id", pa.int64()), ("kept", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])
    for b in batches:
        raw, off = utf8(b.column(1))
        for k in range(0, b.num_rows, 64):
            rows = []
            for i in range(k, min(k + 64, b.num_rows)):
                text = raw[off[i]:off[i + 1]]
                flat = b.column(2)[i].values
                edge = np.zeros(len(text) + 1, np.int32)
                np.add.at(edge, flat.field(0).to_numpy(), 1)
                np.add.at(edge, flat.field(1).to_numpy(), -1)
                gone = np.cumsum(edge)[:-1] > 0
                starts = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append({"id": b.column(0)[i].as_py(), "kept": text[~gone].tobytes(), "n_removed": int(gone.sum()),
                             "n_spans": starts})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def remove_repeats(docs: DataFrame, group: int = GROUP, digest_only: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes (``kept``), or only their digest (``kept_sha256``)."""
    text_batches(docs.sparkSession, 256)
    docs = _identified(docs)
    whole = F.col("text").cast("binary")
    rows = materialize(docs.select("id", "doc_id", F.md5("text").alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"),
                                   F.sha2("text", 256).alias("sha")), "suffix-rows")
    first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = materialize(rows.join(first, "digest").where(F.col("id") != F.col("first")).select("id", "n_bytes"), "suffix-copies")
    spans = materialize(intervals(docs.select("id", "text"), copies.select("id"), group), "suffix-spans")
    per_doc = spans.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    cut = (may_hold(docs.select("id", "text"), spans, "id").join(per_doc, "id").select("id", "text", "spans")
           .mapInArrow(_cut, "id long, kept binary, n_removed long, n_spans long"))
    if digest_only:
        cut = cut.select("id", F.sha2("kept", 256).alias("kept"), "n_removed", "n_spans")
        full, empty = F.col("sha"), F.sha2(F.lit(b""), 256)
        base = rows.select("id", "doc_id", "n_bytes", full.alias("full"))
    else:
        empty = F.lit(b"")
        base = docs.select("id", "doc_id", F.length(whole).cast("long").alias("n_bytes"), whole.alias("full"))
    gone = copies.where(F.col("n_bytes") >= WIDTH).select(
        "id", empty.alias("kept"), F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"))
    out = base.join(cut.unionByName(gone), "id", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"),
                      F.coalesce("n_spans", zero).alias("n_spans"),
                      F.coalesce("kept", "full").alias("kept_sha256" if digest_only else "kept"))
