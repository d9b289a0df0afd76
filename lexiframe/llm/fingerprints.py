"""Document fingerprints from prefix polynomial hashes.

For code points c, the prefix array ``P[i] = sum of c[j] * B^j, j < i`` is kept
modulo the prime 2^31 - 1 for two bases. A span's hash is ``(P[r] - P[l]) *
B^-l``, independent of where it stands, so any two spans are compared in
constant time and the longest common extension of two positions is found by
binary search over its length.

A fingerprint is the length, the whole text's hash and a sketch: the
``SKETCH`` smallest mixed hashes of all distinct spans of ``SPAN`` code points
(a shorter text is one span). Likeness is the share of spans in common,
estimated from the sketches; texts of equal length and hash are alike 1.

The edited text (first half of a text, then the start of its neighbour) needs
no hashing of its own but for the spans across the seam: its other spans are
those of the two prefixes.

Arrays are made ``CHUNK`` code points at a time, so a very long text needs
little more than its code points.

Neighbours: documents are dealt into ranges of ids; the first document of a
range is also sent to the range before it, so no task sees all documents and
no text moves twice.

Defined results: a null text counts as empty; the fingerprints of empty texts
are equal, and their likeness to any other text is 0; ids in descending order,
a null id last, equal ids in the order of their texts' digests; the last
document is followed by the first; a single document is followed by itself.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import range_partitions
from .common import mix64, strings, text_batches

PRIME = (1 << 31) - 1
BASES = (1_000_003, 1_566_083_941)
SPAN = 24
SKETCH = 32
CHUNK = 1 << 17
VALUE_HEX = 10  # hexadecimal digits of a sketch value
RANGES_PER_PARTITION = 4
LOWEST = -(1 << 63)

_P = np.uint64(PRIME)


def _mod(x: np.ndarray) -> np.ndarray:
    return x - (x // _P) * _P


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    filled = 1
    while filled < n:
        step = min(filled, n - filled)
        out[filled:filled + step] = _mod(out[:step] * np.uint64(pow(base, filled, PRIME)))
        filled += step
    return out


_UP = [_powers(b, CHUNK + SPAN) for b in BASES]
_DOWN = [_powers(pow(b, -1, PRIME), CHUNK + SPAN) for b in BASES]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _prefix(codes: np.ndarray, k: int) -> np.ndarray:
    """Prefix array (length + 1) of at most CHUNK + SPAN code points for base number k."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_mod((codes.astype(np.uint64) + np.uint64(1)) * _UP[k][:len(codes)]), out=out[1:])
    return _mod(out)


def span_hashes(codes: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Mixed hashes of all spans of a stretch of at most CHUNK + span code points."""
    n = len(codes) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    both = np.zeros(n, np.uint64)
    for k in range(2):
        p = _prefix(codes, k)
        both = (both << np.uint64(31)) | _mod(_mod(p[span:] + _P - p[:-span]) * _DOWN[k][:n])
    return mix64(both)


def _smallest(values: np.ndarray, k: int = SKETCH) -> np.ndarray:
    """The k smallest distinct values, ascending."""
    m = 4 * k
    if len(values) > m:
        some = np.unique(np.partition(values, m)[:m])
        if len(some) >= k:
            return some[:k]
    return np.unique(values)[:k]


class Prefixes:
    """Prefix hashes of one text: whole hash, span equality and longest common extension."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.marks = [[0], [0]]  # P at every multiple of CHUNK
        self._held: dict[int, list[np.ndarray]] = {}
        for a in range(0, len(codes), CHUNK):
            parts = [_prefix(codes[a:a + CHUNK], k) for k in range(2)]
            if a == 0:
                self._held[0] = parts
            for k in range(2):
                self.marks[k].append((self.marks[k][-1] + int(parts[k][-1]) * pow(BASES[k], a, PRIME)) % PRIME)

    def _at(self, i: int) -> list[int]:
        block, rest = divmod(i, CHUNK)
        if rest == 0:
            return [m[block] for m in self.marks]
        if block not in self._held:
            a = block * CHUNK
            self._held = {block: [_prefix(self.codes[a:a + CHUNK], k) for k in range(2)]}
        return [(self.marks[k][block] + int(self._held[block][k][rest]) * pow(BASES[k], block * CHUNK, PRIME)) % PRIME
                for k in range(2)]

    def span(self, left: int, right: int) -> tuple[int, int]:
        """Hash of code points left..right-1, the same wherever they stand."""
        a, b = self._at(left), self._at(right)
        return tuple((b[k] - a[k]) * pow(BASES[k], -left, PRIME) % PRIME for k in range(2))

    def equal(self, left: int, other: Prefixes, other_left: int, size: int) -> bool:
        return self.span(left, left + size) == other.span(other_left, other_left + size)

    def extension(self, left: int, other: Prefixes, other_left: int) -> int:
        """Length of the longest common extension of the two positions."""
        low, high = 0, min(len(self.codes) - left, len(other.codes) - other_left)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(left + low, other, other_left + low, middle - low):
                low = middle
            else:
                high = middle - 1
        return low


def sketches(codes: np.ndarray, cuts: tuple[int, ...]) -> list[np.ndarray]:
    """For each prefix length in ``cuts``: the smallest mixed span hashes of that prefix."""
    out = [np.zeros(0, np.uint64) for _ in cuts]
    for a in range(0, max(len(codes) - SPAN + 1, 0), CHUNK):
        h = span_hashes(codes[a:a + CHUNK + SPAN - 1])
        for i, cut in enumerate(cuts):
            part = h[:max(0, cut - SPAN + 1 - a)]
            if len(part):
                out[i] = _smallest(np.concatenate([out[i], _smallest(part)]))
    return out


def _short(codes: np.ndarray) -> np.ndarray:
    """Sketch of a text shorter than a span: its own hash, if any."""
    return span_hashes(codes, len(codes)) if len(codes) else np.zeros(0, np.uint64)


def render(n: int, whole: tuple[int, int], sketch: np.ndarray) -> str:
    top = (sketch >> np.uint64(64 - 4 * VALUE_HEX)).tolist()
    return f"{n:x}-{whole[0]:08x}{whole[1]:08x}-" + "".join(f"{v:0{VALUE_HEX}x}" for v in top)


def fingerprint(text: str | None) -> str:
    """The fingerprint of a whole text."""
    codes = code_points(text or "")
    sketch = sketches(codes, (len(codes),))[0] if len(codes) >= SPAN else _short(codes)
    return render(len(codes), Prefixes(codes).span(0, len(codes)), sketch)


def likeness(a: str, b: str) -> float:
    """Estimated share of common spans of two fingerprinted texts, 0 to 1."""
    if a == b:
        return 1.0
    sets = []
    for f in (a, b):
        values = f.rsplit("-", 1)[1]
        sets.append({values[i:i + VALUE_HEX] for i in range(0, len(values), VALUE_HEX)})
    union = sorted(sets[0] | sets[1])[:SKETCH]  # equal width, so text order is numeric order
    return sum(v in sets[0] and v in sets[1] for v in union) / len(union) if union else 0.0


class _Doc:
    """One document on its way: what its own row and its predecessor's need."""

    def __init__(self, doc_id, text: str, wanted: int):
        """``wanted``: code points the predecessor takes from the start."""
        self.doc_id, self.text = doc_id, text
        self.codes = code_points(text)
        n = len(self.codes)
        self.kept = n - n // 2  # code points that stay in the edited text
        self.lent = min(wanted, n)
        self.prefixes = Prefixes(self.codes)
        full, self.head, self.loan = sketches(self.codes, (n, self.kept, self.lent))
        self.print = render(n, self.prefixes.span(0, n), full if n >= SPAN else _short(self.codes))


def _row(doc: _Doc, nxt: _Doc) -> dict:
    n, kept, lent = len(doc.codes), doc.kept, nxt.lent
    edited = doc.text[:kept] + nxt.text[:lent]
    size = kept + lent
    if size >= SPAN:
        seam = np.concatenate([doc.codes[max(0, kept - SPAN + 1):kept], nxt.codes[:min(lent, SPAN - 1)]])
        sketch = _smallest(np.concatenate([doc.head, nxt.loan, span_hashes(seam)]))
    else:
        sketch = _short(np.concatenate([doc.codes[:kept], nxt.codes[:lent]]))
    head, tail = doc.prefixes.span(0, kept), nxt.prefixes.span(0, lent)
    whole = tuple((head[k] + tail[k] * pow(BASES[k], kept, PRIME)) % PRIME for k in range(2))
    edited_print = render(size, whole, sketch)
    # the edit keeps the first half, so the common start goes on into the replaced part
    common = kept + doc.prefixes.extension(kept, nxt.prefixes, 0)
    return {"doc_id": doc.doc_id, "n_chars": n,
            "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
            "fingerprint": doc.print, "edited_fingerprint": edited_print,
            "near_edited": likeness(doc.print, edited_print), "near_next": likeness(doc.print, nxt.print),
            "common_edited": min(common, n, size), "common_next": doc.prefixes.extension(0, nxt.prefixes, 0)}


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, common_edited long, common_next long")
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
                    ("near_next", pa.float64()), ("common_edited", pa.int64()), ("common_next", pa.int64())])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (range, borrowed, doc_id, text) in order: each document with the one after it."""
    before: _Doc | None = None
    at = None
    for b in batches:
        rows = []
        for r, borrowed, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(),
                                             strings(b.column(3))):
            if r != at:
                before, at = None, r
            if borrowed and before is None:
                continue
            doc = _Doc(doc_id, text, len(before.codes) // 2 if before else 0)
            if before is not None:
                rows.append(_row(before, doc))
            before = None if borrowed else doc
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def against_next(docs: DataFrame) -> DataFrame:
    """Fingerprint of every document and of its edited text, and its likeness to that and to the next document.

    ``common_edited`` and ``common_next`` are the lengths of the common start."""
    spark = docs.sparkSession
    text_batches(spark, 128)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(LOWEST))
    n = RANGES_PER_PARTITION * range_partitions(docs)
    found = rows.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n).alias("b"), F.max(key).alias("top")).first()
    # the greatest id of each range: as many numbers as ranges
    bounds = np.unique(np.array([*(found["b"] or []), *([found["top"]] if found["top"] is not None else [])], np.int64))
    shared = spark.sparkContext.broadcast(bounds)

    @F.arrow_udf("array<int>")
    def ranges(k: pa.Array) -> pa.Array:
        b, ids = shared.value, k.to_numpy(zero_copy_only=False)
        own = np.searchsorted(b, ids)
        return pa.array([[o, ~((o + 1) % len(b))] if b[o] == i else [o] for o, i in zip(own.tolist(), ids.tolist())],
                        type=pa.list_(pa.int32()))

    dealt = rows.withColumn("r", F.explode(ranges(key))).select(
        F.when(F.col("r") < 0, F.bitwise_not("r")).otherwise(F.col("r")).alias("range"), (F.col("r") < 0).alias("borrowed"),
        "doc_id", "text")
    ordered = dealt.repartition(range_partitions(docs), "range").sortWithinPartitions(
        "range", "borrowed", F.desc_nulls_last("doc_id"), F.md5("text"))
    return ordered.mapInArrow(_walk, SCHEMA)
