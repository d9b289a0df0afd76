"""Near-duplicate classes by DartMinHash.

A text is the set of its five-word shingles (runs of other than white space),
weighted 1 (``weights="presence"``, plain Jaccard) or by count.

Signature: hashed darts fall on the plane (weight of an element) x (rank). The
weight axis of an element is cut into regions [2^v - 1, 2^(v+1) - 1); in each,
darts arrive along the rank axis as a Poisson process whose gaps, weight
coordinates and target coordinates come from hashes of (element, region,
arrival). A dart hits a text if its weight coordinate is under the element's
weight, so texts share the darts of what they share. Ranks up to (k ln k + 2k) /
(total weight) are thrown, the earliest dart of each of the k coordinates is
kept; a text with an empty coordinate throws on. Coordinates agree with
probability equal to the weighted Jaccard similarity; the cost is the number
of elements plus the darts, not elements times k.

Links: coordinates are joined in bands into bucket keys. In a bucket, texts are
compared with its hub (the text that meets most others), exactly, on their
whole shingle sets. Links give classes (connected components). A bucket that
still holds texts of several classes is then compared whole, in blocks of
``BLOCK`` texts: all pairs across classes are decided exactly inside a task by
an inverted index, and a task returns at most one link per text that it
joined. So no pair list of a bucket ever comes out, and no link between texts
that share a bucket can be missed: it is either found or its ends already are
in one class.

Equal texts are collapsed first (partial aggregation), so copies cost nothing.
Hubs with many partners are salted. Only texts with a partner move (a bounded
bitmap of digests leaves out the others). Intermediate tables are written under the
shared checkpoint folder.

Defined results: class id is the smallest doc_id of the class; a null text
counts as empty; texts without words form one class; repeated rows and
repeated or null ids keep their rows (a class without any id has a null id);
two texts of fewer than five words are alike only if their words are equal.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import may_hold, mix64, text_batches, utf8
from .shingles import weighted_sets

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5  # at similarity 0.8 all bands miss with probability 3e-6
BLOCK = 512
HUB_PARTNERS = 512  # partners of a hub in one task
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


# ---- signatures -------------------------------------------------------------

def _uniform(h: np.ndarray) -> np.ndarray:
    """(0, 1] from the upper 53 bits."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def dart_signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """(texts, k) earliest dart per coordinate; sets are (elements uint64, weights > 0); 0 for an empty set."""
    out = np.zeros((len(sets), k), np.uint64)
    throws = k * np.log(k) + 2 * k
    todo = [i for i, (e, _) in enumerate(sets) if len(e)]
    factor = 1.0
    while todo:
        kept = _throw([sets[i] for i in todo], k, throws * factor)
        full = (kept != 0).all(axis=1)
        out[np.array(todo)[full]] = kept[full]
        todo = [i for i, f in zip(todo, full) if not f]
        factor *= 2
    return out


def _throw(sets: list[tuple[np.ndarray, np.ndarray]], k: int, throws: float) -> np.ndarray:
    sizes = np.array([len(e) for e, _ in sets])
    text = np.repeat(np.arange(len(sets)), sizes)
    element = np.concatenate([e for e, _ in sets])
    weight = np.concatenate([w for _, w in sets]).astype(np.float64)
    limit = throws / np.bincount(text, weight)
    # regions of the weight axis below each weight
    regions = np.maximum(np.ceil(np.log2(weight + 1)).astype(np.int64), 1)
    region = np.arange(regions.sum()) - np.repeat(np.cumsum(regions) - regions, regions)
    owner, seed = np.repeat(text, regions), np.repeat(element, regions)
    weight = np.repeat(weight, regions)
    low, width = 2.0**region - 1, 2.0**region
    seed = mix64(seed + GOLDEN * (region.astype(np.uint64) + np.uint64(1)))
    bound = limit[owner]
    rank = np.zeros(len(seed))
    slots, ranks, darts = [], [], []
    while len(seed):
        seed = mix64(seed + GOLDEN)
        rank = rank - np.log(_uniform(seed)) / width
        on = rank <= bound
        seed, rank, bound, owner, weight, low, width = (x[on] for x in (seed, rank, bound, owner, weight, low, width))
        dart = mix64(seed ^ np.uint64(0x5851F42D4C957F2D))
        hit = (low + width * _uniform(mix64(dart + GOLDEN)) <= weight)
        slots.append(owner[hit] * k + (dart[hit] % np.uint64(k)).astype(np.int64))
        ranks.append(rank[hit])
        darts.append(dart[hit] | np.uint64(1))
    slot, rank, dart = np.concatenate(slots), np.concatenate(ranks), np.concatenate(darts)
    earliest = np.full(len(sets) * k, np.inf)
    np.minimum.at(earliest, slot, rank)
    kept = np.zeros(len(sets) * k, np.uint64)
    won = rank == earliest[slot]
    kept[slot[won]] = dart[won]
    return kept.reshape(len(sets), k)


def _sets(text: pa.Array, weights: str) -> list[tuple[np.ndarray, np.ndarray]]:
    raw, off = utf8(text)
    return [(e, c if weights == "count" else np.ones(len(e), np.int64)) for e, c in weighted_sets(raw, off, WORDS)]


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) bucket keys: the band's coordinates and its number, hashed."""
    key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(signature), axis=0)
    for r in range(rows):
        key = mix64(key * GOLDEN + signature[:, r::rows][:, :bands])
    return key.view(np.int64)


def signatures(docs: DataFrame, weights: str) -> DataFrame:
    """doc_id, digest and ``buckets`` (empty without words) of every row."""
    @F.arrow_udf("array<long>")
    def buckets(text: pa.Array) -> pa.Array:
        parts, sizes = [], []
        for a in range(0, len(text), 128):  # bounds the darts in memory
            sets = _sets(text.slice(a, 128), weights)
            keys = band_keys(dart_signatures(sets, BANDS * ROWS), BANDS, ROWS)
            some = np.array([len(e) > 0 for e, _ in sets], bool)
            parts.append(keys[some].reshape(-1))
            sizes += (some * BANDS).tolist()
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(np.cumsum([0, *sizes]).astype(np.int32), pa.array(flat))

    return docs.select("doc_id", digest().alias("digest"), buckets(F.coalesce("text", F.lit(""))).alias("buckets"))


def digest() -> Column:
    """Key of a text; all texts without words share one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.md5(text)).otherwise("")


# ---- exact comparison ---------------------------------------------------------

def _weight_sums(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.array([w.sum() for _, w in sets], dtype=np.float64)


def _alike(shared: np.ndarray, a: float, b: np.ndarray, least: float) -> np.ndarray:
    return shared >= least * (a + b - shared) - 1e-9


def _with_hub(weights: str, least: float):
    """Rows (hub, salt, member, node, text) in order, the hub's own row first in each group -> links."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own, total = None, None, 0.0
        for b in batches:
            sets = _sets(b.column(4), weights)
            a_out, b_out = [], []
            hubs, members, nodes = (b.column(i).to_pylist() for i in (0, 2, 3))
            for h, member, node, (e, w) in zip(hubs, members, nodes, sets):
                if not member:
                    hub, own, total = h, (e, w), float(w.sum())
                elif h == hub:
                    _, i, j = np.intersect1d(own[0], e, assume_unique=True, return_indices=True)
                    shared = np.minimum(own[1][i], w[j]).sum()
                    if _alike(shared, total, float(w.sum()), least):
                        a_out.append(hub)
                        b_out.append(node)
            if a_out:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    return compare


def block_links(nodes: list[int], classes: list[int], sides: list[int], sets: list[tuple[np.ndarray, np.ndarray]],
                least: float) -> list[tuple[int, int]]:
    """Links that join different classes among the given texts; pairs within one class are not compared.

    ``sides``: 0 and 1 are the two blocks of a pair of blocks, compared across; all 0 for one block."""
    parent = {c: c for c in classes}

    def find(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    across = 1 in sides
    left = [i for i, s in enumerate(sides) if s == 0]
    right = np.array([i for i, s in enumerate(sides) if s == 1] if across else left)
    if len(right) == 0 or not left:
        return []
    # postings of the right block: element -> (text, weight)
    owner = np.repeat(np.arange(len(right)), [len(sets[i][0]) for i in right])
    element = np.concatenate([sets[i][0] for i in right])
    weight = np.concatenate([sets[i][1] for i in right])
    order = np.argsort(element, kind="stable")
    element, owner, weight = element[order], owner[order], weight[order]
    totals = _weight_sums([sets[i] for i in right])
    kinds = np.array([classes[i] for i in right])
    links = []
    for place, i in enumerate(left):
        e, w = sets[i]
        lo, hi = np.searchsorted(element, e, "left"), np.searchsorted(element, e, "right")
        size = hi - lo
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        shared = np.bincount(owner[at], np.minimum(weight[at], np.repeat(w, size)), len(right))
        alike = _alike(shared, float(w.sum()), totals, least) & (kinds != classes[i])
        if not across:
            alike[:place + 1] = False
        for j in np.flatnonzero(alike):
            x, y = find(classes[i]), find(int(kinds[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append((nodes[i], nodes[int(right[j])]))
    return links


def _within_bucket(weights: str, least: float):
    """Rows (bucket, i, j, side, node, class, text) in order of the first three -> links."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [], [])

        def done():
            links = block_links(*held, least)
            return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in links], pa.int64()),
                                               "b": pa.array([b for _, b in links], pa.int64())})

        for b in batches:
            sets = _sets(b.column(6), weights)
            rows = zip(*(b.column(i).to_pylist() for i in range(6)), sets)
            for bucket, i, j, side, node, cls, s in rows:
                if (bucket, i, j) != key:
                    if key is not None:
                        yield done()
                    key, held = (bucket, i, j), ([], [], [], [])
                for column, value in zip(held, (node, cls, side, s)):
                    column.append(value)
        if key is not None:
            yield done()

    return compare


# ---- classes ------------------------------------------------------------------

def components(links: DataFrame, name: str) -> DataFrame:
    """(node, class = smallest node of the component) for all ends of ``links`` (a, b).

    Each round every node takes the smallest label among itself and its
    neighbours, then the label of its label; rounds grow with the logarithm of
    a component's width. Rounds are written, so lineage stays short."""
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
                       name + "-edges")
    label = materialize(both.groupBy("a").agg(F.min("b").alias("m"))
                        .select(F.col("a").alias("node"), F.least("a", "m").alias("class")), name + "-labels")
    while True:
        near = (both.join(label.select(F.col("node").alias("b"), "class"), "b")
                .groupBy("a").agg(F.min("class").alias("m")))
        stepped = label.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("class").alias("was"), F.least("class", "m").alias("class"))
        jump = label.select(F.col("node").alias("class"), F.col("class").alias("further"))
        nxt = materialize(stepped.join(jump, "class").select("node", "was", F.least("class", "further").alias("class")),
                          name + "-labels")
        if nxt.where(F.col("was") != F.col("class")).isEmpty():
            return nxt.select("node", "class")
        label = nxt.select("node", "class")


def _compare_with_hubs(pairs: DataFrame, texts: DataFrame, weights: str, least: float) -> DataFrame:
    """Links among ``pairs`` (hub, node); each partner's text moves once, a hub's once per salt."""
    partners = pairs.groupBy("hub").agg(F.count("*").alias("n"))
    salted = pairs.join(partners, "hub").withColumn(
        "salt", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / HUB_PARTNERS)).cast("int")).drop("n")
    rows = salted.join(texts, "node").select("hub", "salt", F.lit(True).alias("member"), "node", "text")
    own = salted.select("hub", "salt").distinct().join(texts.withColumnRenamed("node", "hub"), "hub").select(
        "hub", "salt", F.lit(False).alias("member"), F.col("hub").alias("node"), "text")
    dealt = rows.unionByName(own).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member")
    return dealt.mapInArrow(_with_hub(weights, least), "a long, b long")


def _compare_in_buckets(members: DataFrame, classes: DataFrame, texts: DataFrame, weights: str, least: float,
                        block: int) -> DataFrame:
    """Links between texts of different classes that share a bucket (bucket, node)."""
    named = members.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    mixed = (named.groupBy("bucket").agg(F.count("*").alias("n"), F.min("class").alias("lo"), F.max("class").alias("hi"),
                                         F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("who"))
             .where((F.col("n") > 2) & (F.col("lo") < F.col("hi")))  # of two, one is the hub
             .groupBy("n", "who").agg(F.min("bucket").alias("bucket")))  # the same texts meet in many bands: once is enough
    rows = named.join(mixed.select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "bucket")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least("own", o).alias("i"), F.greatest("own", o).alias("j"),
        F.when(o < F.col("own"), 1).otherwise(0).alias("side")))
    rows = rows.withColumn("pair", F.explode(pair)).select("bucket", "pair.*", "node", "class")
    dealt = (rows.join(texts, "node").select("bucket", "i", "j", "side", "node", "class", "text")
             .repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j"))
    return dealt.mapInArrow(_within_bucket(weights, least), "a long, b long")


def classes(docs: DataFrame, weights: str = "presence", least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """doc_id, digest, first_id (the smallest id of the same text), class_id, keep_digest (the text that stands for the class)."""
    text_batches(docs.sparkSession, 256)
    rows = materialize(signatures(docs, weights), "near-rows")
    distinct = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.any_value("buckets").alias("buckets"))
    distinct = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "near-texts")
    listed = distinct.select("node", F.explode("buckets").alias("bucket"))  # keys hold the band: a text has each once
    shared = listed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(listed.join(shared, "bucket"), "near-members")
    # hubs: the text of each bucket that meets most others in all its buckets
    reach = members.groupBy("node").agg(F.sum("n").alias("reach"))
    hubs = (members.join(reach, "node").groupBy("bucket")
            .agg(F.max(F.struct("reach", (-F.col("node")).alias("minus"))).alias("top"))
            .select("bucket", (-F.col("top.minus")).alias("hub")))
    pairs = materialize(members.join(hubs, "bucket").where(F.col("node") != F.col("hub")).select("hub", "node").distinct(),
                        "near-pairs")
    involved = distinct.join(members.select("node").distinct(), "node").select("digest", "node", "first_id")
    involved = materialize(involved, "near-involved")
    texts = may_hold(docs.select("doc_id", "text", digest().alias("digest")), involved, "digest")
    texts = materialize(texts.join(involved, (texts["digest"] == involved["digest"])
                                   & F.col("doc_id").eqNullSafe(F.col("first_id"))).select("node", "text"), "near-compared")
    links = materialize(_compare_with_hubs(pairs, texts, weights, least), "near-links")
    first = components(links, "near-first")
    more = materialize(_compare_in_buckets(members.select("bucket", "node"), first, texts, weights, least, block), "near-more")
    found = components(links.unionByName(more), "near-classes") if not more.isEmpty() else first
    labelled = distinct.select("digest", "node", "first_id").join(found, "node", "left").withColumn(
        "class", F.coalesce("class", "node"))
    # the class's smallest id and the text that has it (partial aggregation: a class may be large)
    best = labelled.groupBy("class").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "digest")).alias("m"))
    table = labelled.join(best, "class").select("digest", "first_id", F.col("m.first_id").alias("class_id"),
                                                F.col("m.digest").alias("keep_digest"))
    return rows.select("doc_id", "digest").join(table, "digest")


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id of every document row."""
    return classes(docs).select("doc_id", "class_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, all columns (of any name), one of each class: the one with the smallest doc_id."""
    table = classes(docs)
    kept = (table.where((F.col("digest") == F.col("keep_digest")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
            .groupBy(F.col("digest").alias("kept_digest")).agg(F.any_value("first_id").alias("kept_id")))
    # the document's columns stand in one, so that no name of theirs meets one of this join
    rows = docs.select(F.struct(*docs.columns).alias("row"), digest().alias("key"), F.col("doc_id").alias("id"))
    met = rows.join(kept, (F.col("key") == F.col("kept_digest")) & F.col("id").eqNullSafe(F.col("kept_id")))
    # repeated rows of one id and text: any one of them
    return met.dropDuplicates(["key"]).select("row.*")
