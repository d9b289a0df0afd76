"""Registered queries of this subpackage and their DuckDB oracles."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from . import (bpe, fingerprints, html_extract, mixing, near_dedup, quality, secrets, spelling, suffix_dedup, suffix_tree,
               token_counts, topk, whitening)

BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
UNIGRAM_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every 50th vector with all others."""
    return topk.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document by the mix with weights 1, 2, 3."""
    return mixing.mix(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(read_table(spark, sf_dir, "pages"), "page_id", "url")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document (five-word shingles, similarity 0.8 and more)."""
    return near_dedup.near_classes(read_table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding of every document by the 50k byte-level vocabulary."""
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), BPE_RANKS, public_tokenizers.PATTERN, "doc_id")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base kinds, all spans with the linked ones, and those
    linked by their scope alone."""
    def kinds(*names: str):
        return F.filter("spans", lambda s: s["kind"].isin(*names))

    base = [k for k, *_ in secrets.BASE]
    return secrets.scan(read_table(spark, sf_dir, "documents")).select(
        "doc_id", *[F.size(kinds(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(secrets.spans_text(kinds(*base)), 256).alias("base_sha256"),
        secrets.spans_text(F.col("spans")).alias("spans"), secrets.spans_text(F.col("far")).alias("far_spans"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and likeness to that and to the next document."""
    return fingerprints.against_next(read_table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a 100-byte string with an earlier start covers, and the digest of the rest."""
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), digest_only=True)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of unigram pieces of every document."""
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), UNIGRAM_MODEL, "doc_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels outside the held-out fifth."""
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document by the suffix tree of nine tenths of them, and by its root."""
    return suffix_tree.score_documents(read_table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its form and root."""
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the 16 whitened components of greatest variance."""
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_top_k": op1_top_k,
    "op2_mix_sources": op2_mix_sources,
    "op3_html_text": op3_html_text,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_secrets": op6_secrets,
    "op7_fingerprints": op7_fingerprints,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_quality": op10_quality,
    "op11_suffix_tree": op11_suffix_tree,
    "op12_spelling": op12_spelling,
    "op13_whitening": op13_whitening,
}

OP2_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hash FROM documents),
sized AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM doc GROUP BY source),
src AS (
  SELECT source, source_size, CAST(3 * source_size AS DOUBLE) AS cap,
         CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight FROM sized),
tot AS (SELECT sum(source_size) AS t, sum(weight) AS w FROM src),
fill AS (
  SELECT 0 AS round, t / w AS level, 0 AS n FROM tot
  UNION ALL
  SELECT f.round + 1, (tot.t - s.c) / (tot.w - s.w), s.n
  FROM fill f, tot, LATERAL (
    SELECT CAST(count(*) AS INTEGER) AS n, coalesce(sum(cap), 0) AS c, coalesce(sum(weight), 0) AS w
    FROM src WHERE cap < f.level * weight) s
  WHERE s.n > f.n),
goal AS (
  SELECT source, source_size, CASE WHEN cap < level * weight THEN cap ELSE level * weight END AS target
  FROM src, (SELECT level FROM fill ORDER BY round DESC LIMIT 1)),
queued AS (
  SELECT d.*, g.source_size, g.target,
         sum(size) OVER (PARTITION BY d.source ORDER BY hash, doc_id, size ROWS UNBOUNDED PRECEDING) AS done
  FROM doc d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
copies AS (
  SELECT doc_id, size, (e * source_size + done) / target AS finish, hash, done
  FROM queued, range(0, 3) AS r(e) WHERE size > 0),
served AS (SELECT *, sum(size) OVER (ORDER BY finish, hash, doc_id, done, size ROWS UNBOUNDED PRECEDING) AS upto FROM copies),
took AS (SELECT doc_id, count(*) AS n FROM served, tot WHERE upto <= t GROUP BY doc_id)
SELECT q.doc_id, CAST(q.size AS BIGINT) AS size, q.source_size, q.target,
       CAST(q.size * coalesce(n, 0) AS BIGINT) AS taken
FROM queued q LEFT JOIN took USING (doc_id)
"""

OP1_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))), false)),
part AS (SELECT vec_id, unnest(v) AS w, generate_subscripts(v, 1) AS term FROM whole),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
  FROM part q JOIN part c ON q.term = c.term AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""

# crc32 over the UTF-8 bytes of '<doc_id>:<run>': its table from the polynomial, then one step a byte
OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS steps FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x:
             CASE WHEN a % 2 = 1 THEN xor(3988292384::BIGINT, a // 2) ELSE a // 2 END) AS v FROM range(256) AS r(i))),
found AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
runs AS (SELECT doc_id, run, count(*) AS n FROM found GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
           string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c:
             CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
                  ELSE [192 + unicode(c)::BIGINT // 64, 128 + unicode(c)::BIGINT % 64] END))),
         lambda a, b: xor(a // 256, steps[1 + xor(a % 256, b)]))) AS h FROM runs, crc),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
    FROM hashed) GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3),
skips AS (
  SELECT word, i, left(word, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM skips a JOIN skips b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT word, rest FROM skips WHERE rest IN (SELECT word FROM words)
  UNION SELECT rest, word FROM skips WHERE rest IN (SELECT word FROM words)),
best AS (
  SELECT near.word, count(*) AS n_near, arg_min(other, (-o.n, other)) AS other, max(o.n) AS other_n
  FROM near JOIN words o ON o.word = near.other GROUP BY near.word),
formed AS (
  SELECT w.word, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
         CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
steps AS (
  SELECT word, word AS root, 0 AS step FROM formed
  UNION ALL SELECT s.word, f.form, step + 1 FROM steps s JOIN formed f ON f.word = s.root WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, step) AS root FROM steps GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""

ORACLE_SQL = {"op1_top_k": OP1_SQL, "op2_mix_sources": OP2_SQL, "op12_spelling": OP12_SQL}
