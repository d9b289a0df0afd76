r"""Secret scan with multipart credential linking, in DataFrame functions only.

Base kinds (leftmost non-overlapping matches; too short ones are dropped):
``assign`` a password, passwd, secret, token or api key followed by ``:`` or
``=`` and a value of 6 or more characters, ``access`` AKIA identifiers of 20 or
more characters, ``hex`` runs of 24 or more lower-case hexadecimal digits.

Weak parts say little alone: ``key`` (a stand-alone run of 40 base64
characters with a digit), ``ident`` (a client, account, user or login name
assigned) and ``endpoint`` (a URL). Two parts are complementary when they
stand in the same scope (a block of text between blank lines). A ``key`` is
reported with an identifier (``access`` or ``ident``) in its scope, an
``ident`` with a secret (``assign``, ``hex`` or ``key``), an ``endpoint`` with
both. Distance only grades the report: a weak part that does not find its
complements at most ``REACH`` characters away is marked ``far`` besides; all are
reported and masked.

Positions come from the text between matches: match i starts after pieces 0..i
and matches 0..i-1, a running sum in a window over one text's matches. The
links are left semi joins, so no pairs come out: on (text, scope) with the
distinct scopes that hold a role, and for the grade on (text, scope, cell of
``REACH`` characters), where a key holds at most the parts that fit in one cell.

Everything is keyed by the text's digest: equal texts are scanned into one set
of spans, which all their rows share, and a hot text is one key of narrow rows.

Defined results: a null text counts as empty and has no spans; repeated rows
and repeated or null ids keep their rows; offsets are code points, end
exclusive; nothing is dropped from a very long text; blank lines may end in LF or
CRLF; extra columns, whatever their names, come back unchanged from ``redact``
and are not read by ``scan``; an empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

REACH = 400
BROADCAST_SPANS = 100_000  # spans that redaction may broadcast (counted first)
CHUNK = 1000  # code points of a text that redaction cuts at a time
MASK = "[SECRET]"

# kind, pattern, group whose length counts, least length; in the order of the report
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # the runs of 24 and more among all runs
)
WEAK = (
    ("key", r"(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]{0,39}[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", 0, 40),
    ("ident", r"""(?i:client_?id|account(?:_?id)?|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]+)""", 1, 3),
    ("endpoint", r"""(?i:https?|ftp|amqp|redis|mongodb|mysql|postgres(?:ql)?|s3)://[^\s"'<>|]+""", 0, 8),
)
KINDS = tuple(k for k, *_ in BASE + WEAK)
SCOPE_BREAK = r"\r?\n[ \t]*\r?\n"
ROLE = {"assign": "secret", "hex": "secret", "key": "secret", "access": "identifier", "ident": "identifier",
        "endpoint": "endpoint"}


def _hits(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Per match: length and scope breaks of the text before it, its own and its counted length, whether that is enough."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    before = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    hits = F.transform(F.arrays_zip(before.alias("p"), found.alias("m"), sized.alias("v")), lambda x: F.struct(
        F.length(x["p"]).alias("gap"), F.regexp_count(x["p"], F.lit(SCOPE_BREAK)).alias("breaks"),
        F.length(x["m"]).alias("size"), F.length(x["v"]).alias("counted"), (F.length(x["v"]) >= least).alias("ok"),
        F.lit(KINDS.index(kind)).alias("kind")))
    return F.when(text.rlike(pattern), hits)


def _spans(texts: DataFrame) -> DataFrame:
    """digest, kind, start, end, scope of every match that is long enough, and where its counted part starts
    (``cut``; it goes on to the end); ``texts`` has one row per digest."""
    hits = None
    for c in KINDS:
        rows = texts.where(F.col(c).isNotNull()).select("digest", F.posexplode(c).alias("i", "h")).select("digest", "i", "h.*")
        hits = rows if hits is None else hits.unionByName(rows)
    upto = Window.partitionBy("digest", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(upto)
    return (hits.select("digest", "kind", end.cast("long").alias("end"), (end - F.col("size")).cast("long").alias("start"),
                        F.sum("breaks").over(upto).cast("long").alias("scope"),
                        (end - F.col("counted")).cast("long").alias("cut"), "ok")
            .where("ok").drop("ok"))


def _in_reach(parts: DataFrame, others: DataFrame) -> DataFrame:
    """Rows of ``parts`` with one of ``others`` in the same scope at most REACH characters away."""
    def cell(c: Column) -> Column:
        return F.floor(c / REACH)

    near = parts.withColumn("cell", F.explode(F.sequence(cell(F.col("start")) - 1, cell(F.col("end")) + 1)))
    far = others.select(
        F.col("digest").alias("k2"), F.col("scope").alias("s2"), F.col("start").alias("b2"), F.col("end").alias("e2"),
        F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))).alias("c2"))
    met = ((F.col("digest") == F.col("k2")) & (F.col("scope") == F.col("s2")) & (F.col("cell") == F.col("c2"))
           & (F.col("b2") - F.col("end") <= REACH) & (F.col("start") - F.col("e2") <= REACH))
    return near.join(far, met, "left_semi").drop("cell").distinct()


def _in_scope(parts: DataFrame, others: DataFrame) -> DataFrame:
    """Rows of ``parts`` with one of ``others`` in the same scope."""
    return parts.join(others.select("digest", "scope").distinct(), ["digest", "scope"], "left_semi").select(parts.columns)


def _link(spans: DataFrame) -> DataFrame:
    """The base spans and the weak ones whose complementary parts are in their scope; ``far``: not all in reach."""
    def of(*kinds: str) -> DataFrame:
        return spans.where(F.col("kind").isin([KINDS.index(k) for k in kinds]))

    secrets = of(*[k for k, role in ROLE.items() if role == "secret"])
    identifiers = of(*[k for k, role in ROLE.items() if role == "identifier"])

    def met(within) -> DataFrame:
        linked = within(of("key"), identifiers).unionByName(within(of("ident"), secrets))
        return linked.unionByName(within(within(of("endpoint"), identifiers), secrets))

    weak = met(_in_scope).withColumn("far", F.lit(True)).unionByName(met(_in_reach).withColumn("far", F.lit(False)))
    return of(*[k for k, *_ in BASE]).withColumn("far", F.lit(False)).unionByName(
        weak.groupBy(spans.columns).agg(F.min("far").alias("far")))


def find(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest of every row; digest, kind, start, end, cut, far of every reported span)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select(
        "doc_id", F.md5("text").alias("digest"), *[_hits(F.col("text"), *p).alias(p[0]) for p in BASE + WEAK])
    rows = materialize(rows, "secret-hits")
    texts = (rows.where(F.coalesce(*[F.size(k) for k in KINDS]) > 0)
             .groupBy("digest").agg(*[F.any_value(k).alias(k) for k in KINDS]))
    spans = materialize(_spans(texts), "secret-parts")
    return rows.select("doc_id", "digest"), _link(spans).select("digest", "kind", "start", "end", "cut", "far")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, ``spans`` (array of start, kind, end in order) of every document row, and ``far``, those among them
    that are linked by their scope alone."""
    rows, spans = find(docs)
    per_text = spans.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "far"))).alias("spans"))
    names = F.array(*[F.lit(k) for k in KINDS])
    found = F.coalesce("spans", F.array())

    def named(some: Column) -> Column:
        return F.transform(some, lambda s: F.struct(
            s["start"].alias("start"), F.get(names, s["kind"]).alias("kind"), s["end"].alias("end")))

    return rows.join(per_text, "digest", "left").select(
        "doc_id", named(found).alias("spans"), named(F.filter(found, lambda s: s["far"])).alias("far"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _cuts(spans: DataFrame) -> DataFrame:
    """digest and ``cuts``: the union of the counted parts of the text's spans, as (start, end) in order."""
    upto = Window.partitionBy("digest").orderBy("cut", "end")
    before = F.max("end").over(upto.rowsBetween(Window.unboundedPreceding, -1))
    parts = spans.select("digest", "cut", "end", F.coalesce(F.col("cut") >= before, F.lit(True)).cast("int").alias("new"))
    parts = parts.withColumn("part", F.sum("new").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = parts.groupBy("digest", "part").agg(F.min("cut").alias("start"), F.max("end").alias("end"))
    return whole.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))


def _masked(text: Column, cuts: Column) -> Column:
    """``text`` with ``cuts`` masked. It is read in pieces of CHUNK code points, so many cuts in a long text stay linear."""
    def between(chunks: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
        return F.substring(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""),
                           (a % CHUNK + 1).cast("int"), (b - a).cast("int"))

    zero, size = F.lit(0).cast("long"), F.length(text).cast("long")
    kept = F.arrays_zip(F.concat(F.array(zero), cuts["end"]).alias("a"), F.concat(cuts["start"], F.array(size)).alias("b"))
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    # the outer array binds the pieces once
    return F.array_join(F.flatten(F.transform(F.array(F.struct(chunks.alias("c"), kept.alias("k"))), lambda x: F.transform(
        x["k"], lambda g: between(x["c"], g["a"], g["b"])))), MASK)


def redact(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with every reported span masked in ``text`` (null stays null).

    Spans are those of the unchanged text and are cut by position, all at once: of ``assign`` and ``ident`` the
    value, of the other kinds the whole span; spans that overlap are masked as one."""
    _, spans = find(docs)
    cuts = materialize(_cuts(spans), "secret-cuts")
    n = cuts.agg(F.coalesce(F.sum(F.size("cuts")), F.lit(0))).first()[0]
    if not n:
        return docs
    # the document's columns stand in one, so that no name of theirs meets one of this join
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("digest"))
    marked = rows.join(F.broadcast(cuts) if n <= BROADCAST_SPANS else cuts, "digest", "left")
    text = F.col("row")["text"]
    masked = F.when(F.col("cuts").isNotNull(), _masked(text, F.col("cuts"))).otherwise(text)
    return marked.select(*[(masked if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
