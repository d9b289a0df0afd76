"""DuckDB SQL oracles, one per registered query that SQL can express.

They are written independently of the Spark plans (window functions and
plain joins where the Spark side avoids them for scale) and share only the
parameters: keep range, stop list, seeds, shares, sizes.
"""
from __future__ import annotations

from ..functions.constants import (
    BATCH_SIZE, DEFAULT_DROP_CLASS, EMOJI_CLASS_ENTRIES, MAX_LEN, TEST_SEED, TEST_SHARE,
    VALID_SEED, VALID_TRAIN_SHARE,
)
from .fixtures import (
    BATCH_EPOCHS, FIXTURE_STOP_WORDS, GRID, HEAD_ROWS, KEEP_SQL as KEEP, N_LOGITS, PEEK_POSITIONS, PRED_SQL, RAW_NEWS_LABEL_SQL,
    STOP_SHARE, TOKEN_DIM, TWO_CLASS_NAMES, VECTOR_DIM, VECTORS_PER_DOC,
)

ORACLE_SQL: dict[str, str] = {}

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in FIXTURE_STOP_WORDS)
_EMOJI = "[" + "".join(EMOJI_CLASS_ENTRIES) + "]+"
_HASH_LIMIT = int(TEST_SHARE * 2 ** 32)

BOOK_CTE = rf"""
book1 AS (SELECT doc_id, regexp_replace(text, '\n', '', 'g') AS t1 FROM documents),
book2 AS (SELECT doc_id, t1, regexp_replace(t1, '[^{KEEP}]', ' ', 'g') AS t2 FROM book1),
book3 AS (SELECT *, list_filter(string_split(t2, ' '), lambda x: x <> '') AS toks FROM book2),
book4 AS (SELECT *, array_to_string(list_filter(toks, lambda x: x NOT IN ({_STOP})), ' ') AS t7 FROM book3),
book AS (SELECT doc_id, t1, t2, toks, t7, regexp_replace(t7, '{DEFAULT_DROP_CLASS}', '', 'g') AS t5 FROM book4),
btok AS (SELECT doc_id, list_filter(string_split(t5, ' '), lambda x: x <> '') AS toks FROM book)"""

SPLIT_CTE = f"""
sh AS (SELECT doc_id, md5('{TEST_SEED}:' || CAST(doc_id AS VARCHAR)) AS hh FROM documents),
sr AS (SELECT doc_id, row_number() OVER (ORDER BY hh, doc_id) AS rn, count(*) OVER () AS n FROM sh),
d1 AS (SELECT doc_id, CASE WHEN rn <= ceil(CAST({TEST_SHARE} AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS split
       FROM sr)"""


def _valid_cte(rule: str) -> str:
    k = {"floor": f"floor(CAST({VALID_TRAIN_SHARE} AS DOUBLE) * n)",
         "round": f"round_even(CAST({VALID_TRAIN_SHARE} AS DOUBLE) * n, 0)"}[rule]
    return SPLIT_CTE + f""",
vr AS (SELECT doc_id, row_number() OVER (ORDER BY md5('{VALID_SEED}:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn,
              count(*) OVER () AS n FROM d1 WHERE split = 'train'),
d2 AS (SELECT doc_id, CASE WHEN rn <= {k} THEN 'train' ELSE 'valid' END AS split FROM vr
       UNION ALL SELECT doc_id, split FROM d1 WHERE split = 'test')"""


VOCAB_CTE = BOOK_CTE + f""",
vc AS (SELECT token, count(*) AS cnt FROM (SELECT unnest(toks) AS token FROM btok) GROUP BY token),
vr0 AS (SELECT token, cnt, row_number() OVER (ORDER BY cnt DESC, token) AS rn FROM vc),
vocab AS (SELECT token, CAST(rn + 3 AS INTEGER) AS id, CAST(cnt AS BIGINT) AS cnt FROM vr0),
body AS (SELECT doc_id, list_slice(toks, 1, {MAX_LEN - 2}) AS body FROM btok),
ex AS (SELECT doc_id, unnest(body) AS token, generate_subscripts(body, 1) AS pos FROM body),
exj AS (SELECT ex.doc_id, ex.pos, coalesce(v.id, 1) AS id, coalesce(v.token, '<unk>') AS tok
        FROM ex LEFT JOIN vocab v ON ex.token = v.token),
grp AS (SELECT doc_id, list(id ORDER BY pos) AS ids, list(tok ORDER BY pos) AS toks FROM exj GROUP BY doc_id),
enc AS (SELECT body.doc_id, list_concat([2], coalesce(grp.ids, []::INTEGER[]), [3]) AS ids,
               list_concat(['<s>'], coalesce(grp.toks, []::VARCHAR[]), ['</s>']) AS toks
        FROM body LEFT JOIN grp ON body.doc_id = grp.doc_id)"""

LEN_CTE = BOOK_CTE + f""",
lens AS (SELECT doc_id, CAST(least(len(toks), {MAX_LEN - 2}) + 2 AS INTEGER) AS n_tokens FROM btok)"""


def _hms(x: str) -> str:
    s = f"CAST(round_even({x}, 0) AS BIGINT)"
    hms = f"printf('%d:%02d:%02d', ({s} % 86400) // 3600, ({s} % 3600) // 60, {s} % 60)"
    return (f"CASE WHEN {s} >= 86400 THEN CAST({s} // 86400 AS VARCHAR) || "
            f"CASE WHEN {s} // 86400 = 1 THEN ' day, ' ELSE ' days, ' END || {hms} ELSE {hms} END")


LOGIT_CTE = f"""
lg AS (SELECT vec_id, label AS target, list_transform(range(1, {N_LOGITS + 1}), lambda j: list_sum(list_transform(
              range(1, len(embedding) + 1), lambda i: CAST(embedding[i] AS DOUBLE) * cos(i * j)))) AS l
       FROM embeddings),
sc AS (SELECT vec_id, target, CAST(list_position(l, list_max(l)) - 1 AS INTEGER) AS pred,
              list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))) - l[target + 1] AS loss
       FROM lg)"""

EVENTS_CTE = f"""
em AS (SELECT event_id, ts, user_id, event_type, value AS loss,
              CAST(date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) + 1 AS INTEGER) AS epoch,
              CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END AS ok,
              CASE WHEN CAST('0x' || substr(md5('{VALID_SEED}:' || CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT)
                        < {_HASH_LIMIT} THEN 'valid' ELSE 'train' END AS phase
       FROM events),
ep AS (SELECT epoch, phase, avg(loss) AS loss, avg(ok) AS acc,
              (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS secs, count(*) AS n,
              CAST(sum(1 - ok) AS BIGINT) AS n_err
       FROM em GROUP BY epoch, phase),
hist AS (SELECT epoch,
                max(CASE WHEN phase = 'train' THEN loss END) AS train_loss,
                max(CASE WHEN phase = 'train' THEN acc END) AS train_acc,
                max(CASE WHEN phase = 'valid' THEN loss END) AS valid_loss,
                max(CASE WHEN phase = 'valid' THEN acc END) AS valid_acc,
                max(CASE WHEN phase = 'train' THEN secs END) AS train_secs,
                max(CASE WHEN phase = 'valid' THEN secs END) AS valid_secs
         FROM ep GROUP BY epoch),
hist2 AS (SELECT epoch, round(train_loss, 6) AS train_loss, round(train_acc, 6) AS train_acc,
                 round(valid_loss, 6) AS valid_loss, round(valid_acc, 6) AS valid_acc,
                 {_hms('train_secs')} AS train_time, {_hms('valid_secs')} AS valid_time,
                 coalesce(valid_loss < min(valid_loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                          true) AS improved
          FROM hist)"""


def _name(col: str) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in TWO_CLASS_NAMES.items())
    return f"CASE {col} {whens} ELSE CAST({col} AS VARCHAR) END"


def _report(t: str, p: str) -> str:
    return f"""WITH c AS (SELECT {t} AS t, {p} AS p, CAST(count(*) AS DOUBLE) AS n FROM
        (SELECT quality AS target, CAST({PRED_SQL} AS INTEGER) AS pred FROM labels) GROUP BY 1, 2),
labs AS (SELECT t AS label FROM c UNION SELECT p FROM c),
tt AS (SELECT t AS label, sum(n) AS support FROM c GROUP BY 1),
pp AS (SELECT p AS label, sum(n) AS predicted FROM c GROUP BY 1),
dd AS (SELECT t AS label, sum(n) AS tp FROM c WHERE t = p GROUP BY 1),
per AS (SELECT labs.label, coalesce(support, 0.0) AS support, coalesce(predicted, 0.0) AS predicted,
               coalesce(tp, 0.0) AS tp
        FROM labs LEFT JOIN tt ON labs.label = tt.label LEFT JOIN pp ON labs.label = pp.label
             LEFT JOIN dd ON labs.label = dd.label),
pr AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS prec,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec FROM per),
f AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM pr),
tot AS (SELECT sum(support) AS total, sum(tp) AS tp, avg(prec) AS mp, avg(rec) AS mr, avg(f1) AS mf,
               sum(prec * support) AS wp, sum(rec * support) AS wr, sum(f1 * support) AS wf FROM f)
SELECT {_name('label')} AS class, round(prec, 6) AS precision, round(rec, 6) AS recall,
       round(f1, 6) AS f1_score, round(support, 6) AS support FROM f
UNION ALL SELECT 'accuracy', round(tp / total, 6), round(tp / total, 6), round(tp / total, 6), round(tp / total, 6) FROM tot
UNION ALL SELECT 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), round(total, 6) FROM tot
UNION ALL SELECT 'weighted avg', round(wp / total, 6), round(wr / total, 6), round(wf / total, 6), round(total, 6) FROM tot"""


ORACLE_SQL["union_corpora"] = """
WITH u AS (SELECT 0 AS part, 'documents' AS corpus, doc_id AS k1, CAST(0 AS BIGINT) AS k2, text AS Data,
                  0 AS Sentiment FROM documents
           UNION ALL
           SELECT 1, 'conversations', conv_id, turn, text, 1 FROM conversations)
SELECT CAST(row_number() OVER (ORDER BY part, k1, k2) - 1 AS BIGINT) AS row_id, corpus, Data,
       CAST(Sentiment AS INTEGER) AS Sentiment FROM u"""

ORACLE_SQL["index_aligned_join"] = """
SELECT doc_id, d.text AS Data, l.quality AS Sentiment FROM documents d FULL OUTER JOIN labels l USING (doc_id)"""

ORACLE_SQL["two_class_variant"] = f"""
WITH r AS (SELECT doc_id, CAST({RAW_NEWS_LABEL_SQL} AS INTEGER) AS raw_label FROM labels),
s AS (SELECT doc_id, raw_label, CAST(CASE raw_label WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS INTEGER) AS Sentiment
      FROM r)
SELECT s.doc_id, raw_label, Sentiment FROM documents d JOIN s ON d.doc_id = s.doc_id WHERE Sentiment <> 2"""

ORACLE_SQL["clean_book"] = "WITH" + BOOK_CTE + """
SELECT doc_id, t1 AS t1_no_newlines, t2 AS t2_keep_range, CAST(len(toks) AS INTEGER) AS n_tokens,
       t7 AS t7_no_stop, t5 AS t5_final, length(trim(t5)) = 0 AS is_empty FROM book"""


def _comment(table: str, keys: str) -> str:
    return rf"""
WITH c3 AS (SELECT {keys}, regexp_replace(text, '{_EMOJI}', '', 'g') AS t3 FROM {table}),
c4 AS (SELECT *, trim(regexp_replace(t3, '[^.\x{{0964}} {KEEP}]', '', 'g')) AS t4 FROM c3),
c5 AS (SELECT *, regexp_replace(t4, '{DEFAULT_DROP_CLASS}', '', 'g') AS t5 FROM c4)
SELECT {keys}, t3 AS t3_no_emoji, t4 AS t4_keep_only, t5 AS t5_final, length(trim(t5)) = 0 AS is_empty FROM c5"""


ORACLE_SQL["clean_comment"] = _comment("documents", "doc_id")
ORACLE_SQL["clean_conversations"] = _comment("conversations", "conv_id, turn")

ORACLE_SQL["label_distribution"] = "WITH" + BOOK_CTE + """
SELECT l.quality AS Sentiment, count(*) AS n_rows, CAST(sum(CASE WHEN length(trim(t5)) = 0 THEN 0 ELSE 1 END) AS BIGINT)
       AS n_nonempty
FROM book JOIN labels l ON book.doc_id = l.doc_id GROUP BY l.quality"""

ORACLE_SQL["test_target_counts"] = "WITH" + SPLIT_CTE + """
SELECT l.quality AS target, count(*) AS n_rows FROM d1 JOIN labels l ON d1.doc_id = l.doc_id
WHERE split = 'test' GROUP BY l.quality"""

_PROFILE_COLS = [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int"), ("text", "string"),
                 ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]
ORACLE_SQL["table_profile"] = """
WITH j AS (SELECT d.doc_id, l.quality, l.toxic, d.text, d.lang, d.source, d.n_chars
           FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id)
""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, count({c}) AS non_null, count(*) AS n_rows FROM j"
    for c, t in _PROFILE_COLS)

ORACLE_SQL["row_peek"] = f"""
WITH r AS (SELECT doc_id, text AS Data, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS pos FROM documents)
SELECT 'head' AS kind, pos, doc_id, Data FROM r WHERE pos < {HEAD_ROWS}
UNION ALL
SELECT 'iloc', pos, doc_id, Data FROM r WHERE pos IN ({", ".join(map(str, PEEK_POSITIONS))})"""

ORACLE_SQL["split_train_test"] = "WITH" + SPLIT_CTE + "\nSELECT doc_id, split FROM d1"
ORACLE_SQL["split_valid_floor"] = "WITH" + _valid_cte("floor") + "\nSELECT doc_id, split FROM d2"
ORACLE_SQL["split_valid_round"] = "WITH" + _valid_cte("round") + "\nSELECT doc_id, split FROM d2"
ORACLE_SQL["split_hash"] = f"""
SELECT doc_id, CASE WHEN CAST('0x' || substr(md5('{TEST_SEED}:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT)
                         < {_HASH_LIMIT} THEN 'test' ELSE 'train' END AS split FROM documents"""
ORACLE_SQL["split_shares"] = "WITH" + _valid_cte("floor") + """
SELECT split, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM d2 GROUP BY split"""

ORACLE_SQL["vocab"] = "WITH" + VOCAB_CTE + "\nSELECT token, id, cnt AS count FROM vocab"

ORACLE_SQL["encode"] = "WITH" + VOCAB_CTE + f"""
SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_tokens,
       array_to_string(list_resize(ids, {MAX_LEN}, 0), ' ') AS input_ids,
       array_to_string(list_resize(list_transform(ids, lambda x: 1), {MAX_LEN}, 0), ' ') AS attention_mask
FROM enc"""

ORACLE_SQL["decode"] = "WITH" + VOCAB_CTE + "\nSELECT doc_id, array_to_string(toks, ' ') AS tokens FROM enc"

ORACLE_SQL["max_length"] = "WITH" + LEN_CTE + "," + SPLIT_CTE + """
SELECT CAST(max(n_tokens) AS INTEGER) AS max_len FROM lens JOIN d1 ON lens.doc_id = d1.doc_id WHERE split = 'train'"""

_BATCHED = "WITH" + LEN_CTE + "," + SPLIT_CTE + f""",
bb AS (SELECT lens.doc_id, split, n_tokens,
              CAST((row_number() OVER (PARTITION BY split ORDER BY n_tokens, lens.doc_id) - 1) // {BATCH_SIZE} AS BIGINT)
              AS batch_id
       FROM lens JOIN d1 ON lens.doc_id = d1.doc_id),
bp AS (SELECT *, CAST(max(n_tokens) OVER (PARTITION BY split, batch_id) AS INTEGER) AS pad_to FROM bb)"""

ORACLE_SQL["bucket_batches"] = _BATCHED + "\nSELECT doc_id, split, n_tokens, batch_id, pad_to FROM bp"
ORACLE_SQL["padding_waste"] = _BATCHED + """
SELECT split, CAST(sum(pad_to - n_tokens) AS BIGINT) AS pad_cells, CAST(sum(pad_to) AS BIGINT) AS cells,
       round(sum(pad_to - n_tokens) / sum(pad_to), 6) AS waste FROM bp GROUP BY split"""

ORACLE_SQL["sequential_batches"] = "WITH" + SPLIT_CTE + f"""
SELECT doc_id, split,
       CAST((row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1) // {BATCH_SIZE} AS BIGINT) AS batch_id FROM d1"""

ORACLE_SQL["random_batches"] = "WITH" + SPLIT_CTE + f"""
SELECT doc_id, split,
       CAST((row_number() OVER (PARTITION BY split ORDER BY md5('{VALID_SEED}:' || CAST(doc_id AS VARCHAR)), doc_id) - 1)
            // {BATCH_SIZE} AS BIGINT) AS batch_id FROM d1"""

ORACLE_SQL["label_index"] = "WITH" + SPLIT_CTE + """,
o AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1),
q AS (SELECT CAST(quality AS VARCHAR) AS label, count(*) AS n FROM labels l JOIN d1 ON l.doc_id = d1.doc_id
      WHERE split = 'train' GROUP BY 1)
SELECT 'orders' AS source, label, n, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS INTEGER) AS idx FROM o
UNION ALL
SELECT 'labels', label, n, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS INTEGER) FROM q"""

ORACLE_SQL["argmax_accuracy"] = "WITH" + LOGIT_CTE + """
SELECT vec_id, target, pred, pred = target AS is_correct FROM sc"""

ORACLE_SQL["accuracy"] = "WITH" + LOGIT_CTE + """
SELECT count(*) AS n_rows, CAST(sum(CASE WHEN pred = target THEN 1 ELSE 0 END) AS BIGINT) AS n_correct,
       round(avg(CASE WHEN pred = target THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM sc"""

ORACLE_SQL["batch_mean_metrics"] = "WITH" + LOGIT_CTE + f""",
b AS (SELECT *, (row_number() OVER (ORDER BY vec_id) - 1) // {BATCH_SIZE} AS batch_id,
             CASE WHEN pred = target THEN 1.0 ELSE 0.0 END AS ok FROM sc),
per AS (SELECT batch_id, count(*) AS n, avg(ok) AS acc, avg(loss) AS l, sum(ok) AS c, sum(loss) AS sl
        FROM b GROUP BY batch_id)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_batches, round(sum(c) / sum(n), 6) AS accuracy,
       round(avg(acc), 6) AS mean_batch_accuracy, round(sum(sl) / sum(n), 6) AS loss,
       round(avg(l), 6) AS mean_batch_loss FROM per"""

ORACLE_SQL["cross_entropy"] = "WITH" + LOGIT_CTE + "\nSELECT vec_id, target, round(loss, 6) AS loss FROM sc"

ORACLE_SQL["confusion"] = f"""
SELECT quality AS target, CAST({PRED_SQL} AS INTEGER) AS pred, count(*) AS n FROM labels GROUP BY 1, 2"""

ORACLE_SQL["classification_report"] = _report("target", "pred")
ORACLE_SQL["classification_report_reference"] = _report("pred", "target")

ORACLE_SQL["history"] = "WITH" + EVENTS_CTE + """
SELECT epoch, train_loss, train_acc, valid_loss, valid_acc, train_time, valid_time, improved FROM hist2"""

ORACLE_SQL["best_epoch"] = "WITH" + EVENTS_CTE + """,
best AS (SELECT epoch AS best_epoch, valid_loss AS best_loss, valid_acc AS best_acc FROM hist
         ORDER BY valid_loss, epoch LIMIT 1),
last AS (SELECT epoch AS last_epoch, valid_acc AS last_acc FROM hist ORDER BY epoch DESC LIMIT 1)
SELECT best_epoch, round(best_loss, 6) AS best_loss, round(best_acc, 6) AS best_acc, last_epoch,
       round(last_acc, 6) AS last_acc FROM best, last"""

ORACLE_SQL["history_long"] = "WITH" + EVENTS_CTE + "\n" + "\nUNION ALL\n".join(
    f"SELECT epoch, '{s}' AS series, {s} AS value FROM hist2"
    for s in ("train_loss", "train_acc", "valid_loss", "valid_acc"))

ORACLE_SQL["class_weights"] = """
SELECT quality AS Sentiment, count(*) AS n, round(1.0 / count(*), 9) AS weight FROM labels GROUP BY quality"""

_GRID_VALUES = ",\n    ".join(
    f"('{m}', '{d}', {k}, {size}, {str(w).lower()}, '{rule}', {e}, CAST({lr} AS DOUBLE), CAST({wd} AS DOUBLE))"
    for m, d, k, size, w, rule, e, lr, wd in GRID)
GRID_CTE = f"""
grid(model, dataset, classes, feature_size, weighted, rule, epochs, learning_rate, weight_decay) AS (VALUES
    {_GRID_VALUES}),
total(dataset, n) AS (SELECT 'embeddings', count(*) FROM embeddings
    UNION ALL SELECT 'documents', count(*) FROM documents JOIN labels USING (doc_id)),
tested AS (SELECT grid.*, n, CAST(ceil(CAST({TEST_SHARE} AS DOUBLE) * n) AS BIGINT) AS n_test FROM grid JOIN total USING (dataset)),
sized AS (SELECT *, CAST(CASE rule WHEN 'floor' THEN floor(CAST({VALID_TRAIN_SHARE} AS DOUBLE) * (n - n_test))
                         ELSE round_even(CAST({VALID_TRAIN_SHARE} AS DOUBLE) * (n - n_test), 0) END AS BIGINT) AS n_train FROM tested),
runs AS (SELECT *, n - n_test - n_train AS n_valid FROM sized)"""

ORACLE_SQL["run_ranking"] = "WITH" + GRID_CTE + """
SELECT dataset, CAST(classes AS INTEGER) AS classes, count(*) AS n_runs, CAST(count(*) AS INTEGER) AS last_rank, max(n_test) AS n_test,
       true AS ranks_follow_accuracy, true AS rates_in_range
FROM runs GROUP BY dataset, classes"""

ORACLE_SQL["format_times"] = "WITH" + EVENTS_CTE + f""",
fu AS (SELECT *, (n_err * 20000 + n) // (2 * n) AS units FROM ep)
SELECT epoch, phase, format('{{:,}}', n) AS n_events_text,
       CAST(units // 100 AS VARCHAR) || '.' || lpad(CAST(units % 100 AS VARCHAR), 2, '0') || '%' AS error_share_text,
       printf('%.3f', loss) AS loss_text,
       {_hms('secs')} AS elapsed_text, CAST(trunc(secs / 60) AS INTEGER) AS minutes,
       CAST(trunc(secs - trunc(secs / 60) * 60) AS INTEGER) AS seconds
FROM fu"""

ORACLE_SQL["max_pool"] = f"""
WITH e AS (SELECT vec_id // {VECTORS_PER_DOC} AS doc, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS d
           FROM embeddings),
v AS (SELECT doc, CAST(d AS INTEGER) AS feature, CAST(max(x) AS DOUBLE) AS value FROM e GROUP BY doc, d
      UNION ALL
      SELECT doc, CAST(d + {VECTOR_DIM} AS INTEGER), avg(CAST(x AS DOUBLE)) FROM e GROUP BY doc, d)
SELECT doc, feature, round(value, 6) AS value, round(tanh(value), 6) AS tanh_value FROM v"""

ORACLE_SQL["pooled_tokens"] = "WITH" + VOCAB_CTE + f""",
u AS (SELECT doc_id, unnest(ids) AS id FROM enc),
c AS (SELECT doc_id, id, count(*) AS c FROM u GROUP BY ALL),
x AS (SELECT doc_id, c, i, ((CAST(id AS BIGINT) * (2 * i + 1) + i) % 101 - 50) / CAST(64 AS DOUBLE) AS x
      FROM c, LATERAL (SELECT unnest(range({TOKEN_DIM})) AS i)),
g AS (SELECT doc_id, i, CAST(sum(c) AS BIGINT) AS n_pooled, max(x) AS mx, sum(c * x) / sum(c) AS mn FROM x GROUP BY doc_id, i),
v AS (SELECT doc_id, n_pooled, CAST(i AS INTEGER) AS feature, mx AS value FROM g
      UNION ALL SELECT doc_id, n_pooled, CAST(i + {TOKEN_DIM} AS INTEGER), mn FROM g)
SELECT doc_id, n_pooled, feature, value, round(tanh(value), 6) AS tanh_value FROM v"""

ORACLE_SQL["train_frozen"] = f"""
WITH h AS (SELECT label, row_number() OVER (ORDER BY md5('{TEST_SEED}:' || CAST(vec_id AS VARCHAR)), vec_id) AS rn,
                  count(*) OVER () AS n FROM embeddings),
t AS (SELECT label FROM h WHERE rn <= ceil(CAST({TEST_SHARE} AS DOUBLE) * n)),
r AS (SELECT CAST(label AS VARCHAR) AS class, count(*) AS support FROM t GROUP BY label
      UNION ALL SELECT unnest(['macro avg', 'weighted avg']), count(*) FROM t)
SELECT class, CAST(support AS DOUBLE) AS support, true AS rates_in_range, true AS agrees, true AS learned FROM r"""

ORACLE_SQL["train_text"] = f"""
WITH h AS (SELECT quality, row_number() OVER (ORDER BY md5('{TEST_SEED}:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn,
                  count(*) OVER () AS n FROM documents JOIN labels USING (doc_id)),
t AS (SELECT quality FROM h WHERE rn <= ceil(CAST({TEST_SHARE} AS DOUBLE) * n)),
r AS (SELECT {_name('quality')} AS class, count(*) AS support FROM t GROUP BY quality
      UNION ALL SELECT unnest(['macro avg', 'weighted avg']), count(*) FROM t)
SELECT class, CAST(support AS DOUBLE) AS support, true AS rates_in_range, true AS agrees, true AS learned FROM r"""

ORACLE_SQL["score_table"] = "WITH" + LOGIT_CTE + "\nSELECT vec_id, target, pred, round(loss, 6) AS loss FROM sc"

ORACLE_SQL["io_csv_roundtrip"] = "WITH" + BOOK_CTE + "\nSELECT doc_id, t2 AS t2_keep_range, t5 AS t5_final FROM book"

ORACLE_SQL["io_indexed_roundtrip"] = "WITH" + BOOK_CTE + """
SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS row_id, t2 AS t2_keep_range, t5 AS t5_final FROM book"""

ORACLE_SQL["io_lines_roundtrip"] = "SELECT text AS Data, 1 AS Sentiment FROM documents"

ORACLE_SQL["io_positional_roundtrip"] = """
SELECT d.text AS text, CAST(l.quality AS VARCHAR) AS labels FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id"""

ORACLE_SQL["io_csv_ranges"] = "SELECT doc_id, text, source FROM documents"

ORACLE_SQL["io_fields"] = "WITH" + VOCAB_CTE + """,
li AS (SELECT q, CAST(row_number() OVER (ORDER BY n DESC, q) - 1 AS INTEGER) AS idx
       FROM (SELECT CAST(quality AS VARCHAR) AS q, count(*) AS n FROM labels JOIN documents USING (doc_id)
             WHERE quality IS NOT NULL GROUP BY 1))
SELECT e.doc_id, array_to_string(list_transform(e.ids, lambda x: CAST(x AS VARCHAR)), ' ') AS input_ids, li.idx AS label
FROM enc e LEFT JOIN labels l ON e.doc_id = l.doc_id LEFT JOIN li ON li.q = CAST(l.quality AS VARCHAR)"""

STOP_CTE = VOCAB_CTE + f""",
inl AS (SELECT doc_id, unnest(list_distinct(toks)) AS word FROM btok),
stopw AS (SELECT word FROM inl GROUP BY word HAVING count(*) > {STOP_SHARE} * (SELECT count(*) FROM documents))"""

ORACLE_SQL["io_stop_words"] = "WITH" + STOP_CTE + "\nSELECT word FROM stopw"

ORACLE_SQL["io_corpus_partition"] = "WITH" + SPLIT_CTE + f""",
r AS (SELECT doc_id, CAST({RAW_NEWS_LABEL_SQL} AS INTEGER) AS raw FROM labels)
SELECT d.doc_id, d.text AS Data, CAST(CASE raw WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS INTEGER) AS Sentiment,
       'documents' AS dataset, '2class' AS variant, split
FROM documents d JOIN d1 USING (doc_id) JOIN r USING (doc_id) WHERE split = 'test' AND raw <> 0"""

ORACLE_SQL["results_roundtrip"] = "WITH" + GRID_CTE + """
SELECT model, CAST(classes AS INTEGER) AS classes, dataset, CAST(feature_size AS INTEGER) AS feature_size, weighted,
       CAST(epochs AS INTEGER) AS epochs, 'Adam' AS optimizer, learning_rate, weight_decay, 'CrossEntropyLoss' AS loss_function,
       n_train, n_valid, n_test, round(n_train / n, 6) AS train_share, round(n_valid / n, 6) AS valid_share,
       round(n_test / n, 6) AS test_share
FROM runs WHERE dataset = 'documents'"""

ORACLE_SQL["report_roundtrip"] = ORACLE_SQL["classification_report"]

ORACLE_SQL["stream_clean_comment"] = ORACLE_SQL["clean_comment"]

ORACLE_SQL["stream_label_counts"] = "SELECT quality AS Sentiment, count(*) AS n_rows FROM labels GROUP BY quality"

ORACLE_SQL["stream_confusion"] = ORACLE_SQL["confusion"]

ORACLE_SQL["stream_report"] = ORACLE_SQL["classification_report"]

ORACLE_SQL["stream_profile"] = ORACLE_SQL["table_profile"] + """
UNION ALL
SELECT 'longest text', 'bigint', CAST(max(length(text)) AS BIGINT), count(*) FROM j"""

ORACLE_SQL["sql_functions"] = "WITH" + BOOK_CTE + rf""",
c3 AS (SELECT doc_id, regexp_replace(text, '{_EMOJI}', '', 'g') AS t3 FROM documents),
c5 AS (SELECT doc_id, regexp_replace(trim(regexp_replace(t3, '[^.\x{{0964}} {KEEP}]', '', 'g')),
                                     '{DEFAULT_DROP_CLASS}', '', 'g') AS tc FROM c3)
SELECT book.doc_id, t7 AS t8_book, tc AS t9_comment FROM book JOIN c5 ON book.doc_id = c5.doc_id"""

ORACLE_SQL["io_review_table"] = """
SELECT d.doc_id AS row_id, d.text AS Data, l.quality AS Sentiment FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id"""

ORACLE_SQL["stop_words_table"] = "WITH" + STOP_CTE + """,
stopt AS (SELECT coalesce(list(word), []) AS sl FROM stopw)
SELECT doc_id, array_to_string(list_filter(toks, lambda x: NOT list_contains(sl, x)), ' ') AS t7_no_stop
FROM book, stopt"""

ORACLE_SQL["split_sizes"] = "WITH" + _valid_cte("floor") + """
SELECT split, count(*) AS n_rows, 6 AS n_cols FROM documents d JOIN d2 ON d.doc_id = d2.doc_id GROUP BY split"""

ORACLE_SQL["label_index_apply"] = """
WITH c AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1),
i AS (SELECT label, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS INTEGER) AS idx FROM c)
SELECT o_orderkey, o_orderpriority AS label, idx FROM orders JOIN i ON orders.o_orderpriority = i.label"""

ORACLE_SQL["regex_tokenize"] = r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '\p{L}+')) AS INTEGER) AS n_tokens,
       array_to_string(regexp_extract_all(text, '\p{L}+'), ' ') AS tokens FROM documents"""

ORACLE_SQL["run_history_table"] = "WITH" + GRID_CTE + """
SELECT true AS learned, model, CAST(classes AS INTEGER) AS classes, dataset, CAST(epoch AS INTEGER) AS epoch,
       CASE WHEN epoch = 1 THEN round(ln(classes), 6) END AS start_loss, true AS best_is_lowest, true AS rates_in_range,
       n_train, n_valid, n_test, 'Adam' AS optimizer, learning_rate, weight_decay, 'CrossEntropyLoss' AS loss_function
FROM runs, LATERAL (SELECT unnest(range(1, epochs + 1)) AS epoch)"""

ORACLE_SQL["run_resume"] = "WITH" + GRID_CTE + """
SELECT model, CAST(epoch AS INTEGER) AS epoch, n_train, n_valid, CAST(0 AS DOUBLE) AS train_difference,
       CAST(0 AS DOUBLE) AS valid_difference, true AS same_weights
FROM runs, LATERAL (SELECT unnest(range(1, epochs + 1)) AS epoch) WHERE dataset = 'documents'"""

ORACLE_SQL["run_batch_metrics"] = f"""
WITH h AS (SELECT vec_id, md5('{VALID_SEED}:' || CAST(vec_id AS VARCHAR)) AS hv,
                  row_number() OVER (ORDER BY md5('{TEST_SEED}:' || CAST(vec_id AS VARCHAR)), vec_id) AS rn, count(*) OVER () AS n
           FROM embeddings),
o AS (SELECT *, row_number() OVER (ORDER BY hv, vec_id) AS rv, count(*) OVER () AS nv FROM h
      WHERE rn > ceil(CAST({TEST_SHARE} AS DOUBLE) * n)),
p AS (SELECT vec_id, hv, CASE WHEN rv <= floor(CAST({VALID_TRAIN_SHARE} AS DOUBLE) * nv) THEN 'train' ELSE 'valid' END AS phase FROM o),
b AS (SELECT vec_id, phase, CAST((row_number() OVER (PARTITION BY phase ORDER BY hv, vec_id) - 1) // {BATCH_SIZE} AS BIGINT) AS batch_id FROM p)
SELECT CAST(epoch AS INTEGER) AS epoch, phase, batch_id, count(*) AS n_rows, CAST(sum(vec_id) AS BIGINT) AS key_sum,
       true AS rate_in_range, true AS learned
FROM b, LATERAL (SELECT unnest(range(1, {BATCH_EPOCHS} + 1)) AS epoch) GROUP BY ALL"""

ORACLE_SQL["score_encoded"] = "WITH" + VOCAB_CTE + """,
each AS (SELECT doc_id, unnest(ids) AS id FROM enc),
z AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n_tokens, sum((id + 1) % 101) / count(*) / 10 AS z0,
             sum((id + 2) * 3 % 101) / count(*) / 10 AS z1, sum((id + 3) * 5 % 101) / count(*) / 10 AS z2 FROM each GROUP BY doc_id),
scored AS (SELECT z.*, CAST(quality AS INTEGER) AS target, greatest(z0, z1, z2) AS top FROM z LEFT JOIN labels USING (doc_id))
SELECT doc_id, n_tokens, target, CAST(CASE top WHEN z0 THEN 0 WHEN z1 THEN 1 ELSE 2 END AS INTEGER) AS pred,
       round(ln(exp(z0) + exp(z1) + exp(z2)) - CASE target WHEN 0 THEN z0 WHEN 1 THEN z1 END, 6) AS loss FROM scored"""

ORACLE_SQL["duplicate_keys"] = """
SELECT conv_id, count(*)::BIGINT AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1"""

ORACLE_SQL["batch_padded"] = "WITH" + VOCAB_CTE + f""",
lens AS (SELECT doc_id, CAST(least(len(toks), {MAX_LEN - 2}) + 2 AS INTEGER) AS n_tokens FROM btok),""" + SPLIT_CTE + f""",
bb AS (SELECT lens.doc_id, split, n_tokens,
              CAST((row_number() OVER (PARTITION BY split ORDER BY n_tokens, lens.doc_id) - 1) // {BATCH_SIZE} AS BIGINT)
              AS batch_id
       FROM lens JOIN d1 ON lens.doc_id = d1.doc_id),
bp AS (SELECT *, CAST(max(n_tokens) OVER (PARTITION BY split, batch_id) AS INTEGER) AS pad_to FROM bb)
SELECT enc.doc_id, bp.split, bp.batch_id, bp.pad_to,
       array_to_string(list_resize(enc.ids, bp.pad_to, 0), ' ') AS input_ids,
       array_to_string(list_resize(list_transform(enc.ids, lambda x: 1), bp.pad_to, 0), ' ') AS attention_mask
FROM enc JOIN bp ON enc.doc_id = bp.doc_id"""
