"""DuckDB SQL for each registered query (the correctness oracle).

Each statement runs on the driver's parquet tables registered as views and
returns the same column names as the Spark query.  Written independently of
the DataFrame code, from the operator semantics."""

from __future__ import annotations

from corpusflow.functions.labels import NEGATIVE_TERMS, POSITIVE_TERMS
from corpusflow.plans.fixtures import PREDICTIONS_SQL, STEP_LOG_SQL

NL = "chr(10)"
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
EPS = "CAST(1e-8 AS DOUBLE)"


def _strip(x: str) -> str:
    return f"trim({x}, {WS})"


def _string_label(x: str) -> str:
    s = f"lower({_strip(x)})"
    pos = " OR ".join(f"contains({s}, '{t}')" for t in POSITIVE_TERMS)
    neg = " OR ".join(f"contains({s}, '{t}')" for t in NEGATIVE_TERMS)
    return (f"(CASE WHEN {x} IS NULL THEN 0 WHEN {pos} THEN 1 WHEN {neg} THEN 0 "
            f"WHEN {s} IN ('none', 'neutral', 'clean') THEN 0 "
            f"WHEN regexp_full_match({s}, '[0-9]+') THEN (CASE WHEN regexp_matches({s}, '[1-9]') THEN 1 ELSE 0 END) "
            f"ELSE 0 END)")


def _numeric_label(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL OR isnan(CAST({x} AS DOUBLE)) OR isinf(CAST({x} AS DOUBLE)) THEN 0 "
            f"WHEN {x} >= 1 THEN 1 ELSE 0 END)")


def _rank(order: str, source: str, cols: str = "*") -> str:
    return f"SELECT {cols}, row_number() OVER (ORDER BY {order}) - 1 AS rk, count(*) OVER () AS n FROM {source}"


def _seed_key(seed: int, id_expr: str) -> str:
    return f"md5('{seed}:' || CAST({id_expr} AS VARCHAR))"


def _lines_cte(src: str) -> str:
    return (f"SELECT doc_id, unnest(string_split(text, {NL})) AS line, "
            f"generate_subscripts(string_split(text, {NL}), 1) - 1 AS pos FROM {src}")


def _paragraph_dedup(src: str, min_len: int = 50) -> str:
    """CTE body list that defines ls, kept, re from the documents in ``src``."""
    return f"""
ls AS (SELECT doc_id, pos, line, {_strip('line')} AS s FROM ({_lines_cte(src)})),
kept AS (SELECT doc_id, pos, line FROM ls WHERE length(s) < {min_len}
         UNION ALL
         SELECT doc_id, pos, line FROM ls WHERE length(s) >= {min_len}
         QUALIFY row_number() OVER (PARTITION BY md5(s) ORDER BY doc_id, pos) = 1),
re AS (SELECT doc_id, string_agg(line, {NL} ORDER BY pos) AS text FROM kept GROUP BY doc_id)"""


PREPROCESS = f"""
WITH f AS (SELECT * FROM documents WHERE length(text) >= 100),
d1 AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1),
{_paragraph_dedup('d1')}
SELECT d1.doc_id, re.text, d1.lang, d1.source, d1.n_chars FROM d1 JOIN re USING (doc_id)
WHERE length(re.text) >= 100"""

LABELLED = "(SELECT d.doc_id, d.text, CAST(l.toxic AS INTEGER) AS label FROM documents d JOIN labels l USING (doc_id))"


def _split3_sql(src: str, seed: int, tr: str, va: str, id_expr: str = "doc_id", cols: str = "doc_id") -> str:
    return f"""
SELECT {cols}, CASE WHEN rk < n_tr THEN 'train' WHEN rk < n_tr + n_va THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, greatest(1, CAST(floor(n * {tr}) AS BIGINT)) AS n_tr,
                greatest(1, CAST(floor(n * {va}) AS BIGINT)) AS n_va
      FROM ({_rank(f"{_seed_key(seed, id_expr)}, {id_expr}", src)}))"""


SPLIT3_LABELLED = _split3_sql(LABELLED, 42, "CAST(0.8 AS DOUBLE)", "CAST(0.1 AS DOUBLE)", cols="doc_id, text, label")


def _metric_cols(c: str) -> str:
    return f"""
SELECT *, CASE WHEN total > 0 THEN correct / total ELSE 0.0 END AS accuracy,
       tp / (tp + fp + {EPS}) AS precision, tp / (tp + fn + {EPS}) AS recall FROM ({c})"""


def _binary_counts(src: str, pred: str, label: str = "label", group: str = "run") -> str:
    g = f"{group}, " if group else ""
    gb = f" GROUP BY {group}" if group else ""
    return f"""
SELECT {g}CAST(count(*) AS DOUBLE) AS total, CAST(count_if({pred} = {label}) AS DOUBLE) AS correct,
       CAST(count_if({pred} = 1 AND {label} = 1) AS DOUBLE) AS tp,
       CAST(count_if({pred} = 1 AND {label} = 0) AS DOUBLE) AS fp,
       CAST(count_if({pred} = 0 AND {label} = 1) AS DOUBLE) AS fn
FROM {src}{gb}"""


def _binary_metrics(src: str, pred: str, group: str = "run") -> str:
    g = f"{group}, " if group else ""
    return f"""
SELECT {g}accuracy, precision, recall, 2 * precision * recall / (precision + recall + {EPS}) AS f1
FROM ({_metric_cols(_binary_counts(src, pred, group=group))})"""


P = f"({PREDICTIONS_SQL})"
LOG = f"({STEP_LOG_SQL})"

SQL: dict[str, str] = {
    "preprocess_corpus": PREPROCESS,
    "preprocess_corpus_document": """
SELECT * FROM documents WHERE length(text) >= 100
QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1""",
    "dedup_documents": """
SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1""",
    "dedup_paragraphs": f"""
WITH {_paragraph_dedup('documents').lstrip()}
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars_out, md5(text) AS text_md5 FROM re""",
    "reduction_report": f"""
WITH out AS ({PREPROCESS}),
a AS (SELECT (SELECT count(*) FROM documents) AS docs_in, (SELECT count(*) FROM out) AS docs_out,
             (SELECT coalesce(sum(length(text)), 0) FROM documents WHERE length(text) >= 100) AS chars_in,
             (SELECT coalesce(sum(length(text)), 0) FROM out) AS chars_out)
SELECT CAST(docs_in AS BIGINT) AS docs_in, CAST(docs_out AS BIGINT) AS docs_out,
       CAST(chars_in AS BIGINT) AS chars_in, CAST(chars_out AS BIGINT) AS chars_out,
       round(100 * (1 - docs_out / greatest(1, docs_in)), 6) AS doc_reduction_pct,
       round(100 * (1 - chars_out / greatest(1, chars_in)), 6) AS char_reduction_pct FROM a""",
    "distinct_keep_first": """
SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
    "clean_texts": f"""
SELECT conv_id, turn, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5
FROM (SELECT conv_id, turn, {_strip('text')} AS t FROM conversations) WHERE length(t) >= 15""",
    "content_hash": "SELECT doc_id, md5(text) AS hash FROM documents",
    "collapse_whitespace": f"""
SELECT doc_id, CAST(length(c) AS BIGINT) AS n_chars, md5(c) AS text_md5
FROM (SELECT doc_id, {_strip("regexp_replace(text, '\\s+', ' ', 'g')")} AS c FROM documents)""",
    "filter_min_length": "SELECT doc_id, lang FROM documents WHERE length(text) >= 200",
    "labelled_documents": f"SELECT doc_id, label, CAST(length(text) AS BIGINT) AS n_chars FROM {LABELLED}",
    "to_binary_label": f"""
SELECT l.doc_id,
       CAST({_numeric_label('l.toxic')} AS INTEGER) AS from_int,
       CAST({_string_label('CAST(l.toxic AS VARCHAR)')} AS INTEGER) AS from_str,
       CAST({_numeric_label('(CAST(l.quality AS DOUBLE) * 1.5)')} AS INTEGER) AS from_double,
       CAST({_string_label('d.source')} AS INTEGER) AS from_source,
       CAST({_string_label('d.lang')} AS INTEGER) AS from_lang
FROM labels l JOIN documents d USING (doc_id)""",
    "split3": f"SELECT doc_id, split FROM ({SPLIT3_LABELLED})",
    "split2_tail": f"""
SELECT doc_id, CASE WHEN rk < n - n_va THEN 'train' ELSE 'validation' END AS split
FROM (SELECT *, CASE WHEN v0 >= n THEN greatest(least(n // 5, n - 1), 1) ELSE v0 END AS n_va
      FROM (SELECT *, greatest(1, CAST(floor(n * CAST(0.1 AS DOUBLE)) AS BIGINT)) AS v0
            FROM ({_rank(f"{_seed_key(42, 'doc_id')}, doc_id", 'documents', 'doc_id')})))""",
    "split2_head": f"""
WITH u AS (SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1)
SELECT doc_id, CASE WHEN rk < n_va THEN 'validation' ELSE 'train' END AS split
FROM (SELECT *, CASE WHEN n > 1 THEN least(greatest(1, CAST(floor(n * CAST(0.1 AS DOUBLE)) AS BIGINT)), n - 1)
                     ELSE 0 END AS n_va
      FROM ({_rank(f"{_seed_key(42, 'doc_id')}, doc_id", 'u')}))""",
    "sample_n": f"""
SELECT doc_id, source FROM ({_rank(f"{_seed_key(7, 'doc_id')}, doc_id", 'documents', 'doc_id, source')})
WHERE rk < 100""",
    "combine_and_split": f"""
WITH first AS (SELECT 'doc:' || CAST(doc_id AS VARCHAR) AS uid, label, split
               FROM ({_split3_sql(LABELLED, 7, "CAST(0.7 AS DOUBLE)", "CAST(0.2 AS DOUBLE)", cols="doc_id, label")})),
ratios AS (SELECT CAST(count_if(split = 'train') AS DOUBLE) / count(*) AS r_tr,
                  CAST(count_if(split = 'validation') AS DOUBLE) / count(*) AS r_va FROM first),
second AS (SELECT 'conv:' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS uid,
                  CAST({_string_label('role')} AS INTEGER) AS label FROM conversations),
u AS (SELECT uid, label FROM first UNION ALL SELECT uid, label FROM second),
r AS ({_rank(f"{_seed_key(11, 'uid')}, uid", 'u')})
SELECT uid, label, CASE WHEN rk < n_tr THEN 'train' WHEN rk < n_tr + n_va THEN 'validation' ELSE 'test' END AS split
FROM (SELECT r.*, greatest(1, CAST(floor(n * r_tr) AS BIGINT)) AS n_tr,
             greatest(1, CAST(floor(n * r_va) AS BIGINT)) AS n_va FROM r, ratios)""",
    "dataset_stats": f"""
WITH s AS ({SPLIT3_LABELLED})
SELECT split, count(*) AS total_rows, round(avg(length(text)), 9) AS avg_text_length,
       round(CAST(median(length(text)) AS DOUBLE), 9) AS median_text_length FROM s GROUP BY split
UNION ALL
SELECT 'combined', count(*), round(avg(length(text)), 9), round(CAST(median(length(text)) AS DOUBLE), 9) FROM s""",
    "class_breakdown": f"""
WITH s AS ({SPLIT3_LABELLED}),
t AS (SELECT split, count(*) AS total FROM s GROUP BY split UNION ALL SELECT 'combined', count(*) FROM s),
c AS (SELECT split, label, count(*) AS class_count FROM s WHERE label IS NOT NULL GROUP BY split, label
      UNION ALL SELECT 'combined', label, count(*) FROM s WHERE label IS NOT NULL GROUP BY label)
SELECT c.split, c.label, CAST(c.class_count AS BIGINT) AS class_count,
       round(c.class_count / t.total * 100.0, 9) AS class_pct FROM c JOIN t USING (split)""",
    "value_counts": "SELECT lang, count(*) AS count FROM documents WHERE lang IS NOT NULL GROUP BY lang",
    "n_unique": "SELECT count(DISTINCT source) AS n_unique FROM documents",
    "source_counts": "SELECT source, count(*) AS n_rows FROM documents GROUP BY source",
    "label_ids": """
WITH m AS (SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS label_id
           FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL))
SELECT d.doc_id, m.label_id FROM documents d LEFT JOIN m USING (lang)""",
    "label_names": f"""
WITH m AS (SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS label_id
           FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL))
SELECT p.doc_id, coalesce(m.lang, CAST(p.pred AS VARCHAR)) AS label_name
FROM (SELECT doc_id, pred_b * 3 AS pred FROM {P}) p LEFT JOIN m ON m.label_id = p.pred""",
    "binary_metrics": f"""
SELECT run, round(accuracy, 9) AS accuracy, round(precision, 9) AS precision, round(recall, 9) AS recall,
       round(f1, 9) AS f1 FROM ({_binary_metrics(P, 'pred_b')})""",
    "macro_metrics": f"""
WITH p AS {P},
cls AS (SELECT DISTINCT run, label AS cls FROM p),
pc AS (SELECT c.run, c.cls,
              CAST(count_if(p.pred_a = c.cls AND p.label = c.cls) AS DOUBLE) AS tp,
              CAST(count_if(p.pred_a = c.cls AND p.label <> c.cls) AS DOUBLE) AS fp,
              CAST(count_if(p.pred_a <> c.cls AND p.label = c.cls) AS DOUBLE) AS fn
       FROM cls c JOIN p ON p.run = c.run GROUP BY c.run, c.cls),
prf AS (SELECT run, tp / (tp + fp + {EPS}) AS pr, tp / (tp + fn + {EPS}) AS rc FROM pc),
mac AS (SELECT run, avg(pr) AS precision, avg(rc) AS recall, avg(2 * pr * rc / (pr + rc + {EPS})) AS f1
        FROM prf GROUP BY run),
acc AS (SELECT run, avg(CASE WHEN pred_a = label THEN 1.0 ELSE 0.0 END) AS accuracy FROM p GROUP BY run)
SELECT run, round(accuracy, 9) AS accuracy, round(precision, 9) AS precision, round(recall, 9) AS recall,
       round(f1, 9) AS f1 FROM acc JOIN mac USING (run)""",
    "batched_metrics": f"""
WITH p AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch FROM {P} WHERE pred_a <> -1),
b AS ({_binary_metrics('p', 'pred_a', 'batch')})
SELECT round(avg(accuracy), 9) AS accuracy, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall,
       round(avg(f1), 9) AS f1, round(stddev_pop(accuracy), 9) AS accuracy_std,
       round(stddev_pop(precision), 9) AS precision_std, round(stddev_pop(recall), 9) AS recall_std,
       round(stddev_pop(f1), 9) AS f1_std, count(*) AS n_batches FROM b""",
    "multi_run_summary": f"""
WITH m AS ({_binary_metrics(P, 'pred_b')}),
l AS (SELECT 'accuracy' AS metric, accuracy AS value FROM m UNION ALL SELECT 'precision', precision FROM m
      UNION ALL SELECT 'recall', recall FROM m UNION ALL SELECT 'f1', f1 FROM m)
SELECT 'test' AS split, metric, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS std,
       count(*) AS n_runs FROM l GROUP BY metric""",
    "model_agreement": f"""
SELECT count(*) AS n_samples, round(avg(CASE WHEN pred_a = label THEN 1.0 ELSE 0.0 END), 9) AS accuracy_a,
       round(avg(CASE WHEN pred_b = label THEN 1.0 ELSE 0.0 END), 9) AS accuracy_b,
       CAST(count_if(pred_a = label AND pred_b <> label) AS BIGINT) AS a_only_correct,
       CAST(count_if(pred_b = label AND pred_a <> label) AS BIGINT) AS b_only_correct,
       CAST(count_if(pred_a = label AND pred_b = label) AS BIGINT) AS both_correct,
       CAST(count_if(pred_a <> label AND pred_b <> label) AS BIGINT) AS both_wrong
FROM {P} WHERE pred_a <> -1 AND pred_b <> -1""",
    "category_samples": f"""
WITH c AS (SELECT doc_id, CASE WHEN pred_a = label AND pred_b <> label THEN 'a_only'
                              WHEN pred_b = label AND pred_a <> label THEN 'b_only'
                              WHEN pred_a = label AND pred_b = label THEN 'both_correct'
                              ELSE 'both_wrong' END AS category
           FROM {P} WHERE pred_a <> -1 AND pred_b <> -1)
SELECT doc_id, category, CAST(rank AS INTEGER) AS rank FROM (
  SELECT doc_id, category, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS rank
  FROM c WHERE category <> 'both_correct') WHERE rank <= 20""",
    "top_errors": f"""
(SELECT doc_id, 'false_positive' AS error, round(conf_b, 9) AS conf FROM {P}
 WHERE label = 0 AND pred_b = 1 ORDER BY conf_b DESC, doc_id LIMIT 20)
UNION ALL
(SELECT doc_id, 'false_negative' AS error, round(conf_b, 9) AS conf FROM {P}
 WHERE label = 1 AND pred_b = 0 ORDER BY conf_b DESC, doc_id LIMIT 20)""",
    "softmax_scores": """
WITH e AS (SELECT vec_id, list_transform(range(10), lambda c: list_sum(list_transform(
               range(c, len(embedding), 10), lambda d: CAST(embedding[d + 1] AS DOUBLE)))) AS a FROM embeddings),
x AS (SELECT vec_id, list_transform(a, lambda v: exp(v - list_max(a))) AS ex FROM e),
p AS (SELECT vec_id, list_transform(ex, lambda v: v / list_sum(ex)) AS p FROM x)
SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS pred,
       round(p[list_position(p, list_max(p))], 6) AS conf, round(list_max(p), 6) AS max_prob,
       CASE WHEN p[2] >= 0.5 THEN 1 ELSE 0 END AS thresholded FROM p""",
    "running_loss": f"""
WITH l AS (SELECT run, step, loss, n_tokens, row_number() OVER (PARTITION BY run ORDER BY step) AS step_no
           FROM {LOG} WHERE loss IS NOT NULL),
c AS (SELECT run, step, step_no,
             sum(loss * n_tokens) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS cl,
             sum(n_tokens) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS cn FROM l)
SELECT run, step_no, step, round(cl / greatest(cn, 1.0), 6) AS running_loss,
       round(exp(least(cl / greatest(cn, 1.0), 20.0)), 3) AS running_ppl FROM c WHERE step_no % 10 = 0""",
    "perplexity": f"""
WITH a AS (SELECT run, sum(loss / 10.0 * n_tokens) AS ln, CAST(sum(n_tokens) AS DOUBLE) AS n
           FROM {LOG} WHERE loss IS NOT NULL GROUP BY run)
SELECT run, round(CASE WHEN n = 0 THEN 'inf'::DOUBLE ELSE ln / n END, 9) AS avg_loss,
       round(CASE WHEN n = 0 THEN 'inf'::DOUBLE ELSE exp(least(ln / n, 20.0)) END, 6) AS perplexity FROM a""",
    "early_stop_scan": f"""
WITH RECURSIVE h AS (SELECT run, epoch AS step, v, row_number() OVER (PARTITION BY run ORDER BY epoch) AS rn
                     FROM (SELECT run, epoch, avg(eval_accuracy) AS v FROM {LOG}
                           WHERE eval_accuracy IS NOT NULL GROUP BY run, epoch)),
s(run, rn, best, best_epoch, counter, stop_epoch, improvements, epochs_run) AS (
  SELECT DISTINCT run, CAST(0 AS BIGINT), CAST('-inf' AS DOUBLE), CAST(NULL AS BIGINT), 0, CAST(NULL AS BIGINT), 0, 0 FROM h
  UNION ALL
  SELECT s.run, h.rn,
         CASE WHEN s.stop_epoch IS NULL AND h.v > s.best + 0.05 THEN h.v ELSE s.best END,
         CASE WHEN s.stop_epoch IS NULL AND h.v > s.best + 0.05 THEN h.step ELSE s.best_epoch END,
         CASE WHEN s.stop_epoch IS NOT NULL THEN s.counter WHEN h.v > s.best + 0.05 THEN 0 ELSE s.counter + 1 END,
         CASE WHEN s.stop_epoch IS NOT NULL THEN s.stop_epoch
              WHEN NOT (h.v > s.best + 0.05) AND s.counter + 1 > 3 THEN h.step END,
         s.improvements + CASE WHEN s.stop_epoch IS NULL AND h.v > s.best + 0.05 THEN 1 ELSE 0 END,
         s.epochs_run + CASE WHEN s.stop_epoch IS NULL THEN 1 ELSE 0 END
  FROM s JOIN h ON h.run = s.run AND h.rn = s.rn + 1)
SELECT run, round(best, 9) AS best_value, best_epoch, stop_epoch, improvements, CAST(epochs_run AS BIGINT) AS epochs_run
FROM s QUALIFY row_number() OVER (PARTITION BY run ORDER BY rn DESC) = 1""",
    "best_checkpoint": f"""
SELECT run, step AS best_epoch, round(ppl, 6) AS best_value FROM (
  SELECT run, step, exp(least(loss / 10.0, 20.0)) AS ppl FROM {LOG} WHERE loss IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY run ORDER BY ppl, step) = 1""",
    "melt_metrics": f"""
WITH e AS (SELECT * FROM {LOG} WHERE eval_loss IS NOT NULL)
SELECT step, 'Accuracy' AS Metric, round(eval_accuracy, 9) AS Score FROM e
UNION ALL SELECT step, 'F1', round(eval_f1, 9) FROM e
UNION ALL SELECT step, 'Precision', round(eval_precision, 9) FROM e
UNION ALL SELECT step, 'Recall', round(eval_recall, 9) FROM e""",
    "history_to_scalars": f"""
WITH p AS (SELECT * FROM {P} WHERE pred_a <> -1),
tr AS ({_binary_metrics('p', 'pred_a')}),
va AS ({_binary_metrics('p', 'pred_b')}),
lo AS (SELECT run, avg(1 - conf_a) AS train_loss, avg(1 - conf_b) AS val_loss FROM p GROUP BY run),
w AS (SELECT lo.run AS step, lo.train_loss, lo.val_loss, tr.accuracy AS ta, tr.precision AS tp, tr.recall AS tr_,
             tr.f1 AS tf, va.accuracy AS va_, va.precision AS vp, va.recall AS vr, va.f1 AS vf
      FROM lo JOIN tr USING (run) JOIN va USING (run))
SELECT step, tag, round(value, 9) AS value FROM (
  SELECT step, 'Loss/train' AS tag, train_loss AS value FROM w
  UNION ALL SELECT step, 'Loss/validation', val_loss FROM w
  UNION ALL SELECT step, 'Metrics/train/accuracy', ta FROM w
  UNION ALL SELECT step, 'Metrics/train/precision', tp FROM w
  UNION ALL SELECT step, 'Metrics/train/recall', tr_ FROM w
  UNION ALL SELECT step, 'Metrics/train/f1', tf FROM w
  UNION ALL SELECT step, 'Metrics/validation/accuracy', va_ FROM w
  UNION ALL SELECT step, 'Metrics/validation/precision', vp FROM w
  UNION ALL SELECT step, 'Metrics/validation/recall', vr FROM w
  UNION ALL SELECT step, 'Metrics/validation/f1', vf FROM w)""",
}


# ------------------------------------------------------------------ vocabularies, encoding, sequences

def _words(src: str, key: str = "doc_id") -> str:
    """(key, token, pos 0-based) for ``lower(text).split()``."""
    return (f"SELECT {key}, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM "
            f"(SELECT {key}, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w "
            f"FROM {src})")


def _chars(src: str, key: str) -> str:
    return (f"SELECT {key}, unnest(c) AS token, generate_subscripts(c, 1) - 1 AS pos FROM "
            f"(SELECT {key}, string_split(text, '') AS c FROM {src} WHERE length(text) > 0)")


def _first_seen(tokens: str, key: str, n_specials: int) -> str:
    return f"""
SELECT token, CAST(row_number() OVER (ORDER BY {key}, pos) + {n_specials - 1} AS BIGINT) AS id FROM (
  SELECT token, {key}, pos FROM ({tokens})
  QUALIFY row_number() OVER (PARTITION BY token ORDER BY {key}, pos) = 1)"""


WORD_SPECIALS_SQL = "SELECT '<PAD>' AS token, CAST(0 AS BIGINT) AS id UNION ALL SELECT '<UNK>', CAST(1 AS BIGINT)"
CHAR_SPECIALS_SQL = ("SELECT '<PAD>' AS token, CAST(0 AS BIGINT) AS id UNION ALL SELECT '<UNK>', 1 "
                     "UNION ALL SELECT '<BOS>', 2 UNION ALL SELECT '<EOS>', 3")
TRAIN_VOCAB = f"""{_first_seen(_words(f"(SELECT * FROM ({SPLIT3_LABELLED}) WHERE split = 'train')"), 'doc_id', 2)}"""
UTT = "(SELECT conv_id * 2147483648 + turn AS utt_id, text FROM conversations)"


def _encoded(src: str, vocab: str, max_len: int | None) -> str:
    cut = f"WHERE t.pos < {max_len}" if max_len is not None else ""
    return f"""
SELECT d.doc_id, coalesce(e.l, CAST([] AS BIGINT[])) AS ids FROM {src} d LEFT JOIN (
  SELECT t.doc_id, list(coalesce(v.id, 1) ORDER BY t.pos) AS l
  FROM ({_words(src)}) t LEFT JOIN ({vocab}) v USING (token) {cut} GROUP BY t.doc_id) e USING (doc_id)"""


CORPUS_STREAM = f"""
SELECT CAST(row_number() OVER (ORDER BY t.doc_id, t.pos) - 1 AS BIGINT) AS g, CAST(v.id AS BIGINT) AS token_id
FROM ({_words('documents')}) t JOIN ({_first_seen(_words('documents'), 'doc_id', 2)}) v USING (token)"""

SQL.update({
    "word_vocab": f"{WORD_SPECIALS_SQL} UNION ALL {_first_seen(_words('documents'), 'doc_id', 2)}",
    "char_vocab": f"{CHAR_SPECIALS_SQL} UNION ALL {_first_seen(_chars('documents', 'doc_id'), 'doc_id', 4)}",
    "encode_fixed": f"""
SELECT doc_id, array_to_string(list_resize(ids, 64, 0), ' ') AS ids FROM ({_encoded(LABELLED, TRAIN_VOCAB, 64)})""",
    "encode_truncated": f"""
SELECT e.doc_id, array_to_string(e.ids, ' ') AS ids, CAST(len(e.ids) AS BIGINT) AS n_ids,
       CAST(len(e.ids) AS BIGINT) AS mask_sum, l.label
FROM ({_encoded(LABELLED, TRAIN_VOCAB, 16)}) e JOIN {LABELLED} l USING (doc_id)""",
    "encode_chars": f"""
WITH v AS ({_first_seen(_chars('benchmark', 'item_id'), 'item_id', 4)}),
e AS (SELECT t.utt_id, list(coalesce(v.id, 1) ORDER BY t.pos) AS l
      FROM ({_chars(UTT, 'utt_id')}) t LEFT JOIN v USING (token) GROUP BY t.utt_id),
w AS (SELECT u.utt_id, list_concat([CAST(2 AS BIGINT)], coalesce(e.l, CAST([] AS BIGINT[])), [CAST(3 AS BIGINT)]) AS ids
      FROM {UTT} u LEFT JOIN e USING (utt_id))
SELECT utt_id, CAST(len(ids) AS BIGINT) AS n_ids, md5(array_to_string(ids, ' ')) AS ids_md5 FROM w""",
    "decode_chars": f"SELECT utt_id, md5(text) AS text_md5 FROM {UTT}",
    "token_stream": CORPUS_STREAM,
    "pack_blocks": f"""
WITH st AS ({CORPUS_STREAM}),
n AS (SELECT count(*) AS n FROM st),
starts AS (SELECT unnest(generate_series(0, n - 257, 128)) AS start FROM n UNION SELECT n - 257 FROM n),
w AS (SELECT s.start, st.g, st.token_id FROM starts s JOIN st ON st.g BETWEEN s.start AND s.start + 256)
SELECT start,
       md5(string_agg(CAST(token_id AS VARCHAR), ' ' ORDER BY g) FILTER (WHERE g < start + 256)) AS x_md5,
       md5(string_agg(CAST(token_id AS VARCHAR), ' ' ORDER BY g) FILTER (WHERE g > start)) AS y_md5
FROM w GROUP BY start""",
    "assign_batches": f"""
SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 32 AS BIGINT) AS batch FROM {LABELLED}""",
    "pad_batches": f"""
WITH e AS (SELECT doc_id, list_slice(ids, 1, 48) AS t,
                  CAST((row_number() OVER (ORDER BY doc_id) - 1) // 8 AS BIGINT) AS batch
           FROM ({_encoded(LABELLED, TRAIN_VOCAB, None)})),
w AS (SELECT *, max(len(t)) OVER (PARTITION BY batch) AS width FROM e)
SELECT doc_id, batch, md5(array_to_string(list_resize(t, width, 0), ' ')) AS ids_md5,
       CAST(width AS BIGINT) AS width, CAST(len(t) AS BIGINT) AS mask_sum FROM w""",
    "pool_vectors": """
WITH e AS (SELECT label, vec_id, CASE WHEN vec_id % 4 = 3 THEN 0.0 ELSE 1.0 END AS m,
                  unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
SELECT label, CAST(dim AS INTEGER) AS dim,
       round(sum(CAST(v AS DOUBLE) * m) / greatest(sum(m), 1.0), 6) AS masked_mean,
       round(avg(CAST(v AS DOUBLE)), 6) AS mean, round(arg_max(CAST(v AS DOUBLE), vec_id), 6) AS last
FROM e GROUP BY label, dim""",
})


# ------------------------------------------------------------------ web pages

def _url_parts_sql(x: str) -> str:
    """Subquery columns: scheme, netloc, path, query of URL expression ``x``."""
    return f"""
SELECT *, regexp_replace(regexp_extract(after, '^([^?]*)', 1), ';[^/]*$', '') AS path,
       regexp_extract(after, '^[^?]*[?](.*)$', 1) AS query
FROM (SELECT *, CASE WHEN starts_with(rest, '//') THEN regexp_extract(rest, '^//([^/?#]*)', 1) ELSE '' END AS netloc,
             CASE WHEN starts_with(rest, '//') THEN regexp_replace(rest, '^//[^/?#]*', '') ELSE rest END AS after
      FROM (SELECT *, CASE WHEN scheme <> '' THEN regexp_replace(u0, '^[A-Za-z][A-Za-z0-9+.-]*:', '') ELSE u0 END AS rest
            FROM (SELECT *, lower(regexp_extract(u0, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme
                  FROM (SELECT *, regexp_extract({x}, '^([^#]*)', 1) AS u0 FROM __SRC__))))"""


def _with_url_parts(src: str, x: str) -> str:
    return _url_parts_sql(x).replace("__SRC__", src)


NORM = ("coalesce(nullif(scheme, ''), 'https') || '://' || lower(netloc) || coalesce(nullif(path, ''), '/') "
        "|| CASE WHEN query <> '' THEN '?' || query ELSE '' END")


def _decode_entities(x: str) -> str:
    return (f"replace(replace(replace(replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), "
            f"'&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&amp;', '&')")


def _visible_text(h: str) -> str:
    for tag in ["script", "style", "header", "footer", "nav", "noscript", "svg"]:
        h = f"regexp_replace({h}, '<{tag}[\\s>].*?</{tag}>', '', 'gs')"
    h = f"regexp_replace({h}, '<!--.*?-->', '', 'gs')"
    h = f"regexp_replace({h}, '<![^>]*>', '', 'g')"
    h = f"regexp_replace({h}, '<[^>]*>', chr(10), 'g')"
    h = _decode_entities(h)
    return (f"array_to_string(list_filter(list_transform(string_split({h}, chr(10)), lambda x: trim(x, {WS})), "
            f"lambda x: x <> ''), chr(10))")


SQL.update({
    "normalize_url": f"SELECT page_id, {NORM} AS norm_url FROM ({_with_url_parts('pages', 'url')})",
    "url_allowed": f"""
WITH n AS (SELECT page_id, {NORM} AS url FROM ({_with_url_parts('pages', 'url')})),
p AS (SELECT page_id, lower(netloc) AS host, path FROM ({_with_url_parts('n', 'url')}))
SELECT page_id FROM p
WHERE ((host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en'))
   OR (host = 'example.org' OR ends_with(host, '.example.org'))""",
    "robots_allowed": f"""
SELECT page_id,
       CASE WHEN starts_with(lower(netloc), 'blog.') THEN NOT starts_with(coalesce(nullif(path, ''), '/'), '/en/')
            ELSE NOT starts_with(coalesce(nullif(path, ''), '/'), '/fr/') END AS robots_ok
FROM ({_with_url_parts('pages', 'url')})""",
    "scan_pages": """
SELECT page_id, content_type FROM (
  SELECT page_id, CASE WHEN contains(url, '.html') THEN 'text/html; charset=utf-8'
                       WHEN page_id % 7 = 0 THEN 'application/json'
                       WHEN page_id % 7 = 1 THEN 'application/xhtml+xml' ELSE 'text/html' END AS content_type
  FROM pages)
WHERE contains(split_part(content_type, ';', 1), 'text/html')
   OR contains(split_part(content_type, ';', 1), 'application/xhtml+xml')""",
    "html_title": f"""
SELECT page_id, trim({_decode_entities("regexp_extract(html, '<title>(.*?)</title>', 1)")}, {WS}) AS title
FROM pages""",
    "html_to_text": f"""
SELECT page_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5
FROM (SELECT page_id, {_visible_text('html')} AS t FROM pages)""",
    "extract_links": f"""
WITH a AS (SELECT page_id, url, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS pos
           FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages)),
j AS (SELECT page_id, pos, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || href
                                ELSE href END AS raw FROM a)
SELECT page_id, CAST(pos AS INTEGER) AS pos, {NORM} AS dst FROM ({_with_url_parts('j', 'raw')})""",
})


# ------------------------------------------------------------------ language model

def _bigrams_sql(src: str, key: str) -> str:
    return f"""
SELECT {key}, i - 1 AS pos, s[i] AS prev, s[i + 1] AS next FROM (
  SELECT {key}, s, unnest(generate_series(1, len(s) - 1)) AS i FROM (
    SELECT {key}, list_concat(['<s>'], list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''),
                             ['</s>']) AS s FROM {src}))"""


LM_COUNTS = f"""
c AS (SELECT prev, next, count(*) AS count FROM ({_bigrams_sql('documents', 'doc_id')}) GROUP BY prev, next),
cx AS (SELECT prev, sum(count) AS ctx_count FROM c GROUP BY prev),
v AS (SELECT CAST(count(DISTINCT next) + 1 AS DOUBLE) AS vs FROM c)"""

LOGPROBS = f"""
WITH {LM_COUNTS.strip()},
lp AS (SELECT c.prev, c.next, CAST(c.count AS BIGINT) AS count,
              ln((c.count + 1.0) / (cx.ctx_count + 1.0 * v.vs)) AS logp FROM c JOIN cx USING (prev), v)"""

SQL.update({
    "ngram_lm": f"{LOGPROBS} SELECT prev, next, count, round(logp, 9) AS logp FROM lp",
    "lm_perplexity": f"""
WITH {LM_COUNTS.strip()},
b AS ({_bigrams_sql('benchmark', 'item_id')}),
s AS (SELECT b.item_id, -ln((coalesce(c.count, 0) + 1.0) / (coalesce(cx.ctx_count, 0) + 1.0 * v.vs)) AS nll
      FROM b LEFT JOIN c ON c.prev = b.prev AND c.next = b.next LEFT JOIN cx ON cx.prev = b.prev, v),
a AS (SELECT item_id, sum(nll) / count(*) AS l FROM s GROUP BY item_id)
SELECT item_id, round(l, 9) AS avg_loss, round(exp(least(l, 20.0)), 6) AS perplexity FROM a""",
    "next_token_topk": f"""
{LOGPROBS},
sc AS (SELECT prev, next, logp / 0.8 AS l, rank() OVER (PARTITION BY prev ORDER BY logp / 0.8 DESC) AS rk FROM lp),
k AS (SELECT prev, next, l, exp(l - max(l) OVER (PARTITION BY prev)) AS e FROM sc WHERE rk <= 3)
SELECT prev, next, round(e / sum(e) OVER (PARTITION BY prev), 9) AS prob FROM k""",
})


# ------------------------------------------------------------------ sources, sinks, streaming

SQL.update({
    "jsonl_preprocess": PREPROCESS,
    "csv_roundtrip": f"SELECT doc_id, label, md5(text) AS text_md5, split FROM ({SPLIT3_LABELLED})",
    "collect_texts": f"""
SELECT md5(t) AS text_md5 FROM (
  SELECT {_strip('unnest(string_split(text, chr(10)))')} AS t FROM conversations
  UNION ALL SELECT {_strip('text')} FROM benchmark
  UNION ALL SELECT {_strip('text')} FROM documents
  UNION ALL SELECT {_strip('source')} FROM documents
  UNION ALL SELECT {_strip('lang')} FROM documents) WHERE length(t) >= 15""",
    "read_list": f"SELECT {_strip('url')} AS item FROM pages WHERE {_strip('url')} <> ''",
    "normalize_labelled": f"""
SELECT md5(text) AS text_md5, CAST({_string_label("CASE WHEN label = 1 THEN 'Toxic' ELSE 'not toxic ' END")} AS INTEGER) AS label
FROM {LABELLED}""",
    "with_fallback_source": """
SELECT item_id AS src_id, md5(text) AS text_md5 FROM benchmark WHERE (SELECT count(*) FROM benchmark) >= 100
UNION ALL
SELECT doc_id AS src_id, md5(text) AS text_md5 FROM documents WHERE (SELECT count(*) FROM benchmark) < 100""",
    "load_corpus": """
SELECT 'documents' AS source, count(*) AS n_texts FROM documents
UNION ALL SELECT 'benchmark', count(*) FROM benchmark
UNION ALL SELECT 'conversations', count(*) FROM conversations""",
    "stream_dedup": "SELECT DISTINCT md5(text) AS content_hash FROM documents WHERE length(text) >= 100",
})


def _utt_char_ids() -> str:
    v = _first_seen(_chars(UTT, 'utt_id'), 'utt_id', 4)
    return f"""
WITH v AS ({v}),
e AS (SELECT t.utt_id, t.pos, v.id FROM ({_chars(UTT, 'utt_id')}) t JOIN v USING (token)),
whole AS (SELECT utt_id FROM {UTT} WHERE {_strip('text')} <> ''),
s AS (SELECT utt_id, -1 AS pos, CAST(2 AS BIGINT) AS id FROM whole
      UNION ALL SELECT utt_id, pos, id FROM e WHERE utt_id IN (SELECT utt_id FROM whole)
      UNION ALL SELECT utt_id, 1000000000 AS pos, CAST(3 AS BIGINT) AS id FROM whole)"""


SQL["flat_token_stream"] = f"""
{_utt_char_ids()}
SELECT CAST(row_number() OVER (ORDER BY utt_id, pos) - 1 AS BIGINT) AS g, id AS token_id FROM s"""


SQL.update({
    "take_first": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100",
    "shuffle_order": f"""
SELECT doc_id, CAST(row_number() OVER (ORDER BY {_seed_key(42, 'doc_id')}, doc_id) - 1 AS BIGINT) AS pos FROM documents""",
    "align_predictions": f"""
WITH p AS {P},
r AS (SELECT l.doc_id, l.label, coalesce(p.pred_a, -1) AS pred_a, coalesce(p.pred_b, -1) AS pred_b
      FROM {LABELLED} l LEFT JOIN p USING (doc_id))
SELECT count(*) AS n_samples, CAST(count_if(pred_a = label AND pred_b <> label) AS BIGINT) AS a_only_correct,
       CAST(count_if(pred_b = label AND pred_a <> label) AS BIGINT) AS b_only_correct,
       CAST(count_if(pred_a = label AND pred_b = label) AS BIGINT) AS both_correct,
       CAST(count_if(pred_a <> label AND pred_b <> label) AS BIGINT) AS both_wrong
FROM r WHERE pred_a <> -1 AND pred_b <> -1""",
})


SQL["jsonl_lenient"] = """
SELECT doc_id % 4 = 0 AS not_finite, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS doc_ids,
       CAST(sum(length(text)) AS BIGINT) AS chars, false AS quarantined
FROM documents WHERE doc_id % 4 <> 3 GROUP BY 1
UNION ALL
SELECT false, count(*), NULL, NULL, true FROM documents WHERE doc_id % 4 = 3"""

# a page is reached if its parent is kept; of reached pages with one text the first in the queue (here: by page_id) is kept
SQL["crawl_bfs"] = f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT page_id, url, {_visible_text('html')} AS text FROM pages),
n AS MATERIALIZED (SELECT page_id, {NORM} AS url, text, length(text) AS n_chars FROM ({_with_url_parts('t', 'url')})),
k AS MATERIALIZED (SELECT * FROM n a WHERE n_chars >= 200
     AND NOT EXISTS (SELECT 1 FROM n b WHERE b.text = a.text AND b.page_id < a.page_id)),
r(page_id, depth) AS (SELECT page_id, 0 FROM k WHERE page_id = 0
     UNION ALL SELECT k.page_id, r.depth + 1 FROM r JOIN k ON (k.page_id - 1) // 16 = r.page_id AND k.page_id > 0
     WHERE r.depth < 4)
SELECT k.url, CAST(r.depth AS INTEGER) AS depth, CAST(k.n_chars AS BIGINT) AS n_chars FROM r JOIN k USING (page_id)"""


# ------------------------------------------------------------------ readers, sinks, scoring

# the text holds no runs of white space and nothing that NFKC changes, so the pattern needs no look-ahead
_PRETOKENS = "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+"
_PREFIXED = "CASE WHEN starts_with({t}, ' ') THEN {t} ELSE ' ' || {t} END"

SQL.update({
    "read_labelled": f"SELECT md5(text) AS text_md5, label FROM {LABELLED}",
    "read_table_by_extension": """
SELECT ext, doc_id, lang, n_chars, md5(text) AS text_md5
FROM documents, (SELECT unnest(['csv', 'tsv', 'jsonl']) AS ext)""",
    "discover_tables": f"SELECT md5(text) AS text_md5, label FROM {LABELLED}",
    "list_files": """
SELECT CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS pos, lang FROM (SELECT DISTINCT lang FROM documents)""",
    "resolve_text_column": "SELECT page_id, md5(url) AS first_md5, md5(html) AS preferred_md5 FROM pages",
    "vocab_round_trip": f"SELECT token, id, CAST(128 AS BIGINT) AS max_len FROM ({SQL['char_vocab']})",
    "pretokens": f"""
SELECT pretoken, count(*) AS n, CAST(any_value(octet_length(encode(pretoken))) AS BIGINT) AS n_bytes FROM (
  SELECT unnest(regexp_extract_all({_PREFIXED.format(t="lower(text)")}, '{_PRETOKENS.replace("'", "''")}')) AS pretoken
  FROM conversations) GROUP BY pretoken""",
    "pretoken_counts": f"""
SELECT pretoken, count(*) AS freq FROM (
  SELECT unnest(regexp_extract_all({_PREFIXED.format(t="text")}, '{_PRETOKENS.replace("'", "''")}')) AS pretoken
  FROM documents) GROUP BY pretoken HAVING count(*) >= 2""",
    "accuracy": f"""
SELECT run, round(avg(CAST(pred_b = label AS DOUBLE)), 9) AS accuracy FROM {P}
WHERE pred_a <> -1 AND pred_b <> -1 GROUP BY run""",
    "empty_input_default": """
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND length(trim(text)) > 0 THEN round(1 - length(text) / 1000.0, 9) ELSE 1.0 END AS p0,
       CASE WHEN turn % 2 = 0 AND length(trim(text)) > 0 THEN round(length(text) / 1000.0, 9) ELSE 0.0 END AS p1 FROM conversations""",
    "score_rows": """
SELECT doc_id, CAST(CASE WHEN ok THEN CASE WHEN e > a THEN 1 ELSE 0 END ELSE -1 END AS INTEGER) AS pred,
       CASE WHEN ok THEN round(greatest(a, e) / (a + e), 9) ELSE 0.0 END AS conf
FROM (SELECT *, NOT contains(text, '|') AND a + e > 0 AS ok FROM (
      SELECT doc_id, text, CAST(length(text) - length(replace(text, 'a', '')) AS DOUBLE) AS a,
             CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS e FROM documents))""",
    "report_json": f"SELECT CAST(to_json(r) AS VARCHAR) AS report FROM ({SQL['reduction_report']}) r",
    "write_report": """
SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM benchmark) AS benchmark, 'größer' AS note""",
})
