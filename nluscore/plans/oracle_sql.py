"""DuckDB oracle SQL for the fixture queries (tables are pre-registered views).

Written from the metric definitions, independently of the Spark operators where the definition
allows; every computed column carries the same alias as the Spark result.
"""

from __future__ import annotations


def long_sql(src: str, by: list[str], metrics: list[str], digits: int = 6) -> str:
    keys = "".join(f"{b}, " for b in by)
    return "\nUNION ALL\n".join(
        f"SELECT {keys}'{m}' AS metric, round(CAST({m} AS DOUBLE), {digits}) AS value FROM {src}" for m in metrics
    )


CLS = """cls AS (
  SELECT d.lang AS config, l.quality AS gold, CAST(d.n_chars >= 200 AS INTEGER) AS pred,
         CAST(l.toxic + 1 AS DOUBLE) AS w
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

ACCURACY_BY_LANG = f"""
WITH {CLS},
per AS (
  SELECT config,
         avg(CAST(pred = gold AS DOUBLE)) AS accuracy,
         count(*) AS samples,
         sum(w * CAST(pred = gold AS DOUBLE)) / sum(CASE WHEN (pred = gold) IS NOT NULL THEN w END) AS accuracy_weighted,
         sum(w * CAST(pred = gold AS DOUBLE)) AS correct_weighted
  FROM cls GROUP BY config),
long AS ({long_sql('per', ['config'], ['accuracy', 'accuracy_weighted', 'correct_weighted', 'samples'])})
SELECT config, metric, value FROM long
UNION ALL
SELECT 'avg' AS config, 'accuracy' AS metric, round(avg(value), 6) AS value FROM long WHERE metric = 'accuracy'
"""

F1_MCC_BY_LANG = f"""
WITH {CLS},
b AS (
  SELECT config,
         CAST(sum(CASE WHEN pred = 1 AND gold = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
         CAST(sum(CASE WHEN pred = 1 AND gold = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
         CAST(sum(CASE WHEN pred = 0 AND gold = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
         CAST(sum(CASE WHEN pred = 0 AND gold = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn
  FROM cls GROUP BY config),
m AS (
  SELECT config,
    (tp + tn) / (tp + tn + fp + fn) AS accuracy,
    CASE WHEN 2*tp + fp + fn = 0 THEN 0 ELSE 2*tp / (2*tp + fp + fn) END AS f1,
    CASE WHEN 2*tn + fn + fp = 0 THEN 0 ELSE 2*tn / (2*tn + fn + fp) END AS f1_neg,
    (CASE WHEN tp + fn > 0 OR tp + fp > 0 THEN 1 ELSE 0 END) AS has_pos,
    (CASE WHEN tn + fp > 0 OR tn + fn > 0 THEN 1 ELSE 0 END) AS has_neg,
    tp + fn AS sup_pos, tn + fp AS sup_neg,
    CASE WHEN (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn) = 0 THEN 0
         ELSE (tp*tn - fp*fn) / sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)) END AS mcc
  FROM b),
w AS (
  SELECT config, accuracy, f1, accuracy AS f1_micro,
    (f1 * has_pos + f1_neg * has_neg) / (has_pos + has_neg) AS f1_macro,
    (f1 * sup_pos + f1_neg * sup_neg) / (sup_pos + sup_neg) AS f1_weighted,
    mcc, (accuracy + f1) / 2 AS combined_score
  FROM m)
{long_sql('w', ['config'], ['accuracy', 'f1', 'f1_micro', 'f1_macro', 'f1_weighted', 'mcc', 'combined_score'])}
"""

CUSTOM_METRIC_STATES = f"""
WITH {CLS},
r AS (SELECT config, gold, avg(CAST(gold = pred AS DOUBLE)) AS recall, count(*) AS n FROM cls GROUP BY config, gold)
SELECT config, round(avg(recall), 6) AS balanced_accuracy, CAST(sum(n) AS BIGINT) AS rows FROM r GROUP BY config
"""

PEARSON_SPEARMAN = f"""
WITH li AS (SELECT l_quantity * 1500 AS x, l_extendedprice AS y FROM lineitem
            WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
r AS (SELECT x, y,
        rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx,
        rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry
      FROM li),
s AS (SELECT covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) AS pearson,
             covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)) AS spearman FROM r)
{long_sql('s', [], ['pearson', 'spearman'])}
"""

WEIGHTED_MSE = f"""
WITH li AS (SELECT l_quantity * 1500 AS p, l_extendedprice AS g, l_discount + 0.01 AS w FROM lineitem),
s AS (SELECT avg((p - g) * (p - g)) AS mse, sum(w * (p - g) * (p - g)) / sum(w) AS mse_weighted FROM li),
t AS (SELECT mse, sqrt(mse) AS rmse, mse_weighted, sqrt(mse_weighted) AS rmse_weighted FROM s)
{long_sql('t', [], ['mse', 'mse_weighted', 'rmse', 'rmse_weighted'])}
"""

# ---------------------------------------------------------------- vectors and retrieval

UNIT = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm FROM e),
u AS (SELECT vec_id, label, list_transform(v, lambda x: x / greatest(nrm, 1e-12)) AS u FROM n)"""


def _ranked(src_filter: str, dst_filter: str, k: int, ignore_identical: bool) -> str:
    cond = "q.vec_id <> c.vec_id" if ignore_identical else "TRUE"
    return f"""pairs AS (
  SELECT q.vec_id AS qid, c.vec_id AS docid, round(list_dot_product(q.u, c.u), 9) AS s
  FROM u q JOIN u c ON {cond} WHERE {src_filter} AND {dst_filter}),
ranked AS (
  SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid DESC) AS rank
  FROM (SELECT qid, docid, CASE WHEN isnan(s) THEN -1.0 ELSE s END AS score FROM pairs)),
hits AS (SELECT * FROM ranked WHERE rank <= {k})"""


TOPK_COSINE = f"""
WITH {UNIT},
{_ranked('TRUE', 'TRUE', 10, True)}
SELECT qid, docid, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM hits
"""


def _retrieval_sql(by: list[str], ks: list[int]) -> str:
    keys = "".join(f"{b}, " for b in by)
    per_k = []
    for k in ks:
        per_k.append(f"""
    min(CASE WHEN rank <= {k} AND rel > 0 THEN rank END) AS first_{k},
    sum(CASE WHEN rank <= {k} AND rel > 0 THEN cum / rank ELSE 0 END) AS ap_{k},
    sum(CASE WHEN rank <= {k} THEN rel / log2(rank + 1) ELSE 0 END) AS dcg_{k},
    sum(CASE WHEN rank <= {k} AND rel > 0 THEN 1 ELSE 0 END) AS hit_{k}""")
    metrics = []
    names = []
    for k in ks:
        idcg = f"list_sum(list_transform(range(1, least(j.n_rel, {k}) + 1), lambda i: 1.0 / log2(i + 1)))"
        metrics.append(f"""
    coalesce(1.0 / first_{k}, 0.0) AS mrr_at_{k},
    ap_{k} / j.n_rel AS map_at_{k},
    CASE WHEN {idcg} = 0 THEN 0 ELSE dcg_{k} / {idcg} END AS ndcg_at_{k},
    hit_{k} / j.n_rel AS recall_at_{k},
    hit_{k} / {float(k)} AS precision_at_{k}""")
        names += [f"mrr_at_{k}", f"map_at_{k}", f"ndcg_at_{k}", f"recall_at_{k}", f"precision_at_{k}"]
    jkeys = "".join(f"j.{b}, " for b in by)
    group = ("GROUP BY " + ", ".join(by)) if by else ""
    aggs = ",\n    ".join(
        (f"sum({m}) / (SELECT count(*) FROM judged j2 WHERE j2.n_rel > 0"
         + "".join(f" AND j2.{b} IS NOT DISTINCT FROM pq.{b}" for b in by) + f") AS {m}")
        if m.startswith("mrr") else f"avg({m}) AS {m}" for m in names)
    return f"""cumd AS (
  SELECT *, sum(CASE WHEN rel > 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY qid ORDER BY rank
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM hr),
agg AS (SELECT qid, {",".join(per_k)}
  FROM cumd GROUP BY qid),
pq AS (SELECT {jkeys}a.qid, {",".join(metrics)}
  FROM agg a JOIN judged j ON a.qid = j.qid WHERE j.n_rel > 0),
means AS (SELECT {keys}{aggs}
  FROM pq {group})
{long_sql('means', by, names)}"""


_LABELLED = """lab AS (SELECT vec_id, label FROM embeddings),
cnt AS (SELECT label, count(*) AS n FROM lab GROUP BY label),
judged AS (SELECT l.vec_id AS qid, l.label AS source, c.n - 1 AS n_rel FROM lab l JOIN cnt c ON l.label = c.label),
hr AS (SELECT h.qid, h.docid, h.rank, lq.label AS source, CAST(lq.label = ld.label AS INTEGER) AS rel
       FROM hits h JOIN lab lq ON lq.vec_id = h.qid JOIN lab ld ON ld.vec_id = h.docid)"""

RETRIEVAL_METRICS = f"""
WITH {UNIT},
{_ranked('TRUE', 'TRUE', 10, True)},
{_LABELLED},
{_retrieval_sql([], [1, 3, 5, 10])}
"""

RETRIEVAL_BY_SOURCE = f"""
WITH {UNIT},
{_ranked('TRUE', 'TRUE', 10, True)},
{_LABELLED},
{_retrieval_sql(['source'], [1, 3, 5, 10])}
"""

BITEXT_METRICS = f"""
WITH {UNIT},
{_ranked('q.vec_id % 2 = 0', 'c.vec_id % 2 = 1', 10, False)},
lab AS (SELECT vec_id, label FROM embeddings),
tcount AS (SELECT label, count(*) AS n FROM lab WHERE vec_id % 2 = 1 GROUP BY label),
judged AS (SELECT l.vec_id AS qid, t.n AS n_rel FROM lab l JOIN tcount t ON l.label = t.label WHERE l.vec_id % 2 = 0),
top1 AS (SELECT h.qid, h.docid, CAST(lq.label = ld.label AS DOUBLE) AS rel
         FROM hits h JOIN lab lq ON lq.vec_id = h.qid JOIN lab ld ON ld.vec_id = h.docid WHERE h.rank = 1),
s AS (SELECT sum(rel) AS correct, count(DISTINCT docid) AS docs, (SELECT count(*) FROM judged WHERE n_rel > 0) AS nq FROM top1),
m AS (SELECT correct / nq AS accuracy, correct / docs AS precision, correct / nq AS recall FROM s),
w AS (SELECT accuracy, precision, recall,
             CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m)
{long_sql('w', [], ['accuracy', 'precision', 'recall', 'f1'])}
"""

WHOLE_NUMBERS = """w AS (SELECT vec_id, label, list_transform(embedding[1:8], lambda x: floor(CAST(x AS DOUBLE) * 12)) AS v FROM embeddings)"""

TOPK_STRING_IDS = f"""
WITH {WHOLE_NUMBERS},
p AS (SELECT 'E' || q.vec_id AS qid, 'E' || d.vec_id AS docid, list_dot_product(q.v, d.v) AS score
      FROM w q JOIN w d ON q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid DESC) AS rank FROM p)
SELECT qid, docid, score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 10
"""


def _qrels_metrics_sql(by: list[str], ks: list[int]) -> str:
    """Metrics of hits (qid, docid, score) against qrels (qid, docid, rel[, by]); adds the table `means`."""
    keys = "".join(f"{b}, " for b in by)
    jkeys = "".join(f"j.{b}, " for b in by)
    per_k = ",".join(f"""
    min(CASE WHEN heap_rank <= {k} AND rel > 0 THEN heap_rank END) AS first_{k},
    sum(CASE WHEN rank <= {k} AND rel > 0 THEN cum / rank ELSE 0 END) AS ap_{k},
    sum(CASE WHEN rank <= {k} THEN rel / log2(rank + 1) ELSE 0 END) AS dcg_{k},
    sum(CASE WHEN rank <= {k} AND rel > 0 THEN 1 ELSE 0 END) AS hit_{k}""" for k in ks)
    ideal = ",".join(f"sum(CASE WHEN r <= {k} AND rel > 0 THEN rel / log2(r + 1) ELSE 0 END) AS idcg_{k}" for k in ks)
    metric = ",".join(f"""
    coalesce(1.0 / first_{k}, 0.0) AS mrr_at_{k}, CASE WHEN n_rel = 0 THEN 0 ELSE ap_{k} / n_rel END AS map_at_{k},
    CASE WHEN idcg_{k} = 0 THEN 0 ELSE dcg_{k} / idcg_{k} END AS ndcg_at_{k},
    CASE WHEN n_rel = 0 THEN 0 ELSE hit_{k} / n_rel END AS recall_at_{k}, hit_{k} / {float(k)} AS precision_at_{k}""" for k in ks)
    names = [f"{m}_at_{k}" for k in ks for m in ("mrr", "map", "ndcg", "recall", "precision")]
    same = "".join(f" AND j2.{b} IS NOT DISTINCT FROM pq.{b}" for b in by)
    aggs = ", ".join(f"sum({m}) / (SELECT count(*) FROM jq j2 WHERE TRUE{same}) AS {m}" if m.startswith("mrr") else f"avg({m}) AS {m}" for m in names)
    group = "GROUP BY " + ", ".join(by) if by else ""
    return f"""qr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, docid) AS r FROM qrels),
jq AS (SELECT qid, {keys}count(*) FILTER (WHERE rel > 0) AS n_rel, {ideal} FROM qr GROUP BY ALL),
hr AS (SELECT h.qid, h.docid, coalesce(q.rel, 0) AS rel,
         row_number() OVER (PARTITION BY h.qid ORDER BY score DESC, CAST(h.docid AS VARCHAR) DESC) AS rank,
         row_number() OVER (PARTITION BY h.qid ORDER BY score DESC, h.docid DESC) AS heap_rank
       FROM hits h LEFT JOIN qrels q ON h.qid = q.qid AND h.docid = q.docid),
cumd AS (SELECT *, sum(CASE WHEN rel > 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY qid ORDER BY rank) AS cum FROM hr),
agg AS (SELECT qid, {per_k} FROM cumd GROUP BY qid),
pq AS (SELECT {jkeys}a.qid, {metric} FROM agg a JOIN jq j ON a.qid = j.qid),
means AS (SELECT {keys}{aggs} FROM pq {group})
{long_sql('means', by, names)}"""


QRELS_METRICS = f"""
WITH {WHOLE_NUMBERS},
p AS (SELECT q.vec_id AS qid, d.vec_id AS docid, list_dot_product(q.v, d.v) AS score
      FROM w q JOIN w d ON q.vec_id <> d.vec_id WHERE q.vec_id % 2 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid DESC) AS place FROM p),
hits AS (SELECT qid, docid, score FROM t WHERE place <= 10),
qrels AS (SELECT q.vec_id AS qid, d.vec_id AS docid,
            CASE WHEN q.label = d.label THEN 3 WHEN abs(q.label - d.label) = 1 THEN 1 ELSE 0 END AS rel
          FROM w q JOIN w d ON d.vec_id > q.vec_id AND d.vec_id <= q.vec_id + 40
          WHERE q.vec_id % 2 = 0 OR q.vec_id % 20 = 1),
{_qrels_metrics_sql([], [1, 3, 5, 10])}
"""

_MERGED = f"""{UNIT},
pr AS (SELECT q.vec_id, 'c' || (q.label % 3) AS source, q.u AS asked, d.u AS told, 'entity ' || (((q.vec_id // 2) * 7) % 101) AS text
       FROM u q JOIN u d ON d.vec_id = q.vec_id + 1 WHERE q.vec_id % 2 = 0),
nq AS (SELECT *, row_number() OVER (ORDER BY source, vec_id) - 1 AS qid FROM pr),
f AS (SELECT text, min(qid) AS first_id FROM nq GROUP BY text),
c AS (SELECT f.text, f.first_id, row_number() OVER (ORDER BY f.first_id) - 1 AS docid, nq.told
      FROM f JOIN nq ON nq.qid = f.first_id),
p AS (SELECT nq.qid, c.docid, round(list_dot_product(nq.asked, c.told), 9) AS score FROM nq JOIN c ON TRUE),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid DESC) AS place FROM p),
hits AS (SELECT qid, docid, score FROM t WHERE place <= 10),
qrels AS (SELECT nq.qid, c.docid, 1 AS rel, nq.source FROM nq JOIN c ON nq.text = c.text)"""

MERGED_EVAL = f"""
SELECT 'merged' AS source, metric, value FROM (WITH {_MERGED}, {_qrels_metrics_sql([], [1, 3, 5, 10])})
UNION ALL
SELECT source, metric, value FROM (WITH {_MERGED}, {_qrels_metrics_sql(['source'], [1, 3, 5, 10])})
"""

QRELS_BUILD = """
WITH q AS (SELECT doc_id, lang AS source, text, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id) - 1 AS qid FROM documents),
f AS (SELECT text, min(qid) AS first_id FROM q GROUP BY text),
c AS (SELECT text, row_number() OVER (ORDER BY first_id) - 1 AS docid FROM f)
SELECT q.qid, q.source, q.doc_id, c.docid, CAST(1 AS BIGINT) AS rel, CAST(length(c.text) AS BIGINT) AS doc_chars
FROM q JOIN c ON q.text IS NOT DISTINCT FROM c.text
"""

CONTRASTIVE_LOSS = f"""
WITH {UNIT},
q AS (SELECT vec_id // 40 AS batch_id, vec_id AS qid, vec_id + 1 AS pos, u FROM u WHERE vec_id % 2 = 0),
d AS (SELECT vec_id // 40 AS batch_id, vec_id AS docid, u FROM u WHERE vec_id % 2 = 1),
s AS (SELECT q.batch_id, q.qid, q.pos, d.docid, 20.0 * list_dot_product(q.u, d.u) AS s
      FROM q JOIN d ON q.batch_id = d.batch_id),
m AS (SELECT batch_id, qid, max(s) AS mx FROM s GROUP BY batch_id, qid),
l AS (SELECT s.batch_id, s.qid, m.mx + ln(sum(exp(s.s - m.mx))) AS lse,
             sum(CASE WHEN s.docid = s.pos THEN s.s END) AS spos
      FROM s JOIN m ON s.batch_id = m.batch_id AND s.qid = m.qid GROUP BY s.batch_id, s.qid, m.mx)
SELECT CAST(batch_id AS BIGINT) AS batch_id, qid, round(lse - spos, 6) AS loss FROM l
"""

CONTRASTIVE_BATCH_LOSS = """
WITH e AS (SELECT vec_id, vec_id // 400 AS batch_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.batch_id, q.vec_id AS qid, d.vec_id AS docid, 5.0 * list_dot_product(q.v, d.v) AS s
      FROM e q JOIN e d ON q.batch_id = d.batch_id WHERE q.vec_id % 2 = 0 AND d.vec_id % 2 = 1),
l AS (SELECT batch_id, qid, ln(sum(exp(s))) - max(s) FILTER (WHERE docid = qid + 1) AS loss FROM s GROUP BY batch_id, qid)
SELECT CAST(batch_id AS BIGINT) AS batch_id, 'mean' AS reduction, round(avg(loss), 6) AS loss FROM l GROUP BY batch_id
UNION ALL SELECT CAST(batch_id AS BIGINT), 'sum', round(sum(loss), 6) FROM l GROUP BY batch_id
"""

POOL_MASKED = """
WITH x AS (SELECT vec_id, t, d, CAST(embedding[t * 8 + d + 1] AS DOUBLE) AS h, CAST((vec_id + 3 * t) % 5 <> 0 AS INTEGER) AS m
           FROM embeddings, range(0, 8) r1(t), range(0, 8) r2(d)),
z AS (SELECT vec_id, greatest(coalesce(min(t) FILTER (WHERE m = 0), 8) - 1, 0) AS last FROM x GROUP BY vec_id)
SELECT x.vec_id, 'last_token' AS method, d AS dim, round(h * m, 6) AS value FROM x JOIN z ON x.vec_id = z.vec_id AND x.t = z.last
UNION ALL SELECT vec_id, 'mean', d, round(sum(h * m) / greatest(sum(m), 1e-9), 6) FROM x GROUP BY vec_id, d
UNION ALL SELECT vec_id, 'weightedmean', d, round(sum(h * m * (t + 1)) / greatest(sum(m * (t + 1)), 1e-9), 6) FROM x GROUP BY vec_id, d
"""

POOL_TOKENS = """
WITH t AS (
  SELECT vec_id, least(label + 1, 8) AS n, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT vec_id, n, tok, d, v[tok * 8 + d + 1] AS h
      FROM t, range(0, 8) r1(tok), range(0, 8) r2(d)),
p AS (
  SELECT vec_id, d,
    max(CASE WHEN tok = 0 THEN h END) AS first_token,
    max(CASE WHEN tok = n - 1 THEN h END) AS last_token,
    sum(CASE WHEN tok < n THEN h ELSE 0 END) / greatest(max(n), 1e-9) AS mean,
    sum(CASE WHEN tok < n THEN (tok + 1) * h ELSE 0 END) / greatest(max(n) * (max(n) + 1) / 2.0, 1e-9) AS weightedmean
  FROM x GROUP BY vec_id, d)
SELECT vec_id, method, CAST(d AS BIGINT) AS dim, round(value, 6) AS value FROM p
UNPIVOT (value FOR method IN (first_token, last_token, mean, weightedmean))
"""

# ---------------------------------------------------------------- QA answers

# ASCII-safe normalisation (all fixture text is letters, digits, whitespace and ASCII punctuation)
PUNCT_CLASS = r"[!-/:-@\[-`{-~]"


def toks_sql(x: str) -> str:
    return (f"list_filter(string_split_regex(regexp_replace(lower({x}), '{PUNCT_CLASS}', '', 'g'), '\\s+'), "
            f"lambda t: t <> '' AND t NOT IN ('a', 'an', 'the'))")


TURN_PAIRS = """x AS (
  SELECT conv_id, turn, role, text,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role,
         lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_text
  FROM conversations),
nxt AS (
  SELECT a.conv_id, a.turn, (SELECT b.text FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn > a.turn
                               AND b.role = 'assistant' ORDER BY b.turn LIMIT 1) AS next_asst
  FROM conversations a WHERE a.role = 'assistant'),
golds AS (
  SELECT x.conv_id, x.turn, x.text AS pred,
         list_filter([CASE WHEN x.prev_role = 'user' THEN x.prev_text END, n.next_asst], lambda g: g IS NOT NULL) AS golds
  FROM x JOIN nxt n ON x.conv_id = n.conv_id AND x.turn = n.turn WHERE x.role = 'assistant'),
refs AS (SELECT * FROM golds WHERE len(golds) > 0),
gl AS (SELECT conv_id, turn, pred, unnest(golds) AS gold, generate_subscripts(golds, 1) AS gi FROM refs),"""


def _score_sql(src: str, ids: list[str], v2: bool) -> str:
    """Relational token overlap: unnest tokens, count, join on token, sum(least)."""
    idc = ", ".join(ids)
    jn = " AND ".join(f"g.{i} = p.{i}" for i in ids)
    f1 = ("CASE WHEN len(pt) = 0 OR len(gt) = 0 THEN CAST(len(pt) = len(gt) AS DOUBLE) "
          "WHEN same = 0 THEN 0.0 ELSE 2.0 * (same / len(pt)) * (same / len(gt)) / ((same / len(pt)) + (same / len(gt))) END"
          if v2 else
          "CASE WHEN same = 0 THEN 0.0 ELSE 2.0 * (same / len(pt)) * (same / len(gt)) / ((same / len(pt)) + (same / len(gt))) END")
    return f"""tk AS (SELECT {idc}, gi, pred, gold, {toks_sql('pred')} AS pt, {toks_sql('gold')} AS gt FROM {src}),
pc AS (SELECT {idc}, t, count(*) AS c FROM (SELECT DISTINCT {idc}, pt FROM tk), unnest(pt) u(t) GROUP BY ALL),
gc AS (SELECT {idc}, gi, t, count(*) AS c FROM (SELECT {idc}, gi, gt FROM tk), unnest(gt) u(t) GROUP BY ALL),
common AS (SELECT g.{idc.replace(', ', ', g.')}, g.gi, sum(least(g.c, p.c)) AS same
           FROM gc g JOIN pc p ON {jn} AND g.t = p.t GROUP BY ALL),
per_gold AS (
  SELECT tk.{idc.replace(', ', ', tk.')}, tk.gi, tk.pred,
         CAST(array_to_string(pt, ' ') = array_to_string(gt, ' ') AS DOUBLE) AS em,
         pt, gt, coalesce(c.same, 0) AS same
  FROM tk LEFT JOIN common c ON {" AND ".join(f"tk.{i} = c.{i}" for i in ids)} AND tk.gi = c.gi),
scored AS (SELECT {idc}, any_value(pred) AS pred, max(em) AS exact, max({f1}) AS f1 FROM per_gold GROUP BY {idc}),"""


ANSWER_EM_F1 = f"""
WITH {TURN_PAIRS}
{_score_sql('gl', ['conv_id', 'turn'], False)}
fin AS (SELECT 1)
SELECT conv_id, turn, round(exact, 6) AS exact_match, round(f1, 6) AS f1 FROM scored
"""

SQUAD_V1_SUMMARY = f"""
WITH {TURN_PAIRS}
{_score_sql('gl', ['conv_id', 'turn'], False)}
w AS (SELECT 100.0 * avg(exact) AS exact_match, 100.0 * avg(f1) AS f1 FROM scored)
{long_sql('w', [], ['exact_match', 'f1'])}
"""

V2_BASE = f"""b AS (
  SELECT l.doc_id, l.quality = 1 AS has_ans,
         CASE WHEN l.quality = 1 THEN d.text END AS gold_raw,
         CASE WHEN l.toxic = 1 THEN '' WHEN d.doc_id % 3 = 0 THEN d.text ELSE replace(d.text, 'er', 'e ') END AS pred,
         CAST(d.n_chars % 100 AS DOUBLE) / 100.0 AS na_prob
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
gl AS (SELECT doc_id, 1 AS gi, pred,
              CASE WHEN gold_raw IS NOT NULL AND len({toks_sql('gold_raw')}) > 0 THEN gold_raw ELSE '' END AS gold
       FROM b),"""

SQUAD_V2_SUMMARY = f"""
WITH {V2_BASE}
{_score_sql('gl', ['doc_id'], True)}
r AS (SELECT b.has_ans, CASE WHEN b.na_prob > 0.8 THEN CAST(NOT b.has_ans AS DOUBLE) ELSE s.exact END AS exact,
             CASE WHEN b.na_prob > 0.8 THEN CAST(NOT b.has_ans AS DOUBLE) ELSE s.f1 END AS f1 FROM scored s JOIN b ON s.doc_id = b.doc_id),
w AS (SELECT 100.0 * avg(exact) AS exact, 100.0 * avg(f1) AS f1, count(*) AS total,
             100.0 * avg(CASE WHEN has_ans THEN exact END) AS HasAns_exact,
             100.0 * avg(CASE WHEN has_ans THEN f1 END) AS HasAns_f1,
             count(*) FILTER (WHERE has_ans) AS HasAns_total,
             100.0 * avg(CASE WHEN NOT has_ans THEN exact END) AS NoAns_exact,
             100.0 * avg(CASE WHEN NOT has_ans THEN f1 END) AS NoAns_f1,
             count(*) FILTER (WHERE NOT has_ans) AS NoAns_total FROM r),
l AS ({long_sql('w', [], ['exact', 'f1', 'total', 'HasAns_exact', 'HasAns_f1', 'HasAns_total', 'NoAns_exact', 'NoAns_f1', 'NoAns_total'])})
SELECT * FROM l
WHERE NOT (metric LIKE 'HasAns%' AND (SELECT HasAns_total FROM w) = 0)
  AND NOT (metric LIKE 'NoAns%' AND (SELECT NoAns_total FROM w) = 0)
"""

BEST_THRESHOLD = f"""
WITH {V2_BASE}
{_score_sql('gl', ['doc_id'], True)}
r AS (SELECT s.doc_id, s.exact, s.f1, b.has_ans, b.na_prob, b.pred FROM scored s JOIN b ON s.doc_id = b.doc_id),
d AS (SELECT *, CASE WHEN has_ans THEN exact WHEN pred <> '' THEN -1.0 ELSE 0.0 END AS de,
                CASE WHEN has_ans THEN f1 WHEN pred <> '' THEN -1.0 ELSE 0.0 END AS df FROM r),
c AS (SELECT *, sum(de) OVER (ORDER BY na_prob, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ce,
                sum(df) OVER (ORDER BY na_prob, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cf FROM d),
st AS (SELECT count(*) AS n, count(*) FILTER (WHERE NOT has_ans) AS start, max(ce) AS mce, max(cf) AS mcf FROM c),
te AS (SELECT na_prob AS te FROM c WHERE ce = (SELECT mce FROM st) ORDER BY na_prob, doc_id LIMIT 1),
tf AS (SELECT na_prob AS tf FROM c WHERE cf = (SELECT mcf FROM st) ORDER BY na_prob, doc_id LIMIT 1),
w AS (SELECT 100.0 * (start + greatest(mce, 0.0)) / n AS best_exact,
             CASE WHEN mce > 0 THEN (SELECT te FROM te) ELSE 0.0 END AS best_exact_thresh,
             100.0 * (start + greatest(mcf, 0.0)) / n AS best_f1,
             CASE WHEN mcf > 0 THEN (SELECT tf FROM tf) ELSE 0.0 END AS best_f1_thresh FROM st)
{long_sql('w', [], ['best_exact', 'best_exact_thresh', 'best_f1', 'best_f1_thresh'])}
"""

# ---------------------------------------------------------------- labels, multi-label, dedupe, choice

SPLIT_SQL = ("CASE WHEN event_id % 10 < 8 THEN 'train' WHEN event_id % 10 = 8 THEN 'validation' "
             "ELSE 'test' END")

LABEL_VOCAB = f"""
WITH ev AS (SELECT event_type, {SPLIT_SQL} AS split FROM events),
v AS (SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS BIGINT) AS label_id
      FROM (SELECT DISTINCT event_type AS label FROM ev WHERE event_type IS NOT NULL AND event_type <> '-1'))
SELECT e.split, e.event_type AS label, v.label_id, count(*) AS n
FROM ev e JOIN v ON e.event_type = v.label GROUP BY e.split, e.event_type, v.label_id
"""

UNSEEN_LABELS = f"""
WITH ev AS (SELECT {SPLIT_SQL} AS split, concat_ws(':', CAST(user_id AS VARCHAR), json_extract_string(props, '$.k')) AS label FROM events)
SELECT DISTINCT split, label FROM ev
WHERE split <> 'train' AND label NOT IN (SELECT label FROM ev WHERE split = 'train')
"""

MULTILABEL_F1 = """
WITH v AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS id
           FROM (SELECT DISTINCT event_type AS label FROM events WHERE event_type IS NOT NULL)),
e AS (SELECT event_id // 4 AS grp, event_id % 2 AS odd, v.id FROM events JOIN v ON events.event_type = v.label),
g AS (SELECT grp,
        coalesce(list_sort(list_distinct(list(id) FILTER (WHERE odd = 0))), []::BIGINT[]) AS gold,
        coalesce(list_sort(list_distinct(list(id) FILTER (WHERE odd = 1))), []::BIGINT[]) AS pred
      FROM e GROUP BY grp),
c AS (SELECT gold = pred AS same, len(list_intersect(gold, pred)) AS tp, len(gold) AS ng, len(pred) AS np FROM g),
w AS (SELECT avg(CAST(same AS DOUBLE)) AS subset_accuracy, count(*) AS samples,
             2.0 * sum(tp) / (2.0 * sum(tp) + (sum(np) - sum(tp)) + (sum(ng) - sum(tp))) AS f1_micro FROM c)
""" + long_sql('w', [], ['subset_accuracy', 'samples', 'f1_micro'])

CORPUS_DEDUPE = """
WITH f AS (SELECT text, min(doc_id) AS first_id FROM documents GROUP BY text),
r AS (SELECT first_id, CAST(dense_rank() OVER (ORDER BY first_id) - 1 AS BIGINT) AS corpus_id FROM f)
SELECT d.doc_id, r.corpus_id, d.doc_id = f.first_id AS is_first
FROM documents d JOIN f ON d.text = f.text JOIN r ON f.first_id = r.first_id
"""

CHOICE_ACCURACY = """
WITH a AS (SELECT conv_id, turn, text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx
           FROM conversations WHERE role = 'assistant'),
n AS (SELECT count(*) AS n FROM a),
ex AS (SELECT u.conv_id, u.turn AS uturn, u.text AS question, a.idx, (u.conv_id + u.turn) % 3 AS label
       FROM conversations u JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user'),
cand AS (SELECT ex.*, t.j, (ex.idx + t.j) % (SELECT n FROM n) AS cidx FROM ex, range(0, 3) t(j)),
sc AS (SELECT c.conv_id, c.uturn, c.label, (c.label + c.j) % 3 AS choice,
              -abs(length(c.question || ' ' || a.text) - 2 * length(c.question)) AS score
       FROM cand c JOIN a ON a.idx = c.cidx),
best AS (SELECT conv_id, uturn, label, choice AS pred,
                row_number() OVER (PARTITION BY conv_id, uturn ORDER BY score DESC, choice ASC) AS r FROM sc),
w AS (SELECT avg(CAST(pred = label AS DOUBLE)) AS accuracy, count(*) AS samples FROM best WHERE r = 1)
""" + long_sql('w', [], ['accuracy', 'samples'])

# ---------------------------------------------------------------- tokens, windows, tags, entities
# (fixture text holds only ' ' and '\n' as whitespace, so RE2's ASCII \s equals Python's split)


def _tok_sql(src: str, size: int = 128, step: int = 96) -> str:
    return f"""lists AS (SELECT doc_id, regexp_extract_all(text, '\\s+|\\S+') AS l FROM {src}),
runs AS (SELECT doc_id, unnest(l) AS run, generate_subscripts(l, 1) AS i FROM lists),
offs AS (SELECT doc_id, i, length(run) AS m, regexp_matches(run, '^\\s') AS gap,
           sum(length(run)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS en FROM runs),
tok AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, en - m AS st, en
        FROM offs WHERE NOT gap),
nt AS (SELECT d.doc_id, count(t.pos) AS n FROM (SELECT DISTINCT doc_id FROM {src}) d
       LEFT JOIN tok t ON d.doc_id = t.doc_id GROUP BY d.doc_id),
win AS (SELECT doc_id, n, w AS window_id, w * {step} AS tok_start, least(w * {step} + {size}, n) AS tok_end
        FROM (SELECT doc_id, n, unnest(range(0, 1 + CAST(ceil(greatest(n - {size}, 0) / {step}.0) AS BIGINT))) AS w FROM nt))"""


DOC_WINDOWS = f"""
WITH {_tok_sql('documents')},
edges AS MATERIALIZED (SELECT doc_id, pos, st, en FROM tok
  WHERE pos % 96 = 0 OR (pos + 1 - 128) % 96 = 0 OR pos = (SELECT n - 1 FROM nt WHERE nt.doc_id = tok.doc_id))
SELECT win.doc_id, CAST(window_id AS BIGINT) AS window_id, CAST(tok_start AS BIGINT) AS tok_start,
       CAST(tok_end AS BIGINT) AS tok_end, CAST(s.st AS BIGINT) AS char_start, CAST(e.en AS BIGINT) AS char_end,
       CAST(tok_end - tok_start AS BIGINT) AS n_tokens
FROM win
LEFT JOIN edges s ON s.doc_id = win.doc_id AND s.pos = win.tok_start
LEFT JOIN edges e ON e.doc_id = win.doc_id AND e.pos = win.tok_end - 1
"""

SPAN_LABELS = f"""
WITH ex AS (SELECT d.doc_id, b.item_id, instr(d.text, b.text) - 1 AS sc, instr(d.text, b.text) - 1 + length(b.text) AS ec
            FROM documents d JOIN benchmark b ON length(b.text) > 0 AND instr(d.text, b.text) > 0),
ctx AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM ex)),
{_tok_sql('ctx')},
lab AS (
  SELECT x.doc_id, x.item_id, w.window_id, x.sc, x.ec, min(t.st) AS wst, max(t.en) AS wen,
         count(t.pos) FILTER (WHERE t.st <= x.sc) AS nbs, count(t.pos) FILTER (WHERE t.en < x.ec) AS nbe
  FROM ex x JOIN win w ON w.doc_id = x.doc_id
  LEFT JOIN tok t ON t.doc_id = w.doc_id AND t.pos >= w.tok_start AND t.pos < w.tok_end
  GROUP BY x.doc_id, x.item_id, w.window_id, x.sc, x.ec)
SELECT doc_id, item_id, CAST(window_id AS BIGINT) AS window_id,
       CAST(CASE WHEN wst <= sc AND wen >= ec THEN nbs ELSE 0 END AS BIGINT) AS start_position,
       CAST(CASE WHEN wst <= sc AND wen >= ec THEN nbe + 1 ELSE 0 END AS BIGINT) AS end_position
FROM lab
"""

_WORDS = """w0 AS (SELECT doc_id, coalesce(lang, '_') AS lang, unnest(regexp_extract_all(text, '\\S+')) AS word,
              generate_subscripts(regexp_extract_all(text, '\\S+'), 1) - 1 AS wid FROM documents),
w AS (SELECT *, regexp_matches(word, '^\\p{Lu}') AS gcap,
             regexp_matches(word, '^\\p{Lu}') AND length(word) > 3 AS pcap FROM w0),
t AS (SELECT *,
        CASE WHEN gcap THEN (CASE WHEN coalesce(lag(gcap) OVER (PARTITION BY doc_id ORDER BY wid), false)
                                  THEN 'I-' ELSE 'B-' END) || lang ELSE 'O' END AS gtag,
        CASE WHEN pcap THEN (CASE WHEN coalesce(lag(pcap) OVER (PARTITION BY doc_id ORDER BY wid), false)
                                  THEN 'I-' ELSE 'B-' END) || lang ELSE 'O' END AS ptag
      FROM w)"""

ALIGN_TAGS = f"""
WITH {_WORDS},
v AS (SELECT gtag AS tag, dense_rank() OVER (ORDER BY gtag) - 1 AS id FROM (SELECT DISTINCT gtag FROM t)),
b AS (SELECT v.tag, v.id, coalesce(vi.id, v.id) AS all_id FROM v LEFT JOIN v vi ON vi.tag = regexp_replace(v.tag, '^B-', 'I-')),
np AS (SELECT doc_id, wid, gtag, CAST(ceil(length(word) / 4.0) AS BIGINT) AS np FROM t),
cum AS (SELECT *, sum(np) OVER (PARTITION BY doc_id ORDER BY wid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - np AS before
        FROM np),
pieces AS (SELECT doc_id, wid, gtag, before, unnest(range(0, np)) AS j FROM cum),
body AS (SELECT p.doc_id, p.before + p.j + 1 AS pos, p.wid AS word_id,
                CASE WHEN p.j = 0 THEN b.id ELSE -100 END AS label_id,
                CASE WHEN p.j = 0 THEN b.id ELSE b.all_id END AS label_all_id
         FROM pieces p JOIN b ON p.gtag = b.tag),
tot AS (SELECT d.doc_id, coalesce(sum(np.np), 0) AS total FROM documents d LEFT JOIN np ON np.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(word_id AS BIGINT) AS word_id,
       CAST(label_id AS BIGINT) AS label_id, CAST(label_all_id AS BIGINT) AS label_all_id FROM body
UNION ALL SELECT doc_id, 0, NULL, -100, -100 FROM tot
UNION ALL SELECT doc_id, CAST(total + 1 AS BIGINT), NULL, -100, -100 FROM tot
"""

ENTITY_REPORT = f"""
WITH {_WORDS},
gi AS (SELECT doc_id, lang, wid - row_number() OVER (PARTITION BY doc_id ORDER BY wid) AS g, wid FROM w WHERE gcap),
pi AS (SELECT doc_id, lang, wid - row_number() OVER (PARTITION BY doc_id ORDER BY wid) AS g, wid FROM w WHERE pcap),
ge AS (SELECT doc_id, lang, min(wid) AS s, max(wid) AS e FROM gi GROUP BY doc_id, lang, g),
pe AS (SELECT doc_id, lang, min(wid) AS s, max(wid) AS e FROM pi GROUP BY doc_id, lang, g),
tp AS (SELECT ge.lang FROM ge JOIN pe ON ge.doc_id = pe.doc_id AND ge.s = pe.s AND ge.e = pe.e AND ge.lang = pe.lang),
types AS (SELECT lang FROM ge UNION SELECT lang FROM pe),
c AS (SELECT ty.lang AS type,
             CAST((SELECT count(*) FROM ge WHERE ge.lang = ty.lang) AS DOUBLE) AS ng,
             CAST((SELECT count(*) FROM pe WHERE pe.lang = ty.lang) AS DOUBLE) AS np,
             CAST((SELECT count(*) FROM tp WHERE tp.lang = ty.lang) AS DOUBLE) AS ntp FROM types ty),
ca AS (SELECT type, ng, np, ntp FROM c UNION ALL SELECT 'overall', sum(ng), sum(np), sum(ntp) FROM c),
m AS (SELECT type, ng,
        CASE WHEN np = 0 THEN 0.0 ELSE ntp / np END AS p, CASE WHEN ng = 0 THEN 0.0 ELSE ntp / ng END AS r FROM ca),
f AS (SELECT type, ng AS number, p AS precision, r AS recall, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM m),
l AS ({long_sql('f', ['type'], ['precision', 'recall', 'f1', 'number'])})
SELECT * FROM l WHERE NOT (type = 'overall' AND metric = 'number')
UNION ALL
SELECT 'overall', 'accuracy', round(avg(CAST(gtag = ptag AS DOUBLE)), 6) FROM t
"""

ENTITY_REPORT_BY_LANG = f"""
WITH {_WORDS},
gi AS (SELECT doc_id, lang, wid - row_number() OVER (PARTITION BY doc_id ORDER BY wid) AS g, wid FROM w WHERE gcap),
pi AS (SELECT doc_id, lang, wid - row_number() OVER (PARTITION BY doc_id ORDER BY wid) AS g, wid FROM w WHERE pcap),
ge AS (SELECT doc_id, lang, min(wid) AS s, max(wid) AS e FROM gi GROUP BY doc_id, lang, g),
pe AS (SELECT doc_id, lang, min(wid) AS s, max(wid) AS e FROM pi GROUP BY doc_id, lang, g),
tp AS (SELECT ge.lang FROM ge JOIN pe ON ge.doc_id = pe.doc_id AND ge.s = pe.s AND ge.e = pe.e),
c AS (SELECT lang, avg(CAST(gtag = ptag AS DOUBLE)) AS accuracy,
        CAST((SELECT count(*) FROM ge WHERE ge.lang = t.lang) AS DOUBLE) AS ng,
        CAST((SELECT count(*) FROM pe WHERE pe.lang = t.lang) AS DOUBLE) AS np,
        CAST((SELECT count(*) FROM tp WHERE tp.lang = t.lang) AS DOUBLE) AS ntp FROM t GROUP BY lang),
m AS (SELECT lang, accuracy, CASE WHEN np = 0 THEN 0.0 ELSE ntp / np END AS p, CASE WHEN ng = 0 THEN 0.0 ELSE ntp / ng END AS r FROM c),
f AS (SELECT lang, p AS overall_precision, r AS overall_recall, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS overall_f1,
        accuracy AS overall_accuracy FROM m)
{long_sql('f', ['lang'], ['overall_precision', 'overall_recall', 'overall_f1', 'overall_accuracy'])}
"""

# words of a turn; a pair is cut to 24 - 3 tokens
PAIR_TRUNCATION = """
WITH c AS (SELECT conv_id, turn, role, regexp_extract_all(text, '\\S+') AS w FROM conversations),
p AS (SELECT u.conv_id, u.turn, u.w AS f, a.w AS s, len(u.w) AS a, len(a.w) AS b
      FROM c u JOIN c a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
n AS (
  SELECT *, 'longest_first' AS strategy, false AS bad,
    CASE WHEN a + b <= 21 THEN a WHEN a <= 10 THEN a WHEN b <= 10 THEN 21 - b WHEN a > b THEN 11 ELSE 10 END AS na,
    CASE WHEN a + b <= 21 THEN b WHEN a <= 10 THEN 21 - a WHEN b <= 10 THEN b WHEN a > b THEN 10 ELSE 11 END AS nb FROM p
  UNION ALL
  SELECT *, 'only_second', a + b > 21 AND a >= 21, a, CASE WHEN a + b > 21 AND a < 21 THEN 21 - a ELSE b END FROM p
  UNION ALL
  SELECT *, 'only_first', a + b > 21 AND b >= 21, CASE WHEN a + b > 21 AND b < 21 THEN 21 - b ELSE a END, b FROM p)
SELECT conv_id, turn, strategy, array_to_string(f[1:na], ' ') AS first, array_to_string(s[1:nb], ' ') AS second, bad AS truncation_error FROM n
"""

# ---------------------------------------------------------------- QA n-best

def _nbest_sql(allowed: str = "TRUE") -> str:
    """Spans and nulls of every document's windows; ``allowed``: condition on the start place s."""
    return f"""{_tok_sql('documents', 62, 46)},
f AS MATERIALIZED (SELECT win.doc_id AS example_id, CAST(window_id AS INTEGER) AS feature, tok_start, tok_end - tok_start AS nt, e.embedding AS sl,
        list_reverse(e.embedding) AS el FROM win JOIN embeddings e ON e.vec_id = (win.doc_id + 7 * window_id) % (SELECT count(*) FROM embeddings)),
pos AS (SELECT * FROM range(0, 64) t(i)),
sv AS (SELECT f.example_id, f.feature, f.nt, f.tok_start, p.i AS s, f.sl[p.i + 1] AS v FROM f, pos p),
ev AS (SELECT f.example_id, f.feature, p.i AS e, f.el[p.i + 1] AS v FROM f, pos p),
st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id, feature ORDER BY v DESC, s) AS r FROM sv) WHERE r <= 20),
en AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id, feature ORDER BY v DESC, e) AS r FROM ev) WHERE r <= 20),
cand AS (SELECT st.example_id, st.feature, st.tok_start, st.s, en.e, st.v + en.v AS score, st.v AS start_logit, en.v AS end_logit
         FROM st JOIN en ON st.example_id = en.example_id AND st.feature = en.feature
         WHERE st.s BETWEEN 1 AND nt AND en.e BETWEEN 1 AND nt AND en.e >= st.s AND en.e - st.s + 1 <= 30 AND {allowed}),
ctop AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY score DESC, feature, s, e) AS r2
                        FROM cand) WHERE r2 <= 20),
opened AS MATERIALIZED (SELECT c.*, a.st AS cs FROM ctop c JOIN tok a ON a.doc_id = c.example_id AND a.pos = c.tok_start + c.s - 1),
spans AS MATERIALIZED (SELECT c.example_id, c.feature, 0 AS kind, c.s, c.e, score, start_logit, end_logit, c.cs, b.en AS ce
          FROM opened c JOIN tok b ON b.doc_id = c.example_id AND b.pos = c.tok_start + c.e - 1)"""


_NBEST = f"""{_nbest_sql()},
nul AS (SELECT example_id, feature, 1 AS kind, 0 AS s, 0 AS e, sl[1] + el[1] AS score, sl[1] AS start_logit,
               el[1] AS end_logit, 0 AS cs, 0 AS ce,
               row_number() OVER (PARTITION BY example_id ORDER BY sl[1] + el[1], feature) AS r FROM f),
allc AS (SELECT * FROM spans
         UNION ALL SELECT example_id, feature, kind, s, e, score, start_logit, end_logit, cs, ce FROM nul WHERE r = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY score DESC, kind, feature, s, e) - 1 AS rank FROM allc),
kept AS (SELECT rk.*, CASE WHEN kind = 1 THEN '' ELSE coalesce(substr(d.text, CAST(cs + 1 AS BIGINT), CAST(ce - cs AS BIGINT)), '') END AS text
         FROM rk LEFT JOIN documents d ON d.doc_id = rk.example_id WHERE rank < 20 OR kind = 1),
cnt AS (SELECT example_id, count(*) AS n, max(CAST(text <> '' AS INTEGER)) AS nb FROM kept GROUP BY example_id),
fin AS (SELECT example_id, rank, kind, text, score, start_logit, end_logit FROM kept
        UNION ALL SELECT example_id, -1, 2, 'empty', 0.0::FLOAT, 0.0::FLOAT, 0.0::FLOAT FROM cnt WHERE n = 1 AND nb = 0),
prob AS (SELECT *, exp(CAST(score AS DOUBLE) - max(CAST(score AS DOUBLE)) OVER (PARTITION BY example_id)) AS ex FROM fin),
nb AS (SELECT example_id, row_number() OVER (PARTITION BY example_id ORDER BY rank) - 1 AS rank, kind, text, score,
              start_logit, end_logit, ex / sum(ex) OVER (PARTITION BY example_id) AS probability FROM prob)"""

QA_PREDICTIONS_V1 = f"""
WITH {_nbest_sql('st.s % 4 <> 1')},
best AS (SELECT s.example_id, coalesce(substr(d.text, CAST(cs + 1 AS BIGINT), CAST(ce - cs AS BIGINT)), '') AS text FROM
         (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY score DESC, feature, s, e) AS r FROM spans) s
         JOIN documents d ON d.doc_id = s.example_id WHERE r = 1)
SELECT d.doc_id AS example_id, coalesce(best.text, 'empty') AS prediction_text FROM documents d LEFT JOIN best ON best.example_id = d.doc_id
"""

NBEST_ANSWERS = f"""
WITH {_NBEST}
SELECT example_id, CAST(rank AS BIGINT) AS rank, text, round(CAST(score AS DOUBLE), 6) AS score,
       round(probability, 6) AS probability FROM nb
"""

QA_PREDICTIONS = f"""
WITH {_NBEST},
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY rank) AS r
                        FROM nb WHERE text <> '') WHERE r = 1),
nulls AS (SELECT example_id, score AS null_score FROM nb WHERE kind = 1),
d AS (SELECT n.example_id, b.text, n.null_score - b.start_logit - b.end_logit AS diff
      FROM nulls n LEFT JOIN best b ON n.example_id = b.example_id)
SELECT example_id, CASE WHEN text IS NULL THEN '' WHEN diff > 0 THEN '' ELSE text END AS prediction_text,
       round(CAST(diff AS DOUBLE), 6) AS score_diff FROM d
"""

# ---------------------------------------------------------------- training tuples

TRAINING_TUPLES = """
WITH m AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx,
                  count(*) OVER (PARTITION BY label) AS n FROM embeddings),
q AS (SELECT vec_id, label, idx, n, (vec_id + 42 + 1) % (n - 1) AS j FROM m WHERE n > 1),
pos AS (SELECT q.vec_id AS query_id, 0 AS position, p.vec_id AS doc_id
        FROM q JOIN m p ON p.label = q.label AND p.idx = CASE WHEN q.j < q.idx THEN q.j ELSE q.j + 1 END),
cnt AS (SELECT label, count(*) AS c FROM embeddings GROUP BY label),
neg AS (SELECT q.vec_id AS query_id, t.t + 1 AS position, d.vec_id AS doc_id
        FROM q JOIN cnt c ON c.label = (q.label + 1) % 10 CROSS JOIN range(0, 3) t(t)
        JOIN m d ON d.label = c.label AND d.idx = (1 * 3 + t.t) % c.c
        WHERE c.c >= 3)
SELECT query_id, CAST(position AS BIGINT) AS position, doc_id FROM pos
UNION ALL SELECT query_id, CAST(position AS BIGINT), doc_id FROM neg
"""

# ---------------------------------------------------------------- suite report


def _walk_sql(source: str) -> str:
    """Recursive table `walk` (item, slot, n, x, ...): x passes a keyed Feistel network of 4 rounds until it is below n.
    ``source``: table with item, slot, n."""
    step = "SELECT item, slot, n, w, key, x >> w AS l, x & ((1::BIGINT << w) - 1) AS r FROM ({inner}) s0"
    for add in (12345, 1013904223, 907633515, 362437):
        step = f"SELECT *, (((r + key + {add}) & 2147483647) * 1103515245) & 2147483647 AS a FROM ({step}) s1"
        step = f"SELECT item, slot, n, w, key, r AS l, xor(l, ((xor(a, a >> 15) * 3329051) & 2147483647) >> (31 - w)) AS r FROM ({step}) s3"
    step = f"SELECT item, slot, n, w, key, (l << w) | r AS x FROM ({step}) s2"
    first = f"""SELECT item, slot, n, greatest(1, CAST(ceil(log2(n) / 2) AS INTEGER)) AS w,
      ((item % 2147483648) * 1103515245 + 42) % 2147483648 AS key, CAST(slot AS BIGINT) AS x FROM {source}"""
    return f"""walk AS ({step.replace('{inner}', first)}
  UNION ALL {step.replace('{inner}', 'SELECT item, slot, n, w, key, x FROM walk WHERE x >= n')}),
places AS (SELECT item, slot, x FROM walk WHERE x < n)"""


SHUFFLED_NEGATIVES = f"""
WITH RECURSIVE m AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx,
                  count(*) OVER (PARTITION BY label) AS n FROM embeddings),
cnt AS (SELECT label, count(*) AS c FROM embeddings GROUP BY label),
want AS (SELECT q.vec_id AS item, (3 + t.t) % c.c AS slot, c.c AS n, t.t, c.label FROM m q JOIN cnt c ON c.label = (q.label + 1) % 10
         CROSS JOIN range(0, 3) t(t) WHERE c.c >= 3),
{_walk_sql('want')}
SELECT w.item AS query_id, CAST(w.t + 1 AS BIGINT) AS position, d.vec_id AS doc_id
FROM want w JOIN places p ON p.item = w.item AND p.slot = w.slot JOIN m d ON d.label = w.label AND d.idx = p.x
"""

BORROWED_NEGATIVES = f"""
WITH RECURSIVE e AS (SELECT vec_id, vec_id // 3 AS grp, row_number() OVER (PARTITION BY vec_id // 3 ORDER BY vec_id) - 1 AS idx,
                  count(*) OVER (PARTITION BY vec_id // 3) AS np FROM embeddings),
c AS (SELECT grp, count(*) AS n FROM e GROUP BY grp),
i AS (SELECT e.vec_id, e.grp, e.idx, e.np - 1 AS np, CASE WHEN e.vec_id % 2 = 0 THEN e.grp + 1 ELSE -1 END AS ng FROM e),
j AS (SELECT i.*, coalesce(c.n, 0) AS m, i.np + coalesce(c.n, 0) AS tot FROM i LEFT JOIN c ON c.grp = i.ng),
donor AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS slot FROM j WHERE tot > 0),
want AS (SELECT j.vec_id AS item, d.d AS slot, (SELECT count(*) FROM donor) AS n FROM j CROSS JOIN range(0, 10) d(d)
         WHERE d.d < (SELECT count(*) FROM donor)),
{_walk_sql('want')},
drawn AS (SELECT j.vec_id, j.m, p.slot AS d, o.* EXCLUDE (vec_id, m) FROM places p JOIN j ON j.vec_id = p.item JOIN donor o ON o.slot = p.x
          WHERE o.vec_id <> j.vec_id),
ranked AS (SELECT *, m + row_number() OVER (PARTITION BY vec_id ORDER BY d) AS position, (vec_id + 42 + 1) % tot AS k FROM drawn),
picked AS (SELECT vec_id, position, CASE WHEN k < np THEN grp ELSE ng END AS g,
             CASE WHEN k >= np THEN k - np WHEN k < idx THEN k ELSE k + 1 END AS at FROM ranked WHERE position <= 5)
SELECT j.vec_id AS query_id, CAST(x.idx + 1 AS BIGINT) AS position, x.vec_id AS doc_id FROM j JOIN e x ON x.grp = j.ng WHERE j.m < 5
UNION ALL
SELECT p.vec_id, CAST(p.position AS BIGINT), x.vec_id FROM picked p JOIN e x ON x.grp = p.g AND x.idx = p.at
"""


def _suite_sql() -> str:
    tasks = {"quality": ["accuracy"], "quality_pair": ["f1", "accuracy"], "entities": ["f1", "precision", "recall"]}
    langs = ["de", "en", "es", "fr", "sw"]
    spec = " UNION ALL ".join(
        f"SELECT '{t}' AS task, '{lang}' AS lang, '{m}' AS metric, {i} AS metric_rank"
        for t, ms in tasks.items() for lang in langs for i, m in enumerate(ms))
    suites = " UNION ALL ".join(
        f"SELECT '{s}' AS suite, '{t}' AS task" for s, ts in
        {"suite_a": ["quality", "quality_pair"], "suite_b": ["quality_pair", "entities"]}.items() for t in ts)
    return f"""
WITH acc AS (SELECT 'quality' AS task, config, metric, value FROM ({ACCURACY_BY_LANG}) x WHERE config <> 'avg'),
pair AS (SELECT 'quality_pair' AS task, config, metric, value FROM ({F1_MCC_BY_LANG}) x),
ent AS (SELECT 'entities' AS task, type AS config, metric, value FROM ({ENTITY_REPORT}) x WHERE type <> 'overall'),
res AS (SELECT * FROM acc UNION ALL SELECT * FROM pair UNION ALL SELECT * FROM ent),
spec AS ({spec}),
suites AS ({suites}),
filled AS (SELECT s.task, s.lang, s.metric, s.metric_rank, coalesce(r.value, 0.0) AS value
           FROM spec s LEFT JOIN res r ON r.task = s.task AND r.config = s.lang AND r.metric = s.metric),
first AS (SELECT * FROM filled WHERE metric_rank = 0),
tasks AS (SELECT task, avg(value) * 100.0 AS value FROM first GROUP BY task)
SELECT 'fixture' AS model, 'task' AS section, task AS name, round(value, 6) AS value FROM tasks
UNION ALL SELECT 'fixture', 'suite', s.suite, round(avg(t.value), 6) FROM tasks t JOIN suites s ON s.task = t.task GROUP BY s.suite
UNION ALL SELECT 'fixture', 'lang', lang, round(avg(value) * 100.0, 6) FROM first GROUP BY lang
UNION ALL SELECT 'fixture', 'detail', task || '.' || lang, round(value * 100.0, 6) FROM first
"""


def _held_sql(tasks, models: int, marker: str) -> str:
    """Table `held` (model, task, config, lang, metric, metric_rank, factor, value) as the fixture's results meet the specification."""
    rows = [(t.name, c, lang, m, k, t.factor) for t in tasks for c, lang in t.configs for k, m in enumerate(t.metrics)]
    entry = {}
    for t in tasks:
        for c, _ in t.configs:
            for m in t.metrics:
                entry[t.name, c, m] = len(entry)
    spec = ", ".join(f"({entry[t, c, m]}, '{t}', '{c}', '{lang}', '{m}', {k}, {float(f)})" for t, c, lang, m, k, f in rows)
    return f"""spec(entry, task, config, lang, metric, metric_rank, factor) AS (VALUES {spec}),
r AS (SELECT event_id % {len(entry)} AS entry, user_id % {models} AS m, avg(value) / 100.0 AS value FROM events GROUP BY ALL),
kept AS (SELECT entry, CASE WHEN m = 0 THEN '' ELSE 'model' || m END AS model, value FROM r WHERE entry > 0 OR m < {models - 1}),
models AS (SELECT DISTINCT model FROM kept JOIN spec USING (entry) WHERE task = '{marker}'),
held AS (SELECT models.model, spec.*, kept.value FROM models CROSS JOIN spec LEFT JOIN kept ON kept.model = models.model AND kept.entry = spec.entry),
scores AS (SELECT model, task, metric, metric_rank, avg(coalesce(value, 0) * factor) AS value FROM held GROUP BY ALL)"""


def _glue_sql() -> str:
    from ..operators.benchmark import GLUE

    names = [t.name for t in GLUE]
    cols = ", ".join(f"coalesce(max(value) FILTER (WHERE task = '{n}'), 0) AS {n}" for n in names)
    avg = " + ".join(names)
    out = ", ".join(f"round({n}, 6) AS {n}" for n in names)
    return f"""WITH {_held_sql(GLUE, 4, 'mnli')},
w AS (SELECT model, {cols} FROM scores WHERE metric_rank = 0 GROUP BY model)
SELECT model, round(({avg}) / {len(names)}, 6) AS avg, {out} FROM w"""


def _multilingual_sql() -> str:
    from ..operators.benchmark import MULTILINGUAL, SUITES

    suites = ", ".join(f"('{s}', '{t}')" for s, ts in SUITES.items() for t in ts)
    return f"""WITH {_held_sql(MULTILINGUAL, 3, 'mlqa')},
suites(suite, task) AS (VALUES {suites}),
first AS (SELECT model, task, lang, coalesce(value, 0) * factor AS value FROM held WHERE metric_rank = 0),
l AS (SELECT model, 'task' AS section, task || '-' || metric AS name, value FROM scores
  UNION ALL SELECT model, 'suite', suite, avg(value) FROM scores JOIN suites USING (task) WHERE metric_rank = 0 GROUP BY model, suite
  UNION ALL SELECT model, 'lang', lang, avg(value) FROM first GROUP BY model, lang
  UNION ALL SELECT model, 'detail', task || '.' || lang, value FROM first
  UNION ALL SELECT model, 'missing', task, count(*) FROM held WHERE value IS NULL GROUP BY model, task)
SELECT model, section, name, round(CAST(value AS DOUBLE), 6) AS value FROM l"""


GLUE_REPORT = _glue_sql()
MULTILINGUAL_REPORT = _multilingual_sql()
SUITE_REPORT = _suite_sql()

# ---------------------------------------------------------------- sink round trips

PREDICTIONS_ROUNDTRIP = f"""
WITH {CLS.replace("SELECT d.lang AS config,", "SELECT l.doc_id, d.lang AS config,")}
SELECT config, row_number() OVER (PARTITION BY config ORDER BY doc_id) - 1 AS index,
       CAST(pred AS VARCHAR) AS prediction
FROM cls
"""

TAGS_ROUNDTRIP = f"""
WITH {_WORDS},
lines AS (SELECT doc_id, lang AS config, string_agg(gtag, ' ' ORDER BY wid) AS line FROM t GROUP BY doc_id, lang)
SELECT d.lang AS config, coalesce(l.line, '') AS line
FROM documents d LEFT JOIN lines l ON l.doc_id = d.doc_id
"""

RESULTS_ROUNDTRIP = f"""
SELECT 'fixture' AS model, 'quality' AS task, config, metric, value FROM ({ACCURACY_BY_LANG}) a
UNION ALL
SELECT 'fixture', 'entities', type, metric, value FROM ({ENTITY_REPORT}) e
"""
