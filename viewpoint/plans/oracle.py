"""Independent DuckDB SQL for every catalogue query.

Each string runs on the raw parquet views (documents, conversations,
embeddings, ...) and re-derives the fixture tables itself, so it checks the
Spark plan end to end.
"""

from __future__ import annotations

from viewpoint.plans.sqltext import (
    NL,
    cov,
    except_,
    first_sentence,
    first_sentence_by_tables,
    length,
    lex_tokens,
    mean,
    norm,
    q,
    r6,
    rouge_tokens,
    side,
    split_ws,
    spread,
    token_set,
    tokens,
)

# --- fixture CTEs -----------------------------------------------------------

TOPICS = f"""
topics0 AS (
  SELECT doc_id AS row_id,
         array_to_string({split_ws('text')}[1:4], ' ') AS title,
         text AS alt_op,
         array_to_string(list_filter(string_split(text, {NL}), lambda x, i: (i - 1) % 5 <> 4 AND (i - 1) % 2 = 0), {NL}) AS left_op,
         array_to_string(list_filter(string_split(text, {NL}), lambda x, i: (i - 1) % 5 <> 4 AND (i - 1) % 2 = 1), {NL}) AS right_op
  FROM documents),
topics AS (
  SELECT * EXCLUDE (L, R), {spread('L', '20')} || '.' AS left_sum, {spread('R', '20')} || '.' AS right_sum
  FROM (SELECT *, {split_ws('left_op')} AS L, {split_ws('right_op')} AS R FROM topics0))"""

PREDS = f"""
preds0 AS (
  SELECT t.*, m.m, {split_ws('t.left_op')} AS L, {split_ws('t.right_op')} AS R
  FROM topics t CROSS JOIN (SELECT unnest([0, 1, 2]) AS m) m),
preds AS (
  SELECT 'm' || m AS model, row_id, title, alt_op, left_op, right_op, left_sum, right_sum,
    'The left ' || {spread('L', '8 + m')} || '. Tail here.' AS sp_left_pred,
    'The right ' || {spread('R', '8 + m')} || '. Tail here.' AS sp_right_pred,
    'The left ' || {spread('L', '6 + 2 * m')} || ' ' || {spread('R', '6 - 2 * m')} || '. Tail here.' AS mp_left_pred,
    'The right ' || {spread('R', '6 + 2 * m')} || ' ' || {spread('L', '6 - 2 * m')} || '. Tail here.' AS mp_right_pred
  FROM preds0)"""


def _summ_sets(src: str, spl: str, spr: str, mpl: str, mpr: str, model: str = "model") -> str:
    cols = ", ".join(f"{token_set(first_sentence(c))} AS {k}" for k, c in (("spl", spl), ("spr", spr), ("mpl", mpl), ("mpr", mpr)))
    return f"SELECT {model} AS model, row_id, {cols} FROM {src}"


SUMMS = f"""
summs AS (
  {_summ_sets('preds', 'sp_left_pred', 'sp_right_pred', 'mp_left_pred', 'mp_right_pred')}
  UNION ALL
  {_summ_sets('topics', 'left_sum', 'right_sum', 'left_sum', 'right_sum', "'ref'")})"""

TOPIC_PASSAGES = f"""
tp0 AS (
  SELECT row_id, {norm('left_op')} AS nl, {norm('right_op')} AS nr, string_split(coalesce(alt_op, ''), {NL}) AS ops
  FROM topics),
tp AS (
  SELECT row_id, nl, nr, ops, toks,
    list_distinct(list_concat(list_filter(string_split({norm('ops[1]')}, ''), lambda c: c <> ''), flatten(toks[2:]))) AS ign_coded,
    list_reduce(toks[2:], lambda acc, t: list_intersect(acc, t), toks[1]) AS ign_shared
  FROM (SELECT *, list_transform(ops, lambda op: {token_set('op')}) AS toks FROM tp0))"""


def facts_cte(mode: str = "as_coded") -> str:
    ign = "ign_coded" if mode == "as_coded" else "ign_shared"
    keys = ["spl", "spr", "mpl", "mpr"]
    unq = ", ".join(f"{except_(k, ign)} AS {k}_u" for k in keys)
    ext = ", ".join(f"{cov(k, 'toks[pos + 1]')} AS {k}_ext" for k in keys)
    ext_u = ", ".join(f"{cov(k + '_u', 'toks[pos + 1]')} AS {k}_ext_unq" for k in keys)
    return f"""
j AS (
  SELECT s.model, s.row_id, tp.nl, tp.nr, tp.ops, tp.toks, s.spl, s.spr, s.mpl, s.mpr, {unq}
  FROM summs s JOIN tp USING (row_id)),
jx AS (SELECT *, CAST(generate_subscripts(ops, 1) - 1 AS BIGINT) AS pos FROM j),
facts AS (
  SELECT model, row_id, pos, {side('ops[pos + 1]', 'nl', 'nr')} AS side, {length('ops[pos + 1]')} AS length,
         {ext}, {ext_u}
  FROM jx)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


BASE_FACTS = (TOPICS, PREDS, SUMMS, TOPIC_PASSAGES)


def position_report_sql() -> str:
    left, right = "side = 'left'", "side = 'right'"
    return with_(*BASE_FACTS, facts_cte()) + f"""
, agg AS (
  SELECT model, pos,
    {mean('mpl_ext', left)} AS mpl_ext,
    {mean('mpr_ext', right)} AS mpr_ext,
    1.96 * stddev_samp(mpl_ext) FILTER (WHERE {left}) / sqrt(count(*) FILTER (WHERE {left})) AS mpl_ext_std,
    1.96 * stddev_samp(mpr_ext) FILTER (WHERE {right}) / sqrt(count(*) FILTER (WHERE {right})) AS mpr_ext_std,
    count(*) FILTER (WHERE {left}) AS mpl_count,
    count(*) FILTER (WHERE {right}) AS mpr_count
  FROM facts WHERE pos < 10 GROUP BY model, pos),
scaffold AS (SELECT model, CAST(unnest(range(10)) AS BIGINT) AS pos FROM (SELECT DISTINCT model FROM agg))
SELECT s.model, s.pos, {r6('a.mpl_ext')} AS mpl_ext, {r6('a.mpr_ext')} AS mpr_ext,
       {r6('a.mpl_ext_std')} AS mpl_ext_std, {r6('a.mpr_ext_std')} AS mpr_ext_std,
       CAST(coalesce(a.mpl_count, 0) AS BIGINT) AS mpl_count, CAST(coalesce(a.mpr_count, 0) AS BIGINT) AS mpr_count
FROM scaffold s LEFT JOIN agg a USING (model, pos)"""



EXPS = ["sp_left_pred", "sp_right_pred", "mp_left_pred", "mp_right_pred"]
REFS = ["left_sum", "right_sum", "left_sum", "right_sum"]
SRCS = ["left_op", "right_op", "left_op", "right_op"]
EXT = ["spl_ext", "spr_ext", "mpl_ext", "mpr_ext", "spl_ext_unq", "spr_ext_unq", "mpl_ext_unq", "mpr_ext_unq"]
FACT_NUMERIC = ["pos", "length", *EXT, "num_arous", "perc_arous", "arous_score"]

REF_ROWS = """
refrows AS (
  SELECT 'ref' AS model, row_id, title, alt_op, left_op, right_op, left_sum, right_sum,
         left_sum AS sp_left_pred, right_sum AS sp_right_pred, left_sum AS mp_left_pred, right_sum AS mp_right_pred
  FROM topics)"""

LONG = "\nlong AS (" + " UNION ALL ".join(
    f"SELECT model, row_id, '{e}' AS exp, {e} AS pred, {r} AS ref, {s} AS src FROM preds" for e, r, s in zip(EXPS, REFS, SRCS)
) + ")"

PASSAGES = f"""
tpx AS (
  SELECT row_id, {norm('left_op')} AS nl, {norm('right_op')} AS nr, string_split(coalesce(alt_op, ''), {NL}) AS ops FROM topics),
pas AS (
  SELECT row_id, pos, ops[pos + 1] AS op, {side('ops[pos + 1]', 'nl', 'nr')} AS side, {length('ops[pos + 1]')} AS length
  FROM (SELECT *, CAST(generate_subscripts(ops, 1) - 1 AS BIGINT) AS pos FROM tpx))"""

LEXICON = f"""
vocab AS (SELECT DISTINCT unnest({lex_tokens('text')}) AS token FROM documents),
lexicon AS (
  SELECT token AS term,
         CAST(('0x' || substr(md5(token), 1, 4)) AS INTEGER) % 1001 AS v,
         CAST(('0x' || substr(md5(token), 5, 4)) AS INTEGER) % 1001 AS a,
         CAST(('0x' || substr(md5(token), 13, 4)) AS INTEGER) % 1001 AS d
  FROM vocab WHERE substr(md5(token), 9, 1) IN ('0', '1', '2', '3', '4', '5')),
lemmas AS (
  SELECT token, lemma FROM (
    SELECT token, CASE WHEN suffix(token, 'ing') AND length(token) > 5 THEN substr(token, 1, length(token) - 3)
                       WHEN suffix(token, 'ed') AND length(token) > 4 THEN substr(token, 1, length(token) - 2) END AS lemma
    FROM vocab) c
  WHERE lemma IN (SELECT token FROM vocab)),
lookup AS (
  SELECT l.token, x.v, x.a FROM lemmas l JOIN lexicon x ON x.term = l.lemma WHERE x.v <= 350 OR x.v >= 650
  UNION ALL
  SELECT term AS token, v, a FROM lexicon WHERE (v <= 350 OR v >= 650) AND term NOT IN (SELECT token FROM lemmas))"""


def stats(name: str, src: str, keys: list[str], text: str, strict: bool) -> str:
    """CTE ``name`` = src keys + num_pol, num_arous, sum_a (0 when no hit)."""
    k = ", ".join(keys)
    polar = "(k.v > 650 OR k.v < 350)" if strict else "(k.v >= 650 OR k.v <= 350)"
    on = " AND ".join(f"s.{c} IS NOT DISTINCT FROM h.{c}" for c in keys)
    return f"""
{name}_occ AS (SELECT {k}, unnest({lex_tokens(text)}) AS token FROM {src}),
{name}_hit AS (
  SELECT {k}, count(*) AS num_pol, sum(CASE WHEN k.a > 650 THEN 1 ELSE 0 END) AS num_arous, sum(k.a) AS sum_a
  FROM {name}_occ o JOIN lookup k ON k.token = o.token WHERE {polar} GROUP BY {k}),
{name} AS (
  SELECT s.*, CAST(coalesce(h.num_pol, 0) AS BIGINT) AS num_pol, CAST(coalesce(h.num_arous, 0) AS BIGINT) AS num_arous,
         CAST(coalesce(h.sum_a, 0) AS BIGINT) AS sum_a
  FROM {src} s LEFT JOIN {name}_hit h ON {on})"""


def mean_arousal(num_pol: str, sum_a: str) -> str:
    return f"(CASE WHEN {num_pol} > 0 THEN CAST({sum_a} AS DOUBLE) / (CAST({num_pol} AS DOUBLE) * 1000.0) ELSE 0.0 END)"


AROUSAL = f"""
ar AS (
  SELECT row_id, pos, num_arous, CAST(num_arous AS DOUBLE) / length AS perc_arous, {mean_arousal('num_pol', 'sum_a')} AS arous_score
  FROM pst)"""


def lex_facts() -> str:
    return with_(*BASE_FACTS, facts_cte(), PASSAGES, LEXICON, stats("pst", "pas", ["row_id", "pos", "op", "length"], "op", False), AROUSAL) + """,
lfacts AS (SELECT f.*, ar.num_arous, ar.perc_arous, ar.arous_score FROM facts f LEFT JOIN ar USING (row_id, pos))"""


def ci(x: str, n: str) -> str:
    return f"1.96 * stddev_samp({x}) / sqrt({n})"


def pct_list(n: int) -> str:
    return "[" + ", ".join(f"CAST({i / n!r} AS DOUBLE)" for i in range(1, n + 1)) + "]"


def binned(src: str, value: str, n: int, bin_col: str, cols: list[str], with_ci: bool = True) -> str:
    aggs = [f"{r6(mean(c))} AS {c}" for c in cols]
    if with_ci:
        aggs += [f"{r6(ci(c, f'count({c})'))} AS {c}_std" for c in cols]
    return f"""
edges AS (SELECT model, quantile_cont({value}, {pct_list(n)}) AS edges FROM {src} GROUP BY model),
binned AS (
  SELECT f.*, CAST(len(list_filter(e.edges, lambda q: q < f.{value})) AS BIGINT) AS {bin_col}
  FROM {src} f JOIN edges e USING (model))
SELECT model, {bin_col}, {", ".join(aggs)} FROM binned WHERE pos < 4 GROUP BY model, {bin_col}"""


def rouge_n_sql(pt: str, rt: str, n: int) -> str:
    if n == 2:
        pt = f"list_transform(range(len({pt}) - 1), lambda i: {pt}[i + 1] || ' ' || {pt}[i + 2])"
        rt = f"list_transform(range(len({rt}) - 1), lambda i: {rt}[i + 1] || ' ' || {rt}[i + 2])"
    hits = (
        f"coalesce(list_sum(list_transform(list_distinct({pt}), lambda g: least(len(list_filter({pt}, lambda x: x = g)), "
        f"len(list_filter({rt}, lambda x: x = g))))), 0)"
    )
    p = f"({hits} / greatest(len({pt}), 1))"
    r = f"({hits} / greatest(len({rt}), 1))"
    return f"(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END)"


def rouge_l_cte(src: str, keys: list[str]) -> str:
    """CTEs ``{src}_lcs`` (keys, lcs): LCS by a recursive CTE; the DP row
    runs over the prediction tokens, one recursion step per reference token."""
    k = ", ".join(keys)
    on = " AND ".join(f"t.{c} = d.{c}" for c in keys)
    return f"""
{src}_dp({k}, step, dprow) AS (
  SELECT {k}, 0, list_transform(range(len(pt) + 1), lambda x: 0) FROM {src}
  UNION ALL
  SELECT {", ".join("d." + c for c in keys)}, d.step + 1,
    list_reduce(range(1, len(t.pt) + 1),
      lambda acc, j: list_append(acc, CASE WHEN t.rt[d.step + 1] = t.pt[j] THEN d.dprow[j] + 1 ELSE greatest(d.dprow[j + 1], acc[j]) END),
      [0])
  FROM {src}_dp d JOIN {src} t ON {on}
  WHERE d.step < len(t.rt)),
{src}_lcs AS (
  SELECT {", ".join("d." + c for c in keys)}, d.dprow[len(d.dprow)] AS lcs
  FROM {src}_dp d JOIN {src} t ON {on} WHERE d.step = len(t.rt))"""


def rouge_l_expr(lcs: str, pt: str, rt: str) -> str:
    p = f"({lcs} / greatest(len({pt}), 1))"
    r = f"({lcs} / greatest(len({rt}), 1))"
    return f"(CASE WHEN len({pt}) = 0 OR len({rt}) = 0 THEN 0.0 WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END)"


PAIRS = f"""
pairs AS (
  SELECT c.conv_id, c.turn, {rouge_tokens('c.text')} AS pt, {rouge_tokens('p.text')} AS rt
  FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn + 1 = c.turn)"""

SCORED = f"""
sc_tok AS (SELECT model, row_id, exp, {rouge_tokens(first_sentence('pred'))} AS pt, {rouge_tokens('ref')} AS rt FROM long),
{rouge_l_cte('sc_tok', ['model', 'row_id', 'exp'])},
scored AS (
  SELECT t.model, t.row_id, t.exp, {rouge_n_sql('t.pt', 't.rt', 1)} AS rouge1, {rouge_n_sql('t.pt', 't.rt', 2)} AS rouge2,
         {rouge_l_expr('l.lcs', 't.pt', 't.rt')} AS rougeL
  FROM sc_tok t JOIN sc_tok_lcs l USING (model, row_id, exp))"""

EXTERNAL = """
lab AS (SELECT doc_id AS row_id, max(quality) AS quality FROM labels GROUP BY doc_id),
lrow AS (SELECT l.model, l.row_id, l.exp, lab.quality, CAST(substr(l.model, 2) AS INTEGER) AS m FROM long l JOIN lab USING (row_id)),
ext AS (
  SELECT model, row_id, exp, 'bleurt' AS metric, 1 AS ingest_order,
    CASE WHEN row_id % 29 = 0 THEN NULL WHEN row_id % 23 = 0 THEN 1.5 ELSE CAST(quality * 50 + (row_id * 31 + m * 7) % 51 AS DOUBLE) / 100.0 END AS score
  FROM lrow
  UNION ALL SELECT model, row_id, exp, 'bleurt', 2, 0.25 FROM lrow WHERE row_id % 11 = 0
  UNION ALL SELECT model, row_id, exp, 'menli', 1, 0.5 FROM lrow WHERE row_id % 31 = 0
  UNION ALL SELECT 'm9', row_id, exp, 'bleurt', 1, 0.5 FROM lrow WHERE row_id % 19 = 0)"""


def summary_aggs(metrics: list[str]) -> str:
    return ", ".join(f"{mean(m)} * 100 AS {m}, ({ci(m, 'count(*)')}) * 100 AS {m}_ci" for m in metrics)


BASE_ROWS = """
last AS (SELECT model, row_id, exp, arg_max(score, ingest_order) AS bleurt FROM ext WHERE metric = 'bleurt' GROUP BY model, row_id, exp),
withext AS (SELECT s.*, e.bleurt FROM scored s LEFT JOIN last e USING (model, row_id, exp))"""

STANCE = """
lg AS (
  SELECT vec_id // 2 AS pair_id, vec_id % 2 = 1 AS is_ref,
    list_transform([1, 2, 0], lambda k: list_sum(list_filter(CAST(embedding AS DOUBLE[]), lambda x, i: i % 3 = k))) AS logits
  FROM embeddings),
lg2 AS (SELECT pair_id, first(logits) FILTER (WHERE NOT is_ref) AS lp, first(logits) FILTER (WHERE is_ref) AS lr FROM lg GROUP BY pair_id),
sm AS (
  SELECT pair_id,
    list_transform(lp, lambda x: exp(x - list_max(lp)) / list_sum(list_transform(lp, lambda y: exp(y - list_max(lp))))) AS p_pred,
    list_transform(lr, lambda x: exp(x - list_max(lr)) / list_sum(list_transform(lr, lambda y: exp(y - list_max(lr))))) AS p_ref
  FROM lg2),
st AS (
  SELECT pair_id, p_pred, p_ref, ['pro', 'con', 'neutral'][list_position(p_ref, list_max(p_ref))] AS label,
         abs(p_pred[list_position(p_ref, list_max(p_ref))] - p_ref[list_position(p_ref, list_max(p_ref))]) AS stance,
         sqrt((pow(p_pred[1] - p_ref[1], 2) + pow(p_pred[2] - p_ref[2], 2) + pow(p_pred[3] - p_ref[3], 2)) / 3) AS rmse
  FROM sm),
stp AS (
  SELECT 'm' || CAST((pair_id // 4) % 3 AS VARCHAR) AS model, pair_id // 12 AS row_id,
    ['sp_left_pred', 'sp_right_pred', 'mp_left_pred', 'mp_right_pred'][pair_id % 4 + 1] AS exp, stance
  FROM st)"""

TARGET = """
tv AS (SELECT vec_id // 10 AS k, vec_id % 2 AS side, vec_id AS tok, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
pv AS (
  SELECT 'm' || CAST((k // 4) % 3 AS VARCHAR) AS model, k // 12 AS row_id, ['sp_left_pred', 'sp_right_pred', 'mp_left_pred', 'mp_right_pred'][k % 4 + 1] AS exp,
    CASE WHEN k % 2 = 0 THEN 'left_op' ELSE 'right_op' END AS src, tok, vec
  FROM tv WHERE side = 0),
sv AS (SELECT k // 2 AS row_id, CASE WHEN k % 2 = 0 THEN 'left_op' ELSE 'right_op' END AS src, tok, vec FROM tv WHERE side = 1),
tsim AS (
  SELECT p.model, p.row_id, p.exp, p.tok AS a, s.tok AS b, list_cosine_similarity(p.vec, s.vec) AS sim FROM pv p JOIN sv s ON s.row_id = p.row_id AND s.src = p.src),
tp1 AS (SELECT model, row_id, exp, avg(m) AS p FROM (SELECT model, row_id, exp, a, max(sim) AS m FROM tsim GROUP BY ALL) GROUP BY ALL),
tr1 AS (SELECT model, row_id, exp, avg(m) AS r FROM (SELECT model, row_id, exp, b, max(sim) AS m FROM tsim GROUP BY ALL) GROUP BY ALL),
tgt AS (
  SELECT k.model, k.row_id, k.exp, 2 * p * r / (p + r) AS target
  FROM (SELECT DISTINCT model, row_id, exp FROM pv) k LEFT JOIN tp1 USING (model, row_id, exp) LEFT JOIN tr1 USING (model, row_id, exp))"""


def _cols(cols: list[str]) -> str:
    return ", ".join(cols)


def sql_passage_explode() -> str:
    return with_(TOPICS, PASSAGES) + "\nSELECT row_id, pos, length, CAST(length(op) AS BIGINT) AS n_chars FROM pas"


def sql_first_sentence_tables() -> str:
    cols = ", ".join(f"{first_sentence_by_tables(e)} AS {e}" for e in (*EXPS, "alt_op"))
    return with_(TOPICS, PREDS) + f"\nSELECT model, row_id, {cols} FROM preds"


def sql_first_sentence() -> str:
    cols = ", ".join(f"{first_sentence(e)} AS {e}" for e in EXPS)
    return with_(TOPICS, PREDS) + f"\nSELECT model, row_id, {cols}, {first_sentence('alt_op')} AS doc_first FROM preds"


def sql_passage_side() -> str:
    lead = side("alt_op", norm("left_op"), norm("right_op"))
    return with_(TOPICS, PASSAGES) + f"""
SELECT p.row_id, p.pos, p.side, l.lead_side FROM pas p JOIN (SELECT row_id, {lead} AS lead_side FROM topics) l USING (row_id)"""


def sql_facts_cols(mode: str, cols: list[str]) -> str:
    sel = ", ".join(r6(c) + f" AS {c}" for c in cols)
    return with_(*BASE_FACTS, facts_cte(mode)) + f"\nSELECT model, row_id, pos, {sel} FROM facts"


def sql_side_report() -> str:
    parts = []
    for summ, col in (("left", "mpl_ext"), ("right", "mpr_ext")):
        for sd in ("left", "right"):
            sub = f"side = '{sd}' AND pos < 4"
            n = f"count(*) FILTER (WHERE side = '{sd}' AND pos < 5)"
            parts.append(f"{r6(mean(col, sub))} AS {summ}_{sd}")
            parts.append(f"{r6(f'1.96 * stddev_samp({col}) FILTER (WHERE {sub}) / sqrt({n})')} AS {summ}_{sd}_std")
    return with_(*BASE_FACTS, facts_cte()) + f"\nSELECT model, {', '.join(parts)} FROM facts GROUP BY model"


def _with_ref_preds() -> str:
    return with_(TOPICS, PREDS, REF_ROWS) + ",\nallp AS (SELECT * FROM preds UNION ALL SELECT * FROM refrows)"


def sql_doc_coverage() -> str:
    l = cov(token_set("mp_left_pred"), token_set("alt_op"))
    r = cov(token_set("mp_right_pred"), token_set("alt_op"))
    return _with_ref_preds() + f"""
, c AS (SELECT model, {l} AS l, {r} AS r FROM allp)
SELECT model, {r6(mean('l'))} AS left_cov, {r6(mean('r'))} AS right_cov, {r6(mean('l') + ' / 2 + ' + mean('r') + ' / 2')} AS avg_cov FROM c GROUP BY model"""


def sql_summary_length() -> str:
    return _with_ref_preds() + f"""
, c AS (SELECT model, len({tokens('mp_left_pred')}) AS l, len({tokens('mp_right_pred')}) AS r FROM allp)
SELECT model, {r6(mean('l'))} AS left_len, {r6(mean('r'))} AS right_len, {r6(mean('l') + ' / 2 + ' + mean('r') + ' / 2')} AS avg_len FROM c GROUP BY model"""


def sql_bins(value: str, n: int, bin_col: str, with_ci: bool = True) -> str:
    return lex_facts() + "," + binned("lfacts", value, n, bin_col, FACT_NUMERIC, with_ci)


def sql_arousal_features() -> str:
    return with_(TOPICS, PASSAGES, LEXICON, stats("pst", "pas", ["row_id", "pos", "op", "length"], "op", False), AROUSAL) + f"""
SELECT row_id, pos, num_arous, {r6('perc_arous')} AS perc_arous, {r6('arous_score')} AS arous_score FROM ar"""


def sql_intensity() -> str:
    texts = """
texts AS (""" + " UNION ALL ".join(f"SELECT row_id, '{c}' AS src, {c} AS text FROM topics" for c in ("alt_op", "left_sum", "right_sum")) + ")"
    return with_(TOPICS, texts, LEXICON, stats("tst", "texts", ["row_id", "src", "text"], "text", True)) + f"""
SELECT row_id, src, {r6(mean_arousal('num_pol', 'sum_a'))} AS intensity FROM tst"""


def _gap() -> tuple[str, ...]:
    """CTEs up to g (model, row_id, exp, pred_int, src_int)."""
    lp = f"\nlp AS (SELECT model, row_id, exp, {first_sentence('pred')} AS p FROM long)"
    src = "\nsrc AS (SELECT row_id, alt_op FROM topics)"
    g = f"""
g AS (
  SELECT p.model, p.row_id, p.exp, {mean_arousal('p.num_pol', 'p.sum_a')} AS pred_int, {mean_arousal('s.num_pol', 's.sum_a')} AS src_int
  FROM pst p JOIN sst s USING (row_id))"""
    stats_ = stats("pst", "lp", ["model", "row_id", "exp", "p"], "p", True), stats("sst", "src", ["row_id", "alt_op"], "alt_op", True)
    return TOPICS, PREDS, LONG, lp, src, LEXICON, *stats_, g


def sql_intensity_gap() -> str:
    return with_(*_gap()) + f"""
SELECT model, row_id, exp, {r6('pred_int')} AS pred_int, {r6('src_int')} AS src_int, {r6('pow(pred_int - src_int, 2)')} AS intens FROM g"""


def sql_perspective_rows() -> str:
    return with_(*_gap(), STANCE, TARGET) + f"""
SELECT model, row_id, exp, {r6('stance')} AS stance, {r6('pow(pred_int - src_int, 2)')} AS intens, {r6('target')} AS target
FROM g LEFT JOIN stp USING (model, row_id, exp) LEFT JOIN tgt USING (model, row_id, exp)"""


def sql_keyphrase_target() -> str:
    return with_(TARGET) + f"\nSELECT model, row_id, exp, {r6('target')} AS target FROM tgt"


def sql_lexicon_dedupe() -> str:
    h = "md5(term || ':' || CAST(doc_id AS VARCHAR))"
    vad = ", ".join(f"CAST(('0x' || substr({h}, {s}, 4)) AS INTEGER) % 1001 AS {n}" for n, s in (("v", 1), ("a", 5), ("d", 13)))
    return f"""WITH
toks AS (SELECT doc_id, {lex_tokens('text')} AS t FROM documents),
occ AS (SELECT doc_id, t[i + 1] AS term, i FROM (SELECT doc_id, t, generate_subscripts(t, 1) - 1 AS i FROM toks)),
ends AS (SELECT term, doc_id, i, row_number() OVER (PARTITION BY term ORDER BY doc_id DESC, i DESC) AS r FROM occ)
SELECT term, CAST(v AS BIGINT) AS v, CAST(a AS BIGINT) AS a, CAST(d AS BIGINT) AS d
FROM (SELECT term, {vad} FROM ends WHERE r = 1)"""


def sql_rouge_n(n: int) -> str:
    return with_(PAIRS) + f"\nSELECT conv_id, turn, {r6(rouge_n_sql('pt', 'rt', n))} AS rouge{n} FROM pairs"


def sql_rouge_l() -> str:
    return "WITH RECURSIVE" + PAIRS + "," + rouge_l_cte("pairs", ["conv_id", "turn"]) + f"""
SELECT t.conv_id, t.turn, {r6(rouge_l_expr('l.lcs', 't.pt', 't.rt'))} AS rougeL FROM pairs t JOIN pairs_lcs l USING (conv_id, turn)"""


def sql_experiment_scores() -> str:
    return "WITH RECURSIVE" + ",".join((TOPICS, PREDS, LONG, SCORED)) + """
SELECT model, row_id, exp, """ + ", ".join(f"{r6(m)} AS {m}" for m in ("rouge1", "rouge2", "rougeL")) + " FROM scored"


def _summary_select(src: str, metrics: list[str]) -> str:
    cols = ", ".join(f"{r6(m)} AS {m}, {r6(m + '_ci')} AS {m}_ci" for m in metrics)
    return f"SELECT model, exp, {cols} FROM {src}"


def sql_rouge_missing() -> str:
    f = lambda pt: rouge_n_sql(pt, "rt", 1)
    return with_(TOPICS, PREDS, LONG) + f""",
mt AS (
  SELECT model, row_id, exp, CASE WHEN row_id % 9 <> 0 THEN {rouge_tokens('pred')} END AS pt, {rouge_tokens('ref')} AS rt
  FROM long WHERE exp IN ('mp_left_pred', 'mp_right_pred'))
SELECT model, row_id, exp, CASE WHEN pt IS NOT NULL THEN {r6(f('pt'))} END AS "null",
  CASE WHEN pt IS NULL THEN -1.0 ELSE {r6(f('pt'))} END AS sentinel, {r6(f("coalesce(pt, ['nan'])"))} AS nan_text
FROM mt"""


def sql_base_summary() -> str:
    metrics = ["rouge1", "rouge2", "rougeL", "bleurt"]
    return "WITH RECURSIVE" + ",".join((TOPICS, PREDS, LONG, SCORED, EXTERNAL, BASE_ROWS)) + f""",
base AS (SELECT model, exp, {summary_aggs(metrics)} FROM withext GROUP BY model, exp)
""" + _summary_select("base", metrics)


def sql_topics_csv() -> str:
    columns = ", ".join(f"nullif({c}, '') AS {c}" for c in ("title", "alt_op", "left_op", "right_op", "left_sum", "right_sum"))
    return with_(TOPICS) + f" SELECT row_id, {columns} FROM topics"


def sql_experiment_runs() -> str:
    return with_(TOPICS, PREDS, LONG) + " SELECT model, row_id, exp, pred FROM long"


def sql_score_checks() -> str:
    return with_(TOPICS, PREDS, LONG, EXTERNAL) + """
SELECT 'duplicates' AS "check", CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM ext GROUP BY model, row_id, exp, metric)
UNION ALL SELECT 'unknown_keys', CAST(count(*) AS BIGINT) FROM ext e ANTI JOIN long l USING (model, row_id, exp)
UNION ALL SELECT 'unknown_metrics', CAST(count(*) FILTER (WHERE metric NOT IN ('bleurt', 'summac', 'align', 'bert')) AS BIGINT) FROM ext
UNION ALL SELECT 'out_of_range', CAST(count(*) FILTER (WHERE score < -1.0 OR score > 1.0) AS BIGINT) FROM ext
UNION ALL SELECT 'null_scores', CAST(count(*) FILTER (WHERE score IS NULL) AS BIGINT) FROM ext
UNION ALL SELECT 'rows', CAST(count(*) AS BIGINT) FROM ext
UNION ALL SELECT 'without_score', CAST(count(*) AS BIGINT) FROM long l ANTI JOIN ext e USING (model, row_id, exp)"""


def sql_stance_gap() -> str:
    return with_(STANCE) + f"\nSELECT pair_id, label, {r6('stance')} AS stance, {r6('rmse')} AS rmse, {r6('p_ref[1]')} AS p_ref_pro FROM st"


def sql_stance_summary() -> str:
    metrics = ["rouge1", "rouge2", "rougeL", "bleurt", "stance"]
    return "WITH RECURSIVE" + ",".join((TOPICS, PREDS, LONG, SCORED, EXTERNAL, BASE_ROWS, STANCE)) + f""",
base AS (
  SELECT model, exp, {summary_aggs(metrics)}
  FROM (SELECT w.*, stp.stance FROM withext w LEFT JOIN stp USING (model, row_id, exp)) GROUP BY model, exp)
""" + _summary_select("base", metrics)


def sql_greedy_match() -> str:
    return f"""WITH
tv AS (SELECT vec_id // 10 AS pair_id, vec_id % 2 AS side, vec_id AS tok_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
sim AS (SELECT a.pair_id, a.tok_id AS ca, b.tok_id AS rb, list_cosine_similarity(a.vec, b.vec) AS s
        FROM tv a JOIN tv b ON a.pair_id = b.pair_id AND a.side = 0 AND b.side = 1),
pp AS (SELECT pair_id, avg(m) AS p FROM (SELECT pair_id, ca, max(s) AS m FROM sim GROUP BY pair_id, ca) GROUP BY pair_id),
rr AS (SELECT pair_id, avg(m) AS r FROM (SELECT pair_id, rb, max(s) AS m FROM sim GROUP BY pair_id, rb) GROUP BY pair_id)
SELECT pair_id, {r6('p')} AS precision, {r6('r')} AS recall, {r6('2 * p * r / (p + r)')} AS f1 FROM pp JOIN rr USING (pair_id)"""


def sql_matrix_reduce() -> str:
    return f"""WITH
tv AS (SELECT vec_id // 10 AS pair_id, vec_id % 2 AS side, vec_id AS tok, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
c AS (
  SELECT s.pair_id, c.tok, max(list_cosine_similarity(s.vec, c.vec)) AS best
  FROM tv s JOIN tv c ON c.pair_id = s.pair_id AND s.side = 0 AND c.side = 1 GROUP BY s.pair_id, c.tok)
SELECT pair_id, {r6(mean('best'))} AS score, CAST(count(*) AS BIGINT) AS claims FROM c GROUP BY pair_id"""


def _instructions() -> str:
    """(template, exp, instruction) rows, written out."""
    rows = []
    for template, last in (("api", 'Respond only with the summary beginning with "The {side}": '), ("local", 'Begin the summary with "The {side}": ')):
        for side in ("left", "right"):
            text = f"Produce a short, single-sentence summary of the {side}-leaning political perspective within the following texts. "
            rows += [f"({q(template)}, {q(f'{p}_{side}_pred')}, {q(text + last.format(side=side))})" for p in ("mp", "sp")]
    return "tmpl(template, exp, instruction) AS (VALUES " + ", ".join(rows) + ")"


def sql_prompt_table() -> str:
    source = {"mp_left_pred": "alt_op", "mp_right_pred": "alt_op", "sp_left_pred": "left_op", "sp_right_pred": "right_op"}
    pe = "pe AS (" + " UNION ALL ".join(f"SELECT row_id, '{e}' AS exp, {c} AS text FROM topics" for e, c in source.items()) + ")"
    payload = (
        "to_json({'model': 'summarizer', 'max_tokens': 128, 'top_p': 1, 'top_k': 1, 'presence_penalty': 0, 'frequency_penalty': 0, 'temperature': 0, "
        "'messages': [{'role': 'user', 'content': prompt}], 'stop': ['.'], 'context_length_exceeded_behavior': 'truncate', 'user': exp})::VARCHAR"
    )
    return with_(TOPICS, "\n" + _instructions(), "\n" + pe) + f""",
pr AS (SELECT pe.row_id, pe.exp, t.template, t.instruction || chr(10) || coalesce(pe.text, '') AS prompt FROM pe JOIN tmpl t USING (exp)),
fam(template, name, family) AS (VALUES ('api', 'summarizer', 'api'), ('local', 'mistral-7b', 'mistral'), ('local', 'vicuna-7b', 'vicuna'),
  ('local', 'Meta-Llama-3', 'llama'), ('local', 'falcon-7b', NULL))
SELECT row_id, exp, name, family,
  CASE WHEN family = 'api' THEN {payload}
       WHEN family = 'mistral' THEN '<s>[INST]' || chr(10) || prompt || chr(10) || '[/INST]' || chr(10)
       WHEN family = 'vicuna' THEN 'USER: ' || prompt || chr(10) || 'ASSISTANT:'
       WHEN family = 'llama' THEN to_json([{{'role': 'user', 'content': prompt}}])::VARCHAR END AS model_input,
  CASE WHEN family IS NULL THEN 'unknown model family: ' || name END AS error
FROM pr JOIN fam USING (template)"""


RESPONSES = """
body AS (SELECT model, row_id, exp, pred, to_json({'choices': [{'message': {'content': pred}}]})::VARCHAR AS body FROM long WHERE row_id % 13 <> 0),
resp AS (
  SELECT model, row_id, exp, 2 AS received, CASE
    WHEN model = 'm1' THEN '[INST] x [/INST]' || chr(10) || pred
    WHEN model = 'm2' THEN 'Here it is: ' || pred
    WHEN row_id % 7 = 0 THEN substr(body, 1, length(body) - 3)
    WHEN row_id % 5 = 0 THEN body || ' and more'
    WHEN row_id % 17 = 0 THEN '{"choices":[{"message":{"content":null}}]}'
    ELSE body END AS raw
  FROM body
  UNION ALL SELECT model, row_id, exp, 1, 'oops' FROM body WHERE row_id % 11 = 0)"""


def sql_response_parse() -> str:
    content = "CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.choices[0].message.content') END"
    return with_(TOPICS, PREDS, LONG, RESPONSES) + f"""
SELECT row_id, exp, CAST(received AS BIGINT) AS received, coalesce({content}, 'Error') AS text, ({content}) IS NULL AS is_error FROM resp WHERE model = 'm0'"""


def sql_prediction_table() -> str:
    content = "CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.choices[0].message.content') END"
    return with_(TOPICS, PREDS, LONG, RESPONSES) + f""",
reqs AS (SELECT model, row_id, exp FROM long UNION ALL SELECT 'm3', row_id, exp FROM long WHERE model = 'm0' AND exp = 'mp_left_pred'),
lastr AS (SELECT model, row_id, exp, arg_max(raw, received) AS raw FROM resp GROUP BY model, row_id, exp),
pt AS (
  SELECT r.model, r.row_id, r.exp, raw, CASE r.model WHEN 'm0' THEN {content}
    WHEN 'm1' THEN substr(raw, instr(raw, '[/INST]') + 8) WHEN 'm2' THEN raw END AS text
  FROM reqs r LEFT JOIN lastr USING (model, row_id, exp))
SELECT model, row_id, exp, coalesce(text, 'Error') AS pred, text IS NULL AS is_error,
  CASE WHEN model = 'm3' THEN 'unknown model family: falcon-7b' WHEN raw IS NULL THEN 'no response' WHEN text IS NULL THEN 'unparseable response' END AS error,
  raw AS raw_response
FROM pt"""


def sql_summary_length_tokens() -> str:
    return _with_ref_preds() + f"""
, c AS (SELECT model, ceil(length(mp_left_pred) / 4) AS l, ceil(length(mp_right_pred) / 4) AS r FROM allp)
SELECT model, {r6(mean('l'))} AS left_len, {r6(mean('r'))} AS right_len, {r6(mean('l') + ' / 2 + ' + mean('r') + ' / 2')} AS avg_len FROM c GROUP BY model"""


def _py_slice(t: str, start0: str, end: str) -> str:
    return f"substr({t}, ({start0}) + 1, greatest(({end}) - ({start0}), 0))"


def _clean(t: str, parity: bool) -> str:
    m_at, v_at, n = f"instr({t}, '[/INST]')", f"instr({t}, 'ASSISTANT:')", f"length({t})"
    mis = _py_slice(t, f"{m_at} - 1 + 8", n)
    vic = _py_slice(t, f"{v_at} - 1 + 11", f"{n} - 3")
    if not parity:
        mis = f"(CASE WHEN {m_at} > 0 THEN {mis} ELSE {t} END)"
        vic = f"(CASE WHEN {v_at} > 0 THEN {vic} ELSE {t} END)"
    lla = f"(CASE WHEN lower(substr({t}, 1, 4)) = 'here' THEN {_py_slice(t, f'instr({t}, chr(58))', n)} ELSE {t} END)"
    return f"(CASE WHEN family = 'mistral' THEN {mis} WHEN family = 'vicuna' THEN {vic} WHEN family = 'llama' THEN {lla} ELSE {t} END)"


def sql_output_cleanup() -> str:
    raw = """CASE WHEN model = 'm2' THEN pred
    WHEN family = 'mistral' THEN '[INST] ' || title || ' [/INST]' || chr(10) || pred
    WHEN family = 'vicuna' THEN 'USER: ' || title || chr(10) || 'ASSISTANT: ' || pred || '</s>'
    WHEN family = 'llama' THEN 'Here is the summary: ' || pred
    ELSE pred END"""
    return with_(TOPICS, PREDS, LONG) + f""",
ro AS (SELECT l.model, l.row_id, l.exp, f.family, {raw} AS raw
       FROM long l JOIN topics t USING (row_id) CROSS JOIN (SELECT unnest(['mistral', 'vicuna', 'llama', 'mixtral']) AS family) f)
SELECT model, row_id, exp, family, {_clean('raw', False)} AS clean, {_clean('raw', True)} AS clean_parity FROM ro"""


def _pad(seq: str, maxlen: int, padding: str, trunc: str) -> str:
    kept = f"(CASE WHEN len({seq}) > {maxlen} THEN {seq}[len({seq}) - {maxlen} + 1:] ELSE {seq} END)" if trunc == "pre" else f"{seq}[1:{maxlen}]"
    pad = f"list_transform(range(greatest({maxlen} - len({kept}), 0)), lambda x: 0)"
    return f"list_concat({kept}, {pad})" if padding == "post" else f"list_concat({pad}, {kept})"


def sql_pad_segments() -> str:
    ids = f"list_transform({tokens('text')}, lambda t: CAST(length(t) AS BIGINT))"
    asp = f"list_transform({tokens('title')}, lambda t: CAST(length(t) AS BIGINT))"
    seg = "list_concat(list_transform(range(len(list_filter(ids, lambda x: x <> 0)) + 2), lambda x: 0), list_transform(range(len(list_filter(asp, lambda x: x <> 0)) + 1), lambda x: 1))"
    cols = [f"'[CLS] ' || text || ' [SEP] ' || title || ' [SEP]' AS pair_text", f"array_to_string({_pad(seg, 256, 'post', 'post')}, ',') AS segments"]
    for pad in ("post", "pre"):
        for tr in ("post", "pre"):
            cols.append(f"array_to_string({_pad('ids', 16, pad, tr)}, ',') AS ids_{pad}_{tr}")
    return with_(TOPICS, PREDS) + f""",
pp AS (SELECT model, row_id, title, {first_sentence('mp_left_pred')} AS text FROM preds),
pi AS (SELECT *, {ids} AS ids, {asp} AS asp FROM pp)
SELECT model, row_id, {', '.join(cols)} FROM pi"""


def sql_plot_series() -> str:
    left, right = "side = 'left'", "side = 'right'"

    def by(series: str, value: str, suffix: str = "") -> str:
        l, r = f"mpl_ext{suffix}", f"mpr_ext{suffix}"
        return f"""
{series}_e AS (SELECT model, quantile_cont({value}, {pct_list(10)}) AS edges FROM lfacts GROUP BY model),
{series}_s AS (
  SELECT model, '{series}' AS series, (bin + 1) * 10 AS x, {mean(l)} AS mpl, {mean(r)} AS mpr, {ci(l, f'count({l})')} AS mpl_std, {ci(r, f'count({r})')} AS mpr_std
  FROM (SELECT f.*, len(list_filter(e.edges, lambda q: q < f.{value})) AS bin FROM lfacts f JOIN {series}_e e USING (model)) WHERE pos < 4 GROUP BY model, bin)"""

    return lex_facts() + f""",
pagg AS (
  SELECT model, pos AS x,
    {mean('mpl_ext', left)} AS mpl, {mean('mpr_ext', right)} AS mpr,
    1.96 * stddev_samp(mpl_ext) FILTER (WHERE {left}) / sqrt(count(*) FILTER (WHERE {left})) AS mpl_std,
    1.96 * stddev_samp(mpr_ext) FILTER (WHERE {right}) / sqrt(count(*) FILTER (WHERE {right})) AS mpr_std
  FROM lfacts WHERE pos < 10 GROUP BY model, pos),
pscaf AS (SELECT model, CAST(unnest(range(10)) AS BIGINT) AS x FROM (SELECT DISTINCT model FROM pagg)),
ps AS (SELECT s.model, 'position' AS series, s.x, a.mpl, a.mpr, a.mpl_std, a.mpr_std FROM pscaf s LEFT JOIN pagg a USING (model, x)),
{by('length', 'length')},{by('length_unq', 'length', '_unq')},{by('density', 'perc_arous')},
alls AS (SELECT * FROM ps UNION ALL SELECT * FROM length_s UNION ALL SELECT * FROM length_unq_s UNION ALL SELECT * FROM density_s),
pts AS (
  SELECT model, series, x, 'avg' AS side, (mpl + mpr) / 2 AS ext, (mpl_std + mpr_std) / 2 AS ext_std FROM alls
  UNION ALL SELECT model, series, x, 'left', mpl, mpl_std FROM alls WHERE series IN ('length_unq', 'density')
  UNION ALL SELECT model, series, x, 'right', mpr, mpr_std FROM alls WHERE series IN ('length_unq', 'density')),
labels(model, label, ord) AS (VALUES ('m0', 'Model 0', 0), ('m1', 'Model 1', 1), ('m2', 'Model 2', 2), ('ref', 'Reference', 3))
SELECT p.model, series, side, CAST(x AS BIGINT) AS x, {r6('ext')} AS ext, {r6('ext_std')} AS ext_std,
       {r6('ext - ext_std')} AS lo, {r6('ext + ext_std')} AS hi, label, CAST(ord AS BIGINT) AS ord
FROM pts p LEFT JOIN labels USING (model)"""


def sql_scorer_hook() -> str:
    return with_(TOPICS, PREDS, LONG) + f"""
SELECT model, row_id, exp, {r6('length(pred) / CASE WHEN length(ref) > 0 THEN length(ref) END')} AS len_ratio FROM long"""


def oracle_sql() -> dict[str, str]:
    return {
        "passage_explode": sql_passage_explode(),
        "first_sentence": sql_first_sentence(),
        "first_sentence_tables": sql_first_sentence_tables(),
        "passage_side": sql_passage_side(),
        "passage_coverage": sql_facts_cols("as_coded", EXT[:4]),
        "coverage_unique_as_coded": sql_facts_cols("as_coded", EXT[4:]),
        "coverage_unique_shared": sql_facts_cols("shared", EXT[4:]),
        "position_report": position_report_sql(),
        "side_report": sql_side_report(),
        "doc_coverage_by_model": sql_doc_coverage(),
        "summary_length_by_model": sql_summary_length(),
        "summary_length_tokens": sql_summary_length_tokens(),
        "length_bins": sql_bins("length", 10, "length_bin"),
        "arousal_bins": sql_bins("arous_score", 20, "arous_bin", with_ci=False),
        "density_bins": sql_bins("perc_arous", 10, "parous_bin"),
        "arousal_features": sql_arousal_features(),
        "intensity": sql_intensity(),
        "intensity_gap": sql_intensity_gap(),
        "lexicon_dedupe": sql_lexicon_dedupe(),
        "rouge1": sql_rouge_n(1),
        "rouge2": sql_rouge_n(2),
        "rougeL": sql_rouge_l(),
        "experiment_scores": sql_experiment_scores(),
        "rouge_missing_text": sql_rouge_missing(),
        "base_summary": sql_base_summary(),
        "topics_csv": sql_topics_csv(),
        "experiment_runs": sql_experiment_runs(),
        "summary_sinks": sql_base_summary(),
        "score_checks": sql_score_checks(),
        "stance_gap": sql_stance_gap(),
        "stance_summary": sql_stance_summary(),
        "keyphrase_target": sql_keyphrase_target(),
        "perspective_rows": sql_perspective_rows(),
        "greedy_match_f1": sql_greedy_match(),
        "matrix_reduce": sql_matrix_reduce(),
        "prompt_table": sql_prompt_table(),
        "prediction_table": sql_prediction_table(),
        "response_parse": sql_response_parse(),
        "output_cleanup": sql_output_cleanup(),
        "pad_segments": sql_pad_segments(),
        "plot_series": sql_plot_series(),
        "scorer_hook": sql_scorer_hook(),
    }
