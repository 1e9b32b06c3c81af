"""Independent SQL (DuckDB dialect) for the registered queries.

Each text restates the definition in plain SQL: band self-joins for windows,
brute-force pair counts for AUC, subset enumeration for the audit.  Nothing is
shared with the Spark plans but the parameters.
"""

from __future__ import annotations

import re

from collections.abc import Sequence

from ..functions.lexicon import ANCHOR_ANSWER_PREFIX, ANCHOR_QUESTION_PREFIX, CANDIDATE_PREFIX
from ..operators.diagnostics import STAGE_COLUMNS
from ..operators.recovery import LAMBDA0_GRID, LAMBDAT_GRID
from .queries import DRAWS, GRAPH_HIDDEN, GRAPH_IN, GRAPH_LAYERS, REGISTRY, graph_weight
from .tables import LAMBDA_0, LAMBDA_T, SCORE_FACTOR, TABLE_LEXICON as LEX, THRESHOLD, TOP_K

BLANK = (
    r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WORD = r"[\x{4e00}-\x{9fff}A-Za-z0-9]"
CJK = r"[\x{4e00}-\x{9fff}]"


def clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{BLANK}+', ' ', 'g'))"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(terms: Sequence[str]) -> str:
    return "[" + ", ".join(lit(t) for t in terms) + "]::VARCHAR[]"


def has(x: str, terms: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(t)})" for t in terms) + ")"


def hits(x: str, terms: Sequence[str]) -> str:
    return f"len(list_filter({words(terms)}, lambda w: contains({x}, w)))"


def tscore(x: str, terms: Sequence[str], n: float) -> str:
    return f"least({hits(x, terms)} / {n}::DOUBLE, 1.0::DOUBLE)"


def jac(a: str, b: str) -> str:
    inter = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN {inter} > 0 THEN {inter}::DOUBLE / (len({a}) + len({b}) - {inter}) ELSE 0.0::DOUBLE END"


def div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END"


def terms_of(x: str) -> str:
    return (
        f"list_distinct(list_filter(regexp_extract_all({x}, '{WORD}{{2,10}}'), "
        f"lambda w: NOT list_contains({words(LEX.term_stopwords)}, w)))"
    )


def marks(x: str) -> str:
    return f"least((length({x}) - length(replace(replace({x}, '?', ''), '？', ''))) / 2.0::DOUBLE, 1.0::DOUBLE)"


# -- shared relations -------------------------------------------------------

def base(window: int = 5) -> str:
    return f"""
t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nrole, lead(text) OVER w AS ntext
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT conv_id AS session_id,
             CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS pos, turn,
             {clean('text')} AS "Q",
             {clean("CASE WHEN nrole = 'assistant' THEN ntext ELSE '' END")} AS "A"
      FROM t WHERE role = 'user'),
e AS (SELECT concat_ws('_', s.session_id, s.pos, d.pos) AS edge_id, s.session_id,
             CAST(s.pos AS INTEGER) AS "Q1_row", CAST(d.pos AS INTEGER) AS "Q2_row",
             CAST(d.pos - s.pos AS INTEGER) AS distance, s."Q" AS "Q1", s."A" AS "A1", d."Q" AS "Q2"
      FROM r s JOIN r d ON s.session_id = d.session_id AND d.pos > s.pos AND d.pos <= s.pos + {window}
      WHERE s."Q" <> '' AND s."A" <> '' AND d."Q" <> '')"""


SCORED = f"""
tm AS (SELECT *, {terms_of("concat_ws(' ', Q1, A1)")} AS ats, {terms_of('Q2')} AS qt FROM e),
ov AS (SELECT *, CASE WHEN least(len(ats), len(qt)) > 0
                 THEN len(list_intersect(ats, qt))::DOUBLE / least(len(ats), len(qt)) ELSE 0.0::DOUBLE END AS overlap FROM tm),
sc AS (SELECT *, round(least(1.0::DOUBLE, overlap * {SCORE_FACTOR}::DOUBLE), 6) AS stage1_prob,
              CAST((session_id * 7 + Q1_row * 3 + Q2_row) % 5 = 0 AS INTEGER) AS edge_label,
              CASE WHEN session_id % 25 < 16 THEN 'train' WHEN session_id % 25 < 20 THEN 'validation' ELSE 'test' END AS split
       FROM ov)"""

RANKED = f"""
rk AS (SELECT *, row_number() OVER (PARTITION BY session_id, Q1_row ORDER BY stage1_prob DESC, Q2_row) AS source_rank FROM sc),
kept AS (SELECT *, CAST(stage1_prob >= {THRESHOLD}::DOUBLE AND source_rank <= {TOP_K} AS INTEGER) AS stage1_pred_edge FROM rk)"""

EVIDENCE = """
lp AS (SELECT *, greatest(least(stage1_prob, 1.0::DOUBLE - 2.220446049250313e-16::DOUBLE), 2.220446049250313e-16::DOUBLE) AS local_prob FROM kept),
ev AS (SELECT *, stage1_pred_edge AS given,
              round(ln(greatest(least(local_prob, 0.999999::DOUBLE), 0.000001::DOUBLE)
                       / (1.0::DOUBLE - greatest(least(local_prob, 0.999999::DOUBLE), 0.000001::DOUBLE))), 6) AS r
       FROM lp)"""

RECOVERED = f"""
tr AS (SELECT *, row_number() OVER o AS k,
              sum(r) OVER (PARTITION BY session_id, Q2_row, given ORDER BY r DESC, Q1_row
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix
       FROM ev WINDOW o AS (PARTITION BY session_id, Q2_row, given ORDER BY r DESC, Q1_row)),
va AS (SELECT *, prefix - {LAMBDA_0}::DOUBLE * k - {LAMBDA_T}::DOUBLE * k * (k - 1) / 2.0::DOUBLE AS v FROM tr),
be AS (SELECT *, greatest(0.0::DOUBLE, max(v) OVER (PARTITION BY session_id, Q2_row, given)) AS best FROM va),
ks AS (SELECT *, coalesce(min(CASE WHEN best > 0 AND v = best THEN k END)
                          OVER (PARTITION BY session_id, Q2_row, given), 0) AS kstar FROM be),
fin AS (SELECT *, CAST(given = 1 AND k <= kstar AS INTEGER) AS pred,
               CASE WHEN given = 1 THEN round(r - {LAMBDA_0}::DOUBLE - {LAMBDA_T}::DOUBLE * (k - 1), 9) END AS gain FROM ks),
rec AS (SELECT *, CASE WHEN given = 1 THEN 1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(least(gain, 30.0::DOUBLE), -30.0::DOUBLE)))
                  ELSE 0.0::DOUBLE END AS final_score,
               CAST(given = 1 AND pred = 0 AS INTEGER) AS pruned FROM fin)"""


#: edges of long sessions, in the place of the dialogues' scored edges
LONG_SCORED = """
lr AS (SELECT user_id // 2 AS session_id, event_id, row_number() OVER (PARTITION BY user_id // 2 ORDER BY ts NULLS LAST, event_id NULLS LAST) - 1 AS pos FROM events),
lp0 AS (SELECT s.session_id, s.pos AS p, t.pos AS q, (s.event_id * 7919 + t.event_id * 104729) % 50 AS step, (s.event_id * 31 + t.event_id * 17) % 100 AS chance
        FROM lr s JOIN lr t ON s.session_id IS NOT DISTINCT FROM t.session_id AND t.pos BETWEEN s.pos + 1 AND s.pos + 5),
sc AS (SELECT concat_ws('_', session_id, p, q) AS edge_id, session_id, CAST(p AS INTEGER) AS Q1_row, CAST(q AS INTEGER) AS Q2_row,
         CAST(q - p AS INTEGER) AS distance, round((step + 1) / 51.0::DOUBLE, 6) AS stage1_prob,
         CAST(chance < step * step / 40.0::DOUBLE - 4 * (q - p) AS INTEGER) AS edge_label,
         CASE WHEN session_id % 25 < 16 THEN 'train' WHEN session_id % 25 < 20 THEN 'validation' ELSE 'test' END AS split FROM lp0)"""


def on_long(sql: str) -> str:
    """The SQL of a query on scored edges, turned to those of long sessions."""
    dialogues = base() + "," + SCORED
    assert dialogues in sql
    return sql.replace(dialogues, LONG_SCORED)


def with_(select: str, *parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


def on_edges(select: str, window: int = 5) -> str:
    return with_(select, base(window))


def on_scored(select: str, *more: str) -> str:
    return with_(select, base(), SCORED, *more)


def on_kept(select: str, *more: str) -> str:
    return with_(select, base(), SCORED, RANKED, *more)


def on_evidence(select: str, *more: str) -> str:
    return with_(select, base(), SCORED, RANKED, EVIDENCE, *more)


def on_recovered(select: str, *more: str) -> str:
    return with_(select, base(), SCORED, RANKED, EVIDENCE, RECOVERED, *more)


# -- metric helpers ---------------------------------------------------------

def conf(label: str, pred: str) -> str:
    c = lambda cond: f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT)"
    return f"""CAST(count(*) AS BIGINT) AS total, {c(f'{label}=1')} AS true_edges, {c(f'{pred}=1')} AS pred_edges,
 {c(f'{label}=1 AND {pred}=1')} AS tp, {c(f'{label}=0 AND {pred}=1')} AS fp,
 {c(f'{label}=1 AND {pred}=0')} AS fn, {c(f'{label}=0 AND {pred}=0')} AS tn"""


def rates(src: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}total, true_edges, pred_edges, tp, fp, fn, tn,
 round({div('tp', 'tp + fp')}, 6) AS "precision", round({div('tp', 'tp + fn')}, 6) AS recall,
 round({div('2 * tp', '2 * tp + fp + fn')}, 6) AS f1, round({div('tp + tn', 'total')}, 6) AS accuracy FROM {src}"""


def rank_cte(src: str, label: str, score: str, name: str, by: Sequence[str] = ()) -> str:
    """AUC by counting pairs, AP by its step sum, per group."""
    k = "".join(f"{c}, " for c in by)
    g = f"GROUP BY {', '.join(by)}" if by else ""
    match = " AND ".join(f"p.{c} IS NOT DISTINCT FROM n.{c}" for c in by) or "true"
    same = " AND ".join(f"x.{c} IS NOT DISTINCT FROM y.{c}" for c in by) or "true"
    return f"""
{name}_h AS (SELECT {k}{score} AS s, sum(CASE WHEN {label} = 1 THEN 1 ELSE 0 END) AS pos,
                    sum(CASE WHEN {label} = 1 THEN 0 ELSE 1 END) AS neg FROM {src} GROUP BY {k}{score}),
{name}_w AS (SELECT {''.join(f'p.{c}, ' for c in by)} sum(p.pos * n.neg * CASE WHEN p.s > n.s THEN 1.0::DOUBLE WHEN p.s = n.s THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS wins
             FROM {name}_h p JOIN {name}_h n ON {match} {('GROUP BY ' + ', '.join(f'p.{c}' for c in by)) if by else ''}),
{name}_a AS (SELECT {''.join(f'x.{c}, ' for c in by)} x.s, any_value(x.pos) AS pos, sum(y.pos) AS cp, sum(y.pos + y.neg) AS cn
             FROM {name}_h x JOIN {name}_h y ON {same} AND y.s >= x.s GROUP BY {''.join(f'x.{c}, ' for c in by)} x.s),
{name}_p AS (SELECT {k}sum(pos * cp / cn::DOUBLE) AS steps FROM {name}_a {g}),
{name}_t AS (SELECT {k}sum(pos) AS np, sum(neg) AS nn FROM {name}_h {g}),
{name} AS (SELECT {''.join(f't.{c}, ' for c in by)}
             CAST(t.np + t.nn AS BIGINT) AS total, CAST(t.np AS BIGINT) AS true_edges,
             CASE WHEN t.np > 0 AND t.nn > 0 THEN w.wins / (t.np::DOUBLE * t.nn) END AS auc,
             CASE WHEN t.np > 0 AND t.nn > 0 THEN p.steps / t.np END AS ap
           FROM {name}_t t
           JOIN {name}_w w ON {' AND '.join(f't.{c} IS NOT DISTINCT FROM w.{c}' for c in by) or 'true'}
           JOIN {name}_p p ON {' AND '.join(f't.{c} IS NOT DISTINCT FROM p.{c}' for c in by) or 'true'})"""


def sweep_cte(src: str, label: str, score: str, name: str, by: Sequence[str] = (), total: str | None = None) -> str:
    """Every distinct score as a cut, rates by direct counting."""
    k = "".join(f"{c}, " for c in by)
    same = " AND ".join(f"x.{c} = y.{c}" for c in by) or "true"
    allpos = total or (
        f"(SELECT count(*) FROM {src} z WHERE z.{label} = 1" + "".join(f" AND z.{c} = x.{c}" for c in by) + ")"
    )
    xk = "".join(f"x.{c}, " for c in by)
    return f"""
{name}_d AS (SELECT DISTINCT {k}{score} AS threshold FROM {src}),
{name}_c AS (SELECT {xk}x.threshold,
   CAST(count(*) FILTER (WHERE y.{label} = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE y.{label} = 0) AS BIGINT) AS fp,
   CAST({allpos} AS BIGINT) AS allpos
   FROM {name}_d x JOIN {src} y ON {same} AND y.{score} >= x.threshold GROUP BY {xk}x.threshold),
{name} AS (SELECT {k}threshold, tp, fp, allpos - tp AS fn, tp + fp AS pred_edges,
   {div('tp', 'tp + fp')} AS prec, {div('tp', 'allpos')} AS rec, {div('2 * tp', 'tp + fp + allpos')} AS f1 FROM {name}_c)"""


LABELLED_DOCS = """
ld AS (SELECT d.doc_id, d.source, round(d.n_chars / (d.n_chars + 1000.0::DOUBLE), 6) AS score, l.quality AS edge_label
       FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

RETENTION = f"""
v AS (SELECT * FROM rk WHERE split = 'validation'),
tot AS (SELECT count(*) AS n, count(*) FILTER (WHERE edge_label = 1) AS p FROM v),
nd AS (SELECT *, CAST(ceil(0.98::DOUBLE * p - 1e-12::DOUBLE) AS BIGINT) AS need FROM tot),
caps AS (SELECT CAST(unnest(generate_series(1, 5)) AS INTEGER) AS "TopK"),
pk AS (SELECT c."TopK", v.*, row_number() OVER (PARTITION BY c."TopK", v.edge_label ORDER BY v.stage1_prob DESC) AS o
       FROM caps c JOIN v ON v.source_rank <= c."TopK"),
th AS (SELECT c."TopK", (SELECT max(stage1_prob) FROM pk, nd WHERE pk."TopK" = c."TopK" AND pk.edge_label = 1 AND pk.o = nd.need) AS cut,
              (SELECT count(*) FROM pk WHERE pk."TopK" = c."TopK" AND pk.edge_label = 1) AS got FROM caps c),
rs AS (SELECT th."TopK", th.cut, th.got, nd.need, nd.p, nd.n,
   (SELECT count(*) FROM pk WHERE pk."TopK" = th."TopK" AND edge_label = 1 AND (th.cut IS NULL OR stage1_prob >= th.cut)) AS tp,
   (SELECT count(*) FROM pk WHERE pk."TopK" = th."TopK" AND edge_label = 0 AND (th.cut IS NULL OR stage1_prob >= th.cut)) AS fp
   FROM th, nd),
res AS (SELECT "TopK", cut AS "Threshold", got >= need AS "Feasible", 0.98::DOUBLE AS "TargetRecall",
   CAST(need AS BIGINT) AS "RequiredPositiveEdges", CAST(p AS BIGINT) AS "ValidationPositiveEdges",
   {div('got', 'p')} AS mr, {div('tp', 'p')} AS rc, {div('tp', 'tp + fp')} AS pr, {div('2 * tp', 'tp + fp + p')} AS f1,
   CAST(tp + fp AS BIGINT) AS "RetainedEdges", {div('tp + fp', 'n')} AS rr, CAST(tp AS BIGINT) AS "TruePositives",
   CAST(fp AS BIGINT) AS "FalsePositives", CAST(p - tp AS BIGINT) AS "FalseNegatives" FROM rs)"""

RETENTION_OUT = """SELECT "TopK", round("Threshold", 6) AS "Threshold", "Feasible", "TargetRecall", "RequiredPositiveEdges",
 "ValidationPositiveEdges", round(mr, 6) AS "MaxRecallAtK", round(rc, 6) AS "Recall", round(pr, 6) AS "Precision",
 round(f1, 6) AS "F1", "RetainedEdges", round(rr, 6) AS "RetentionRatio", "TruePositives", "FalsePositives",
 "FalseNegatives" FROM res"""


def series(values: Sequence[float]) -> str:
    return "[" + ", ".join(f"{v}::DOUBLE" for v in values) + "]"


def grid_ctes(l0: Sequence[float], lt: Sequence[float], where: str = "split = 'validation'") -> str:
    return f"""
gv AS (SELECT * FROM ev WHERE {where}),
g0 AS (SELECT unnest({series(l0)}) AS lambda_0), gt AS (SELECT unnest({series(lt)}) AS lambda_t),
gs AS (SELECT lambda_0, lambda_t FROM g0, gt),
gk AS (SELECT split, session_id, Q2_row, edge_label, r, row_number() OVER o AS k,
              sum(r) OVER (PARTITION BY session_id, Q2_row ORDER BY r DESC, Q1_row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix
       FROM gv WHERE given = 1 WINDOW o AS (PARTITION BY session_id, Q2_row ORDER BY r DESC, Q1_row)),
gx AS (SELECT *, prefix - lambda_0 * k - lambda_t * k * (k - 1) / 2.0::DOUBLE AS v FROM gk, gs),
gb AS (SELECT *, greatest(0.0::DOUBLE, max(v) OVER (PARTITION BY session_id, Q2_row, lambda_0, lambda_t)) AS best FROM gx),
gz AS (SELECT *, coalesce(min(CASE WHEN best > 0 AND v = best THEN k END) OVER (PARTITION BY session_id, Q2_row, lambda_0, lambda_t), 0) AS ks FROM gb),
ga AS (SELECT split, lambda_0, lambda_t, sum(CASE WHEN k <= ks AND edge_label = 1 THEN 1 ELSE 0 END) AS tp,
              sum(CASE WHEN k <= ks THEN 1 ELSE 0 END) AS pred, sum(CASE WHEN k = 1 THEN best ELSE 0.0::DOUBLE END) AS obj
       FROM gz GROUP BY split, lambda_0, lambda_t),
gp AS (SELECT split, count(*) FILTER (WHERE edge_label = 1) AS p FROM gv GROUP BY split),
gr AS (SELECT ga.split, lambda_0, lambda_t, {div('tp', 'pred')} AS "Precision", {div('tp', 'p')} AS "Recall",
              {div('2 * tp', 'pred + p')} AS "F1", CAST(pred AS BIGINT) AS "PredEdges", CAST(tp AS BIGINT) AS "TP",
              CAST(pred - tp AS BIGINT) AS "FP", CAST(p - tp AS BIGINT) AS "FN", obj AS "ObjectiveTotal"
       FROM ga JOIN gp ON ga.split = gp.split)"""


GRID_ORDER = '"F1" DESC, "Precision" DESC, "PredEdges", lambda_0, lambda_t'
GRID_OUT = """round(lambda_0, 6) AS lambda_0, round(lambda_t, 6) AS lambda_t, round("Precision", 6) AS "Precision",
 round("Recall", 6) AS "Recall", round("F1", 6) AS "F1", "PredEdges", "TP", "FP", "FN", round("ObjectiveTotal", 6) AS "ObjectiveTotal\""""
GRID = grid_ctes(LAMBDA0_GRID, LAMBDAT_GRID)
FLAGS = f"""
sel AS (SELECT * FROM gr WHERE abs(lambda_0 - {LAMBDA_0}) <= 1e-12 AND abs(lambda_t - {LAMBDA_T}) <= 1e-12),
fl AS (SELECT gr.*, abs(gr.lambda_0 - {LAMBDA_0}) <= 1e-12 AND abs(gr.lambda_t - {LAMBDA_T}) <= 1e-12 AS selected_row,
   gr."F1" - sel."F1" AS d1, gr."Precision" - sel."Precision" AS d2, CAST(gr."PredEdges" - sel."PredEdges" AS DOUBLE) AS d3,
   abs(gr.lambda_0 - {LAMBDA_0}::DOUBLE) AS a0, abs(gr.lambda_t - {LAMBDA_T}::DOUBLE) AS a1 FROM gr, sel)"""
FLAG_OUT = f"""SELECT {GRID_OUT}, selected_row, round(d1, 6) AS delta_f1_from_selected, round(d2, 6) AS delta_precision_from_selected,
 round(d3, 6) AS delta_pred_edges_from_selected, round(a0, 6) AS abs_lambda_0_distance, round(a1, 6) AS abs_lambda_t_distance FROM fl"""

# -- channels ---------------------------------------------------------------

_UNS = tscore("A1", LEX.unsatisfied, 2)
CHANNELS = f"""
i0 AS (SELECT *, {_UNS} AS u0, {marks('Q2')} AS mk, {tscore('Q2', LEX.pressure, 2)} AS pr0, {tscore('Q2', LEX.challenge, 2)} AS ch0,
   {tscore('A1', LEX.claim, 2)} AS claim, {tscore('Q2', LEX.explain_only, 2)} AS expl,
   greatest({tscore('Q2', LEX.evidence, 2)}, {tscore('A1', LEX.evidence, 3)}) AS evi FROM sc),
i1 AS (SELECT *, CASE WHEN u0 > 0 AND length(A1) <= 18 THEN greatest(u0, 0.75::DOUBLE)
                      WHEN u0 > 0 AND length(A1) <= 35 THEN greatest(u0, 0.60::DOUBLE) ELSE u0 END AS uns,
   greatest(pr0, mk * 0.25::DOUBLE) AS pres, greatest(ch0, mk * 0.35::DOUBLE) AS chal, stage1_prob AS sem, distance <= 5 AS near FROM i0),
i2 AS (SELECT *, greatest(least(pres - 0.70::DOUBLE * expl, 1.0::DOUBLE), 0.0::DOUBLE) AS bare FROM i1),
i3 AS (SELECT *, greatest(0.0::DOUBLE, CASE WHEN uns >= 0.45 AND pres >= 0.75 AND near THEN 0.58::DOUBLE ELSE 0.0::DOUBLE END,
   CASE WHEN uns >= 0.58 AND pres >= 0.55 AND near THEN 0.80::DOUBLE ELSE 0.0::DOUBLE END,
   CASE WHEN bare >= 0.92 AND sem >= 0.01 AND near THEN 0.56::DOUBLE ELSE 0.0::DOUBLE END,
   CASE WHEN bare >= 0.95 AND distance <= 2 THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END,
   CASE WHEN expl >= 0.65 AND uns >= 0.45 AND near THEN 0.53::DOUBLE ELSE 0.0::DOUBLE END) AS complaint,
   greatest(0.0::DOUBLE, CASE WHEN chal >= 0.45 AND sem >= 0.06 AND near THEN 0.58::DOUBLE ELSE 0.0::DOUBLE END,
   CASE WHEN evi >= 0.55 AND chal >= 0.35 AND sem >= 0.02 AND near THEN 0.70::DOUBLE ELSE 0.0::DOUBLE END,
   CASE WHEN chal >= 0.55 AND (claim >= 0.35 OR evi >= 0.35) AND sem >= 0.02 AND near THEN 0.78::DOUBLE ELSE 0.0::DOUBLE END) AS challenge
   FROM i2)"""


def objects(x: str) -> str:
    vocab = words(LEX.object_vocabulary())
    runs = f"regexp_extract_all({x}, '{WORD}{{2,24}}')"
    ascii_runs = f"list_transform(list_filter({runs}, lambda w: regexp_full_match(w, '[A-Za-z0-9]+')), lambda w: lower(w))"
    return f"list_distinct(list_concat(list_filter({vocab}, lambda w: contains({x}, w)), {ascii_runs}))"


def shared_score(s: str) -> str:
    return f"least(len(list_filter({s}, lambda w: length(w) >= 3)) * 0.5::DOUBLE + len({s}) * 0.12::DOUBLE, 1.0::DOUBLE)"


def shared_names(s: str) -> str:
    ordered = f"list_transform(list_sort(list_transform({s}, lambda w: {{'n': -length(w), 't': w}})), lambda q: q.t)"
    return f"coalesce(array_to_string(({ordered})[1:12], '|'), '')"


_ANC = "concat_ws(' ', Q1, A1)"
BRIDGE = f"""
b0 AS (SELECT *, {objects(_ANC)} AS ao, {objects('A1')} AS a1o, {objects('Q2')} AS qo,
   {', '.join(f'{tscore(_ANC, t, 2)} AS a1_event_{g}' for g, t in LEX.events.items())},
   {', '.join(f'{tscore("Q2", t, 2)} AS q2_intent_{g}' for g, t in LEX.intents.items())},
   {tscore('Q2', LEX.action, 2)} AS act, {tscore('Q2', LEX.reference, 1)} AS ref,
   {tscore('A1', LEX.answer_state, 2)} AS ast, {tscore('A1', LEX.commitment, 2)} AS com, {tscore('Q2', LEX.continuation_need, 2)} AS need,
   CASE WHEN {has(_ANC, LEX.capacity_anchor)} AND {has('Q2', LEX.capacity_query)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cap FROM i3),
b1 AS (SELECT *, list_intersect(ao, qo) AS sh, list_intersect(a1o, qo) AS ash FROM b0),
b2 AS (SELECT *, {shared_score('sh')} AS shs, {shared_score('ash')} AS ashs,
   greatest(0.0::DOUBLE, {', '.join(f'CASE WHEN a1_event_{e} >= 0.5 AND q2_intent_{i} >= 0.5 AND near AND sem >= 0 THEN {w}::DOUBLE ELSE 0.0::DOUBLE END' for e, i, w in LEX.bridges)}) AS rule
   FROM b1),
b3 AS (SELECT *, (act >= 0.45 OR ref >= 0.5) AS asks FROM b2),
b4 AS (SELECT *, CASE WHEN rule > 0 AND asks AND (
     (shs >= 0.5 AND rule > 0 AND (ashs >= 0.24 OR ref >= 0.5 OR sem >= 0.03))
  OR (rule >= 0.3 AND (shs >= 0.12 OR ashs >= 0.12) AND asks AND distance <= 3)
  OR (rule >= 0.24 AND ashs >= 0.12 AND asks AND distance <= 2)
  OR (ref >= 0.5 AND (shs >= 0.24 OR ashs >= 0.12))
  OR (a1_event_project_capacity >= 0.5 AND q2_intent_growth_profit_question >= 0.5 AND cap >= 1 AND act >= 0.45 AND distance <= 1)
  ) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS eligible FROM b3),
b5 AS (SELECT *, CASE WHEN eligible = 1 THEN greatest(rule + 0.05::DOUBLE * shs + 0.03::DOUBLE * act + 0.02::DOUBLE * ref, sem) ELSE 0.0::DOUBLE END AS strength FROM b4)"""


def on_channels(select: str, *more: str) -> str:
    return on_scored(select, CHANNELS, BRIDGE, *more)


# -- topic shift ------------------------------------------------------------

SHIFT = f"""
s0 AS (SELECT *, length(Q2) <= 20 AS short, {has('Q2', LEX.strong_shift)} AS st, {has('Q2', LEX.soft_shift)} AS so,
   {has('Q2', LEX.continuation)} AS co, {has('Q2', LEX.new_topic)} AS nt, {has('Q2', LEX.question)} AS qf,
   length(Q2) > 0 AND NOT contains(Q1, Q2) AND NOT contains(A1, Q2) AS fresh, length(Q2) AS n FROM ov),
s1 AS (SELECT *, 0.0::DOUBLE + CASE WHEN st THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN NOT st AND so THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END
   + CASE WHEN overlap < 0.05 AND short THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END
   + CASE WHEN overlap = 0 THEN 0.22::DOUBLE ELSE 0.0::DOUBLE END
   + CASE WHEN overlap > 0 AND overlap < 0.08 THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END
   + CASE WHEN short AND overlap < 0.12 AND NOT co AND nt THEN 0.18::DOUBLE ELSE 0.0::DOUBLE END
   + CASE WHEN co THEN -0.15::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN qf THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END
   + CASE WHEN n <= 10 THEN 0.05::DOUBLE WHEN n <= 16 THEN 0.04::DOUBLE WHEN n <= 20 THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END
   + CASE WHEN fresh THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END AS raw,
   concat_ws('|', CASE WHEN st THEN 'strong_pattern' END, CASE WHEN NOT st AND so THEN 'soft_pattern' END,
     CASE WHEN overlap < 0.05 AND short THEN 'low_overlap_short_q2' END, CASE WHEN overlap = 0 THEN 'no_overlap' END,
     CASE WHEN overlap > 0 AND overlap < 0.08 THEN 'tiny_overlap' END,
     CASE WHEN short AND overlap < 0.12 AND NOT co AND nt THEN 'new_topic_short_q2' END,
     CASE WHEN co THEN 'continuation_marker' END, CASE WHEN qf THEN 'question_form' END, CASE WHEN n <= 20 THEN 'short_q2' END) AS flags FROM s0),
s2 AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, raw)) AS shift FROM s1),
s3 AS (SELECT *, CASE WHEN shift >= 0.8 THEN 'easy' WHEN shift >= 0.45 THEN 'boundary' ELSE 'keep' END AS bucket FROM s2)"""


def on_shift(select: str) -> str:
    return with_(select, base(), SCORED.rsplit("sc AS", 1)[0].rstrip().rstrip(","), SHIFT)


# -- errors -----------------------------------------------------------------

def visible(x: str) -> str:
    return f"list_distinct(list_filter(string_split(lower({x}), ''), lambda c: NOT regexp_matches(c, '^{BLANK}$') AND c <> ''))"


def _db(d: str) -> str:
    return f"CASE WHEN {d} <= 1 THEN 'd=1' WHEN {d} <= 3 THEN 'd=2-3' WHEN {d} <= 5 THEN 'd=4-5' ELSE 'd>=6' END"


def _sb(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN 'nan' WHEN {x} < 0 THEN '<=0' WHEN {x} < 0.1 THEN '0-0.1' WHEN {x} < 0.25 THEN '0.1-0.25' "
            f"WHEN {x} < 0.5 THEN '0.25-0.5' WHEN {x} < 0.75 THEN '0.5-0.75' ELSE '>=0.75' END")


ERRORS = f"""
a0 AS (SELECT rec.*, s3.flags, s3.bucket, CAST(sum(pred) OVER (PARTITION BY rec.session_id, rec.Q2_row) AS INTEGER) AS indeg,
   {jac(visible('rec.Q1'), visible('rec.Q2'))} AS j1, {jac(visible('rec.A1'), visible('rec.Q2'))} AS j2,
   contains(s3.flags, 'question_form') OR contains(s3.flags, 'short_q2') OR s3.bucket = 'boundary' OR length(rec.Q2) <= 20 AS form
   FROM rec JOIN s3 ON rec.edge_id = s3.edge_id),
an AS (SELECT *, CASE WHEN NOT (pred = 1 AND edge_label = 0) THEN 'not_fp' WHEN distance >= 4 THEN 'long_distance_carryover'
   WHEN indeg >= 2 THEN 'multiple_source_over_recovery' WHEN {has('A1', LEX.generic_answer)} THEN 'vague_answer_false_trigger'
   WHEN form THEN 'boundary_question_form' WHEN j1 >= 0.3 OR j2 >= 0.3 THEN 'broad_lexical_overlap'
   WHEN bucket <> 'keep' THEN 'topic_boundary_extension' ELSE 'other_manual_review' END AS fp_taxonomy,
   CASE WHEN NOT (pred = 0 AND edge_label = 1) THEN 'not_fn' WHEN stage1_pred_edge = 0 THEN 'stage1_recall_miss'
   WHEN pruned = 1 THEN 'stage2_graph_pruning_drop' WHEN distance >= 4 THEN 'long_distance_drop' WHEN form THEN 'boundary_question_form'
   WHEN bucket <> 'keep' THEN 'topic_boundary_drop' ELSE 'other_manual_review' END AS fn_taxonomy FROM a0)"""


def on_errors(select: str) -> str:
    return on_recovered(select, SHIFT, ERRORS)


# -- BM25 -------------------------------------------------------------------

def bag(x: str) -> str:
    ascii_words = f"list_transform(regexp_extract_all({x}, '[A-Za-z0-9]+'), lambda w: lower(w))"
    runs = f"regexp_extract_all({x}, '{CJK}+')"
    grams = (f"flatten(list_transform({runs}, lambda s: CASE WHEN length(s) = 1 THEN [s] "
             f"ELSE list_transform(range(1, length(s)), lambda i: substr(s, CAST(i AS BIGINT), 2)) END))")
    both = f"list_concat({ascii_words}, coalesce({grams}, []::VARCHAR[]))"
    return f"CASE WHEN len({both}) > 0 THEN {both} ELSE string_split({x}, '') END"


BM25 = f"""
tx AS (SELECT *, {clean(f"{lit(ANCHOR_QUESTION_PREFIX)} || Q1 || {lit(ANCHOR_ANSWER_PREFIX)} || A1")} AS anchor,
              {clean(f"{lit(CANDIDATE_PREFIX)} || Q2")} AS cand FROM sc),
tk AS (SELECT *, {bag('anchor')} AS dt, {bag('cand')} AS qk FROM tx),
cor AS (SELECT anchor, any_value(dt) AS dt FROM tk WHERE split = 'train' GROUP BY anchor),
cs AS (SELECT count(*) AS n_docs, avg(len(dt)::DOUBLE) AS avgdl FROM cor),
tf AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(dt)) AS token FROM cor) GROUP BY token),
idf AS (SELECT token, CAST(df AS BIGINT) AS df, CAST(n_docs AS BIGINT) AS n_docs, avgdl, ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM tf, cs),
qe AS (SELECT edge_id, len(dt) AS dl, dt, unnest(qk) AS token FROM tk),
qc AS (SELECT edge_id, dl, token, len(list_filter(dt, lambda w: w = token)) AS c FROM qe),
qs AS (SELECT qc.edge_id, sum(coalesce(i.idf, 0.0::DOUBLE) * (c * 2.5::DOUBLE)
         / (c + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avgdl FROM cs)) + 1e-9::DOUBLE)) AS s
       FROM qc LEFT JOIN idf i ON qc.token = i.token WHERE c > 0 GROUP BY qc.edge_id),
bm AS (SELECT tk.*, round(coalesce(s, 0.0::DOUBLE), 6) AS bm25_score, round(1.0::DOUBLE / greatest(distance, 1), 6) AS distance_prior
       FROM tk LEFT JOIN qs ON tk.edge_id = qs.edge_id)"""

LONG = """
lg AS (SELECT edge_id, split, edge_label, 'BM25' AS "Model", bm25_score AS score FROM bm
 UNION ALL SELECT edge_id, split, edge_label, 'Temporal-distance Prior', distance_prior FROM bm
 UNION ALL SELECT edge_id, split, edge_label, 'Term Overlap', stage1_prob FROM bm)"""

VECTORS = """
ve AS (SELECT CAST(label AS BIGINT) AS session_id, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM embeddings),
vp AS (SELECT concat_ws('_', s.session_id, s.pos, d.pos) AS edge_id, s.session_id, CAST(s.pos AS INTEGER) AS "Q1_row", CAST(d.pos AS INTEGER) AS "Q2_row",
   CAST(d.pos - s.pos AS INTEGER) AS distance, s.vec_id AS v1, d.vec_id AS v2, s.embedding AS a, d.embedding AS b
   FROM ve s JOIN ve d ON s.session_id = d.session_id AND d.pos > s.pos AND d.pos <= s.pos + 5)"""
NODES = """
nd AS (SELECT DISTINCT session_id, "Q1_row" AS "row", 'source' AS role, a::DOUBLE[] AS x FROM vp
  UNION SELECT DISTINCT session_id, "Q2_row", 'target', b::DOUBLE[] FROM vp),
ar AS (SELECT session_id, "Q2_row" AS "row", 'target' AS role, "Q1_row" AS nrow, 'source' AS nrole FROM vp
  UNION SELECT session_id, "Q1_row", 'source', "Q2_row", 'target' FROM vp),
un AS (SELECT session_id, "row", role, unnest(x) AS val, unnest(range(1, 65)) AS i FROM nd)"""


def _graph_sql(directed: bool) -> str:
    """The forward pass with matrices as nested lists; the error function by its series."""
    factorials = [1.0]
    for n in range(1, 40):
        factorials.append(factorials[-1] * n)
    terms = "[" + ", ".join(f"{(-1) ** n / (f * (2 * n + 1))!r}::DOUBLE" for n, f in enumerate(factorials)) + "]"
    hidden = GRAPH_HIDDEN

    def layer(name: str, src: str, number: int, width: int) -> str:
        rows = "[" + ", ".join("[" + ", ".join(f"{graph_weight(number, i, j)}::DOUBLE" for j in range(width)) + "]" for i in range(hidden)) + "]"
        bias = "[" + ", ".join(f"{graph_weight(number, i, 99)}::DOUBLE" for i in range(hidden)) + "]"
        scale = "[" + ", ".join(f"{1 + i % 3 / 4}::DOUBLE" for i in range(hidden)) + "]"
        shift = "[" + ", ".join(f"{(i % 5 - 2) / 8}::DOUBLE" for i in range(hidden)) + "]"
        dot = f"list_sum(list_transform(range(1, {width + 1}), lambda k: c[k] * ({rows})[o][k]))"
        erf = f"2.0::DOUBLE / sqrt(pi()) * list_sum(list_transform(range(1, 41), lambda n: ({terms})[n] * pow(v / sqrt(2.0::DOUBLE), 2 * n - 1)))"
        return f"""
{name}_z AS (SELECT * EXCLUDE (c), list_transform(range(1, {hidden + 1}), lambda o: {dot} + ({bias})[o]) AS z FROM {src}),
{name}_m AS (SELECT *, list_sum(z) / {hidden} AS mean FROM {name}_z),
{name}_v AS (SELECT *, list_sum(list_transform(z, lambda v: (v - mean) * (v - mean))) / {hidden} AS spread FROM {name}_m),
{name}_n AS (SELECT * EXCLUDE (z, mean, spread), list_transform(range(1, {hidden + 1}),
   lambda o: (z[o] - mean) / sqrt(spread + 1e-5::DOUBLE) * ({scale})[o] + ({shift})[o]) AS y FROM {name}_v),
{name} AS (SELECT * EXCLUDE (y), list_transform(y, lambda v: 0.5::DOUBLE * v * (1.0::DOUBLE + {erf})) AS x FROM {name}_n)"""

    parts = [f"""
ar AS (SELECT session_id, "Q2_row" AS "row", 'target' AS role, "Q1_row" AS nrow, 'source' AS nrole FROM vp
  UNION SELECT session_id, "Q1_row", 'source', "Q2_row", 'target' FROM vp),
h0 AS (SELECT session_id, "Q1_row" AS "row", 'source' AS role, any_value(a[1:{GRAPH_IN}]::DOUBLE[]) AS x FROM vp GROUP BY 1, 2
  UNION ALL SELECT session_id, "Q2_row", 'target', any_value(b[1:{GRAPH_IN}]::DOUBLE[]) FROM vp GROUP BY 1, 2)"""]
    width = GRAPH_IN
    for n in range(GRAPH_LAYERS):
        arcs = "ar" if directed else f'(SELECT * FROM ar UNION ALL SELECT session_id, "row", role, "row", role FROM h{n})'
        zero = "[" + ", ".join(["0.0::DOUBLE"] * width) + "]"
        # a source has targets only, a target sources only
        both = f"CASE WHEN role = 'source' THEN list_concat(x, {zero}, m) ELSE list_concat(x, m, {zero}) END" if directed else "list_concat(x, m)"
        parts.append(f"""
u{n} AS (SELECT session_id, "row" AS nrow, role AS nrole, unnest(x) AS val, unnest(range(1, {width + 1})) AS i FROM h{n}),
w{n} AS (SELECT a.session_id, a."row", a.role, u.i, avg(u.val) AS m FROM {arcs} a
   JOIN u{n} u ON a.session_id = u.session_id AND a.nrow = u.nrow AND a.nrole = u.nrole GROUP BY ALL),
y{n} AS (SELECT session_id, "row", role, list(m ORDER BY i) AS m FROM w{n} GROUP BY ALL),
c{n} AS (SELECT session_id, "row", role, {both} AS c FROM h{n} JOIN y{n} USING (session_id, "row", role))""")
        parts.append(layer(f"h{n + 1}", f"c{n}", n, width * (3 if directed else 2)))
        width = hidden
    last = f"h{GRAPH_LAYERS}"
    parts.append(f"""
ed AS (SELECT vp.edge_id, list_concat(s.x, t.x, list_transform(range(1, {hidden + 1}), lambda i: abs(s.x[i] - t.x[i])), list_transform(range(1, {hidden + 1}), lambda i: s.x[i] * t.x[i])) AS c
   FROM vp JOIN {last} s ON s.session_id = vp.session_id AND s."row" = vp."Q1_row" AND s.role = 'source'
   JOIN {last} t ON t.session_id = vp.session_id AND t."row" = vp."Q2_row" AND t.role = 'target')""")
    parts.append(layer("eh", "ed", GRAPH_LAYERS, 4 * hidden))
    out = " + ".join(f"x[{i + 1}] * {graph_weight(9, i, 0)}::DOUBLE" for i in range(hidden))
    return with_(f"SELECT edge_id, round({out} + 0.25::DOUBLE, 6) AS margin FROM eh", VECTORS, *parts)


def _stage_record(stage: str, note: str, filled: dict[str, str], src: str) -> str:
    cols = ", ".join(
        f'round(CAST({filled.get(c, "NULL")} AS DOUBLE), 6) AS {c}' for c in STAGE_COLUMNS
    )
    return f"SELECT split, {lit(stage)} AS stage, {cols}, {lit(note)} AS notes FROM {src}"


STAGES = (
    rank_cte("rec", "edge_label", "stage1_prob", "m1", ["split"]) + ","
    + rank_cte("rec", "edge_label", "local_prob", "m2", ["split"]) + ","
    + rank_cte("rec", "edge_label", "final_score", "m3", ["split"]) + f""",
c1 AS (SELECT split, {conf('edge_label', 'stage1_pred_edge')} FROM rec GROUP BY split),
c3 AS (SELECT split, {conf('edge_label', 'pred')}, count(*) FILTER (WHERE given = 1) AS g, count(*) FILTER (WHERE pruned = 1) AS del,
   count(*) FILTER (WHERE pruned = 1 AND edge_label = 1) AS dtp, count(*) FILTER (WHERE pruned = 1 AND edge_label = 0) AS dfp,
   count(*) FILTER (WHERE given = 0 AND edge_label = 1) AS dfn FROM rec GROUP BY split),
j1 AS (SELECT c1.*, m1.auc, m1.ap FROM c1 JOIN m1 ON c1.split = m1.split),
j3 AS (SELECT c3.*, m3.auc, m3.ap FROM c3 JOIN m3 ON c3.split = m3.split)"""
)
_P, _R, _F = div("tp", "tp + fp"), div("tp", "tp + fn"), div("2 * tp", "2 * tp + fp + fn")
STAGE_UNION = " UNION ALL ".join(
    [
        _stage_record(
            "stage1_candidate_retention", "Stage 1 source-conditioned candidate retention.",
            {"total_edges": "total", "true_edges": "true_edges", "pred_edges": "pred_edges",
             "candidate_retention_ratio": "pred_edges / total::DOUBLE",
             "candidate_compression_ratio": "1.0::DOUBLE - pred_edges / total::DOUBLE", "stage1_gold_edge_recall": _R,
             "stage1_precision": _P, "stage1_recall": _R, "stage1_f1": _F, "stage1_tp": "tp", "stage1_fp": "fp",
             "stage1_fn": "fn", "stage1_tn": "tn", "stage1_auc": "auc", "stage1_ap": "ap"}, "j1"),
        _stage_record(
            "stage2a_local_calibration", "Stage 2A candidate-set ranking and calibration.",
            {"total_edges": "total", "true_edges": "true_edges", "stage2a_auc": "auc", "stage2a_ap": "ap"}, "m2"),
        _stage_record(
            "stage2b_structured_recovery", "Stage 2B exact target-wise graph recovery.",
            {"total_edges": "total", "true_edges": "true_edges", "stage2b_input_pred_edges": "g",
             "stage2b_final_pred_edges": "pred_edges", "stage2b_deleted_edges": "del", "stage2b_deleted_tp": "dtp",
             "stage2b_deleted_fp": "dfp", "stage2b_deleted_fn": "dfn", "stage2b_precision": _P, "stage2b_recall": _R,
             "stage2b_f1": _F, "stage2b_auc": "auc", "stage2b_ap": "ap"}, "j3"),
    ]
)


def _transition() -> str:
    own = [("stage1_candidate_retention", c, n) for c, n in (
        ("total_edges", "raw_candidates"), ("true_edges", "raw_true_edges"), ("pred_edges", "stage1_retained_edges"),
        ("stage1_gold_edge_recall", "stage1_gold_edge_recall"), ("candidate_compression_ratio", "stage1_compression_ratio"))]
    own += [("stage2a_local_calibration", c, c) for c in ("stage2a_auc", "stage2a_ap")]
    own += [("stage2b_structured_recovery", f"stage2b_{c}", f"stage2b_{c}") for c in (
        "input_pred_edges", "final_pred_edges", "deleted_edges", "deleted_tp", "deleted_fp", "precision", "recall", "f1", "auc", "ap")]
    cols = ", ".join(f"max({c}) FILTER (WHERE stage = '{s}') AS {n}" for s, c, n in own)
    return (f"SELECT split, {cols}, {LAMBDA_0}::DOUBLE AS selected_lambda_0, {LAMBDA_T}::DOUBLE AS selected_lambda_t "
            "FROM su GROUP BY split")


# -- learned steps ----------------------------------------------------------

def newton(name: str, src: str, xs: Sequence[str], ridge_on_bias: bool, steps: int) -> str:
    """A class-balanced logistic fit by Newton's steps: ``{name}`` has m_i, d_i (scaling) and b_i, the last of them the bias.

    Each step sums the Hessian and the gradient over all rows and solves for the
    move by elimination, column after column.
    """
    d = len(xs)
    every = range(1, d + 2)
    listed = lambda form, part: ", ".join(form.format(i=i) for i in part)
    out = [
        f"{name}_r AS MATERIALIZED (SELECT {', '.join(f'CAST({x} AS DOUBLE) AS x{i}' for i, x in enumerate(xs, 1))}, CAST(edge_label AS DOUBLE) AS y FROM {src})",
        f"{name}_m AS MATERIALIZED (SELECT count(*)::DOUBLE AS n, sum(y) AS p, {listed('sum(x{i}) / count(*) AS m{i}', range(1, d + 1))} FROM {name}_r)",
        f"{name}_d AS MATERIALIZED (SELECT {listed('coalesce(nullif(sqrt(sum((x{i} - m{i}) * (x{i} - m{i})) / any_value(n)), 0.0::DOUBLE), 1.0::DOUBLE) AS d{i}', range(1, d + 1))} FROM {name}_r, {name}_m)",
        f"{name}_u AS MATERIALIZED (SELECT {listed('(x{i} - m{i}) / d{i} AS u{i}', range(1, d + 1))}, 1.0::DOUBLE AS u{d + 1}, y, "
        f"n / (2.0::DOUBLE * CASE WHEN y = 1 THEN p ELSE n - p END) AS w FROM {name}_r, {name}_m, {name}_d)",
        f"{name}_f0 AS MATERIALIZED (SELECT {listed('0.0::DOUBLE AS b{i}', every)})",
    ]
    for k in range(1, steps + 1):
        z = " + ".join(f"u{i} * b{i}" for i in every)
        ridge = {i: 1.0 if i <= d or ridge_on_bias else 0.0 for i in every}
        out.append(f"{name}_q{k} AS MATERIALIZED (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(least({z}, 30.0::DOUBLE), -30.0::DOUBLE))) AS q FROM {name}_u, {name}_f{k - 1})")
        sums = [f"sum(w * q * (1.0::DOUBLE - q) * u{i} * u{j}) + {ridge[i] if i == j else 0.0}::DOUBLE AS a{i}_{j}" for i in every for j in every]
        sums += [f"sum(w * (q - y) * u{i}) + {ridge[i]}::DOUBLE * any_value(b{i}) AS a{i}_0" for i in every]
        out.append(f"{name}_e{k}_0 AS MATERIALIZED (SELECT {', '.join(sums)} FROM {name}_q{k})")
        for c in range(1, d + 1):  # clear column c below its row
            cells = []
            for i in every:
                for j in (*every, 0):
                    own = f"a{i}_{j}"
                    cells.append(f"{own} - a{i}_{c} / a{c}_{c} * a{c}_{j} AS {own}" if i > c else own)
            out.append(f"{name}_e{k}_{c} AS MATERIALIZED (SELECT {', '.join(cells)} FROM {name}_e{k}_{c - 1})")
        last = f"{name}_e{k}_{d}"
        for i in reversed(every):
            known = "".join(f" - a{i}_{j} * t{j}" for j in range(i + 1, d + 2))
            out.append(f"{name}_t{k}_{i} AS MATERIALIZED (SELECT *, (a{i}_0{known}) / a{i}_{i} AS t{i} FROM {last})")
            last = f"{name}_t{k}_{i}"
        out.append(f"{name}_f{k} AS MATERIALIZED (SELECT {listed('b{i} - t{i} AS b{i}', every)} FROM {name}_f{k - 1}, {last})")
    out.append(f"{name} AS MATERIALIZED (SELECT * FROM {name}_m, {name}_d, {name}_f{steps})")
    return "\n" + ",\n".join(out)


CALIBRATION = "\nct AS (SELECT * FROM kept WHERE split = 'train' AND stage1_pred_edge = 1)," + newton("cal", "ct", ["stage1_prob"], True, 12)
CALIBRATED = """
lp AS (SELECT kept.*, greatest(least(1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(least((stage1_prob - m1) / d1 * b1 + b2, 30.0::DOUBLE), -30.0::DOUBLE))),
                                     0.999999::DOUBLE), 0.000001::DOUBLE) AS local_prob FROM kept, cal),
ev AS (SELECT *, stage1_pred_edge AS given, ln(local_prob / (1.0::DOUBLE - local_prob)) AS r FROM lp)"""
FUSION = newton("fu", "ft", ["bm25_score", "stage1_prob", "stage1_prob * distance_prior", "distance_prior"], False, 12)


def staged(select: str, calibrated: bool = True) -> str:
    """The whole protocol: cap and threshold, calibration and penalties are looked up where they were selected."""
    chosen = """
sb AS MATERIALIZED (SELECT "Threshold" AS th, "TopK" AS tk FROM res WHERE "Feasible" ORDER BY "RetainedEdges", "TopK", "Threshold" DESC LIMIT 1),
kept AS MATERIALIZED (SELECT rk.*, CAST(stage1_prob >= sb.th AND source_rank <= sb.tk AS INTEGER) AS stage1_pred_edge FROM rk, sb)"""
    best = f"\npb AS MATERIALIZED (SELECT lambda_0, lambda_t FROM gr ORDER BY {GRID_ORDER} LIMIT 1)"
    recovered = RECOVERED.replace(f"{LAMBDA_0}::DOUBLE", "(SELECT lambda_0 FROM pb)").replace(f"{LAMBDA_T}::DOUBLE", "(SELECT lambda_t FROM pb)")
    evidence = (CALIBRATION, CALIBRATED) if calibrated else (EVIDENCE.replace("round(ln(", "(ln(").replace(", 6) AS r", ") AS r"),)
    ranked = RANKED.split("kept AS", 1)[0].rstrip().rstrip(",")
    return with_(
        select, base(), SCORED, ranked, RETENTION, chosen, *evidence, GRID, best, recovered,
        f"\ncf AS (SELECT split, {conf('edge_label', 'pred')} FROM rec GROUP BY split)", rank_cte("rec", "edge_label", "final_score", "rm", ["split"]),
        "\ncj AS (SELECT cf.*, rm.auc, rm.ap FROM cf JOIN rm ON cf.split = rm.split)",
    )


MOD = 2147483647
BOOT = f"""
te AS (SELECT session_id, edge_label, pred, stage1_pred_edge AS bp, round(final_score, 6) AS fs FROM rec WHERE split = 'test'),
se AS (SELECT session_id, row_number() OVER (ORDER BY session_id) - 1 AS idx FROM (SELECT DISTINCT session_id FROM te)),
sn AS (SELECT CAST(count(*) AS BIGINT) AS n FROM se),
p0 AS (SELECT CAST(d.d AS BIGINT) AS d, CAST(se.idx AS BIGINT) AS k FROM (SELECT unnest(range({DRAWS})) AS d) d, se),
p1 AS (SELECT d, k, (d * 7919 + k * 104729 + {42 * 31}) % {MOD} AS x FROM p0),
p2 AS (SELECT d, k, (x * 48271) % {MOD} AS x FROM p1),
p3 AS (SELECT d, k, (x * x + d) % {MOD} AS x FROM p2),
p4 AS (SELECT d, (x * 16807 + k) % {MOD} % (SELECT n FROM sn) AS idx FROM p3),
bo AS (SELECT p4.d, te.* FROM p4 JOIN se ON p4.idx = se.idx JOIN te ON te.session_id = se.session_id),
bc AS (SELECT d, count(*) FILTER (WHERE edge_label=1 AND pred=1) AS tp, count(*) FILTER (WHERE edge_label=0 AND pred=1) AS fp,
   count(*) FILTER (WHERE edge_label=1 AND pred=0) AS fn, count(*) FILTER (WHERE edge_label=1 AND bp=1) AS btp,
   count(*) FILTER (WHERE edge_label=0 AND bp=1) AS bfp, count(*) FILTER (WHERE edge_label=1 AND bp=0) AS bfn FROM bo GROUP BY d)"""


#: the same draws for several models: counts of a session times how often a draw picked it
BOOT_MODELS = BOOT.split("\nbo AS", 1)[0].rstrip().rstrip(",") + """,
bt AS (SELECT session_id, edge_label, unnest(['Final Graph', 'Stage 1', 'Temporal-distance Prior']) AS "Model",
   unnest([round(final_score, 6), stage1_prob, round(1.0::DOUBLE / greatest(distance, 1), 6)]) AS score,
   unnest([pred, stage1_pred_edge, CAST(round(1.0::DOUBLE / greatest(distance, 1), 6) >= 0.5 AS INTEGER)]) AS p FROM rec WHERE split = 'test'),
dw AS (SELECT d, idx, count(*) AS w FROM p4 GROUP BY d, idx),
ce AS (SELECT se.idx, "Model", score, sum(edge_label) AS pos, count(*) - sum(edge_label) AS neg, count(*) FILTER (WHERE edge_label = 1 AND p = 1) AS tp,
   count(*) FILTER (WHERE edge_label = 0 AND p = 1) AS fp, count(*) FILTER (WHERE edge_label = 1 AND p = 0) AS fn
   FROM bt JOIN se ON bt.session_id = se.session_id GROUP BY se.idx, "Model", score),
ds AS (SELECT d, "Model", score, sum(w * pos) AS pos, sum(w * neg) AS neg, sum(w * tp) AS tp, sum(w * fp) AS fp, sum(w * fn) AS fn
   FROM dw JOIN ce ON dw.idx = ce.idx GROUP BY d, "Model", score),
dc AS (SELECT *, sum(pos) OVER o AS cp, sum(neg) OVER o AS cn FROM ds WINDOW o AS (PARTITION BY d, "Model" ORDER BY score DESC)),
dt AS (SELECT d, "Model", sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn, sum(pos)::DOUBLE AS np, sum(neg)::DOUBLE AS nn,
   sum(neg * (cp - pos / 2.0::DOUBLE)) AS wins, sum(CASE WHEN pos > 0 THEN pos * cp / (cp + cn)::DOUBLE ELSE 0.0::DOUBLE END) AS steps FROM dc GROUP BY d, "Model"),
dm AS (SELECT d, "Model", CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS rc,
   CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0::DOUBLE END AS f1,
   CASE WHEN np > 0 AND nn > 0 THEN wins / (np * nn) END AS auc, CASE WHEN np > 0 AND nn > 0 THEN steps / np END AS ap FROM dt)"""


def _ci(metric: str, expr: str, src: str) -> str:
    return (f"SELECT {lit(metric)} AS \"Metric\", round(avg(v), 6) AS \"BootstrapMean\", round(quantile_cont(v, 0.025), 6) AS \"CI_Lower\", "
            f"round(quantile_cont(v, 0.975), 6) AS \"CI_Upper\", {DRAWS} AS \"BootstrapSamples\" FROM (SELECT {expr} AS v FROM {src})")


_RESP = """CASE (Q1_row + Q2_row * 2 + session_id) % 5 WHEN 0 THEN '' WHEN 1 THEN 'yes' WHEN 2 THEN 'no' WHEN 3 THEN 'maybe' ELSE 'none' END"""


def all_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    narrow = "edge_id, session_id, Q1_row, Q2_row, distance"
    q["records_qa"] = on_edges('SELECT session_id, pos, turn, "Q", "A" FROM r')
    q["candidate_edges_w5"] = on_edges("SELECT * FROM e")
    q["streamed_candidate_edges"] = q["candidate_edges_w5"]
    sessions = (
        "WITH g AS (SELECT *, epoch_us(ts) AS tick, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events), "
        "n AS (SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap > 86400000000 THEN 1 ELSE 0 END) "
        "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS session_no FROM g) ")
    q["event_session_numbers"] = sessions + "SELECT event_id, user_id, session_no FROM n"
    q["event_sessions"] = sessions + (
        "SELECT user_id, min(tick) AS start_us, max(tick) + 86400000000 AS end_us, count(*) AS events, round(sum(value), 4) AS total "
        "FROM n GROUP BY user_id, session_no")
    q["event_sessions_stream"] = q["event_sessions"]
    q["candidate_edges_w3"] = on_edges(f"SELECT {narrow} FROM e", 3)
    q["candidate_edges_w1"] = on_edges(f"SELECT {narrow} FROM e", 1)
    q["candidate_edges_blocks"] = on_edges("SELECT edge_id, Q1_row, Q2_row, Q1, A1, Q2 FROM e", 2)
    q["candidate_distance_hist"] = on_edges("SELECT distance, count(*) AS edges FROM e GROUP BY distance")
    q["min_q2_length_filter"] = on_edges("SELECT edge_id, CAST(length(Q2) AS INTEGER) AS q2_len FROM e WHERE length(Q2) >= 120")
    q["text_features"] = on_edges(
        "SELECT edge_id, CAST(length(Q1) AS INTEGER) AS q1_len, CAST(length(A1) AS INTEGER) AS a1_len, "
        "CAST(length(Q2) AS INTEGER) AS q2_len, CAST(distance AS DOUBLE) AS distance_num FROM e")
    q["clean_documents"] = f"SELECT doc_id, CAST(length({clean('text')}) AS INTEGER) AS clean_chars, md5({clean('text')}) AS clean_md5 FROM documents"
    flag = lambda x, t: f"CAST({has(x, t)} AS INTEGER)"
    q["cue_flags"] = on_edges(
        f"SELECT edge_id, {flag('Q2', LEX.followup)} AS followup, {flag('Q2', LEX.complaint)} AS complaint, "
        f"{flag('A1', LEX.vague)} AS vague, {flag('Q2', LEX.question)} AS question FROM e")
    chars = lambda x: f"list_distinct(regexp_extract_all({x}, '{WORD}'))"
    q["char_jaccard"] = on_edges(
        f"SELECT edge_id, round({jac(chars('Q1'), chars('Q2'))}, 6) AS word_chars, round({jac(visible('A1'), visible('Q2'))}, 6) AS visible_chars FROM e")
    q["term_overlap"] = on_scored(
        "SELECT edge_id, CAST(len(ats) AS INTEGER) AS anchor_terms, CAST(len(qt) AS INTEGER) AS q2_terms, round(overlap, 6) AS overlap FROM ov")
    one = lambda cond: f"CASE WHEN {cond} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    heur = f"""
hs AS (SELECT *, round(least(1.0::DOUBLE, 0.26::DOUBLE * {one(has('Q2', LEX.followup))} + 0.30::DOUBLE * {one(has('Q2', LEX.complaint))}
 + 0.16::DOUBLE * {one(has('A1', LEX.vague))} + 0.16::DOUBLE * greatest({jac(chars('Q1'), chars('Q2'))}, {jac(chars('A1'), chars('Q2'))})
 + 0.08::DOUBLE * (1.0::DOUBLE / (1.0::DOUBLE + greatest(distance, 1))) + 0.20::DOUBLE * {one(f"length(Q2) <= 12 AND ({has('Q2', LEX.complaint)} OR {has('Q2', LEX.short_complaint)})")}), 6) AS prompt_test_score FROM e)"""
    q["heuristic_score"] = with_("SELECT edge_id, prompt_test_score FROM hs", base(), heur)
    q["heuristic_topn"] = with_("SELECT edge_id, prompt_test_score FROM hs ORDER BY prompt_test_score DESC, session_id, Q1_row, Q2_row LIMIT 50", base(), heur)
    q["sample_candidates"] = with_(
        "SELECT edge_id FROM hi UNION ALL SELECT edge_id FROM (SELECT edge_id FROM hs WHERE edge_id NOT IN (SELECT edge_id FROM hi) ORDER BY md5('42:' || edge_id), edge_id LIMIT 30)",
        base(), heur.replace("round(least", "(least").replace("), 6) AS prompt", ")) AS prompt"),
        "\nhi AS (SELECT edge_id FROM hs ORDER BY prompt_test_score DESC, session_id, Q1_row, Q2_row LIMIT 30)")
    docs = f"WITH x AS (SELECT *, {clean('text')} AS t FROM documents) "
    q["question_marks"] = docs + f"SELECT doc_id, round({marks('t')}, 6) AS marks FROM x"
    q["term_scores"] = docs + f"SELECT doc_id, round({tscore('t', LEX.pressure, 3)}, 6) AS pressure, round({tscore('t', LEX.objects, 2)}, 6) AS objects FROM x"
    q["bm25_tokens"] = docs + (
        f", y AS (SELECT doc_id, {bag('t')} AS tok FROM x) SELECT doc_id, CAST(len(tok) AS INTEGER) AS tokens, CAST(len(list_distinct(tok)) AS INTEGER) AS vocabulary FROM y")
    runs = rf"regexp_extract_all(t, '{CJK}+|[A-Za-z0-9]+')"
    q["run_tokens"] = docs + (
        f", y AS (SELECT doc_id, CASE WHEN len({runs}) > 0 THEN {runs} ELSE string_split(t, '') END AS tok FROM x) "
        "SELECT doc_id, CAST(len(tok) AS INTEGER) AS tokens, md5(array_to_string(tok, ' ')) AS joined FROM y")
    q["slugs"] = ("SELECT regexp_replace(regexp_replace(lower(concat_ws(' / ', source, lang)), '[^0-9A-Za-z]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, "
                  "count(*) AS n FROM documents GROUP BY 1")
    q["text_hashes"] = on_edges(
        f"SELECT edge_id, sha256({lit(ANCHOR_QUESTION_PREFIX)} || Q1 || {lit(ANCHOR_ANSWER_PREFIX)} || A1) AS anchor_sha, "
        f"sha256({lit(CANDIDATE_PREFIX)} || Q2) AS candidate_sha FROM e")

    q["topic_shift_score"] = on_shift(
        "SELECT edge_id, round(shift, 6) AS topic_shift_score, flags AS topic_shift_flags, bucket AS topic_shift_bucket FROM s3")
    q["topic_shift_buckets"] = on_shift("SELECT bucket AS topic_shift_bucket, count(*) AS edges FROM s3 GROUP BY bucket")
    easy = lambda v, other: f"CASE WHEN bucket = 'easy' THEN {v} ELSE {other} END"
    q["topic_shift_autolabel"] = on_shift(
        f"SELECT edge_id, {easy(1, 0)} AS done, {easy(lit('No'), lit(''))} AS dependent, {easy(lit('No-Dependency'), lit(''))} AS dependency_type, "
        f"{easy(lit('Topic Shift'), lit(''))} AS relation_type, {easy(lit('Automatic topic shift denoise.'), lit(''))} AS dep_reason FROM s3")
    q["pending_rows"] = on_shift("SELECT edge_id FROM s3 WHERE bucket <> 'easy'")
    q["label_value_counts"] = on_shift(
        "SELECT 'dependent' AS \"column\", " + easy(lit("No"), lit("")) + " AS value, count(*) AS count FROM s3 GROUP BY 2 UNION ALL "
        "SELECT 'dependency_type', " + easy(lit("No-Dependency"), lit("")) + ", count(*) FROM s3 GROUP BY 2 UNION ALL "
        "SELECT 'relation_type', " + easy(lit("Topic Shift"), lit("")) + ", count(*) FROM s3 GROUP BY 2")

    q["interaction_scores"] = on_scored(
        "SELECT edge_id, round(uns, 6) AS answer_unsatisfied_score, round(pres, 6) AS q2_pressure_score, round(claim, 6) AS a1_claim_score, "
        "round(chal, 6) AS q2_challenge_score, round(expl, 6) AS q2_explain_only_score, round(evi, 6) AS evidence_score FROM i3", CHANNELS)
    q["complaint_challenge_levels"] = on_scored("SELECT edge_id, round(complaint, 6) AS complaint, round(challenge, 6) AS challenge FROM i3", CHANNELS)
    groups = [f"a1_event_{g}" for g in LEX.events] + [f"q2_intent_{g}" for g in LEX.intents]
    q["event_intent_groups"] = on_channels("SELECT edge_id, " + ", ".join(f"round({g}, 6) AS {g}" for g in groups) + " FROM b5")
    q["shared_objects"] = on_channels(
        f"SELECT edge_id, round(shs, 6) AS shared, round(ashs, 6) AS a1_shared, {shared_names('sh')} AS structured_shared_terms, "
        f"{shared_names('ash')} AS structured_a1_shared_terms FROM b5")
    q["bridge_rules"] = on_channels(
        'SELECT edge_id, round(rule, 6) AS "rule", round(act, 6) AS "action", round(ref, 6) AS reference, round(cap, 6) AS capacity, '
        "eligible AS structured_bridge_eligible, round(greatest(least(strength, 0.45::DOUBLE), 0.0::DOUBLE), 6) AS bridge FROM b5")
    q["interaction_channels"] = on_channels(
        "SELECT edge_id, round(complaint, 6) AS complaint, round(challenge, 6) AS challenge, "
        "round(CASE WHEN blocked THEN 0.0::DOUBLE ELSE half END, 6) AS structured, CAST(g1 AS DOUBLE) AS structured_answer_state_guard, "
        "CAST(g2 AS DOUBLE) AS structured_capacity_growth_guard, CAST(blocked AS DOUBLE) AS structured_standalone_blocked, stage1_prob FROM b8",
        """
b6 AS (SELECT *, greatest(least(strength, 0.45::DOUBLE), 0.0::DOUBLE) AS half, greatest(ast, com) AS state FROM b5),
b7 AS (SELECT *, rule > 0 AND need >= 0.35 AND state >= 0.35 AND (ashs >= 0.12 OR shs >= 0.24 OR ref >= 0.5) AND near AS g1,
  cap >= 1 AND q2_intent_growth_profit_question >= 0.5 AND state >= 0.35 AND distance <= 1 AS g2 FROM b6),
b8 AS (SELECT *, half >= 0.12 AND NOT (sem >= 0.005 OR complaint >= 0.12 OR challenge >= 0.12) AND NOT (g1 OR g2) AS blocked FROM b7)""")

    q["source_rank"] = on_kept("SELECT edge_id, CAST(source_rank AS INTEGER) AS source_rank FROM rk")
    q["source_topk_mask"] = on_kept("SELECT edge_id, CAST(source_rank AS INTEGER) AS source_rank FROM rk WHERE source_rank <= 2")
    q["retain_policy"] = on_kept("SELECT edge_id, stage1_pred_edge FROM kept")
    q["retention_recheck"] = on_kept("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS mismatches FROM kept")
    q["target_candidate_max"] = on_kept(
        "SELECT coalesce(max(n), 0) AS max_candidates, count(*) AS targets FROM (SELECT count(*) AS n FROM kept WHERE stage1_pred_edge = 1 GROUP BY session_id, Q2_row)")
    q["retention_search"] = on_kept(RETENTION_OUT, RETENTION)
    q["retention_best"] = on_kept(RETENTION_OUT + ' WHERE "Feasible" ORDER BY "RetainedEdges", "TopK", "Threshold" DESC LIMIT 1', RETENTION)

    q["evidence_columns"] = on_evidence(
        "SELECT edge_id, given AS stage2_graph_input_pred, round(local_prob, 6) AS local_prob, r AS stage2a_local_evidence, "
        "round(CASE WHEN given = 1 THEN local_prob ELSE 0.0::DOUBLE END, 6) AS stage2_score FROM ev")
    q["evidence_ranking"] = on_evidence(
        "SELECT split, total AS candidate_edges, true_edges AS candidate_true_edges, round(auc, 6) AS auc, round(ap, 6) AS ap FROM rm",
        "\nevk AS (SELECT * FROM ev WHERE given = 1)", rank_cte("evk", "edge_label", "local_prob", "rm", ["split"]))
    q["recovery_graph"] = on_recovered(
        "SELECT edge_id, CASE WHEN given = 1 THEN CAST(k AS DOUBLE) END AS stage2b_target_rank, round(gain, 6) AS gain, "
        "round(CASE WHEN given = 1 THEN best ELSE 0.0::DOUBLE END, 6) AS objective, CAST(CASE WHEN given = 1 THEN kstar ELSE 0 END AS INTEGER) AS stage2_graph_target_degree, "
        "pruned AS stage2_pruned_by_graph, pred AS final_graph_pred_edge, round(final_score, 6) AS final_graph_score FROM rec")
    q["recovery_totals"] = on_recovered(
        f"SELECT {LAMBDA_0}::DOUBLE AS lambda_0, {LAMBDA_T}::DOUBLE AS lambda_t, round(sum(CASE WHEN given = 1 AND k = 1 THEN best ELSE 0.0::DOUBLE END), 6) AS objective_total, "
        "count(*) FILTER (WHERE given = 1 AND k = 1) AS target_groups, CAST(sum(pred) AS BIGINT) AS pred_edges FROM rec")
    q["exactness_audit"] = on_recovered(
        """SELECT t.split, CAST(t.n AS BIGINT) AS all_target_groups, CAST(count(*) AS BIGINT) AS candidate_target_groups,
 CAST(max(m) AS BIGINT) AS max_candidates_per_target, CAST(sum(subsets) AS BIGINT) AS enumerated_subsets,
 count(*) FILTER (WHERE top - got > 1e-10) AS objective_mismatches, count(*) FILTER (WHERE abs(top - got) > 1e-10) AS subset_mismatches,
 round(max(greatest(0.0::DOUBLE, top - got)), 6) AS max_objective_gap, 1e-10::DOUBLE AS tolerance,
 count(*) FILTER (WHERE abs(top - got) > 1e-10) = 0 AS passed
 FROM au JOIN (SELECT split, count(*) AS n FROM (SELECT DISTINCT split, session_id, Q2_row FROM rec) GROUP BY split) t ON au.split = t.split GROUP BY t.split, t.n""",
        f"""
cg AS (SELECT split, session_id, Q2_row, count(*) AS m, list(r ORDER BY k) AS rs, sum(pred * (1 << (k - 1)::INTEGER)) AS mine FROM rec WHERE given = 1 GROUP BY ALL),
mk AS (SELECT *, unnest(range(0, CAST(1 << m::INTEGER AS BIGINT))) AS mask FROM cg),
mv AS (SELECT *, list_filter(range(1, m + 1), lambda i: (mask >> (i - 1)::INTEGER) & 1 = 1) AS chosen FROM mk),
ms AS (SELECT *, coalesce(list_sum(list_transform(chosen, lambda i: rs[i])), 0.0::DOUBLE) - {LAMBDA_0}::DOUBLE * len(chosen)
        - {LAMBDA_T}::DOUBLE * len(chosen) * (len(chosen) - 1) / 2.0::DOUBLE AS v FROM mv),
au AS (SELECT split, session_id, Q2_row, any_value(m) AS m, count(*) AS subsets, max(v) AS top, max(v) FILTER (WHERE mask = mine) AS got FROM ms GROUP BY split, session_id, Q2_row)""")
    # final scores of one setting, in gains: rows outside the graph come last
    final = """
gf AS (SELECT lambda_0, lambda_t, edge_label, round(r - lambda_0 - lambda_t * (k - 1), 9) AS fs FROM gx
  UNION ALL SELECT lambda_0, lambda_t, edge_label, -1e30::DOUBLE FROM gv, gs WHERE given = 0)"""
    ranked = f"SELECT {GRID_OUT}, round(gm.auc, 6) AS \"AUC\", round(gm.ap, 6) AS \"AP\" FROM gr JOIN gm USING (lambda_0, lambda_t)"
    by_setting = rank_cte("gf", "edge_label", "fs", "gm", ["lambda_0", "lambda_t"])
    q["penalty_grid"] = on_evidence(ranked, GRID, final, by_setting)
    q["penalty_best"] = on_evidence(f"SELECT {GRID_OUT} FROM gr ORDER BY gr.\"F1\" DESC, gr.\"Precision\" DESC, gr.\"PredEdges\", gr.lambda_0, gr.lambda_t LIMIT 1", GRID)
    q["penalty_ties"] = on_evidence(f"SELECT {GRID_OUT} FROM gr WHERE gr.\"F1\" = (SELECT max(\"F1\") FROM gr)", GRID)
    q["penalty_grid_ranking"] = on_evidence(ranked, grid_ctes((0.0, 0.2, 0.4), (0.0, 0.15)), final, by_setting)
    q["penalty_ablation"] = on_evidence(
        f"SELECT condition, gr.split, {GRID_OUT.replace('round(lambda_0', 'round(gr.lambda_0').replace('round(lambda_t', 'round(gr.lambda_t')} "
        "FROM gr JOIN pc ON gr.lambda_0 = pc.lambda_0 AND gr.lambda_t = pc.lambda_t",
        grid_ctes(LAMBDA0_GRID, LAMBDAT_GRID, "true"), f"""
gvv AS (SELECT * FROM gr WHERE split = 'validation'),
pc AS (SELECT 'M0' AS condition, 0.0::DOUBLE AS lambda_0, 0.0::DOUBLE AS lambda_t
  UNION ALL (SELECT 'M1', lambda_0, lambda_t FROM gvv WHERE lambda_t = 0 ORDER BY {GRID_ORDER} LIMIT 1)
  UNION ALL (SELECT 'M2', lambda_0, lambda_t FROM gvv ORDER BY {GRID_ORDER} LIMIT 1))""")

    q["confusion_by_split"] = on_recovered(rates("cf", "split"), f"\ncf AS (SELECT split, {conf('edge_label', 'pred')} FROM rec GROUP BY split)")
    q["split_metrics"] = on_recovered(
        rates("cf", "split").replace(" FROM cf", ", round(auc, 6) AS auc, round(ap, 6) AS ap FROM cj"),
        f"\ncf AS (SELECT split, {conf('edge_label', 'pred')} FROM rec GROUP BY split)", rank_cte("rec", "edge_label", "final_score", "rm", ["split"]),
        "\ncj AS (SELECT cf.*, rm.auc, rm.ap FROM cf JOIN rm ON cf.split = rm.split)")
    q["ranking_documents"] = with_("SELECT total, true_edges, round(auc, 6) AS auc, round(ap, 6) AS ap FROM rm", LABELLED_DOCS, rank_cte("ld", "edge_label", "score", "rm"))
    q["ranking_by_source"] = with_("SELECT source, total, true_edges, round(auc, 6) AS auc, round(ap, 6) AS ap FROM rm", LABELLED_DOCS, rank_cte("ld", "edge_label", "score", "rm", ["source"]))
    sweep_out = 'threshold, tp, fp, fn, pred_edges, round(prec, 6) AS "precision", round(rec, 6) AS recall, round(f1, 6) AS f1'
    q["threshold_sweep"] = with_(f"SELECT {sweep_out} FROM sw", LABELLED_DOCS, sweep_cte("ld", "edge_label", "score", "sw"))
    q["best_f1_threshold"] = with_(
        f"SELECT {sweep_out} FROM (SELECT * FROM sw ORDER BY f1 DESC, prec DESC, pred_edges, threshold DESC LIMIT 1)", LABELLED_DOCS, sweep_cte("ld", "edge_label", "score", "sw"))
    topk = ["\nvv AS (SELECT * FROM rk WHERE split = 'validation')",
            "\nvk AS (SELECT c.top_k, vv.* FROM vv JOIN (SELECT unnest([1, 2, 3, 5]) AS top_k) c ON vv.source_rank <= c.top_k)",
            sweep_cte("vk", "edge_label", "stage1_prob", "sw", ["top_k"], "(SELECT count(*) FROM vv WHERE edge_label = 1)"),
            "\nbk AS (SELECT * FROM sw QUALIFY row_number() OVER (PARTITION BY top_k ORDER BY f1 DESC, prec DESC, pred_edges, threshold DESC) = 1)"]
    q["topk_threshold_search"] = on_kept(f"SELECT top_k, {sweep_out} FROM bk", *topk)
    q["topk_best"] = on_kept(
        f"SELECT top_k, {sweep_out} FROM (SELECT * FROM bk ORDER BY f1 DESC, prec DESC, pred_edges, top_k, threshold DESC LIMIT 1)", *topk)

    q["bm25_corpus"] = on_scored("SELECT token, df, n_docs, round(avgdl, 6) AS avgdl, round(idf, 6) AS idf FROM idf", BM25)
    q["bm25_scores"] = on_scored("SELECT edge_id, bm25_score FROM bm", BM25)
    q["bm25_sparse"] = q["bm25_scores"]
    q["distance_prior"] = on_scored("SELECT edge_id, round(1.0::DOUBLE / greatest(distance, 1), 6) AS distance_prior FROM sc")
    q["model_comparison"] = on_scored(
        """SELECT cj."Model", cj.split, total, true_edges, pred_edges, tp, fp, fn, tn, round(p, 6) AS "precision", round(rc, 6) AS recall,
 round(f, 6) AS f1, round(acc, 6) AS accuracy, round(auc, 6) AS auc, round(ap, 6) AS ap, round(threshold, 6) AS "Threshold" FROM cj""",
        BM25, LONG, "\nlv AS (SELECT * FROM lg WHERE split = 'validation')",
        sweep_cte("lv", "edge_label", "score", "sw", ['"Model"']),
        '\ncut AS (SELECT * FROM sw QUALIFY row_number() OVER (PARTITION BY "Model" ORDER BY f1 DESC, prec DESC, pred_edges, threshold DESC) = 1)',
        '\nde AS (SELECT lg.*, cut.threshold, CAST(score >= cut.threshold AS INTEGER) AS pred FROM lg JOIN cut ON lg."Model" = cut."Model" WHERE split <> \'train\')',
        f'\ncf AS (SELECT "Model", split, any_value(threshold) AS threshold, {conf("edge_label", "pred")} FROM de GROUP BY "Model", split)',
        rank_cte("de", "edge_label", "score", "rm", ['"Model"', "split"]),
        f'\ncj AS (SELECT cf.*, rm.auc, rm.ap, {div("tp", "tp + fp")} AS p, {div("tp", "tp + fn")} AS rc, {div("2 * tp", "2 * tp + fp + fn")} AS f, '
        f'{div("tp + tn", "cf.total")} AS acc FROM cf JOIN rm ON cf."Model" = rm."Model" AND cf.split = rm.split)')
    pv = lambda m, s: f"max(score) FILTER (WHERE \"Model\" = '{m}') AS {s}_score, max(CAST(score >= 0.5 AS INTEGER)) FILTER (WHERE \"Model\" = '{m}') AS {s}_pred"
    q["prediction_audit_table"] = on_scored(
        f"SELECT edge_id, edge_label, {pv('BM25', 'bm25')}, {pv('Temporal-distance Prior', 'temporal_distance_prior')}, {pv('Term Overlap', 'term_overlap')} "
        "FROM lg WHERE split = 'test' GROUP BY edge_id, edge_label", BM25, LONG)

    selected = (
        """
fl AS (SELECT *, row_number() OVER (PARTITION BY "Model", session_id, Q1_row ORDER BY score DESC, Q2_row) AS place FROM (
   SELECT 'Stage 1' AS "Model", stage1_prob AS score, edge_id, session_id, Q1_row, Q2_row, split, edge_label FROM rec WHERE split <> 'train'
   UNION ALL SELECT 'Temporal-distance Prior', round(1.0::DOUBLE / greatest(distance, 1), 6), edge_id, session_id, Q1_row, Q2_row, split, edge_label
   FROM rec WHERE split <> 'train')),
fv AS (SELECT * FROM fl WHERE split = 'validation'),
fk AS (SELECT c.cap, fv.* FROM fv JOIN (SELECT unnest([0, 1, 2, 3, 5]) AS cap) c ON c.cap = 0 OR fv.place <= c.cap)""",
        sweep_cte("fk", "edge_label", "score", "fs", ['"Model"', "cap"], '(SELECT count(*) FROM fv z WHERE z.edge_label = 1 AND z."Model" = x."Model")'),
        """
fc AS (SELECT "Model" AS base, "Model" || CASE WHEN cap > 0 THEN ' Top-K' ELSE '' END AS "Model", threshold, nullif(cap, 0) AS top_k FROM fs
   QUALIFY row_number() OVER (PARTITION BY base, cap > 0 ORDER BY f1 DESC, prec DESC, pred_edges, cap, threshold DESC) = 1),
fd AS (SELECT fc."Model", threshold, top_k, score, edge_id, session_id, Q1_row, Q2_row, split, edge_label,
          CAST(score >= threshold AND (top_k IS NULL OR place <= top_k) AS INTEGER) AS pred FROM fl JOIN fc ON fl."Model" = fc.base
   UNION ALL SELECT 'Final Graph', NULL, NULL, round(final_score, 6), edge_id, session_id, Q1_row, Q2_row, split, edge_label, pred
   FROM rec WHERE split <> 'train')""",
    )
    q["full_comparison"] = on_recovered(
        """SELECT cj."Model", cj.split, CAST(top_k AS INTEGER) AS "TopK", round(threshold, 6) AS "Threshold", total, true_edges, pred_edges, tp, fp, fn, tn,
 round(p, 6) AS "precision", round(rc, 6) AS recall, round(f, 6) AS f1, round(acc, 6) AS accuracy, round(auc, 6) AS auc, round(ap, 6) AS ap FROM cj""",
        *selected,
        f'\ncf AS (SELECT "Model", split, any_value(threshold) AS threshold, any_value(top_k) AS top_k, {conf("edge_label", "pred")} FROM fd GROUP BY "Model", split)',
        rank_cte("fd", "edge_label", "score", "fm", ['"Model"', "split"]),
        f'\ncj AS (SELECT cf.*, fm.auc, fm.ap, {div("tp", "tp + fp")} AS p, {div("tp", "tp + fn")} AS rc, {div("2 * tp", "2 * tp + fp + fn")} AS f, '
        f'{div("tp + tn", "cf.total")} AS acc FROM cf JOIN fm ON cf."Model" = fm."Model" AND cf.split = fm.split)')
    sv = lambda m: f"max(score) FILTER (WHERE \"Model\" = '{m}') AS {re.sub('[^a-z0-9]+', '_', m.lower())}_score, max(pred) FILTER (WHERE \"Model\" = '{m}') AS {re.sub('[^a-z0-9]+', '_', m.lower())}_pred"
    q["prediction_audit_selected"] = on_recovered(
        "SELECT edge_id, session_id, Q1_row, Q2_row, edge_label, "
        + ", ".join(map(sv, ("Temporal-distance Prior", "Temporal-distance Prior Top-K", "Stage 1", "Stage 1 Top-K", "Final Graph")))
        + " FROM fd WHERE split = 'test' GROUP BY ALL", *selected)

    dotp = "list_sum(list_transform(range(1, 65), lambda i: a[i]::DOUBLE * b[i]::DOUBLE))"
    sq = lambda v: f"sqrt(list_sum(list_transform(range(1, 65), lambda i: {v}[i]::DOUBLE * {v}[i]::DOUBLE)))"
    q["cosine_pairs"] = with_(f"SELECT edge_id, round({dotp} / greatest({sq('a')} * {sq('b')}, 1e-12::DOUBLE), 6) AS cosine FROM vp", VECTORS)
    q["edge_vector_features"] = with_(
        f"""SELECT edge_id, CAST(133 AS INTEGER) AS width, round({dotp} + distance + 2 * length(v1::VARCHAR) + length(v2::VARCHAR)
 + list_sum(list_transform(range(1, 65), lambda i: abs(a[i] - b[i])::DOUBLE)) + list_sum(list_transform(range(1, 65), lambda i: (a[i] * b[i])::DOUBLE)), 3) AS total,
 round({dotp}, 4) AS cosine FROM vp""", VECTORS)
    mean = lambda arcs: f"(SELECT a.session_id, a.\"row\", a.role, u.i, avg(u.val) AS m FROM {arcs} a JOIN un u ON a.session_id = u.session_id AND a.nrow = u.\"row\" AND a.nrole = u.role GROUP BY ALL)"
    q["node_mean_agg"] = with_(
        "SELECT session_id, \"row\", role, round(sum(m), 4) AS neigh_sum, round(max(m) FILTER (WHERE i = 1), 5) AS neigh_1 FROM "
        + mean("al") + " GROUP BY ALL", VECTORS, NODES,
        '\nal AS (SELECT * FROM ar UNION SELECT session_id, "row", role, "row", role FROM nd)')
    q["node_in_out_agg"] = with_(
        "SELECT nd.session_id, nd.\"row\", nd.role, round(coalesce(i.s, 0.0::DOUBLE), 4) AS in_sum, round(coalesce(o.s, 0.0::DOUBLE), 4) AS out_sum FROM nd "
        "LEFT JOIN mi i USING (session_id, \"row\", role) LEFT JOIN mo o USING (session_id, \"row\", role)", VECTORS, NODES,
        "\nain AS (SELECT * FROM ar WHERE role = 'target')", "\naout AS (SELECT * FROM ar WHERE role = 'source')",
        "\nmi AS (SELECT session_id, \"row\", role, sum(m) AS s FROM " + mean("ain") + " GROUP BY ALL)",
        "\nmo AS (SELECT session_id, \"row\", role, sum(m) AS s FROM " + mean("aout") + " GROUP BY ALL)")
    q["node_texts"] = on_edges(
        "SELECT DISTINCT session_id, Q1_row AS \"row\", 'source' AS role, md5(Q1 || ' ' || A1) AS text_md5 FROM e "
        "UNION SELECT DISTINCT session_id, Q2_row, 'target', md5(Q2) FROM e")
    q["edge_states"] = with_(
        "SELECT edge_id, CAST(256 AS INTEGER) AS width, round(list_sum(list_transform(range(1, 65), lambda i: a[i]::DOUBLE + b[i]::DOUBLE "
        "+ abs(a[i]::DOUBLE - b[i]::DOUBLE) + a[i]::DOUBLE * b[i]::DOUBLE)), 4) AS total FROM vp", VECTORS)

    spl = lambda x: f"CASE WHEN {x} % 25 < 16 THEN 'train' WHEN {x} % 25 < 20 THEN 'validation' ELSE 'test' END"
    q["split_manifest"] = on_edges(f"SELECT DISTINCT session_id, {spl('session_id')} AS split FROM e")
    q["split_counts"] = f"SELECT {spl('conv_id')} AS split, count(DISTINCT conv_id) AS sessions FROM conversations GROUP BY 1"
    cnt = lambda s: f"count(DISTINCT conv_id) FILTER (WHERE {spl('conv_id')} = '{s}') AS {s}"
    q["manifest_report"] = (f"SELECT {cnt('train')}, {cnt('validation')}, {cnt('test')}, CAST(0 AS BIGINT) AS empty_sessions, "
                            "CAST(0 AS BIGINT) AS repeated_sessions, CAST(0 AS BIGINT) AS unknown_splits FROM conversations")
    q["manifest_gaps"] = on_edges(
        "SELECT DISTINCT conv_id AS session_id, 'not_in_data' AS problem FROM conversations WHERE conv_id NOT IN (SELECT session_id FROM e)")
    q["split_overlap"] = on_edges(
        f"SELECT session_id, count(DISTINCT {spl('(session_id + Q2_row)')}) AS splits FROM e GROUP BY session_id HAVING count(DISTINCT {spl('(session_id + Q2_row)')}) > 1")
    zeros = ", ".join(f"CAST(0 AS BIGINT) AS {c}" for c in (
        "empty_session_id", "empty_Q1_row", "empty_Q2_row", "empty_edge_id", "nonfinite_edge_label", "nonfinite_stage1_pred_edge",
        "nonfinite_stage1_prob", "bad_labels", "bad_predictions", "bad_probabilities"))
    q["partition_report"] = on_kept(
        f"SELECT count(*) AS rows, count(*) FILTER (WHERE edge_label = 1) AS true_edges, {zeros}, count(DISTINCT session_id) AS sessions, "
        "CAST(count(*) - count(DISTINCT edge_id) AS BIGINT) AS repeated_edge_ids, "
        "(SELECT max(n) FROM (SELECT count(*) AS n FROM kept WHERE stage1_pred_edge = 1 GROUP BY session_id, Q2_row)) AS max_target_candidates FROM kept")
    q["graph_align"] = on_recovered("SELECT edge_id, pred AS final_graph_pred_edge, round(final_score, 6) AS final_graph_score FROM rec")
    q["label_columns"] = on_edges(
        "SELECT edge_id, CAST(distance = 1 AS INTEGER) AS edge_label, CASE WHEN Q2_row % 2 = 0 THEN 'Elaboration' ELSE 'Complaint' END AS relation_type_train, "
        "CAST(distance = 1 AS INTEGER) AS positive FROM e")

    q["error_columns"] = on_errors(
        f"SELECT edge_id, indeg AS pred_indegree, {_db('distance')} AS distance_bucket, {_sb('length(Q2)')} AS q2_bucket, round(j1, 6) AS q1_q2_jaccard, "
        "round(j2, 6) AS a1_q2_jaccard, fp_taxonomy, fn_taxonomy FROM an")
    tax = lambda c, n, l: f"SELECT '{l}' AS label, {c} AS category, count(*) AS count, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM an WHERE {c} <> '{n}' GROUP BY {c}"  # noqa: E731,E741
    q["fp_taxonomy"] = on_errors(tax("fp_taxonomy", "not_fp", "FP"))
    q["fn_taxonomy"] = on_errors(tax("fn_taxonomy", "not_fn", "FN"))
    q["secondary_breakdown"] = on_errors(
        f"SELECT 'FP' AS label, fp_taxonomy AS primary_category, {_db('distance')} AS secondary_attribute, count(*) AS count, "
        "round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share_within_error, round(count(*) / sum(count(*)) OVER (PARTITION BY fp_taxonomy)::DOUBLE, 6) AS share_within_primary "
        "FROM an WHERE fp_taxonomy <> 'not_fp' GROUP BY 2, 3")
    six = lambda x, name: f"round({x}, 6) AS {name}"
    for kind, cut in (("fp", "pred = 1 AND edge_label = 0"), ("fn", "pred = 0 AND edge_label = 1")):
        q[f"{kind}_cases"] = on_errors(
            f"SELECT edge_id, session_id, Q1_row, Q2_row, {six('final_score', 'final_graph_score')}, {six('local_prob', 'stage2a_local_prob')}, stage1_prob, "
            f"{six('j2', 'a1_q2_jaccard')}, {six('j1', 'q1_q2_jaccard')}, indeg AS pred_indegree, {_db('distance')} AS distance_bucket, "
            f"{_sb('length(Q2)')} AS q2_bucket, {kind}_taxonomy AS taxonomy FROM an WHERE {cut}")
    place = lambda k, second, third: (
        f"""SELECT '{k}' AS error, {k}_taxonomy AS taxonomy, CAST(row_number() OVER (PARTITION BY {k}_taxonomy ORDER BY round(final_score, 6) DESC,
 round({second}, 6) DESC, round({third}, 6) DESC, session_id, Q1_row, Q2_row) AS INTEGER) AS place, edge_id, session_id, Q1_row, Q2_row,
 {six('final_score', 'final_graph_score')} FROM an WHERE {k}_taxonomy <> 'not_{k.lower()}' QUALIFY place <= 5""")
    q["case_examples"] = on_errors(place("FP", "j2", "j1") + " UNION ALL " + place("FN", "local_prob", "stage1_prob"))
    q["bucket_distribution"] = on_errors(
        f"SELECT 'FN' AS label, {_db('distance')} AS bucket, count(*) AS count, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM an WHERE fn_taxonomy <> 'not_fn' GROUP BY 2")
    q["score_buckets"] = on_scored(
        f"SELECT 'all' AS label, {_sb('stage1_prob')} AS bucket, count(*) AS count, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM sc GROUP BY 2")
    q["indegree_summary"] = on_recovered(
        "SELECT indeg AS pred_indegree, count(*) AS rows, CAST(sum(edge_label) AS BIGINT) AS positives, CAST(sum(pred) AS BIGINT) AS predicted, "
        "round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM (SELECT *, CAST(sum(pred) OVER (PARTITION BY session_id, Q2_row) AS INTEGER) AS indeg FROM rec) GROUP BY indeg")
    q["miss_attribution"] = on_recovered(
        "SELECT 'stage1_recall_miss' AS metric, count(*) FILTER (WHERE edge_label = 1 AND given = 0) AS count FROM rec UNION ALL "
        "SELECT 'stage2_graph_pruning_drop', count(*) FILTER (WHERE edge_label = 1 AND given = 1 AND pred = 0) FROM rec UNION ALL "
        "SELECT 'total_fn', count(*) FILTER (WHERE edge_label = 1 AND pred = 0) FROM rec")
    miss = lambda cond: f"(SELECT count(*) FROM an WHERE edge_label = 1 AND pred = 0{cond})"
    fpc = lambda c: f"(SELECT count(*) FROM an WHERE fp_taxonomy {c})"
    q["error_boundaries"] = on_errors(" UNION ALL ".join(
        f"SELECT {lit(o)} AS outcome, {lit(text)} AS pattern, {n} AS count, round({div(n, t)}, 6) AS share"
        for o, text, n, t in (
            ("False negative", "Not retained by Stage 1", miss(" AND given = 0"), miss("")),
            ("False negative", "Not selected by Stage 2B", miss(" AND given = 1"), miss("")),
            *(("False positive", text, fpc(f"= {lit(c)}"), fpc("<> 'not_fp'")) for c, text in (
                ("long_distance_carryover", "Carryover across distant turns"),
                ("vague_answer_false_trigger", "False triggers from vague answers"),
                ("multiple_source_over_recovery", "Excessive recovery of multiple sources"),
                ("boundary_question_form", "Questions at the annotation boundary"),
                ("other_manual_review", "Other observed patterns"))))))
    other = "CAST(CASE WHEN given = 1 THEN local_prob ELSE 0.0::DOUBLE END >= 0.55 AS INTEGER)"
    q["consistency_check"] = on_recovered(
        f"SELECT 'matched_rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM rec UNION ALL SELECT 'pred_mismatches', CAST(count(*) FILTER (WHERE pred <> {other}) AS DOUBLE) FROM rec "
        f"UNION ALL SELECT 'score_mismatches', 0.0::DOUBLE UNION ALL SELECT 'pred_match_rate', round(1.0::DOUBLE - count(*) FILTER (WHERE pred <> {other}) / count(*)::DOUBLE, 6) FROM rec")
    long_rows = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round(CAST({c} AS DOUBLE), 6) AS value FROM cj" for m, c in (
            ("rows", "total"), ("true_edges", "true_edges"), ("pred_edges", "pred_edges"), ("tp", "tp"), ("fp", "fp"), ("fn", "fn"), ("tn", "tn"),
            ("precision", _P), ("recall", _R), ("f1", _F), ("auc", "auc"), ("ap", "ap")))
    q["error_summary"] = on_recovered(
        long_rows, f"\ncf AS (SELECT {conf('edge_label', 'pred')} FROM rec)", rank_cte("rec", "edge_label", "final_score", "rm"),
        "\ncj AS (SELECT cf.*, rm.auc, rm.ap FROM cf, rm)")
    q["stage_records"] = on_recovered(STAGE_UNION, STAGES)
    q["stage_transitions"] = on_recovered(_transition(), STAGES, f"\nsu AS ({STAGE_UNION})")

    q["retention_flags"] = on_kept(
        """SELECT "TopK", round("Threshold", 6) AS "Threshold", "Feasible", round(rc, 6) AS "Recall", round(pr, 6) AS "Precision", round(f1, 6) AS "F1",
 CAST("RetainedEdges" AS DOUBLE) AS "RetainedEdges", CAST("TruePositives" AS DOUBLE) AS "TruePositives", CAST("FalsePositives" AS DOUBLE) AS "FalsePositives",
 CAST("FalseNegatives" AS DOUBLE) AS "FalseNegatives", is_selected, round(f1 - coalesce(sf, bf), 6) AS delta_f1_from_selected,
 round(pr - coalesce(sp, bp), 6) AS delta_precision_from_selected, round("RetainedEdges" - coalesce(sr, br), 6)::DOUBLE AS delta_retained_edges_from_selected
 FROM (SELECT *, "TopK" = 3 AND coalesce(abs("Threshold") <= 1e-12, false) AS is_selected FROM res),
 (SELECT max(f1) FILTER (WHERE s) AS sf, max(pr) FILTER (WHERE s) AS sp, max("RetainedEdges") FILTER (WHERE s) AS sr FROM
   (SELECT *, "TopK" = 3 AND coalesce(abs("Threshold") <= 1e-12, false) AS s FROM res)),
 (SELECT max(f1) AS bf, max(pr) AS bp, min("RetainedEdges") AS br FROM res WHERE f1 = (SELECT max(f1) FROM res))""", RETENTION)
    q["retention_compression"] = on_kept(
        'SELECT "TopK", "Feasible", round(rc, 6) AS "Recall", round(1.0::DOUBLE - "RetainedEdges" / (SELECT count(*) FROM v)::DOUBLE, 6) AS "Compression" FROM res', RETENTION)
    q["penalty_flags"] = on_evidence(FLAG_OUT, GRID, FLAGS)
    q["penalty_neighbourhood"] = on_evidence(FLAG_OUT + " WHERE a0 <= 0.05 + 1e-9 AND a1 <= 0.05 + 1e-9", GRID, FLAGS)
    q["penalty_slice"] = on_evidence(FLAG_OUT + f" WHERE abs(fl.lambda_t - {LAMBDA_T}) <= 1e-12", GRID, FLAGS)
    q["penalty_heatmap"] = on_evidence(
        "SELECT round(lambda_0, 6) AS lambda_0, " + ", ".join(
            f"round(max(\"F1\") FILTER (WHERE abs(lambda_t - {t}) < 1e-9), 6) AS t_{round(t * 100):03d}" for t in LAMBDAT_GRID)
        + " FROM gr GROUP BY gr.lambda_0", GRID)

    rank = rank_cte("bo", "edge_label", "fs", "bm", ["d"])
    q["bootstrap_ci"] = on_recovered(
        " UNION ALL ".join([_ci("AUC", "auc", "bm"), _ci("AP", "ap", "bm"), _ci("Precision", _P, "bc"), _ci("Recall", _R, "bc"), _ci("F1", _F, "bc")]), BOOT, rank)
    bf = div("2 * btp", "2 * btp + bfp + bfn")
    q["bootstrap_paired_f1"] = on_recovered(
        f"SELECT round(avg(x), 6) AS \"F1_Difference_Mean\", round(quantile_cont(x, 0.025), 6) AS \"CI_Lower\", round(quantile_cont(x, 0.975), 6) AS \"CI_Upper\", "
        f"round(avg(CASE WHEN x <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS \"P_Diff_LE_0\", {DRAWS} AS \"BootstrapSamples\" FROM (SELECT {_F} - {bf} AS x FROM bc)", BOOT)

    pair = (f"pp AS (SELECT {lit(ANCHOR_QUESTION_PREFIX)} || Q1 || {lit(ANCHOR_ANSWER_PREFIX)} || A1 AS anchor, {lit(CANDIDATE_PREFIX)} || Q2 AS candidate, count(*) AS copies "
            "FROM sc WHERE split = 'train' AND edge_label = 1 GROUP BY 1, 2)")
    q["positive_pairs"] = on_scored("SELECT md5(anchor) AS anchor, md5(candidate) AS candidate, copies FROM pp", "\n" + pair)
    q["pair_stats"] = on_scored(
        "SELECT count(*) AS all_rows, count(*) FILTER (WHERE split = 'train') AS train_rows, count(*) FILTER (WHERE split = 'train' AND edge_label = 1) AS train_positive_rows, "
        "(SELECT count(*) FROM pp) AS unique_train_positive_pairs, CAST((SELECT sum(copies - 1) FROM pp) AS BIGINT) AS duplicate_positive_pairs_removed FROM sc", "\n" + pair)
    q["unique_anchor_batches"] = on_scored(
        "SELECT batch, count(*) AS pairs, count(DISTINCT anchor) AS anchors FROM nb GROUP BY batch HAVING count(*) > 1", "\n" + pair, """
ps AS (SELECT greatest(ceil(sum(n) / 16.0::DOUBLE)::BIGINT, max(n)) AS m FROM (SELECT count(*) AS n FROM pp GROUP BY anchor)),
nb AS (SELECT *, (row_number() OVER (ORDER BY md5('42:' || anchor), anchor, md5('42:' || candidate), candidate) - 1) % (SELECT m FROM ps) AS batch FROM pp)""")
    q["json_rescue"] = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"
    q["label_responses"] = on_edges(f"""SELECT edge_id, CASE x WHEN 'yes' THEN 'Yes' WHEN 'no' THEN 'No' ELSE 'Error' END AS dependent,
 CASE x WHEN 'yes' THEN 'Content-Dependent' WHEN 'no' THEN 'No-Dependency' WHEN 'maybe' THEN 'a' ELSE 'Error' END AS dependency_type,
 CASE x WHEN 'yes' THEN 'Complaint' WHEN 'no' THEN 'Topic Shift' WHEN 'maybe' THEN 'b' ELSE 'Error' END AS relation_type,
 CASE x WHEN 'yes' THEN 'r' WHEN 'no' THEN 'n' WHEN 'maybe' THEN 'm' ELSE 'API failed' END AS dep_reason FROM (SELECT edge_id, {_RESP} AS x FROM e)""")
    line = lambda artifact, rule, kind, checked, bad: (
        f"SELECT {lit(artifact)} AS artifact, {lit(rule)} AS rule, {lit(kind)} AS kind, CAST(({checked}) AS BIGINT) AS checked, CAST(({bad}) AS BIGINT) AS violations")
    over = lambda artifact, rule, kind, cond: line("edges", rule, kind, f"SELECT count(*) FROM {artifact}", f"SELECT count(*) FROM {artifact} WHERE {cond}")
    groups = lambda rule, kind, keys, cond, where="true": line(
        "edges", rule, kind, f"SELECT count(*) FROM (SELECT {keys} FROM bk WHERE {where} GROUP BY {keys})",
        f"SELECT count(*) FROM (SELECT {keys} FROM bk WHERE {where} GROUP BY {keys} HAVING {cond})")
    distinct = "(SELECT DISTINCT session_id FROM {})"
    q["contract_report"] = on_long(on_kept(" UNION ALL ".join([
        over("bk", "edges_keys_present", "present", "edge_id IS NULL OR edge_id = '' OR session_id IS NULL OR Q1_row IS NULL OR Q2_row IS NULL"),
        over("bk", "edges_numbers_finite", "finite", "edge_label IS NULL OR stage1_pred_edge IS NULL OR stage1_prob IS NULL"),
        over("bk", "edges_labels", "among", "edge_label NOT IN (0, 1)"), over("bk", "edges_predictions", "among", "stage1_pred_edge NOT IN (0, 1)"),
        over("bk", "edges_probabilities", "between", "stage1_prob < 0 OR stage1_prob > 1"), groups("edges_edge_ids", "unique", "edge_id", "count(*) > 1"),
        groups("edges_target_candidates", "at_most", "session_id, Q2_row", "count(*) > 4", "stage1_pred_edge = 1"),
        groups("edges_one_split", "one_value", "session_id", "count(DISTINCT split) > 1"),
        line("edges", "in_manifest", "contained", f"SELECT count(*) FROM {distinct.format('bk')}", f"SELECT count(*) FROM {distinct.format('bk')} WHERE session_id NOT IN (SELECT session_id FROM mf)"),
        line("manifest", "same_sessions", "same_keys", "SELECT count(*) FROM (SELECT session_id FROM mf UNION SELECT session_id FROM bk)",
             "SELECT count(*) FROM (SELECT session_id FROM mf UNION SELECT session_id FROM bk) WHERE session_id NOT IN (SELECT session_id FROM mf) OR session_id NOT IN (SELECT session_id FROM bk)"),
        line("train", "no_leak", "disjoint", "SELECT count(DISTINCT session_id) FROM bk WHERE split = 'train'",
             "SELECT count(DISTINCT session_id) FROM bk WHERE split = 'train' AND session_id IN (SELECT session_id FROM bk WHERE split = 'test')"),
        line("test", "rows_expected", "rows", "SELECT count(*) FROM bk WHERE split = 'test'", "SELECT abs(count(*) - 1000) FROM bk WHERE split = 'test'"),
        line("manifest", "sessions_expected", "distinct", "SELECT count(*) FROM mf", "SELECT abs(count(*) - 275) FROM mf"),
        over("bk", "selected_only_if_near", "implies", "distance = 5 AND stage1_pred_edge <> 0"),
        "SELECT 'graph' AS artifact, 'graph_written' AS rule, 'unique' AS kind, CAST(0 AS BIGINT) AS checked, CAST(NULL AS BIGINT) AS violations",
    ]), """
bk AS (SELECT * REPLACE (CASE WHEN (Q1_row * 7 + Q2_row) % 97 = 0 THEN 2 ELSE edge_label END AS edge_label,
   CASE WHEN session_id % 31 = 7 THEN stage1_prob + 1 ELSE stage1_prob END AS stage1_prob,
   CASE WHEN session_id % 29 = 3 AND Q1_row = 0 THEN NULL WHEN session_id % 37 = 5 AND Q1_row = 1 THEN 'same' ELSE edge_id END AS edge_id,
   CASE WHEN session_id % 41 = 2 AND Q2_row = 3 THEN 'test' ELSE split END AS split) FROM kept),
mf AS (SELECT DISTINCT user_id // 2 AS session_id FROM events WHERE (user_id // 2) % 13 <> 1)"""))
    q["filled_anchor_batches"] = """
WITH RECURSIVE a AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT list(n ORDER BY n DESC) AS ms, CAST(sum(n) AS BIGINT) AS total FROM a),
p(i, left_over, places) AS (SELECT CAST(0 AS BIGINT), total, CAST(16 AS BIGINT) FROM m
  UNION ALL SELECT i + 1, left_over - CAST(ms[i + 1] AS BIGINT), places - 1 FROM p, m WHERE places > 1 AND i < len(ms) AND ms[i + 1] > left_over // places),
f AS (SELECT * FROM p ORDER BY i DESC LIMIT 1),
t AS (SELECT unnest(range(0, CAST(greatest((SELECT left_over // places + 1 FROM f), (SELECT ms[1] FROM m)) AS BIGINT))) AS batch),
s AS (SELECT batch, CAST(len(list_filter(ms[1:i], lambda x: x > batch)) + CASE WHEN batch < left_over // places THEN places
   WHEN batch = left_over // places THEN left_over % places ELSE 0 END AS BIGINT) AS pairs FROM t, m, f)
SELECT batch, pairs, pairs AS anchors FROM s WHERE pairs > 1"""
    q["label_upsert"] = on_edges("""
SELECT edge_id, CAST(hit AS INTEGER) AS done, CASE WHEN NOT hit THEN '' WHEN n % 7 < 2 THEN 'Error' WHEN n % 11 < 3 THEN 'Yes' ELSE 'No' END AS dependent,
  CASE WHEN NOT hit THEN '' WHEN n % 7 < 2 THEN 'Error' WHEN n % 11 < 3 THEN 'Elaboration' ELSE 'Topic Shift' END AS relation_type
FROM (SELECT *, session_id % 2 = 0 OR coalesce(nr <= (SELECT coalesce(min(nr), 1e18) FROM tripped WHERE three = 3), false) AS hit FROM asked LEFT JOIN tripped USING (edge_id))
WHERE Q2_row % 2 = 1 OR Q1_row = 0 OR session_id % 2 = 0""").replace("\nSELECT edge_id, CAST(hit", """,
asked AS (SELECT *, length('Q1: ' || Q1 || chr(10) || 'A1: ' || A1 || chr(10) || 'Q2: ' || Q2 || chr(10) || 'distance: ' || distance::VARCHAR) AS n FROM e),
tripped AS (SELECT edge_id, row_number() OVER o AS nr, sum(CASE WHEN n % 7 < 2 THEN 1 ELSE 0 END) OVER (o ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS three
  FROM asked WHERE Q1_row = 0 WINDOW o AS (ORDER BY session_id, Q1_row, Q2_row, edge_id))
SELECT edge_id, CAST(hit""", 1)
    q["graph_forward"] = _graph_sql(False)
    q["graph_forward_directed"] = _graph_sql(True)
    q["bootstrap_models"] = on_recovered(" UNION ALL ".join(
        f"SELECT \"Model\", {lit(m)} AS \"Metric\", round(avg({c}), 6) AS \"BootstrapMean\", round(quantile_cont({c}, 0.025), 6) AS \"CI_Lower\", "
        f"round(quantile_cont({c}, 0.975), 6) AS \"CI_Upper\", {DRAWS} AS \"BootstrapSamples\" FROM dm GROUP BY \"Model\""
        for m, c in (("AUC", "auc"), ("AP", "ap"), ("Precision", "pr"), ("Recall", "rc"), ("F1", "f1"))), BOOT_MODELS)
    q["bootstrap_paired_models"] = on_recovered(
        f"SELECT b.\"Model\" AS \"Baseline\", round(avg(a.f1 - b.f1), 6) AS \"F1_Difference_Mean\", round(quantile_cont(a.f1 - b.f1, 0.025), 6) AS \"CI_Lower\", "
        f"round(quantile_cont(a.f1 - b.f1, 0.975), 6) AS \"CI_Upper\", round(avg(CASE WHEN a.f1 - b.f1 <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS \"P_Diff_LE_0\", "
        f"{DRAWS} AS \"BootstrapSamples\" FROM dm a JOIN dm b ON a.d = b.d AND a.\"Model\" = 'Final Graph' AND b.\"Model\" <> 'Final Graph' GROUP BY b.\"Model\"", BOOT_MODELS)
    q["fusion_coefficients"] = on_scored(
        "SELECT feature, round(coefficient, 6) AS coefficient FROM (SELECT unnest(['bm25_score', 'semantic_score', 'pairwise_score', 'distance_prior', 'intercept']) AS feature, "
        "unnest([b1, b2, b3, b4, b5]) AS coefficient FROM fu)", BM25, "\nft AS (SELECT * FROM bm WHERE split = 'train')", FUSION)
    q["score_fusion"] = on_scored(
        "SELECT edge_id, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(least((bm25_score - m1) / d1 * b1 + (stage1_prob - m2) / d2 * b2 "
        "+ (stage1_prob * distance_prior - m3) / d3 * b3 + (distance_prior - m4) / d4 * b4 + b5, 30.0::DOUBLE), -30.0::DOUBLE))), 6) AS fusion FROM bm, fu",
        BM25, "\nft AS (SELECT * FROM bm WHERE split = 'train')", FUSION)
    q["frozen_fusion"] = q["score_fusion"]
    q["calibration"] = on_kept("SELECT round(m1, 6) AS mean, round(d1, 6) AS deviation, round(b1, 6) AS weight, round(b2, 6) AS bias FROM cal", CALIBRATION)
    q["calibrated_columns"] = on_kept(
        "SELECT edge_id, given AS stage2_graph_input_pred, round(local_prob, 6) AS local_prob, round(r, 6) AS local_evidence FROM ev", CALIBRATION, CALIBRATED)
    summary = rates("cf", "split").replace(" FROM cf", ", round(auc, 6) AS auc, round(ap, 6) AS ap FROM cj")
    q["staged_run"] = staged(summary)
    q["staged_parameters"] = staged(
        "SELECT parameter, round(value, 6) AS value FROM (SELECT unnest(['selected_threshold', 'selected_top_k', 'selected_lambda_0', 'selected_lambda_t']) AS parameter, "
        "unnest([th, CAST(tk AS DOUBLE), lambda_0, lambda_t]) AS value FROM sb, pb)")
    chosen = summary.replace(" FROM cj", ", (SELECT round(lambda_0, 6) FROM pb) AS selected_lambda_0, (SELECT round(lambda_t, 6) FROM pb) AS selected_lambda_t FROM cj")
    q["evidence_ablation"] = (
        f"SELECT 'raw_stage1_prob' AS condition, a.* FROM ({staged(chosen, False)}) a UNION ALL "
        f"SELECT 'calibrated_lr' AS condition, b.* FROM ({staged(chosen)}) b")
    for name in REGISTRY:
        if name.startswith("long_"):
            q[name] = on_long(q[name.removeprefix("long_")])
    return q
