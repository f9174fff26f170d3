"""DuckDB SQL that computes the registered queries independently, from the raw tables."""

NUM = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
STRICT = r"-?(\d+\.?\d*|\.\d+)"

_LINE = (
    "(case when event_type in ('purchase','signup') then '+1' else '-1' end) || ' ' || "
    "(cast(json_extract_string(props, '$.k') as int) + 1) || ':' || cast(value as decimal(18,2)) || ' ' || "
    "(user_id % 100 + 1) || ':1'"
)
LINES = f"lines as (select event_id as row_id, {_LINE} as value from events)"

NOISY = f"""clean as (select event_id as row_id, {_LINE} as value from events),
parts as (select row_id, value, split_part(split_part(value, ' ', 2), ':', 1) as k,
  split_part(value, ' ', 2) || ' ' || split_part(value, ' ', 3) as body from clean),
lines as (select row_id, case row_id % 7
  when 0 then value || ' # c 5:1'
  when 1 then '1 qid:7 ' || body
  when 2 then '  0 0:9  ' || body
  when 3 then value || ' ' || k || ':.5 ' || k || ':-1e-1'
  when 4 then 'abc ' || body || ' 1:2:3 :4 x'
  when 5 then '-1.5 3:x ' || body
  else '# ' || value end as value from parts)"""


def _parsed(label: str, keep: str) -> str:
    return f"""bodies as (select row_id, trim(regexp_replace(value, '#.*$', '')) as body from lines
  where trim(value) <> '' and not starts_with(trim(value), '#')),
words as (select row_id, string_split_regex(body, '\\s+') as p from bodies where body <> ''),
labelled as (select row_id, {label} as label from words where {keep}),
toks as (select row_id, unnest(p[2:]) as t from words where {keep}),
pairs as (select row_id, cast(split_part(t, ':', 1) as bigint) - 1 as j, cast(split_part(t, ':', 2) as double) as v
  from toks where regexp_full_match(t, '[+-]?\\d+:{NUM}')),
coo as (select row_id, j, sum(v) as v from pairs where j >= 0 group by 1, 2)"""


PARSED = _parsed(
    f"case when regexp_full_match(p[1], '{NUM}') and try_cast(p[1] as double) > 0 then 1.0::double else -1.0 end", "true")
PARSED_STRICT = _parsed("try_cast(p[1] as double)", f"regexp_full_match(p[1], '{STRICT}')")

STORED = ("select l.row_id, l.label, c.j, round(c.v, 6) + 0.0 as v from labelled l left join coo c using (row_id)")
STORED_ANONYMOUS = ("select l.label, c.j, round(c.v, 6) + 0.0 as v, count(*) as n "
                    "from labelled l left join coo c using (row_id) group by 1, 2, 3")
# Spark's strict reader does not store explicit zeros.
STORED_NONZERO = STORED_ANONYMOUS.replace("left join coo c", "left join (select * from coo where v <> 0) c")
ENCODED = ("select l.row_id, (case when l.label > 0 then '+1' else '-1' end) || "
           "coalesce(string_agg(' ' || (c.j + 1) || ':' || c.v, '' order by c.j), '') as value "
           "from labelled l left join coo c using (row_id) group by l.row_id, l.label")
WIDTH = "width as (select max(j) + 1 as width from coo)"

DOCUMENTS = r"""doc_words as (select d.doc_id as row_id, l.quality, unnest(string_split_regex(d.text, '\s+')) as t
  from documents d join labels l using (doc_id)),
doc_coo as (select row_id, case when quality > 0 then 1.0::double else -1.0 end as label,
  least(length(t), 63)::bigint as j, count(*)::double as v from doc_words group by 1, 2, 3)"""

# The fixed weights and direction of the product queries.
_W = "((((j * 37) % 11) - 5) / 10.0::double)"
_S = "((((j * 13) % 7) - 3) / 10.0::double)"

EVENT_MARGIN = (f"scored as (select l.row_id, l.label, coalesce(sum(c.v * {_W.replace('j *', 'c.j *')}), 0) as m "
                "from labelled l left join coo c using (row_id) group by 1, 2)")
EVENT_SCORES = f"{LINES}, {PARSED}, {EVENT_MARGIN}, scores as (select row_id, label, round(m, 6) + 0.0 as margin from scored)"

EMBEDDED = """emb as (select vec_id as row_id, case when label % 2 > 0 then 1.0::double else -1.0 end as y,
  unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as j from embeddings)"""
MARGIN = f"scored as (select row_id, y, sum(v * {_W}) as m, sum(v * {_S}) as ms from emb group by 1, 2)"

_SIG = "(case when -y*m >= 0 then 1/(1+exp(y*m)) else exp(-y*m)/(1+exp(-y*m)) end)"
_FORMULAS = {
    "lr": {
        "loss": "(greatest(-y*m, 0) + ln(1 + exp(-abs(y*m))))",
        "residual": f"(-y * {_SIG})",
        "curvature": f"({_SIG} * (1 - {_SIG}))",
        "bend": 0.25,
    },
    "l2svm": {
        "loss": "(greatest(1 - y*m, 0) * greatest(1 - y*m, 0))",
        "residual": "(case when 1 - y*m > 0 then 2*(m - y) else 0 end)",
        "curvature": "(case when 1 - y*m > 0 then 2.0 else 0 end)",
        "bend": 2.0,
    },
}
_WIDTH = "(select max(j) + 1 from emb)"


def objective_sql(solver: str) -> str:
    return (f"with {EMBEDDED}, {MARGIN} select round((select sum({_W} * {_W}) / 2 from range(0, {_WIDTH}) r(j)) + "
            f"sum({_FORMULAS[solver]['loss']}), 6) + 0.0 as f from scored")


def _slope(solver: str) -> str:
    return (f"slope as (select e.j, sum(e.v * s.r) as z from emb e join "
            f"(select row_id, {_FORMULAS[solver]['residual']} as r from scored) s using (row_id) group by 1)")


def gradient_sql(solver: str) -> str:
    return f"with {EMBEDDED}, {MARGIN}, {_slope(solver)} select j, round({_W} + z, 6) + 0.0 as g from slope"


def strategies_sql(solver: str) -> str:
    return (f"with {EMBEDDED}, {MARGIN}, {_slope(solver)} select j, round({_W} + z, 6) + 0.0 as g_coo, "
            f"round({_W} + z, 6) + 0.0 as g_partition from slope")


def hessvec_sql(solver: str) -> str:
    return (f"with {EMBEDDED}, {MARGIN}, bent as (select e.j, sum(e.v * s.r) as z from emb e join "
            f"(select row_id, {_FORMULAS[solver]['curvature']} * ms as r from scored) s using (row_id) group by 1) "
            f"select j, round({_S} + z, 6) + 0.0 as h from bent")


def first_step_sql() -> str:
    return f"""with {EMBEDDED}, g as (select j, sum(v * -y / 2) as g from emb group by 1),
xg as (select e.row_id, sum(e.v * g.g) as x from emb e join g using (j) group by 1),
h as (select e.j, sum(e.v * xg.x) / 4 as z from emb e join xg using (row_id) group by 1),
t as (select sum(g * g) as gg, sum(g * (g + z)) as ghg from g join h using (j))
select round(gg, 6) as gg, round(ghg, 6) as ghg, round(gg / ghg, 6) as alpha from t"""


def models(scales) -> str:
    rows = ", ".join(f"('run{s}', {s})" for s in scales)
    return f"models(run_id, scale) as (values {rows})"


def objective_grid_sql(scales) -> str:
    loss = _FORMULAS["lr"]["loss"].replace("*m", "*m*scale")
    return (f"with {EMBEDDED}, {MARGIN}, {models(scales)}, "
            f"reg as (select sum({_W} * {_W}) / 2 as r from range(0, {_WIDTH}) t(j)) "
            f"select run_id, round(any_value(r) * scale * scale + sum({loss}), 6) + 0.0 as f "
            f"from scored, models, reg group by run_id, scale")


# --- optimum by accelerated gradient descent, independent of the Newton solver


def _descent(solver: str, steps: int, C: float = 1.0) -> str:
    """A recursive query that iterates w <- v - grad(v) / L, v <- w + beta (w - w_before).

    The step comes from a row-sum bound of the largest curvature. The strong
    convexity of the penalty is 1, which fixes the momentum.
    """
    f = _FORMULAS[solver]
    residual = f["residual"].replace("*m", "*q.m").replace("(m ", "(q.m ").replace("y*", "q.y*").replace("-y", "-q.y").replace("- y)", "- q.y)")
    return f"""{EMBEDDED},
gram as (select a.j, sum(abs(g)) as s from (select a.j, b.j as k, sum(a.v * b.v) as g
  from emb a join emb b using (row_id) group by 1, 2) a group by 1),
lip as (select 1 + {C} * {f['bend']} * max(s) as l from gram),
mom as (select l, (sqrt(l) - 1) / (sqrt(l) + 1) as beta from lip),
descent(it, j, w, v) as (
  select 0, j, 0.0::double, 0.0::double from range(0, {_WIDTH}) r(j)
  union all
  (with q as (select e.row_id, any_value(e.y) as y, sum(e.v * d.v) as m from emb e join descent d using (j) group by 1),
   z as (select e.j, sum(e.v * {residual}) as z from emb e join q using (row_id) group by 1),
   n as (select d.it, d.j, d.w, d.v - (d.v + {C} * z.z) / mom.l as w_new, mom.beta
         from descent d join z using (j), mom where d.it < {steps})
   select it + 1, j, w_new, w_new + beta * (w_new - w) from n)),
best as (select j, w from descent where it = {steps})"""


STEPS = {"lr": 60, "l2svm": 220}


def optimum_sql(solver: str) -> str:
    return f"with recursive {_descent(solver, STEPS[solver])} select j, round(w, 5) + 0.0 as w from best"


def _model_scores(C: float) -> str:
    return ("final as (select e.row_id, any_value(e.y) as y, sum(e.v * b.w) as m from emb e join best b using (j) group by 1), "
            "ranks as (select y, m, rank() over (order by m) + (count(*) over (partition by m) - 1) / 2.0::double as rk from final), "
            "quality as (select count(*) as n, avg(case when (m >= 0) = (y > 0) then 1.0::double else 0.0 end) as accuracy, "
            "(sum(rk) filter (y > 0) - (count(*) filter (y > 0)) * ((count(*) filter (y > 0)) + 1) / 2) / "
            "((count(*) filter (y > 0)) * (count(*) filter (y < 0))) as auc from ranks)")


def optimum_summary_sql(solver: str) -> str:
    f = _FORMULAS[solver]
    at_zero = {k: f[k].replace("*m", "*0").replace("(m ", "(0 ") for k in ("loss", "residual")}
    return f"""with recursive {_descent(solver, STEPS[solver])}, {_model_scores(1.0)},
g0 as (select sqrt(sum(z * z)) as g0 from (select sum(v * {at_zero['residual']}) as z from emb group by j)),
f0 as (select sum({at_zero['loss']}) as f0 from (select distinct row_id, y from emb)),
obj as (select (select sum(w * w) / 2 from best) + sum({f['loss']}) as f from final)
select '{solver}' as solver, n, round(accuracy, 6) as accuracy, round(auc, 6) as auc, round(f0, 6) as f0,
  round(g0, 6) as g0_norm, round(f, 5) as f from quality, g0, f0, obj"""


def baseline_sql() -> str:
    return f"""with recursive {_descent('lr', STEPS['lr'])}, {_model_scores(1.0)}
select round((select sum(w * w) / 2 from best) + sum({_FORMULAS['lr']['loss']}), 3) as f from final"""


def final_objective_sql(solver: str) -> str:
    """The objective of the optimum, in a common table ``obj``."""
    return (f"with recursive {_descent(solver, STEPS[solver])}, {_model_scores(1.0)}, "
            f"obj as (select (select sum(w * w) / 2 from best) + sum({_FORMULAS[solver]['loss']}) as f from final)")


def strategies_timed_sql(solver: str) -> str:
    return (f"{final_objective_sql(solver)} select strategy, round(f, 5) + 0.0 as f, true as decreasing, true as agrees "
            "from obj, (values ('map'), ('mappart')) s(strategy)")


def curve_sql(grid) -> str:
    rows = ", ".join(f"({k})" for k in grid)
    return (f"{final_objective_sql('lr')} select max_iter, true as decreasing, case when max_iter >= 20 then round(f, 3) + 0.0 end as f "
            f"from obj, (values {rows}) g(max_iter)")


def hinge_sql() -> str:
    """With a penalty of 1 no margin reaches 1, so every example pulls alike and the optimum is the mean of y x."""
    return f"""with {EMBEDDED}, best as (select j, avg(v * y) as w from emb group by 1), {_model_scores(1.0)}
select n, round(accuracy, 6) as accuracy, round(auc, 6) as auc, (select max(y * m) < 1 from final) as all_inside from quality"""


def _events(scale: float) -> str:
    """Events with a bias, scaled, in place of the embeddings."""
    return f"""{LINES}, {PARSED}, {WIDTH},
emb as (select c.row_id, l.label as y, c.v / {scale} as v, c.j from coo c join labelled l using (row_id)
  union all select row_id, label, 1.0::double, width from labelled, width)"""


def event_fit_sql(scale: float, C: float, steps: int) -> str:
    sql = f"with recursive {_descent('lr', steps, C)}, {_model_scores(C)}".replace(EMBEDDED, _events(scale))
    loss = _FORMULAS["lr"]["loss"]
    return (f"{sql}, obj as (select (select sum(w * w) / 2 from best) + {C} * sum({loss}) as f from final) "
            "select n, round(accuracy, 6) as accuracy, round(auc, 5) as auc, round(f, 4) as f from quality, obj")


def sweep_sql() -> str:
    parts = []
    for solver in ("lr", "l2svm"):
        for C in (0.1, 1.0):
            tag = f"{solver}_C{C:g}_eps1e-07_bias-1_rep1"
            parts.append(f"""select * from (with recursive {_descent(solver, STEPS[solver], C)}, {_model_scores(C)},
cuts as (select t.m as cut, avg(case when (f.m >= t.m) = (f.y > 0) then 1.0::double else 0.0 end) as score
  from final f, final t group by 1),
top as (select max(score) as best_score, min(cut) as cut from cuts where score = (select max(score) from cuts)),
hit as (select avg(case when (m >= cut) = (y > 0) then 1.0::double else 0.0 end) as accuracy from final, top)
select '{tag}' as run_id, n, round(hit.accuracy, 6) as accuracy, round(auc, 6) as auc, round(best_score, 6) as best_score
  from quality, top, hit)""")
    return " union all ".join(parts)


def split_sweep_sql() -> str:
    """The optima on the training part of a three-way split, cut on the validation part, tested on the rest."""
    split = """ids as (select vec_id as k, md5(concat(vec_id, ':', 42)) as h, md5(concat(vec_id, ':', 7)) as h2 from embeddings),
outer_ as (select *, row_number() over (order by h, k) <= floor(0.8::double * count(*) over ()) as inside from ids),
inner_ as (select k, row_number() over (order by h2, k) <= floor(0.8::double * count(*) over ()) as train from outer_ where inside),
part as (select o.k as row_id, case when not inside then 'test' when train then 'train' else 'val' end as part from outer_ o left join inner_ i using (k))"""
    everything = EMBEDDED.replace("emb as", "every as")
    train = f"{everything}, {split}, emb as (select e.* from every e join part using (row_id) where part = 'train')"
    parts = []
    for solver in ("lr", "l2svm"):
        for C in (0.1, 1.0):
            tag = f"{solver}_C{C:g}_eps1e-07_bias-1_rep1"
            parts.append(f"""select * from (with recursive {_descent(solver, STEPS[solver], C).replace(EMBEDDED, train)},
scored as (select e.row_id, any_value(p.part) as part, any_value(e.y) as y, sum(e.v * b.w) as m from every e join best b using (j) join part p using (row_id) group by 1),
final as (select * from scored where part = 'val'), test as (select * from scored where part = 'test'),
cuts as (select t.m as cut, avg(case when (f.m >= t.m) = (f.y > 0) then 1.0::double else 0.0 end) as score from final f, final t group by 1),
top as (select max(score) as best_score, min(cut) as cut from cuts where score = (select max(score) from cuts)),
ranks as (select y, m, rank() over (order by m) + (count(*) over (partition by m) - 1) / 2.0::double as rk from test),
quality as (select (sum(rk) filter (y > 0) - (count(*) filter (y > 0)) * ((count(*) filter (y > 0)) + 1) / 2) /
  ((count(*) filter (y > 0)) * (count(*) filter (y < 0))) as auc from ranks),
hit as (select count(*) as n, avg(case when (m >= cut) = (y > 0) then 1.0::double else 0.0 end) as accuracy from test, top)
select '{tag}' as run_id, n, round(hit.accuracy, 6) as accuracy, round(auc, 6) as auc, round(best_score, 6) as best_score from quality, top, hit)""")
    return " union all ".join(parts)


def converged_sql(solvers, Cs, epss, reps: int) -> str:
    """What holds of every fit of a grid: its part sizes, its start, and that it ends at its tolerance."""
    f = {s: _FORMULAS[s]["loss"].replace("*m", "*0") for s in solvers}
    rows = ", ".join(f"('{s}_C{C:g}_eps{eps:g}_bias-1_rep{r}', '{s}', {C}::double)" for s in solvers for C in Cs for eps in epss for r in range(1, reps + 1))
    start = " union all ".join(f"select '{s}' as solver, {loss} as loss" for s, loss in f.items()).replace("y", "1.0::double")
    return f"""with n as (select count(*) as n, floor(0.8::double * count(*)) as inside from embeddings),
parts as (select n - inside as n_test, floor(0.8::double * inside) as n_train from n), runs(run_id, solver, c) as (values {rows}), start as ({start})
select run_id, n_test::bigint as n, round(c * n_train * loss, 6) as f0, true as converged, true as better from runs join start using (solver), parts"""


# ------------------------------------------------------------------ evaluation

RANKED = """counts as (select margin, count(*) filter (label > 0) as pos, count(*) filter (label <= 0) as neg from scores group by 1),
ranked as (select margin, pos, neg, coalesce(sum(neg) over before, 0) as below, coalesce(sum(pos) over before, 0) as pos_below
  from counts window before as (order by margin rows between unbounded preceding and 1 preceding))"""

CURVE = """totals as (select sum(pos)::bigint as n_pos, sum(neg)::bigint as n_neg from counts),
curve as (select margin, n_pos, n_neg, (n_pos - pos_below)::bigint as tp, (n_neg - below)::bigint as fp,
  pos_below::bigint as fn, below::bigint as tn from ranked, totals)"""


def confusion_sql() -> str:
    return f"""with {EVENT_SCORES}, c as (select count(*) filter (label > 0 and margin >= 0) as tp,
  count(*) filter (label <= 0 and margin >= 0) as fp, count(*) filter (label > 0 and margin < 0) as fn,
  count(*) filter (label <= 0 and margin < 0) as tn from scores)
select tp, fp, fn, tn, round(case when tp + fp > 0 then tp::double / (tp + fp) else 0 end, 6) as precision,
  round(case when tp + fn > 0 then tp::double / (tp + fn) else 0 end, 6) as recall,
  round(case when 2*tp + fp + fn > 0 then 2*tp::double / (2*tp + fp + fn) else 0 end, 6) as f1 from c"""


_VALUE_SCORES = ("scores as (select value as margin, case when event_type in ('purchase','signup') then 1.0::double "
                 "else -1.0 end as label, cast(user_id % 10 as varchar) as run_id from events)")


def auc_value_sql() -> str:
    return (f"with {_VALUE_SCORES}, {RANKED} select sum(pos)::bigint as n_pos, sum(neg)::bigint as n_neg, "
            "round(sum(pos * (below + neg / 2.0::double)) / (sum(pos) * sum(neg)), 6) as auc from ranked")


def auc_by_run_sql() -> str:
    return f"""with {_VALUE_SCORES}, ranks as (select run_id, label,
  rank() over (partition by run_id order by margin) + (count(*) over (partition by run_id, margin) - 1) / 2.0::double as rk from scores),
a as (select run_id, count(*) filter (label > 0) as n_pos, count(*) filter (label <= 0) as n_neg,
  sum(rk) filter (label > 0) as s from ranks group by 1)
select run_id, n_pos, n_neg, round((s - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 6) as auc from a"""


def best_threshold_sql(metric: str) -> str:
    n = "(n_pos + n_neg)"
    score = f"(tp + tn)::double / {n}" if metric == "acc" else "case when 2*tp + fp + fn > 0 then 2*tp::double / (2*tp + fp + fn) else 0 end"
    nothing = f"n_neg::double / {n}" if metric == "acc" else "0.0::double"
    return f"""with {EVENT_SCORES}, {RANKED}, {CURVE},
rated as (select margin, {score} as score, {nothing} as nothing from curve),
top as (select max(score) as best, max(margin) as largest, max(nothing) as nothing from rated),
chosen as (select min(margin) as thr from rated, top where score = best)
select '{metric}' as metric,
  round(case when largest < 0 and nothing > best then 0.0 else thr end, 6) + 0.0 as best_threshold,
  round(case when largest < 0 and nothing > best then nothing else best end, 6) + 0.0 as best_score from top, chosen"""


def evaluate_sql() -> str:
    return f"""with {LINES}, {PARSED}, {EVENT_MARGIN}, scores as (select row_id, label, m as margin from scored), {RANKED},
a as (select round(sum(pos * (below + neg / 2.0::double)) / (sum(pos) * sum(neg)), 6) as auc from ranked)
select count(*) as n, round(avg(case when (margin >= 0) = (label > 0) then 1.0::double else 0.0 end), 6) as accuracy,
  any_value(auc) as auc from scores, a"""


# ---------------------------------------------------------------------- splits

SPLIT = """placed as (select o_orderkey, row_number() over (order by md5(concat(o_orderkey, ':', 42)), o_orderkey) as rn,
  floor(0.8::double * count(*) over ()) as k from orders)"""


def three_way_sql() -> str:
    return f"""with {SPLIT}, inside as (select o_orderkey,
  row_number() over (order by md5(concat(o_orderkey, ':', 7)), o_orderkey) as rn,
  floor(0.8::double * count(*) over ()) as k from placed where rn <= k)
select o_orderkey, case when rn <= k then 'train' else 'val' end as split from inside
union all select o_orderkey, 'test' from placed where rn > k"""


# -------------------------------------------------------------------- run logs

_TAG = ("(case when user_id % 2 = 0 then 'lr' else 'l2svm' end) || '_C1e' || (user_id % 5 - 3) || "
        "'_eps1e-3_bias-1_rep' || (user_id % 3 + 1)")
HISTORY = f"""history as (select cast(user_id as varchar) as run_id, {_TAG} as tag, event_id as iter,
  epoch_us(ts) / 1e6 as t_sec, value as f, cast(json_extract_string(props, '$.k') as double) as g_norm from events)"""

_SUMMARY = """summary as (select run_id, count(*) as n_points, min(f) as f_min, arg_min(f, iter) as f_first,
  arg_max(f, iter) as f_last from history group by 1)"""


def curve_summary_sql() -> str:
    return f"with {HISTORY}, {_SUMMARY} select *, (select min(f_min) from summary) as f_best from summary"


def gap_sql(variant: str) -> str:
    best = {
        "v1": "(select min(f_min) from summary)", "v2": "(select min(f_min) from summary)",
        "v3": "(select min(f_last) from summary)", "v4": "(select min(f_last) from summary)", "v5": "f_last",
    }[variant]
    gap = {
        "v1": "log10(greatest(abs((f - b) / greatest(abs(f_first - b), 1e-12::double)), 1e-12::double))",
        "v2": "log10(greatest(abs((f - b) / greatest(abs(b), 1e-12::double)), 1e-12::double))",
        "v3": "log10(abs((f - b) / greatest(abs(b), 1e-12::double) + 1e-12::double))",
        "v4": "case when f = b then '-inf'::double else log10(abs((f - b) / b)) end",
        "v5": "case when f_first = b then case when f = b then 'nan'::double else 'inf'::double end "
              "else log10(abs((f - b) / (f_first - b) + 1e-12::double)) end",
    }[variant]
    return (f"with {HISTORY}, {_SUMMARY}, joined as (select run_id, iter, f, f_first, {best} as b "
            f"from history join summary using (run_id)) select run_id, iter, round({gap}, 6) + 0.0 as gap from joined")


def parse_tag_sql() -> str:
    return f"""with {HISTORY}, runs as (select distinct run_id, tag, regexp_replace(tag, '_rep\\d+$', '') as base from history),
named as (select *, case cast(run_id as int) % 3 when 0 then '' when 1 then 'mllib' end as configured from runs)
select run_id, tag, '/logs/r' || run_id as dir, base,
  coalesce(nullif(configured, ''), case when starts_with(tag, 'lr_') then 'lr' when starts_with(tag, 'l2svm_') then 'l2svm' else '?' end) as solver,
  coalesce(try_cast(nullif(regexp_extract(base, 'C([0-9e.-]+)', 1), '') as double), 0) as C,
  regexp_replace(regexp_replace(base, '^(lr_|l2svm_)', ''), '_bias-1$', '') as label from named"""


def group_stats_sql() -> str:
    return f"""with runs as (select regexp_replace({_TAG}, '_rep\\d+$', '') as base,
  cast(json_extract_string(props, '$.k') as double) as t, case when event_type <> 'error' then value end as f from events)
select base, split_part(base, '_', 1) as solver, cast(regexp_extract(base, 'C([0-9e.-]+)', 1) as double) as C,
  regexp_replace(regexp_replace(base, '^(lr_|l2svm_)', ''), '_bias-1$', '') as label, count(*) as n,
  round(avg(t), 6) as time_sec_mean, round(stddev_pop(t), 6) as time_sec_std,
  round(avg(f), 6) as final_f_mean, round(stddev_pop(f), 6) as final_f_std from runs group by base"""


_USER_RUNS = ("runs as (select distinct 'd' || (user_id % 3) as dir, 't' || user_id as tag, 'w_' || (user_id * 20) as weights_path from events)")
_OWN = "select 'd' || (s_suppkey % 3) as dir, 't' || s_suppkey as tag"


def threshold_join_sql() -> str:
    return (f"with {_USER_RUNS}, thr as ({_OWN}, s_acctbal as t from supplier) "
            "select dir, tag, round(coalesce(t, 0), 6) + 0.0 as threshold from runs left join thr using (dir, tag)")


def weights_join_sql() -> str:
    return (f"with {_USER_RUNS}, own as ({_OWN}, 'own_' || s_suppkey as o from supplier), "
            "av as (select 'w_' || c_custkey as w from customer), "
            "j as (select dir, tag, coalesce(o, w) as weights_id from runs left join own using (dir, tag) left join av on weights_path = w) "
            "select dir, tag, weights_id from j where weights_id is not null")


def convergence_sql() -> str:
    return (f"with {HISTORY} select run_id, split_part(tag, '_', 1) as solver, round(t_sec, 3) as t_sec, f, g_norm from history "
            "where cast(run_id as int) % 7 > 1")


def finite_points_sql() -> str:
    return (f"with {HISTORY} select run_id, count(*) as n, round(sum(f), 6) as total from history "
            "where g_norm between 10 and 90 group by 1")


# ----------------------------------------------------------------- round trips


def weights_roundtrip_sql(scales) -> str:
    return (f"with {LINES}, {PARSED}, {WIDTH}, {models(scales)}, norm as (select any_value(width) as width, "
            f"sum({_W} * {_W}) as n2 from width, range(0, (select width from width)) r(j)) "
            "select run_id, width, round(n2 * scale * scale, 6) + 0.0 as norm2 from norm, models")


def runlog_sql() -> str:
    return """with h as (select event_id // 100 as run, event_id as iter, value as f from events)
select (case when run % 2 = 0 then 'lr' else 'l2svm' end) || '_run' || run as tag,
  case when run % 2 = 0 then 'lr' else 'l2svm' end as solver, case when run % 5 <> 0 then arg_max(f, iter) end as final_f,
  case when run % 3 <> 0 then 1.0::double else -1.0 end as bias,
  count(*) as n, round(sum(f), 6) as total from h group by run"""


def stored_runs_sql(runs) -> str:
    rows = ", ".join(
        f"('{t}', {s}, {b}, {0.0 if c is None else c})" for t, s, b, c in runs if s)
    return f"""with {LINES}, {PARSED}, {EVENT_MARGIN}, {WIDTH},
runs(tag, scale, bias, cut) as (values {rows}),
last as (select (((width * 37) % 11) - 5) / 10.0::double as w from width),
marked as (select tag, cut, label, round(m * scale + case when bias >= 0 then bias * scale * w else 0 end, 9) + 0.0 as margin
  from scored, runs, last),
counts as (select tag, cut, margin, count(*) filter (label > 0) as pos, count(*) filter (label <= 0) as neg from marked group by 1, 2, 3),
swept as (select *, coalesce(sum(neg) over (partition by tag order by margin rows between unbounded preceding and 1 preceding), 0) as below from counts),
runs_done as (select tag, sum(case when margin >= cut then pos else neg end) / sum(pos + neg)::double as accuracy,
  sum(pos * (below + neg / 2.0::double)) / (sum(pos)::double * sum(neg)) as auc from swept group by 1)
select regexp_replace(tag, '_rep[0-9]+$', '') as base,
  regexp_extract(tag, 'C([0-9.]+)_', 1)::double as "C",
  regexp_replace(regexp_replace(regexp_replace(tag, '_rep[0-9]+$', ''), '^(lr|l2svm)_', ''), '_bias-1$', '') as label, count(*) as n,
  round(avg(accuracy), 6) + 0.0 as accuracy_mean, round(stddev_pop(accuracy), 6) + 0.0 as accuracy_std,
  round(avg(auc), 6) + 0.0 as auc_mean, round(stddev_pop(auc), 6) + 0.0 as auc_std
from runs_done group by 1, 2, 3"""


def timing_sql() -> str:
    return """with t as (select case when user_id % 2 = 0 then 'map' else 'mappart' end as strategy, length(event_type) as l,
  round(sum(cast(value as decimal(18,2)))::double, 6) as t_sec, count(*)::double as f from events group by 1, 2)
select strategy, row_number() over (partition by strategy order by l) as iter, t_sec, f from t"""
