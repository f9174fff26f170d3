"""The registered queries, each with the SQL that checks it.

Inputs are the whole test tables: events become sparse examples (through LIBSVM
text) and run histories, embeddings dense examples, documents examples of word
lengths, orders the population of splits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparselin import oracle as O
from sparselin import sinks
from sparselin.functions import rows as R
from sparselin.functions import tags
from sparselin.functions.losses import get_loss
from sparselin.operators import curves, grid, metrics, objective, split
from sparselin.operators import matvec as M
from sparselin.plans import baseline, compare, evaluate, fit, reports, sweep
from sparselin.plans import stored as stored_runs
from sparselin.schema import CONFIG, META, RUNS, STEP, SUMMARY
from sparselin.session import materialize, scratch_path, spread
from sparselin.sources import libsvm, runlogs, tables
from sparselin.sources import weights as W

# Features of a range in the queries of wide models: several ranges for the narrow test tables.
SPAN = 16

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def r6(column, name: str):
    """Six digits without a negative zero, the precision both engines agree on."""
    x = F.col(column) if isinstance(column, str) else column
    return (F.round(x, 6) + F.lit(0.0)).alias(name)


# ------------------------------------------------------------------- inputs


def events(spark, sf):
    return tables.table(spark, sf, "events")


def event_rows(spark, sf):
    return libsvm.parse(tables.event_lines(spread(events(spark, sf))))


def stored_event_rows(spark, sf):
    """The parsed rows as a written table, for queries that read them more than once."""
    return materialize(event_rows(spark, sf), scratch_path(spark, "events"))


def embedding_rows(spark, sf):
    return tables.embedding_rows(tables.table(spark, sf, "embeddings"))


def document_rows(spark, sf, target="quality"):
    return tables.document_rows(
        tables.table(spark, sf, "documents"), tables.table(spark, sf, "labels"), target)


def rule_weights(spark, width, multiplier=37, modulus=11, shift=5):
    return W.by_rule(spark.range(width).withColumnRenamed("id", "j"), multiplier, modulus, shift)


def weights_and_direction(spark, width):
    s = rule_weights(spark, width, 13, 7, 3).withColumnRenamed("w", "s")
    return rule_weights(spark, width).join(s, "j")


def event_scores(spark, sf):
    """Margins rounded to six digits, so that equal scores are equal in both engines."""
    rows = stored_event_rows(spark, sf)
    width = libsvm.feature_width(rows)
    return M.margins(rows, rule_weights(spark, width), width).select("row_id", "label", r6("margin", "margin"))


def stored(rows):
    """Rows as comparable records: one per stored entry, one null entry for an empty row."""
    return M.to_coo(rows, "label", outer=True).select("row_id", "label", "j", r6("v", "v"))


# ------------------------------------------------------- text and projections


@query("libsvm_lines", f"with {O.LINES} select row_id, value from lines")
def libsvm_lines(spark, sf):
    return tables.event_lines(events(spark, sf))


@query("libsvm_parse", f"with {O.LINES}, {O.PARSED} {O.STORED}")
def libsvm_parse(spark, sf):
    return stored(event_rows(spark, sf))


def noisy_lines(spark, sf):
    """Every line with one of seven irregularities."""
    lines = tables.event_lines(events(spark, sf))
    kind, value = F.col("row_id") % 7, F.col("value")
    first = F.split_part(F.split_part(value, F.lit(" "), F.lit(2)), F.lit(":"), F.lit(1))
    body = F.substring_index(value, " ", -2)
    return lines.select("row_id", (
        F.when(kind == 0, F.concat(value, F.lit(" # c 5:1")))
        .when(kind == 1, F.concat(F.lit("1 qid:7 "), body))
        .when(kind == 2, F.concat(F.lit("  0 0:9  "), body))
        .when(kind == 3, F.concat(value, F.lit(" "), first, F.lit(":.5 "), first, F.lit(":-1e-1")))
        .when(kind == 4, F.concat(F.lit("abc "), body, F.lit(" 1:2:3 :4 x")))
        .when(kind == 5, F.concat(F.lit("-1.5 3:x "), body))
        .otherwise(F.concat(F.lit("# "), value))
    ).alias("value"))


@query("libsvm_parse_noisy", f"with {O.NOISY}, {O.PARSED} {O.STORED}")
def libsvm_parse_noisy(spark, sf):
    return stored(libsvm.parse(noisy_lines(spark, sf)))


@query("svmlight_parse", f"with {O.NOISY}, {O.PARSED_STRICT} {O.STORED}")
def svmlight_parse(spark, sf):
    return stored(libsvm.parse(noisy_lines(spark, sf), "svmlight"))


@query("libsvm_encode", f"with {O.LINES}, {O.PARSED} {O.ENCODED}")
def libsvm_encode(spark, sf):
    return sinks.encode_rows(event_rows(spark, sf))


@query("document_features", f"with {O.DOCUMENTS} select row_id, label, j, round(v, 6) + 0.0 as v from doc_coo")
def document_features(spark, sf):
    return stored(document_rows(spark, sf))


@query("document_features_toxic",
       f"with {O.DOCUMENTS} select c.row_id, case when l.toxic > 0 then 1.0::double else -1.0 end as label, c.j, "
       "round(c.v, 6) + 0.0 as v from doc_coo c join labels l on l.doc_id = c.row_id")
def document_features_toxic(spark, sf):
    return stored(document_rows(spark, sf, "toxic"))


@query("bias_append", f"with {O.LINES}, {O.PARSED}, {O.WIDTH}, biased as ("
       "select row_id, label, j, v from labelled join coo using (row_id) "
       "union all select row_id, label, width, 1.0 from labelled, width) "
       "select row_id, label, j, round(v, 6) + 0.0 as v from biased")
def bias_append(spark, sf):
    rows, _ = libsvm.with_bias(stored_event_rows(spark, sf), 1.0)
    return stored(rows)


@query("densify", f"with {O.DOCUMENTS}, grid as ("
       "select row_id, j from (select distinct row_id from doc_coo), range(0, (select max(j) + 1 from doc_coo)) r(j)) "
       "select g.row_id, g.j, round(coalesce(c.v, 0), 6) + 0.0 as v "
       "from grid g left join doc_coo c on c.row_id = g.row_id and c.j = g.j")
def densify(spark, sf):
    rows = document_rows(spark, sf)
    width = libsvm.feature_width(rows)
    # The array is the generator's own expression: of a named column Spark would infer a filter that computes it twice.
    cells = F.posexplode(R.densify(F.col("indices"), F.col("values"), width))
    return rows.select("row_id", cells.alias("j", "v")).select(
        "row_id", F.col("j").cast("bigint").alias("j"), r6("v", "v"))


@query("range_transform", "select count(*) as n, round(sum(0.9::double * (o_orderkey % 2) + 1), 6) as total from orders")
def range_transform(spark, sf):
    """The parity of every order's key, moved and summed."""
    labelled = tables.table(spark, sf, "orders").select((F.col("o_orderkey") % 2).cast("double").alias("y"))
    moved = labelled.select((F.col("y") * 0.9 + 1.0).alias("z"))
    return moved.agg(F.count("*").alias("n"), r6(F.sum("z"), "total"))


# ------------------------------------------------------------ matrix statistics


@query("matrix_profile", f"with {O.LINES}, {O.PARSED}, per_row as ("
       "select l.row_id, count(c.j) as k from labelled l left join coo c using (row_id) group by 1) "
       "select count(*) as n_rows, (select max(j) + 1 from coo) as n_cols, sum(k)::bigint as nnz, "
       "min(k)::bigint as min_row_nnz, max(k)::bigint as max_row_nnz, count(*) filter (k = 0) as empty_rows from per_row")
def matrix_profile(spark, sf):
    return M.matrix_profile(event_rows(spark, sf))


@query("row_offsets", f"with {O.LINES}, {O.PARSED}, per_row as ("
       "select l.row_id, count(c.j) as k from labelled l left join coo c using (row_id) group by 1), "
       "ends as (select row_id, k, (sum(k) over (order by row_id))::bigint as stop from per_row) "
       "select row_id, stop - k as start, stop from ends")
def row_offsets(spark, sf):
    return curves.row_offsets(event_rows(spark, sf))


@query("label_histogram", f"with {O.LINES}, {O.PARSED} select label, count(*) as n from labelled group by 1")
def label_histogram(spark, sf):
    return M.label_histogram(event_rows(spark, sf))


@query("feature_width", f"with {O.LINES}, {O.PARSED} select max(j) + 1 as n_features, "
       "(select count(*) from labelled) as n_rows from coo")
def feature_width(spark, sf):
    return event_rows(spark, sf).agg(
        (F.max(F.array_max("indices")) + 1).alias("n_features"), F.count("*").alias("n_rows"))


@query("structure_checks", f"with {O.DOCUMENTS}, k as (select row_id, count(*) as k from doc_coo group by 1) select "
       "(select count(*) from k where row_id % 7 = 0) as length_mismatch, "
       "(select count(distinct row_id) from doc_coo where j >= 16) as out_of_range, "
       "(select count(*) from k where row_id % 5 = 0) as repeated_index, "
       "(select count(*) from k where row_id % 3 = 0) as missing_label, "
       "(case when (select max(j) + 1 from doc_coo) <> 16 then 1 else 0 end)::bigint as weight_width_mismatch")
def structure_checks(spark, sf):
    """Documents with faults put in by id: a value too many, a repeated index, no label."""
    rows = document_rows(spark, sf)
    width = libsvm.feature_width(rows)
    id_ = F.col("row_id")
    repeated = F.concat("indices", F.slice("indices", 1, 1))
    faulty = rows.select(
        "row_id", F.when(id_ % 3 != 0, F.col("label")).alias("label"),
        F.when(id_ % 5 == 0, repeated).otherwise(F.col("indices")).alias("indices"),
        F.when((id_ % 5 == 0) & (id_ % 7 != 0), F.concat("values", F.slice("values", 1, 1)))
        .when((id_ % 5 != 0) & (id_ % 7 == 0), F.concat("values", F.array(F.lit(1.0))))
        .otherwise(F.col("values")).alias("values"))
    return M.violations(faulty, 16, rule_weights(spark, width))


# ------------------------------------------------------------------- products


@query("margin", f"with {O.LINES}, {O.PARSED}, {O.EVENT_MARGIN} "
       "select row_id, label, round(m, 6) + 0.0 as margin from scored")
def margin(spark, sf):
    return event_scores(spark, sf)


@query("margin_partition", f"with {O.LINES}, {O.PARSED}, {O.EVENT_MARGIN} "
       "select row_id, label, round(m, 6) + 0.0 as margin from scored")
def margin_partition(spark, sf):
    rows = stored_event_rows(spark, sf)
    w = W.to_array(rule_weights(spark, libsvm.feature_width(rows)))
    return M.dense_margins(rows, w).select("row_id", "label", r6("margin", "margin"))


@query("margin_wide", f"with {O.LINES}, {O.PARSED}, {O.EVENT_MARGIN} "
       "select row_id, label, round(m, 6) + 0.0 as margin from scored")
def margin_wide(spark, sf):
    """The route of weights too wide to broadcast: rows cut by feature ranges, to which slices of the weights are sent."""
    rows = stored_event_rows(spark, sf)
    width = libsvm.feature_width(rows)
    scores = grid.wide_margins(rows, rule_weights(spark, width), width, span=SPAN)
    return scores.select("row_id", "label", r6("margin", "margin"))


@query("margin_joined", f"with {O.LINES}, {O.PARSED}, {O.EVENT_MARGIN} "
       "select row_id, label, round(m, 6) + 0.0 as margin from scored")
def margin_joined(spark, sf):
    """The same by joins of entries and weights: hot features apart, the rest shuffled."""
    rows = stored_event_rows(spark, sf)
    width = libsvm.feature_width(rows)
    scores = M.margins(rows, rule_weights(spark, width), width, max_broadcast=0)
    return scores.select("row_id", "label", r6("margin", "margin"))


@query("margin_inline", f"with {O.EMBEDDED}, {O.MARGIN} select row_id, round(m, 6) + 0.0 as margin from scored")
def margin_inline(spark, sf):
    rows = embedding_rows(spark, sf)
    w = W.to_array(rule_weights(spark, libsvm.feature_width(rows)))
    return rows.select("row_id", r6(R.inline_dot(F.col("indices"), F.col("values"), w), "margin"))


@query("xt_dot", f"with {O.LINES}, {O.PARSED} select j, round(sum(v * ((row_id * 7) % 5 - 2) / 4), 6) + 0.0 as z "
       "from coo where (row_id * 7) % 5 <> 2 group by 1")
def xt_dot(spark, sf):
    rows = stored_event_rows(spark, sf)
    r = rows.select("row_id", (((F.col("row_id") * 7) % 5 - 2) / 4).alias("r"))
    return M.transposed_by_id(rows, r).select("j", r6("z", "z"))


@query("xt_dot_in_row", f"with {O.LINES}, {O.PARSED} select j, round(sum(v * ((row_id * 7) % 5 - 2) / 4), 6) + 0.0 as z "
       "from coo where (row_id * 7) % 5 <> 2 group by 1")
def xt_dot_in_row(spark, sf):
    rows = event_rows(spark, sf)
    return M.transposed(rows, ((F.col("row_id") * 7) % 5 - 2) / 4).select("j", r6("z", "z"))


_SIGNED = (f"with {O.LINES}, {O.PARSED}, {O.EVENT_MARGIN} "
           "select round(sum(label * m), 4) + 0.0 as signed_sum from scored")


@query("signed_margin_sum", _SIGNED)
def signed_margin_sum(spark, sf):
    rows = stored_event_rows(spark, sf)
    width = libsvm.feature_width(rows)
    total = M.signed_margin_sum(M.margins(rows, rule_weights(spark, width), width))
    return total.select((F.round("signed_sum", 4) + 0.0).alias("signed_sum"))


@query("signed_margin_sum_partition", _SIGNED)
def signed_margin_sum_partition(spark, sf):
    rows = stored_event_rows(spark, sf)
    w = W.to_array(rule_weights(spark, libsvm.feature_width(rows)))
    total = M.signed_margin_sum_partition(rows, w)
    return total.select((F.round("signed_sum", 4) + 0.0).alias("signed_sum"))


# ------------------------------------------------------------------ objectives


def _objective_queries(name):
    solver = name

    @query(f"{name}_objective", O.objective_sql(solver))
    def value(spark, sf):
        rows = embedding_rows(spark, sf)
        width = libsvm.feature_width(rows)
        return objective.objective(rows, rule_weights(spark, width), solver, 1.0, width).select(r6("f", "f"))

    @query(f"{name}_gradient", O.gradient_sql(solver))
    def grad(spark, sf):
        rows = embedding_rows(spark, sf)
        width = libsvm.feature_width(rows)
        return objective.gradient(rows, rule_weights(spark, width), solver, 1.0, width).select("j", r6("g", "g"))

    @query(f"{name}_hessvec", O.hessvec_sql(solver))
    def hess(spark, sf):
        rows = embedding_rows(spark, sf)
        width = libsvm.feature_width(rows)
        h = objective.hessian_vector(rows, weights_and_direction(spark, width), solver, 1.0, width)
        return h.select("j", r6("h", "h"))

    @query(f"{name}_strategies", O.strategies_sql(solver))
    def strategies(spark, sf):
        rows = embedding_rows(spark, sf)
        width = libsvm.feature_width(rows)
        weights = rule_weights(spark, width)
        by_join = objective.gradient(rows, weights, solver, 1.0, width, strategy="coo").select("j", F.col("g").alias("g_coo"))
        w = W.to_array(weights, width)
        with objective.Blocks(rows, width) as blocks:
            _, slope = blocks.loss_and_slope(get_loss(solver), w)
        by_task = W.from_array(spark, w + slope).withColumnRenamed("w", "g_partition")
        return by_join.join(by_task, "j").select("j", r6("g_coo", "g_coo"), r6("g_partition", "g_partition"))


for _solver in ("lr", "l2svm"):
    _objective_queries(_solver)


@query("lr_first_cg_step", O.first_step_sql())
def lr_first_cg_step(spark, sf):
    rows = embedding_rows(spark, sf)
    width = libsvm.feature_width(rows)
    zero = rule_weights(spark, width, 0, 1, 0)
    g = objective.gradient(rows, zero, "lr", 1.0, width)
    at_zero = g.select("j", F.lit(0.0).alias("w"), F.col("g").alias("s"))
    h = objective.hessian_vector(rows, at_zero, "lr", 1.0, width)
    both = g.join(h, "j").agg(F.sum(F.col("g") * F.col("g")).alias("gg"), F.sum(F.col("g") * F.col("h")).alias("ghg"))
    return both.select(r6("gg", "gg"), r6("ghg", "ghg"), r6(F.col("gg") / F.col("ghg"), "alpha"))


# Models of the multi-model queries: run r scales the rule weights by r.
MODEL_SCALES = (0, 1, 2, 3)


def model_table(spark, width):
    base = rule_weights(spark, width)
    return reduce(DataFrame.unionByName, (
        base.select(F.lit(f"run{s}").alias("run_id"), "j", (F.col("w") * s).alias("w")) for s in MODEL_SCALES))


@query("objective_grid", O.objective_grid_sql(MODEL_SCALES))
def objective_grid(spark, sf):
    rows = embedding_rows(spark, sf)
    width = libsvm.feature_width(rows)
    return sweep.objective_grid(rows, model_table(spark, width), "lr", 1.0, width).select("run_id", r6("f", "f"))


_MODEL_SCORES = (f"with {O.LINES}, {O.PARSED}, {O.EVENT_MARGIN}, {O.models(MODEL_SCALES)} "
                 "select run_id, row_id, label, round(m * scale, 6) + 0.0 as margin from scored, models")


@query("objective_grid_wide", O.objective_grid_sql(MODEL_SCALES))
def objective_grid_wide(spark, sf):
    rows = embedding_rows(spark, sf)
    width = libsvm.feature_width(rows)
    return sweep.objective_grid(rows, model_table(spark, width), "lr", 1.0, width, max_dense=0, span=SPAN).select("run_id", r6("f", "f"))


@query("model_counts", f"with {O.LINES}, {O.PARSED}, {O.EVENT_MARGIN}, {O.models(MODEL_SCALES)}, "
       "rounded as (select run_id, label, round(m * scale, 6) + 0.0 as margin from scored, models) "
       "select run_id, margin, (count(*) filter (label > 0))::bigint as pos, (count(*) filter (label <= 0))::bigint as neg from rounded group by 1, 2")
def model_counts(spark, sf):
    """Examples by margin of several models, counted in the tasks."""
    rows = stored_event_rows(spark, sf)
    w = W.to_array(rule_weights(spark, libsvm.feature_width(rows)))
    return M.model_counts(rows, {f"run{s}": w * s for s in MODEL_SCALES}, digits=6).select("run_id", r6("margin", "margin"), "pos", "neg")


@query("score_models", _MODEL_SCORES)
def score_models(spark, sf):
    rows = stored_event_rows(spark, sf)
    scored = M.score_models(rows, model_table(spark, libsvm.feature_width(rows)))
    return scored.select("run_id", "row_id", "label", r6("margin", "margin"))


@query("score_models_partition", _MODEL_SCORES)
def score_models_partition(spark, sf):
    rows = stored_event_rows(spark, sf)
    w = W.to_array(rule_weights(spark, libsvm.feature_width(rows)))
    scored = M.model_margins(rows, {f"run{s}": w * s for s in MODEL_SCALES})
    return scored.select("run_id", "row_id", "label", r6("margin", "margin"))


# ------------------------------------------------------------------------ fits

# Tight enough that two solvers agree on six digits.
TIGHT = 1e-7


def _fit_queries(solver):
    @query(f"tron_{solver}", O.optimum_sql(solver))
    def optimum(spark, sf):
        done = fit.fit(embedding_rows(spark, sf), solver, 1.0, TIGHT)
        return done.weights.select("j", (F.round("w", 5) + 0.0).alias("w"))

    @query(f"tron_{solver}_summary", O.optimum_summary_sql(solver))
    def summary(spark, sf):
        rows = embedding_rows(spark, sf)
        done = fit.fit(rows, solver, 1.0, TIGHT)
        scored = evaluate.evaluate(rows, done.w)
        return scored.select(
            F.lit(solver).alias("solver"), "n", r6("accuracy", "accuracy"), r6("auc", "auc"),
            r6(F.lit(done.result.f0), "f0"), r6(F.lit(done.result.g0_norm), "g0_norm"),
            (F.round(F.lit(done.result.f), 5) + 0.0).alias("f"))


for _solver in ("lr", "l2svm"):
    _fit_queries(_solver)


@query("tron_history")
def tron_history(spark, sf):
    runs = [fit.fit(embedding_rows(spark, sf), s, 1.0, 1e-3) for s in ("lr", "l2svm")]
    return reduce(DataFrame.unionByName, (r.history(spark) for r in runs))


@query("tron_coo", O.optimum_sql("lr"))
def tron_coo(spark, sf):
    """The same fit by joins and aggregations."""
    done = fit.fit(embedding_rows(spark, sf), "lr", 1.0, TIGHT, strategy="coo")
    return done.weights.select("j", (F.round("w", 5) + 0.0).alias("w"))


@query("tron_grid", O.optimum_sql("lr"))
def tron_grid(spark, sf):
    """The same fit with rows cut by feature ranges and every vector in slices."""
    done = fit.fit(embedding_rows(spark, sf), "lr", 1.0, TIGHT, strategy="grid", span=SPAN)
    return done.weights.select("j", (F.round("w", 5) + 0.0).alias("w"))


@query("tron_resumed", O.optimum_sql("lr"))
def tron_resumed(spark, sf):
    """A fit that is ended after two steps, and another one that goes on from what it stored."""
    rows, place = embedding_rows(spark, sf), scratch_path(spark, "states")
    fit.fit(rows, "lr", 1.0, TIGHT, max_iter=2, states=place)
    done = fit.fit(rows, "lr", 1.0, TIGHT, states=place)
    return done.weights.select("j", (F.round("w", 5) + 0.0).alias("w"))


@query("tron_table", O.optimum_sql("lr"))
def tron_table(spark, sf):
    """The same fit with every vector kept in a table."""
    done = fit.fit(embedding_rows(spark, sf), "lr", 1.0, TIGHT, strategy="table")
    return done.weights.select("j", (F.round("w", 5) + 0.0).alias("w"))


# Values of events run to hundreds: scaled, the optimum is found by a descent as well.
EVENT_SCALE, EVENT_C, EVENT_STEPS = 100.0, 0.01, 400


@query("tron_events", O.event_fit_sql(EVENT_SCALE, EVENT_C, EVENT_STEPS))
def tron_events(spark, sf):
    """Sparse text examples end to end: parse, scale, add a bias, fit, evaluate."""
    rows = stored_event_rows(spark, sf).withColumn("values", F.transform("values", lambda v: v / EVENT_SCALE))
    rows, width = libsvm.with_bias(rows, 1.0)
    done = fit.fit(rows, "lr", EVENT_C, TIGHT, n_features=width, bias=1.0)
    scored = evaluate.summarize(M.dense_margins(rows, done.w))
    return scored.select("n", r6("accuracy", "accuracy"), F.round("auc", 5).alias("auc"), F.round(F.lit(done.result.f), 4).alias("f"))


@query("sweep_report", O.sweep_sql())
def sweep_report(spark, sf):
    """A small grid, its thresholds and its test metrics: every model scored in the same pass."""
    rows = embedding_rows(spark, sf)
    done = sweep.sweep(rows, Cs=(0.1, 1.0), epss=(TIGHT,), reps=1)
    found = sweep.thresholds(rows, done.models)
    tested = sweep.report_on_test(rows, done.models, found)
    return tested.join(found, "run_id").select(
        "run_id", "n", r6("accuracy", "accuracy"), r6("auc", "auc"), r6("best_score", "best_score"))


@query("sweep_wide", O.sweep_sql())
def sweep_wide(spark, sf):
    """The same beyond the broadcast bound: no model and no vector of a fit is ever whole on the driver or in a task."""
    rows = embedding_rows(spark, sf)
    done = sweep.sweep(rows, Cs=(0.1, 1.0), epss=(TIGHT,), reps=1, max_dense=0, span=SPAN)
    found = sweep.thresholds(rows, done.models)
    return sweep.report_on_test(rows, done.models, found).join(found, "run_id").select(
        "run_id", "n", r6("accuracy", "accuracy"), r6("auc", "auc"), r6("best_score", "best_score"))


def split_embeddings(spark, sf):
    rows = materialize(split.three_way_split(embedding_rows(spark, sf), "row_id"), scratch_path(spark, "parts"))
    return [rows.where(F.col("split") == s).drop("split") for s in ("train", "val", "test")]


@query("sweep_split", O.split_sweep_sql())
def sweep_split(spark, sf):
    """A small grid fitted on 64 %, with thresholds from 16 % and tests on 20 % of the examples."""
    train, val, test = split_embeddings(spark, sf)
    done = sweep.sweep(train, Cs=(0.1, 1.0), epss=(TIGHT,), reps=1, n_features=64)
    found = sweep.thresholds(val, done.models)
    return sweep.report_on_test(test, done.models, found).join(found, "run_id").select(
        "run_id", "n", r6("accuracy", "accuracy"), r6("auc", "auc"), r6("best_score", "best_score"))


@query("sweep_grid", O.converged_sql(sweep.SOLVERS, sweep.C_GRID, sweep.EPS_GRID, sweep.REPETITIONS))
def sweep_grid(spark, sf):
    """The whole default grid on the same parts: every fit starts at the loss of 0, gets better, and ends at its tolerance.

    The gradients at the ends are computed anew, from the weights as a table.
    """
    train, val, test = split_embeddings(spark, sf)
    done = sweep.sweep(train, n_features=libsvm.feature_width(train))
    report = sweep.report_on_test(test, done.models, sweep.thresholds(val, done.models))
    with objective.Blocks(train, done.fits[0].n_features) as blocks:
        asked = [(get_loss(f.config["solver"]), "value", w) for f in done.fits for w in (f.w, 0 * f.w)]
        sums = blocks.answers(asked)
    facts = []
    for f, (_, slope), (loss, slope0) in zip(done.fits, sums[::2], sums[1::2]):
        C, eps = f.config["C"], f.config["eps"]
        norm, norm0 = (float((x @ x) ** 0.5) for x in (f.w + C * slope, C * slope0))
        facts.append((f.tag, round(C * loss, 6), norm <= eps * max(1.0, norm0) * (1 + 1e-6), f.result.f < f.result.f0))
    return report.select("run_id", "n").join(spark.createDataFrame(facts, "run_id string, f0 double, converged boolean, better boolean"), "run_id")


@query("mllib_lr", O.baseline_sql())
def mllib_lr(spark, sf):
    rows = embedding_rows(spark, sf)
    width = libsvm.feature_width(rows)
    done = baseline.fit_lr(baseline.to_ml(rows, width), 1.0, 200, 1e-12)
    f = objective.objective(rows, W.from_array(spark, done.w), "lr", 1.0, width)
    return f.select((F.round("f", 3) + 0.0).alias("f"))


@query("mllib_linsvc", O.hinge_sql())
def mllib_linsvc(spark, sf):
    rows = embedding_rows(spark, sf)
    ml = baseline.to_ml(rows, libsvm.feature_width(rows))
    done = baseline.fit_linsvc(ml, tol=1e-12)
    scores = materialize(baseline.ml_scores(done.model, ml), scratch_path(spark, "hinge-scores"))
    inside = scores.agg((F.max(F.col("label") * F.col("margin")) < 1).alias("all_inside"))
    return evaluate.summarize(scores).select("n", r6("accuracy", "accuracy"), r6("auc", "auc")).crossJoin(F.broadcast(inside))


@query("mllib_curve", O.curve_sql(baseline.ITERATION_GRID))
def mllib_curve(spark, sf):
    """Objectives by iteration limit: never worse with more iterations, and from 20 on those of the optimum."""
    points = baseline.lr_curve(embedding_rows(spark, sf), tol=1e-12)
    before = F.lag("f").over(Window.partitionBy(F.lit(0)).orderBy("max_iter"))
    return points.select("max_iter", (F.coalesce(before, F.col("f")) >= F.col("f") - 1e-6).alias("decreasing"),
                         F.when(F.col("max_iter") >= 20, F.round("f", 3) + F.lit(0.0)).alias("f"))


@query("strategy_timings", O.strategies_timed_sql("lr"))
def strategy_timings(spark, sf):
    """Both strategies through one fit, timed, written and read back: the same objective in every iteration."""
    path = scratch_path(spark, "strategies")
    compare.time_strategies(embedding_rows(spark, sf), path, "lr", 1.0, TIGHT)
    read = runlogs.read_timings(spark, path, one_per_file=False)
    other = read.select(F.col("strategy").alias("_s"), "iter", F.col("f").alias("_f"), F.col("t_sec").alias("_t"))
    both = read.join(other, "iter", "left").where(F.col("_s") != F.col("strategy"))
    step = Window.partitionBy("strategy").orderBy("iter")
    better = F.coalesce(F.lag("f").over(step) >= F.col("f") - 1e-9, F.lit(True))
    return both.withColumn("better", better).groupBy("strategy").agg(
        (F.round(F.max_by("f", "iter"), 5) + F.lit(0.0)).alias("f"), F.every("better").alias("decreasing"),
        F.every(F.abs(F.col("f") - F.col("_f")) <= 1e-9 * F.abs("f")).alias("agrees"))


@query("ml_vectors", f"with {O.DOCUMENTS} select row_id, label, j, round(v, 6) + 0.0 as v from doc_coo")
def ml_vectors(spark, sf):
    """Rows to ML vectors and back."""
    rows = document_rows(spark, sf)
    return stored(baseline.vector_rows(baseline.to_ml(rows, libsvm.feature_width(rows))))


# ------------------------------------------------------------------ evaluation


@query("predict", f"with {O.EVENT_SCORES} select row_id, label, margin, "
       "case when margin >= 0.25 then 1.0::double else -1.0 end as prediction from scores")
def predict(spark, sf):
    return metrics.predict(event_scores(spark, sf), 0.25)


@query("accuracy", f"with {O.EVENT_SCORES} select count(*) as n, "
       "round(avg(case when (margin >= 0) = (label > 0) then 1.0::double else 0.0 end), 6) as accuracy from scores")
def accuracy(spark, sf):
    return metrics.accuracy(metrics.predict(event_scores(spark, sf))).select("n", r6("accuracy", "accuracy"))


@query("confusion_f1", O.confusion_sql())
def confusion_f1(spark, sf):
    c = metrics.confusion(metrics.predict(event_scores(spark, sf)))
    return c.select("tp", "fp", "fn", "tn", r6("precision", "precision"), r6("recall", "recall"), r6("f1", "f1"))


@query("roc_auc", f"with {O.EVENT_SCORES}, {O.RANKED} select sum(pos)::bigint as n_pos, sum(neg)::bigint as n_neg, "
       "round(sum(pos * (below + neg / 2.0::double)) / (sum(pos) * sum(neg)), 6) as auc from ranked")
def roc_auc(spark, sf):
    return metrics.roc_auc(event_scores(spark, sf)).select("n_pos", "n_neg", r6("auc", "auc"))


@query("roc_auc_value", O.auc_value_sql())
def roc_auc_value(spark, sf):
    return metrics.roc_auc(value_scores(spark, sf)).select("n_pos", "n_neg", r6("auc", "auc"))


def value_scores(spark, sf):
    e = tables.table(spark, sf, "events")
    positive = F.col("event_type").isin(*tables.POSITIVE_EVENTS)
    return e.select(
        F.col("event_id").alias("row_id"), F.when(positive, 1.0).otherwise(-1.0).alias("label"),
        F.col("value").alias("margin"), (F.col("user_id") % 10).cast("string").alias("run_id"))


@query("roc_auc_by_run", O.auc_by_run_sql())
def roc_auc_by_run(spark, sf):
    return metrics.roc_auc(value_scores(spark, sf), ["run_id"]).select("run_id", "n_pos", "n_neg", r6("auc", "auc"))


@query("threshold_curve", f"with {O.EVENT_SCORES}, {O.RANKED}, {O.CURVE} select margin, n_pos, n_neg, tp, fp, fn, tn from curve")
def threshold_curve(spark, sf):
    return metrics.threshold_curve(event_scores(spark, sf))


@query("best_threshold_acc", O.best_threshold_sql("acc"))
def best_threshold_acc(spark, sf):
    best = metrics.best_threshold(event_scores(spark, sf), "acc")
    return best.select("metric", r6("best_threshold", "best_threshold"), r6("best_score", "best_score"))


@query("best_threshold_f1", O.best_threshold_sql("f1"))
def best_threshold_f1(spark, sf):
    best = metrics.best_threshold(event_scores(spark, sf), "f1")
    return best.select("metric", r6("best_threshold", "best_threshold"), r6("best_score", "best_score"))


@query("evaluate", O.evaluate_sql())
def evaluate_query(spark, sf):
    """The flagship: text lines, tolerant parse, margins of a fixed model, accuracy and AUC."""
    rows = stored_event_rows(spark, sf)
    width = libsvm.feature_width(rows)
    done = evaluate.evaluate(rows, rule_weights(spark, width))
    return done.select("n", r6("accuracy", "accuracy"), r6("auc", "auc"))


# ---------------------------------------------------------------------- splits


@query("exact_split", f"with {O.SPLIT} select o_orderkey, case when rn <= k then 'train' else 'test' end as split from placed")
def exact_split(spark, sf):
    orders = tables.table(spark, sf, "orders")
    return split.exact_split(orders, "o_orderkey", 0.8, 42).select("o_orderkey", "split")


@query("three_way_split", O.three_way_sql())
def three_way_split(spark, sf):
    return split.three_way_split(tables.table(spark, sf, "orders"), "o_orderkey").select("o_orderkey", "split")


_LINE_SPLIT = """counted as (select l_orderkey as k, count(*) as n, md5(concat(l_orderkey, ':', 42)) as h from lineitem group by 1),
upto as (select *, sum(n) over (order by h, k) as upto, floor(0.8::double * (sum(n) over ())) as cut from counted)
select k as l_orderkey, greatest(least(cut - (upto - n), n), 0)::bigint as n_train, n as n_all from upto"""


@query("split_repeated_keys", f"with {_LINE_SPLIT}")
def split_repeated_keys(spark, sf):
    """An exact split of lines by a key that several lines share: how many of each key's lines come first."""
    done = split.exact_split(tables.table(spark, sf, "lineitem"), "l_orderkey", 0.8, 42)
    return done.groupBy("l_orderkey").agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count("*").alias("n_all"))


@query("seeded_order", "select o_orderkey, md5(concat(o_orderkey, ':', 42)) as position from orders")
def seeded_order(spark, sf):
    orders = tables.table(spark, sf, "orders")
    return split.seeded_order(orders, "o_orderkey", 42).select(
        "o_orderkey", split.seeded_hash("o_orderkey", 42).alias("position"))


# ------------------------------------------------------------------- run logs


def history(spark, sf):
    return tables.event_history(events(spark, sf))


@query("elapsed", f"with {O.HISTORY} select run_id, iter, round(t_sec - min(t_sec) over (partition by run_id), 3) + 0.0 as elapsed from history")
def elapsed(spark, sf):
    return curves.elapsed(history(spark, sf)).select("run_id", "iter", (F.round("elapsed", 3) + 0.0).alias("elapsed"))


@query("curve_summary", O.curve_summary_sql())
def curve_summary(spark, sf):
    return reports.compare_curves(history(spark, sf)).select(
        "run_id", "n_points", "f_min", "f_first", "f_last", "f_best")


def _gap_query(variant):
    @query(f"relative_gap_{variant}", O.gap_sql(variant))
    def gap(spark, sf):
        return curves.relative_gap(history(spark, sf), variant).select("run_id", "iter", r6("gap", "gap"))


for _variant in ("v1", "v2", "v3", "v4", "v5"):
    _gap_query(_variant)


@query("cumulative_time", f"with {O.HISTORY} select run_id, iter, "
       "round(sum(f) over (partition by run_id order by iter), 4) as t_cum from history")
def cumulative_time(spark, sf):
    points = history(spark, sf).select("run_id", "iter", "f")
    timed = curves.cumulative(points, "f", "iter", ["run_id"], "t_cum")
    return timed.select("run_id", "iter", F.round("t_cum", 4).alias("t_cum"))


@query("run_parse_tag", O.parse_tag_sql())
def run_parse_tag(spark, sf):
    h = tables.event_history(events(spark, sf)).select("run_id", "tag").distinct()
    path = F.concat(F.lit("/logs/r"), F.col("run_id"), F.lit("/metrics_"), F.col("tag"), F.lit(".json"))
    tag = tags.run_tag(path)
    base = tags.base_tag(tag)
    configured = F.when(F.col("run_id").cast("int") % 3 == 0, F.lit("")).when(F.col("run_id").cast("int") % 3 == 1, F.lit("mllib"))
    return h.select(
        "run_id", tag.alias("tag"), tags.run_folder(path).alias("dir"), base.alias("base"),
        tags.solver_name(configured, tag).alias("solver"),
        tags.c_from_tag(base).alias("C"), tags.short_label(base).alias("label"))


def noisy_runs(spark, sf):
    """Events as single runs; an error event has no objective."""
    h = tables.event_history(events(spark, sf).withColumn(
        "value", F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))))
    return h.select(
        F.concat(F.lit("/logs/"), F.col("iter")).alias("path"), F.lit("/logs").alias("dir"), "tag",
        tags.base_tag(F.col("tag")).alias("base"), tags.solver_name(F.lit(None).cast("string"), F.col("tag")).alias("solver"),
        F.col("g_norm").alias("time_sec"), F.col("f").alias("final_f"))


@query("run_group_stats", O.group_stats_sql())
def run_group_stats(spark, sf):
    stats = reports.time_and_objective(noisy_runs(spark, sf))
    return stats.select("base", "solver", "C", "label", "n", *(
        r6(c, c) for c in ("time_sec_mean", "time_sec_std", "final_f_mean", "final_f_std")))


def user_runs(spark, sf):
    users = events(spark, sf).select("user_id").distinct()
    return users.select(
        F.concat(F.lit("d"), F.col("user_id") % 3).alias("dir"), F.concat(F.lit("t"), F.col("user_id")).alias("tag"),
        F.concat(F.lit("w_"), F.col("user_id") * 20).alias("weights_path"))


@query("run_threshold_join", O.threshold_join_sql())
def run_threshold_join(spark, sf):
    s = tables.table(spark, sf, "supplier")
    found = s.select(
        F.concat(F.lit("d"), F.col("s_suppkey") % 3).alias("dir"), F.concat(F.lit("t"), F.col("s_suppkey")).alias("tag"),
        F.col("s_acctbal").alias("best_threshold"))
    return reports.with_thresholds(user_runs(spark, sf), found).select("dir", "tag", r6("threshold", "threshold"))


@query("run_weights_join", O.weights_join_sql())
def run_weights_join(spark, sf):
    available = tables.table(spark, sf, "customer").select(F.concat(F.lit("w_"), F.col("c_custkey")).alias("weights_id"))
    own = tables.table(spark, sf, "supplier").select(
        F.concat(F.lit("d"), F.col("s_suppkey") % 3).alias("dir"), F.concat(F.lit("t"), F.col("s_suppkey")).alias("tag"),
        F.concat(F.lit("own_"), F.col("s_suppkey")).alias("weights_id"))
    return reports.with_weights(user_runs(spark, sf), available, own).select("dir", "tag", "weights_id")


@query("convergence_report", O.convergence_sql())
def convergence_report(spark, sf):
    h = history(spark, sf)
    # Runs without times: NaN in some, null in others.
    run = F.col("run_id").cast("int")
    h = h.withColumn("t_sec", F.when(run % 7 == 0, F.lit(float("nan"))).when(run % 7 == 1, F.lit(None)).otherwise(F.col("t_sec")))
    solvers = h.select("run_id", tags.solver_name(F.lit(None).cast("string"), F.col("tag")).alias("solver")).distinct()
    return reports.convergence(h, solvers).select(
        "run_id", "solver", F.round("t_sec", 3).alias("t_sec"), "f", "g_norm")


@query("finite_points", O.finite_points_sql())
def finite_points(spark, sf):
    h = history(spark, sf)
    broken = (
        F.when(F.col("g_norm") < 10, F.lit(float("nan"))).when(F.col("g_norm") > 90, F.lit(float("-inf")))
        .otherwise(F.col("f")))
    kept = runlogs.finite_points(h.withColumn("f", broken))
    return kept.groupBy("run_id").agg(F.count("*").alias("n"), r6(F.sum("f"), "total"))


# ----------------------------------------------------------------- round trips


@query("libsvm_roundtrip", f"with {O.LINES}, {O.PARSED} {O.STORED_ANONYMOUS}")
def libsvm_roundtrip(spark, sf):
    """Rows to text files and back; the file has no keys, so entries are compared as a bag."""
    path = scratch_path(spark, "lines")
    sinks.write_libsvm(event_rows(spark, sf), path)
    rows, _ = libsvm.read_libsvm(spark, path)
    return stored(rows).groupBy("label", "j", "v").agg(F.count("*").alias("n"))


@query("strict_libsvm_reader", f"with {O.LINES}, {O.PARSED} {O.STORED_NONZERO}")
def strict_libsvm_reader(spark, sf):
    path = scratch_path(spark, "strict")
    sinks.write_libsvm(event_rows(spark, sf), path)
    ml = libsvm.read_strict(spark, path).withColumn("row_id", F.lit(0).cast("bigint"))
    return stored(baseline.vector_rows(ml)).groupBy("label", "j", "v").agg(F.count("*").alias("n"))


@query("row_ids", "select count(*) as n, count(*) as n_ids, 0::bigint as first_id, count(*) - 1 as last_id from events")
def row_ids(spark, sf):
    """Dense ids of text lines in scan order."""
    path = scratch_path(spark, "ids")
    sinks.write_lines(tables.event_lines(events(spark, sf)), path)
    ids = libsvm.with_row_id(libsvm.read_lines(spark, path))
    distinct = ids.groupBy("row_id").agg(F.count("*").alias("k"))
    return distinct.agg(
        F.sum("k").alias("n"), F.count("*").alias("n_ids"), F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id"))


@query("row_ids_by_file", f"with {O.LINES} select row_number() over (order by row_id) - 1 as row_id, value from lines")
def row_ids_by_file(spark, sf):
    """Line numbers over several files that are read in small pieces: those of the lines in the order of the paths."""
    path = scratch_path(spark, "ordered-lines")
    lines = tables.event_lines(events(spark, sf))
    lines.repartitionByRange(5, "row_id").sortWithinPartitions("row_id").select("value").write.text(path)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        return materialize(libsvm.numbered_lines(spark, path).select("row_id", "value"), scratch_path(spark, "numbered"))
    finally:
        spark.conf.set(key, before)


def _write_folders(df, folder, path):
    """A folder of JSON lines for each value of a column.

    Making a folder takes far longer than its few bytes tell, so the number of tasks is given: by size alone, Spark
    would leave them all to one, as it would if rows that lie by the column already were dealt by it again. A task
    also moves its own folders to their place, not the driver all of them.
    """
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartition(tasks, F.xxhash64(folder))
    writer = dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.partitionBy(folder).json(path)


@query("run_order", "select row_number() over (order by cast(user_id as varchar)) - 1 as position, cast(user_id as varchar) as name "
       "from (select distinct user_id from events)")
def run_order(spark, sf):
    """Runs of many folders by their paths."""
    path = scratch_path(spark, "many-runs")
    runs = events(spark, sf).select(F.col("user_id").cast("string").alias("user")).distinct().select(
        "user", F.lit(None).cast("string").alias("tag"), *(F.lit(None).cast(RUNS[n].dataType).alias(n) for n in RUNS.names if n != "meta"),
        _record(META, {"mode": F.lit("test")}).alias("meta"))
    _write_folders(runs, "user", path)
    read = runlogs.in_path_order(runlogs.read_runs(spark, path, one_per_file=False))
    return read.select("position", F.regexp_extract("dir", "user=([^/]*)", 1).alias("name"))


@query("weights_roundtrip", O.weights_roundtrip_sql(MODEL_SCALES))
def weights_roundtrip(spark, sf):
    path = scratch_path(spark, "weights")
    sinks.write_weights(model_table(spark, libsvm.feature_width(event_rows(spark, sf))), path)
    w = W.read_weights(spark, path)
    return w.groupBy("run_id").agg(
        (F.max("j") + 1).alias("width"), r6(F.sum(F.col("w") * F.col("w")), "norm2"))


@query("threshold_roundtrip", O.best_threshold_sql("f1"))
def threshold_roundtrip(spark, sf):
    path = scratch_path(spark, "threshold")
    sinks.write_records(metrics.best_threshold(event_scores(spark, sf), "f1"), path)
    found = runlogs.read_thresholds(spark, f"{path}/*.json")
    return found.select("metric", r6("best_threshold", "best_threshold"), r6("best_score", "best_score"))


# Events per run of the run-log query, as many as a fit has iterations at most.
RUN_LENGTH = 100


def event_runs(spark, sf):
    """RUNS records of consecutive events: the events are the iterations of their run."""
    steps = {
        "iter": (F.col("event_id") % RUN_LENGTH).cast("int"), "f": F.col("value"),
        "g_norm": F.get_json_object("props", "$.k").cast("double"),
    }
    run = F.floor(F.col("event_id") / RUN_LENGTH)
    solver = F.when(run % 2 == 0, F.lit("lr")).otherwise(F.lit("l2svm"))
    tag = F.concat(solver, F.lit("_run"), run.cast("string"))
    step = _record(STEP, steps)
    # The event id is unique, hence a list has at most RUN_LENGTH elements.
    runs = events(spark, sf).groupBy(tag.alias("tag"), run.alias("run")).agg(
        F.sort_array(F.collect_list(step)).alias("history"), F.max_by("value", "event_id").alias("final_f"))
    return runs.select(
        "tag",
        _record(META, {"mode": F.lit("test"), "timestamp_utc": tags.utc_stamp()}).alias("meta"),
        # Some logs lack a bias, and some the final objective.
        _record(CONFIG, {"bias": F.when(F.col("run") % 3 != 0, F.lit(1.0))}).alias("config"),
        _record(SUMMARY, {"final_f": F.when(F.col("run") % 5 != 0, F.col("final_f")), "time_sec": F.lit(float(RUN_LENGTH - 1))}).alias("summary"),
        "history")


def _record(schema, given):
    return F.struct(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


@query("runlog_roundtrip", O.runlog_sql())
def runlog_roundtrip(spark, sf):
    path = scratch_path(spark, "runs")
    sinks.write_runs(event_runs(spark, sf), path)
    logs = runlogs.read_runs(spark, path, one_per_file=False)
    # A missing number is NaN, which is no value to compare.
    flat = reports.flat_runs(logs).select("tag", "solver", tags.nan_as_null(F.col("final_f")).alias("final_f"), "bias")
    points = runlogs.run_history(logs).where(F.col("t_sec") == F.col("iter")).groupBy(F.col("run_id").alias("tag")).agg(
        F.count("*").alias("n"), r6(F.sum("f"), "total"))
    return flat.join(points, "tag").select("tag", "solver", "final_f", "bias", "n", "total")


# Runs of the stored-run report: tag, factor of the rule weights (none: no stored weights), bias, threshold.
STORED_RUNS = (
    ("lr_C1_eps0.01_bias1_rep1", 1, 1.0, 0.2505), ("lr_C1_eps0.01_bias1_rep2", 2, 0.5, -0.1305),
    ("l2svm_C0.1_eps0.01_bias-1_rep1", 3, -1.0, None), ("l2svm_C0.1_eps0.01_bias-1_rep2", 1, -1.0, 0.1005),
    ("lr_C10_eps0.01_bias-1_rep1", None, -1.0, 0.5),
)


@query("stored_run_report", O.stored_runs_sql(STORED_RUNS))
def stored_run_report(spark, sf):
    """Run logs, thresholds and weights, written and read back, to accuracy and AUC by configuration."""
    rows = stored_event_rows(spark, sf)
    width = libsvm.feature_width(rows)
    path = scratch_path(spark, "stored-runs")
    runs = spark.createDataFrame([(t, f"w{s}", b) for t, s, b, _ in STORED_RUNS], "tag string, weights_id string, bias double")
    sinks.write_runs(runs.select(
        "tag", _record(META, {}).alias("meta"), _record(CONFIG, {"bias": F.col("bias")}).alias("config"),
        _record(SUMMARY, {"weights_path": F.col("weights_id")}).alias("summary"),
        F.lit(None).cast(RUNS["history"].dataType).alias("history")), f"{path}/logs")
    base = rule_weights(spark, width + 1)
    sinks.write_weights(reduce(DataFrame.unionByName, (
        base.select(F.lit(f"w{s}").alias("weights_id"), "j", (F.col("w") * s).alias("w"))
        for s in sorted({s for _, s, _, _ in STORED_RUNS if s}))), f"{path}/weights", width + 1)
    logs = runlogs.read_runs(spark, f"{path}/logs", one_per_file=False)
    cuts = spark.createDataFrame([(t, c) for t, _, _, c in STORED_RUNS if c is not None], "tag string, best_threshold double")
    cuts = logs.select("dir", "tag").join(cuts, "tag")
    return stored_runs.report(rows, logs, cuts, W.read_weights(spark, f"{path}/weights"), digits=9).select(
        "base", "C", "label", "n", *(r6(c, c) for c in ("accuracy_mean", "accuracy_std", "auc_mean", "auc_std")))


@query("timing_roundtrip", O.timing_sql())
def timing_roundtrip(spark, sf):
    """Event types as repetitions of two strategies."""
    e = events(spark, sf)
    strategy = F.when(F.col("user_id") % 2 == 0, F.lit("map")).otherwise(F.lit("mappart"))
    timed = e.groupBy(strategy.alias("strategy"), F.length("event_type").alias("iter")).agg(
        F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"), 6).alias("t_sec"),
        F.count("*").cast("double").alias("f"))
    path = scratch_path(spark, "timings")
    sinks.write_timings(timed, path)
    return runlogs.read_timings(spark, path, one_per_file=False).select("strategy", F.col("iter").cast("bigint").alias("iter"), r6("t_sec", "t_sec"), "f")
