"""Wide models: the grid of row blocks and feature ranges, sliced vectors, fits and sweeps on them."""

import gc
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparselin.functions import losses
from sparselin.operators import grid as G
from sparselin.operators import matvec as M
from sparselin.plans import evaluate, fit, sweep
from sparselin.plans import vectors as V
from sparselin.sources import weights as W

SPAN, CELL = 8, 3000


@pytest.fixture(scope="module")
def grid(random_rows):
    made = G.Grid(random_rows[0], 30, SPAN, CELL)
    yield made
    made.close()


def dense(df, n, name="w"):
    out = np.zeros(n)
    for r in df.collect():
        out[r["j"]] += r[name]
    return out


def test_slices_of_a_vector(spark):
    rng = np.random.default_rng(1)
    w = np.where(rng.random(30) < 0.5, rng.normal(size=30), 0.0)
    w[8:16] = 0.0
    slices = G.sliced(W.from_array(spark, w).where("w <> 0"), SPAN)
    rows = {r["span"]: r for r in slices.collect()}
    assert set(rows) == {0, 2, 3}
    assert sum(r["square"] for r in rows.values()) == pytest.approx(w @ w) and max(r["largest"] for r in rows.values()) == np.abs(w).max()
    assert dense(G.unsliced(slices, SPAN), 30) == pytest.approx(w)


def test_rows_are_cut_once(random_rows, grid):
    rows, X, _ = random_rows
    pieces = grid.pieces.collect()
    assert sum(len(p["v"]) // 8 for p in pieces) == (X != 0).sum()
    # The feature that every row has makes its range fall into several cells.
    assert grid.cells.where("span = 0").first()["salts"] > 1
    assert len({p["salt"] for p in pieces if p["span"] == 0}) > 1


@pytest.mark.parametrize("asks", [1, 40])
def test_margins_without_an_exchange_of_entries(spark, random_rows, asks):
    rows, X, y = random_rows
    w = np.linspace(-1, 1, 30)
    table = W.from_array(spark, w).crossJoin(spark.range(asks).withColumnRenamed("id", "ask")).withColumn("w", F.col("w") * (F.col("ask") + 1))
    scores = G.wide_margins(rows, table, 30, asks, SPAN)
    got = {(r["ask"], r["row_id"]): (r["label"], r["margin"]) for r in scores.collect()}
    assert len(got) == 200 * asks and {k for k, _ in got} == set(range(asks))
    for k in {0, asks - 1}:
        assert [got[k, i][1] for i in range(200)] == pytest.approx(list((k + 1) * X @ w))
        assert [got[k, i][0] for i in range(200)] == list(y)


def test_the_plan_of_a_pass_moves_no_entries(spark, grid):
    plan = grid.margins(G.sliced(W.from_array(spark, np.ones(30)), SPAN))._jdf.queryExecution().executedPlan().toString()
    live, cached = [], None
    for line in plan.split("\n"):
        depth = len(line) - len(line.lstrip(" :+-*"))
        if cached is not None and depth > cached:
            continue
        cached = depth if "InMemoryRelation" in line else None
        live.append(line)
    # Slices to the cells, partial margins to the blocks; never a piece.
    exchanges = [x for x in live if "Exchange hashpartitioning" in x]
    assert 0 < len(exchanges) <= 3 and "InMemoryTableScan" in plan
    below = [live[i + 1] for i, x in enumerate(live) if "Exchange hashpartitioning" in x]
    assert not any("InMemoryTableScan" in x for x in below)


@pytest.mark.parametrize("solver", ["lr", "l2svm"])
def test_passes_equal_numpy(spark, random_rows, grid, solver):
    rows, X, y = random_rows
    loss = losses.get_loss(solver)
    rng = np.random.default_rng(2)
    w, s = rng.normal(size=30), rng.normal(size=30)
    vectors = G.sliced(W.from_array(spark, w), SPAN).unionAll(
        G.sliced(W.from_array(spark, w), SPAN).withColumn("ask", F.lit(2))).unionAll(
        G.sliced(W.from_array(spark, s), SPAN).withColumn("ask", F.lit(3)))
    sums = grid.sums(vectors, [(loss, "value"), (loss, "product")], [2.0, 1.0])
    heads = {r["ask"]: np.frombuffer(r["x"])[0] for r in sums.where(F.col("span") == G.HEAD).collect()}
    m = X @ w
    assert heads == {0: pytest.approx(loss.value(m, y, np).sum())}
    table = G.unsliced(sums.where("span >= 0"), SPAN, "z")
    assert dense(table.where("ask = 0"), 30, "z") == pytest.approx(2 * X.T @ loss.residual(m, y, np))
    assert dense(table.where("ask = 1"), 30, "z") == pytest.approx(X.T @ (loss.curvature(m, y, np) * (X @ s)))
    assert grid.losses(G.sliced(W.from_array(spark, w), SPAN), loss, 2) == pytest.approx(
        [loss.value(m, y, np).sum(), loss.value(0 * m, y, np).sum()])


def test_grid_fits_equal_dense_ones(random_rows, bias=1.0):
    from sparselin.sources.libsvm import with_bias
    rows, width = with_bias(random_rows[0], bias)
    one = fit.fit(rows, "lr", 0.5, 1e-2, strategy="partition", bias=bias)
    wide = fit.fit(rows, "lr", 0.5, 1e-2, strategy="grid", span=SPAN, bias=bias)
    assert wide.w is None and wide.n_features == width == one.n_features
    assert dense(wide.weights, width) == pytest.approx(one.w, abs=1e-9)
    assert [h["cg"] for h in wide.result.history] == [h["cg"] for h in one.result.history]
    assert wide.result.f == pytest.approx(one.result.f) and wide.result.reason == one.result.reason


def test_vectors_are_deleted_when_nothing_uses_them(spark, random_rows):
    fits = V.SlicedFits(random_rows[0], 30, SPAN)
    a, = fits._keep(G.weighted_sums(G.sliced(W.from_array(spark, np.ones(30)), SPAN).select(
        "ask", "span", F.lit(1.0).alias("scale"), "x", F.lit(False).alias("partner"))), 1)[0]
    (b,), = fits._combine([[(a, 2.0, a, "step")]])
    assert (a.square, a.largest, b.square, b.largest) == (30.0, 1.0, 270.0, 3.0)
    zero = V.SlicedVector()
    assert fits._dots([[(a, b), (a, a)], [(b, zero)]]) == [[90.0, 30.0], [0.0]]
    path = a.stored.df.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    assert Path(path).exists()
    del a, zero
    gc.collect()
    assert not Path(path).exists()
    fits.close()


def test_auto_takes_the_grid_beyond_the_bound(random_rows, monkeypatch):
    rows, *_ = random_rows
    one = fit.fit(rows, "l2svm", 0.5, 1e-1)
    for module in (fit, evaluate, M):
        monkeypatch.setattr(module, "MAX_BROADCAST_FEATURES", 10)
    wide = fit.fit(rows, "l2svm", 0.5, 1e-1)
    assert (one.strategy, wide.strategy) == ("partition", "grid")
    assert dense(wide.weights, 30) == pytest.approx(one.w, abs=1e-9)
    monkeypatch.undo()
    want = evaluate.evaluate(rows, one).first()
    monkeypatch.setattr(evaluate, "MAX_BROADCAST_FEATURES", 10)
    assert evaluate.evaluate(rows, wide).first() == want


def test_sweep_beyond_the_bound(spark, random_rows):
    rows, *_ = random_rows
    grid = {"Cs": (1e-2, 1.0), "epss": (1e-1,), "reps": 2, "bias": 1.0}
    near = sweep.sweep(rows, **grid)
    far = sweep.sweep(rows, max_dense=0, span=SPAN, **grid)
    assert {f.strategy for f in near.fits} == {"partition"} and {f.strategy for f in far.fits} == {"grid"}
    for a, b in zip(near.fits, far.fits):
        assert a.tag == b.tag and dense(b.weights, 31) == pytest.approx(a.w, abs=1e-9) and a.result.iters == b.result.iters
    cuts = [sweep.thresholds(rows, x.models, 1.0).orderBy("run_id").collect() for x in (near, far)]
    reports = [sweep.report_on_test(rows, x.models, None, 1.0).orderBy("run_id").collect() for x in (near, far)]
    for a, b in zip(cuts[0] + reports[0], cuts[1] + reports[1]):
        assert a["run_id"] == b["run_id"] and list(a)[-2:] == pytest.approx(list(b)[-2:], abs=1e-6)
    assert far.weights(spark).select("run_id").distinct().count() == far.runs(spark).count() == 8


def test_objectives_of_models_beyond_the_bound(spark, random_rows):
    rows, X, y = random_rows
    loss = losses.get_loss("l2svm")
    rng = np.random.default_rng(3)
    models = {f"m{k}": rng.normal(size=30) for k in range(3)}
    table = sweep.reduce(lambda a, b: a.unionByName(b), (W.from_array(spark, w, n) for n, w in models.items()))
    want = {n: 0.5 * w @ w + 0.7 * loss.value(X @ w, y, np).sum() for n, w in models.items()}
    for width, limit in ((30, None), (None, None), (30, 0), (None, 0)):
        got = {r["run_id"]: r["f"] for r in sweep.objective_grid(rows, table, "l2svm", 0.7, width, limit, SPAN).collect()}
        assert got == {n: pytest.approx(f) for n, f in want.items()}


@pytest.mark.parametrize("held", [1 << 20, 3])
def test_margins_are_counted_in_the_tasks(random_rows, held):
    rows, X, y = random_rows
    models = {"a": np.round(np.linspace(-1, 1, 30), 1), "b": np.zeros(20)}
    counted = M.model_counts(rows, models, digits=0, held=held)
    got = {(r["run_id"], r["margin"]): (r["pos"], r["neg"]) for r in counted.collect()}
    want = {}
    for name, w in models.items():
        for m, label in zip(np.round(X[:, :len(w)] @ w, 0) + 0.0, y):
            pos, neg = want.get((name, float(m)), (0, 0))
            want[name, float(m)] = (pos + (label > 0), neg + (label <= 0))
    assert got == want


def test_a_task_ships_each_margin_once(random_rows):
    rows, X, _ = random_rows
    sent = {}
    plan = M.model_counts(rows, {"a": np.ones(30), "b": np.zeros(30)}, digits=0)
    plan.collect()
    from pyspark.sql import functions as F
    for k, part in enumerate(rows.withColumn("p", F.spark_partition_id()).select("p", "row_id").collect()):
        sent.setdefault(part["p"], set()).add(float(np.round(X[part["row_id"]].sum(), 0)))
    most = sum(len(x) + 1 for x in sent.values())
    sizes = [n.metrics().apply("shuffleRecordsWritten").value() for n in exchanges(plan._jdf.queryExecution().executedPlan())]
    assert sizes and max(sizes) <= most


def exchanges(plan):
    """The shuffles of an executed plan, adaptive or not."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return exchanges(plan.finalPhysicalPlan())
    if "QueryStageExec" in name:
        return exchanges(plan.plan())
    children = plan.children()
    below = [x for i in range(children.size()) for x in exchanges(children.apply(i))]
    return ([plan] if name == "ShuffleExchangeExec" else []) + below
