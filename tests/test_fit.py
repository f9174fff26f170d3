"""Solver, fits, sweeps and baselines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparselin import sinks
from sparselin.functions.losses import get_loss
from sparselin.plans import baseline, evaluate, fit, newton, sweep
from sparselin.plans.vectors import TableProblem, _Dense
from sparselin.schema import ROWS
from sparselin.session import scratch_path
from sparselin.sources import libsvm, tables, weights

# Independent plain Newton solutions on embeddings of sf0.01, C = 1: f(0), ‖g(0)‖, f*, accuracy, AUC and,
# per tolerance, outer and inner iterations.
GOLDEN = {
    "lr": (346.57359028, 10.6323930168, 327.4743614131, 0.626, 0.6965292008, {1e-2: (3, 5), 1e-3: (3, 5), 1e-4: (4, 8)}),
    "l2svm": (500.0, 42.5295720673, 444.9655942031, 0.642, 0.6991547131, {1e-2: (3, 6), 1e-3: (4, 9), 1e-4: (4, 9)}),
}


def told(asking, problem):
    """What a generator returns whose questions are answered by ``problem``."""
    answer = None
    while True:
        try:
            request = asking.send(answer)
        except StopIteration as end:
            return end.value
        answer = newton.answered(problem, request)


@pytest.fixture(scope="module")
def embeddings(spark):
    return tables.embedding_rows(tables.table(spark, "/root/testdata/sf0.01", "embeddings"))


class Quadratic(_Dense):
    def __init__(self, A, b):
        super().__init__(len(b))
        self.A, self.b = A, b

    def value_and_gradient(self, w):
        return 0.5 * w @ self.A @ w - self.b @ w, self.A @ w - self.b

    def hessian_vector(self, w, s):
        return self.A @ s


def test_quadratic_in_closed_form():
    rng = np.random.default_rng(0)
    U = rng.normal(size=(50, 50))
    A, b = U.T @ U + 1e-3 * np.eye(50), rng.normal(size=50)
    done = newton.minimize(Quadratic(A, b), eps=1e-8)
    exact = np.linalg.solve(A, b)
    assert np.linalg.norm(done.w - exact) / np.linalg.norm(exact) < 1e-3
    assert all(h["prered"] > 0 for h in done.history)


def test_predicted_reduction_is_that_of_the_model():
    rng = np.random.default_rng(4)
    U = rng.normal(size=(20, 20))
    q = Quadratic(U.T @ U, rng.normal(size=20))
    g = -q.b
    for delta in (1e-3, 0.1, 10.0):
        p, norm, predicted, _ = told(newton.newton_step(q, np.zeros(20), g, delta, 1e-9), q)
        assert predicted == pytest.approx(-(g @ p + 0.5 * p @ q.A @ p), rel=1e-9)
        assert norm <= delta * (1 + 1e-9) and norm == pytest.approx(np.linalg.norm(p))


def test_exits():
    q = Quadratic(np.eye(3), np.zeros(3))
    assert newton.minimize(q).reason == "g0 == 0"
    q = Quadratic(np.diag([1.0, 50.0, 1000.0]), np.ones(3))
    assert newton.minimize(q, delta_init=1e-3, max_iter=1).reason == "max_iter"
    assert newton.minimize(q, eps=1e-6).reason == "grad_tol"
    assert newton.minimize(q, delta_init=1e-12).reason == "p ~ 0"


def test_region_follows_the_options():
    q = Quadratic(np.eye(2), np.array([10.0, 0.0]))
    done = newton.minimize(q, delta_init=1.0, delta_max=3.0, eps=1e-6)
    assert [h["delta"] for h in done.history][:2] == [2.0, 3.0]
    assert max(h["delta"] for h in done.history) <= 3.0


def test_rejected_step_keeps_the_point():
    class Wrong(Quadratic):
        def value_and_gradient(self, w):
            f, g = super().value_and_gradient(w)
            return (f if not w.any() else 1.0), g
    done = newton.minimize(Wrong(np.eye(2), np.ones(2)), max_iter=3)
    assert [h["accepted"] for h in done.history] == [False] * 3
    assert done.f == 0.0 and not done.w.any()
    assert [h["delta"] for h in done.history] == pytest.approx([2**0.5 / 4, 2**0.5 / 16, 2**0.5 / 64])


def test_callback_errors_do_not_end_the_fit():
    seen = []

    def callback(row):
        seen.append(row["iter"])
        raise RuntimeError("observer")
    done = newton.minimize(Quadratic(np.diag([1.0, 9.0]), np.ones(2)), callback=callback, eps=1e-6)
    assert seen == [h["iter"] for h in done.history]


@pytest.mark.parametrize("solver", ["lr", "l2svm"])
@pytest.mark.parametrize("eps", [1e-2, 1e-3, 1e-4])
def test_golden_fits(embeddings, solver, eps):
    f0, g0, f_best, acc, auc, counts = GOLDEN[solver]
    done = fit.fit(embeddings, solver, 1.0, eps)
    r = done.result
    assert (r.f0, r.g0_norm) == pytest.approx((f0, g0), rel=1e-9)
    assert (r.iters, sum(h["cg"] for h in r.history)) == counts[eps]
    assert r.reason == "grad_tol" and f_best - 1e-6 <= r.f < f_best * (1 + 1e-4)
    if eps == 1e-4:
        e = evaluate.evaluate(embeddings, done.w).first()
        assert (e["n"], e["accuracy"]) == (500, acc) and e["auc"] == pytest.approx(auc, abs=1e-5)


@pytest.mark.parametrize("solver", ["lr", "l2svm"])
def test_strategies_agree(random_rows, solver):
    rows, *_ = random_rows
    a = fit.fit(rows, solver, 0.5, 1e-3, strategy="partition")
    b = fit.fit(rows, solver, 0.5, 1e-3, strategy="coo", partitions=3)
    assert a.w == pytest.approx(b.w, abs=1e-9)
    assert [h["cg"] for h in a.result.history] == [h["cg"] for h in b.result.history]


def test_table_vectors_beyond_the_broadcast_bound(random_rows):
    rows, *_ = random_rows
    a = fit.fit(rows, "lr", 0.5, 1e-2)
    problem = TableProblem(rows, 30, get_loss("lr"), 0.5, max_broadcast=4)
    try:
        done = newton.minimize(problem, eps=1e-2)
    finally:
        problem.close()
    w = {r["j"]: r["x"] for r in done.w.df.collect()}
    assert problem.hot and [w.get(j, 0.0) for j in range(30)] == pytest.approx(list(a.w), abs=1e-9)


@pytest.mark.parametrize("solver", ["lr", "l2svm"])
@pytest.mark.parametrize("bias", [-1.0, 1.0])
def test_fit_equals_numpy_newton(random_rows, solver, bias):
    rows, X, y = random_rows
    if bias >= 0:
        rows, X = libsvm.with_bias(rows, bias)[0], np.hstack([X, np.full((len(y), 1), bias)])
    loss, w = get_loss(solver), np.zeros(X.shape[1])
    for _ in range(50):
        m = X @ w
        H = np.eye(len(w)) + 0.3 * X.T @ (loss.curvature(m, y, np)[:, None] * X)
        w -= np.linalg.solve(H, w + 0.3 * X.T @ loss.residual(m, y, np))
    assert fit.fit(rows, solver, 0.3, 1e-7, bias=bias).w == pytest.approx(w, abs=1e-5)


def test_fit_arguments(random_rows):
    rows, *_ = random_rows
    with pytest.raises(ValueError):
        fit.fit(rows, "ridge")
    with pytest.raises(ValueError):
        fit.fit(rows, "lr", strategy="magic")


def test_fit_from_file_and_its_log(spark, random_rows):
    from sparselin import sinks
    from sparselin.session import scratch_path
    rows, *_ = random_rows
    path = scratch_path(spark, "train")
    sinks.write_libsvm(rows, path)
    done = fit.fit_file(spark, path, bias=1.0, solver="l2svm", C=0.1, eps=1e-3, partitions=3)
    direct = fit.fit(libsvm.with_bias(rows, 1.0)[0], "l2svm", 0.1, 1e-3)
    assert done.w == pytest.approx(direct.w, abs=1e-9)
    log = done.run(spark, "w").first()
    assert log["config"]["n_features"] == 31 and log["summary"]["final_f"] == done.result.f
    assert [h["iter"] for h in log["history"]] == list(range(1, done.result.iters + 1))
    assert done.history(spark).where("t_sec is null").count() == 0
    assert done.tag == "l2svm_C0.1_eps0.001_bias1"


def test_sweep(spark, embeddings):
    done = sweep.sweep(embeddings, Cs=(0.1, 1.0), epss=(1e-3,), reps=2)
    assert len(done.fits) == 8
    again = done.models["lr_C1_eps0.001_bias-1_rep1"] - done.models["lr_C1_eps0.001_bias-1_rep2"]
    assert not np.abs(again).max() > 1e-12
    found = sweep.thresholds(embeddings, done.models)
    report = {r["run_id"]: r for r in sweep.report_on_test(embeddings, done.models, found).collect()}
    cuts = {r["run_id"]: r for r in found.collect()}
    for tag, w in done.models.items():
        single = evaluate.find_threshold(embeddings, w).first()
        assert cuts[tag]["best_score"] == pytest.approx(single["best_score"])
        assert report[tag]["accuracy"] == pytest.approx(single["best_score"])
        assert report[tag]["auc"] == pytest.approx(evaluate.evaluate(embeddings, w).first()["auc"])
    assert done.weights(spark).groupBy("run_id").count().where("count <> 64").count() == 0
    assert done.runs(spark).count() == 8


def test_spark_ml_finds_the_same_optimum(embeddings):
    ml = baseline.to_ml(embeddings, 64)
    assert ml.first()["features"].size == 64
    done = baseline.fit_lr(ml)
    from sparselin.operators.objective import objective
    from sparselin.sources import weights as W
    f = objective(embeddings, W.from_array(embeddings.sparkSession, done.w), "lr", 1.0).first()["f"]
    assert f == pytest.approx(GOLDEN["lr"][2], abs=1e-4)


def test_linsvc_scores_point_the_right_way(embeddings):
    ml = baseline.to_ml(embeddings, 64)
    done = baseline.fit_linsvc(ml)
    scored = baseline.ml_scores(done.model, ml)
    assert evaluate.summarize(scored).first()["auc"] > 0.6
    direct = {r["row_id"]: r["margin"] for r in evaluate.scores_for(embeddings, done.w).collect()}
    assert all(abs(direct[r["row_id"]] - r["margin"]) < 1e-9 for r in scored.collect())


def test_curve(embeddings):
    points = baseline.lr_curve(embeddings, grid=(1, 3, 20)).orderBy("max_iter").collect()
    assert [p["max_iter"] for p in points] == [1, 3, 20]
    assert points[0]["f"] > points[1]["f"] >= points[2]["f"]
    assert points[2]["t_sec"] == pytest.approx(sum(p["dt"] for p in points))


def test_vectors_round_trip(micro):
    back = baseline.vector_rows(baseline.to_ml(micro, 3))
    assert back.orderBy("row_id").collect() == micro.orderBy("row_id").select(*back.columns).collect()
    from pyspark.ml.linalg import Vectors
    mixed = micro.sparkSession.createDataFrame(
        [(0, 1.0, Vectors.dense([0.0, 2.0])), (1, -1.0, Vectors.sparse(9, [3, 5], [0.0, 4.0])),
         (2, 1.0, Vectors.sparse(9, [], []))], ["row_id", "label", "features"])
    got = {r["row_id"]: (r["indices"], r["values"]) for r in baseline.vector_rows(mixed).collect()}
    assert got == {0: ([0, 1], [0.0, 2.0]), 1: ([3, 5], [0.0, 4.0]), 2: ([], [])}
    assert baseline.with_class_labels(micro).where(~F.col("label").isin(0.0, 1.0)).count() == 0


@pytest.mark.parametrize("strategy", ["partition", "coo", "table"])
def test_a_model_knows_its_width(spark, strategy):
    """Features that no training row has are part of the model, whatever holds its vectors."""
    train = spark.createDataFrame([(0, 1.0, [0], [1.0]), (1, -1.0, [1], [1.0]), (2, 1.0, [0, 1], [2.0, 0.5])], ROWS)
    test = spark.createDataFrame([(0, 1.0, [0, 4], [1.0, 9.0]), (1, -1.0, [1, 3], [1.0, 9.0]), (2, 1.0, [4], [1.0])], ROWS)
    done = fit.fit(train, "lr", 1.0, 1e-6, strategy=strategy, n_features=5)
    assert done.n_features == 5
    got = evaluate.evaluate(test, done).first()
    assert (got["n"], got["accuracy"], got["auc"]) == (3, 1.0, 1.0)
    assert evaluate.find_threshold(test, done).first()["best_score"] == 1.0
    # The table alone gives the same scores, and keeps the width if it is stored with it.
    assert evaluate.evaluate(test, done.weights).first()["accuracy"] == 1.0
    path = scratch_path(spark, "model")
    sinks.write_weights(done.weights, path, done.n_features)
    assert weights.weight_width(weights.read_weights(spark, path)) == 5


def test_run_logs_name_no_person(spark):
    done = fit.fit(spark.createDataFrame([(0, 1.0, [0], [1.0])], ROWS), "lr")
    meta = done.run(spark).first()["meta"]
    assert meta["user"] is None and meta["hostname"] is None and meta["timestamp_utc"].endswith("Z")


def test_radius_and_acceptance():
    o = newton.NewtonOptions()
    assert newton.first_radius(0.2, o) == 1.0 and newton.first_radius(7.0, newton.NewtonOptions(delta_max=3.0)) == 3.0
    assert newton.next_radius(4.0, 0.1, 4.0, o) == 1.0
    assert newton.next_radius(4.0, 0.9, 4.0, o) == 8.0 and newton.next_radius(4.0, 0.9, 3.0, o) == 4.0
    assert newton.next_radius(4.0, 0.5, 4.0, o) == 4.0
    assert newton.is_accepted(0.5, 1.0) and not newton.is_accepted(0.5, 0.0) and not newton.is_accepted(1e-5, 1.0)
    assert newton.is_converged(0.09, 9.0, o) and not newton.is_converged(0.1, 9.0, o)


def test_a_broken_observer_is_reported(caplog):
    newton.observed(lambda row: 1 / 0, {"iter": 3})
    assert "iteration 3" in caplog.text


@pytest.mark.parametrize("bound", [1 << 24, 200])
def test_sweep_in_lockstep(random_rows, monkeypatch, bound):
    """The whole grid: same models as single fits, from as many passes as the slowest fit takes."""
    from sparselin.operators import objective
    rows, X, y = random_rows
    monkeypatch.setattr(objective, "MAX_BROADCAST_FEATURES", bound)
    rounds, passes = [], objective.Blocks.answers
    def counted(self, requests):
        rounds.append(len(requests))
        return passes(self, requests)
    monkeypatch.setattr(objective.Blocks, "answers", counted)
    Cs = (1e-2, 10.0)
    done = sweep.sweep(rows, Cs=Cs, epss=(1e-2, 1e-4), reps=2, n_features=30)
    assert len(done.fits) == 2 * 2 * 2 * 2
    singles = {(s, C, e): fit.fit(rows, s, C, e, n_features=30, strategy="partition") for s in ("lr", "l2svm") for C in Cs for e in (1e-2, 1e-4)}
    for f in done.fits:
        one = singles[f.config["solver"], f.config["C"], f.config["eps"]]
        assert f.w == pytest.approx(one.w, abs=1e-9) and f.result.iters == one.result.iters
    if bound > 200:
        slowest = max(1 + sum(1 + row["cg"] for row in f.result.history) for f in singles.values())
        assert len(rounds) <= slowest + 1 and max(rounds) == 8


@pytest.mark.parametrize("strategy", ["partition", "grid", "coo"])
def test_a_fit_goes_on_after_its_driver(spark, embeddings, random_rows, strategy):
    """Stopped after two steps and resumed, a fit has the history and the model of one that ran through."""
    rows, solver = (embeddings, "l2svm") if strategy == "partition" else (random_rows[0], "lr")
    eps, stop = (1e-4, 2) if strategy == "partition" else (1e-2, 1)
    place = scratch_path(spark, "states")
    whole = fit.fit(rows, solver, 1.0, eps, strategy=strategy, span=16)
    first = fit.fit(rows, solver, 1.0, eps, strategy=strategy, span=16, max_iter=stop, states=place)
    assert first.result.iters == stop and first.result.reason == "max_iter" and whole.result.iters > stop
    again = fit.fit(rows, solver, 1.0, eps, strategy=strategy, span=16, states=place)
    assert [{k: v for k, v in h.items() if k != "t_sec"} for h in again.result.history] == [
        {k: pytest.approx(v, rel=1e-9) if isinstance(v, float) else v for k, v in h.items() if k != "t_sec"} for h in whole.result.history]
    times = [h["t_sec"] for h in again.result.history]
    assert times == sorted(times) and again.result.reason == whole.result.reason == "grad_tol"
    w = {r["j"]: r["w"] for r in whole.weights.collect()}
    assert {r["j"]: r["w"] for r in again.weights.collect()} == pytest.approx(w, abs=1e-9)
    # Finished, it has nothing left to do; and the place is that of this fit only.
    assert fit.fit(rows, solver, 1.0, eps, strategy=strategy, span=16, states=place).result.iters == whole.result.iters
    with pytest.raises(ValueError, match="another fit"):
        fit.fit(rows, solver, 2.0, eps, strategy=strategy, span=16, states=place)


def test_an_incomplete_state_is_left_out(spark, embeddings):
    from sparselin.plans import states
    place = scratch_path(spark, "states")
    fit.fit(embeddings, "lr", 1.0, 1e-4, max_iter=2, states=place)
    weights.from_array(spark, np.ones(3)).write.parquet(f"{place}/step-000009/weights")
    assert [r["iters"] for r in states.read_states(spark, place).orderBy("iters").collect()] == [1, 2]
    assert fit.fit(embeddings, "lr", 1.0, 1e-4, states=place).result.reason == "grad_tol"
