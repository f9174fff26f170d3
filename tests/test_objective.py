"""Products, objectives and their two strategies against hand-checked numbers and NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparselin.functions import losses
from sparselin.operators import matvec as M
from sparselin.operators import objective as obj
from sparselin.sources import weights as W

w3, s3 = np.array([0.1, -0.2, 0.3]), np.array([1.0, 0.5, -1.0])
EXPECTED = {
    "lr": (7.427105876399274, [1.707300843, 1.3204237513, -1.9722901547], [2.1507967993, 1.0656464397, -3.3421525785]),
    "l2svm": (8.8, [7.0, 4.95, -5.7], [10.0, 5.125, -21.0]),
}


def column(df, name, n):
    return W.to_array(df, n, name)


@pytest.fixture(scope="module")
def vectors(spark):
    return W.from_arrays(spark, w=w3, s=s3)


def test_margins(spark, micro):
    m = {r["row_id"]: round(r["margin"], 9) for r in M.margins(micro, W.from_array(spark, w3)).collect()}
    assert m == {0: 0.65, 1: -0.3, 2: 0.2, 3: -0.05, 4: 0.1, 7: 0.0}


@pytest.mark.parametrize("solver", ["lr", "l2svm"])
def test_hand_checked_objective(spark, micro, vectors, solver):
    f, g, h = EXPECTED[solver]
    assert obj.objective(micro, vectors, solver, 2.0).first()["f"] == pytest.approx(f, abs=1e-9)
    assert column(obj.gradient(micro, vectors, solver, 2.0), "g", 3) == pytest.approx(g, abs=1e-9)
    assert column(obj.hessian_vector(micro, vectors, solver, 2.0), "h", 3) == pytest.approx(h, abs=1e-9)


@pytest.mark.parametrize("solver", ["lr", "l2svm"])
@pytest.mark.parametrize("bound", [1 << 24, 60, 1])
def test_blocks_equal_numpy(random_rows, solver, bound, monkeypatch):
    """Also if only two models, or one, fit a broadcast."""
    rows, X, y = random_rows
    loss = losses.get_loss(solver)
    rng = np.random.default_rng(1)
    w, s = rng.normal(size=30), rng.normal(size=30)
    m = X @ w
    with obj.Blocks(rows, 30) as b:
        monkeypatch.setattr(obj, "MAX_BROADCAST_FEATURES", bound)
        total, slope = b.loss_and_slope(loss, w)
        bent = b.curvature_product(loss, w, s)
        several = b.losses_at(loss, [w, s, np.zeros(30)])
    assert total == pytest.approx(loss.value(m, y, np).sum())
    assert slope == pytest.approx(X.T @ loss.residual(m, y, np))
    assert bent == pytest.approx(X.T @ (loss.curvature(m, y, np) * (X @ s)))
    assert several == pytest.approx([loss.value(X @ v, y, np).sum() for v in (w, s, np.zeros(30))])


@pytest.mark.parametrize("solver", ["lr", "l2svm"])
@pytest.mark.parametrize("max_broadcast", [1 << 20, 0])
def test_coo_equals_numpy(spark, random_rows, solver, max_broadcast):
    """Both ways of the lookup: broadcast, and shuffled with the hot feature apart."""
    rows, X, y = random_rows
    loss = losses.get_loss(solver)
    rng = np.random.default_rng(2)
    w, s = rng.normal(size=30), rng.normal(size=30)
    v = W.from_arrays(spark, w=w, s=s)
    kw = {"width": 30, "max_broadcast": max_broadcast}
    m = X @ w
    g = column(obj.gradient(rows, v, loss, 0.7, strategy="coo", **kw), "g", 30)
    h = column(obj.hessian_vector(rows, v, loss, 0.7, strategy="coo", **kw), "h", 30)
    z = {r["j"]: r["z"] for r in obj.loss_and_slope(rows, v, loss, **kw).collect()}
    assert g == pytest.approx(w + 0.7 * X.T @ loss.residual(m, y, np))
    assert h == pytest.approx(s + 0.7 * X.T @ (loss.curvature(m, y, np) * (X @ s)))
    assert z[obj.LOSS_ID] == pytest.approx(loss.value(m, y, np).sum())


@pytest.mark.parametrize("solver", ["lr", "l2svm"])
def test_derivatives_by_differences(random_rows, solver):
    rows, X, y = random_rows
    loss = losses.get_loss(solver)
    rng = np.random.default_rng(5)
    w, d, t = 0.1 * rng.normal(size=30), rng.normal(size=30), 1e-6
    with obj.Blocks(rows, 30) as b:
        _, slope = b.loss_and_slope(loss, w)
        up, down = b.losses_at(loss, [w + t * d, w - t * d])
        g_up, g_down = b.loss_and_slope(loss, w + t * d)[1], b.loss_and_slope(loss, w - t * d)[1]
        bent = b.curvature_product(loss, w, d)
    assert (up - down) / (2 * t) == pytest.approx(slope @ d, rel=1e-5)
    assert (g_up - g_down) / (2 * t) == pytest.approx(bent, rel=1e-3, abs=1e-3)


def test_stable_functions(spark):
    x = np.array([-1000.0, -1.0, 0.0, 1.0, 1000.0])
    soft, sig = losses.softplus(x, np), losses.sigmoid(x, np)
    assert soft == pytest.approx([0.0, np.log1p(np.exp(-1)), np.log(2), np.log1p(np.exp(1)), 1000.0])
    assert sig == pytest.approx([0.0, 1 / (1 + np.e), 0.5, np.e / (1 + np.e), 1.0])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = df.select(losses.softplus(F.col("x")), losses.sigmoid(F.col("x"))).collect()
    assert [r[0] for r in got] == pytest.approx(list(soft)) and [r[1] for r in got] == pytest.approx(list(sig))


def test_margin_on_the_border_is_inactive():
    assert losses.is_active(np.array([1.0]), np.array([1.0]), np) == [0.0]


def test_registering_a_loss(random_rows):
    rows, X, y = random_rows
    square = losses.register(losses.Loss(
        "square", lambda m, y, xp=None: (m - y) * (m - y), lambda m, y, xp=None: 2 * (m - y),
        lambda m, y, xp=None: 2.0 + 0 * m))
    from sparselin.plans.fit import fit
    done = fit(rows, "square", 1.0, 1e-8)
    assert done.w == pytest.approx(np.linalg.solve(np.eye(30) + 2 * X.T @ X, 2 * X.T @ y), abs=1e-6)
    assert losses.get_loss("SQUARE") is square
    with pytest.raises(ValueError):
        losses.get_loss("nope")


def test_partition_products(random_rows):
    rows, X, y = random_rows
    w = np.linspace(-1, 1, 30)
    got = {r["row_id"]: r["margin"] for r in M.dense_margins(rows, w).collect()}
    assert [got[i] for i in range(200)] == pytest.approx(list(X @ w))
    assert M.signed_margin_sum_partition(rows, w).first()[0] == pytest.approx(y @ X @ w)
    models = M.model_margins(rows, {"a": w, "b": 2 * w[:20]})
    b = {r["row_id"]: r["margin"] for r in models.where("run_id = 'b'").collect()}
    assert [b[i] for i in range(200)] == pytest.approx(list(X[:, :20] @ (2 * w[:20])))


@pytest.mark.parametrize("max_broadcast", [1 << 20, 0])
def test_models_by_join(spark, random_rows, max_broadcast):
    rows, X, _ = random_rows
    w = np.linspace(-1, 1, 30)
    table = W.from_array(spark, w, "a").unionByName(W.from_array(spark, -w, "b"))
    scored = M.score_models(rows, table, max_broadcast=max_broadcast)
    got = {(r["run_id"], r["row_id"]): r["margin"] for r in scored.collect()}
    assert len(got) == 400 and got["a", 17] == 0.0
    assert [got["b", i] for i in range(200)] == pytest.approx(list(-X @ w))


def test_transposed(spark, random_rows):
    rows, X, y = random_rows
    r = np.where(np.arange(200) % 3 == 0, 0.0, y)
    table = spark.createDataFrame([(i, float(v)) for i, v in enumerate(r)], "row_id bigint, r double")
    apart = M.transposed_by_id(rows, table)
    inside = M.transposed(rows, F.when(F.col("row_id") % 3 == 0, 0.0).otherwise(F.col("label")))
    assert column(apart, "z", 30) == pytest.approx(X.T @ r)
    assert column(inside, "z", 30) == pytest.approx(X.T @ r)


def test_profile_and_checks(spark, random_rows, micro):
    rows, X, _ = random_rows
    p = M.matrix_profile(rows).first()
    assert (p["n_rows"], p["n_cols"], p["nnz"], p["empty_rows"]) == (200, 30, int((X != 0).sum()), 1)
    M.check(rows, 30, W.from_array(spark, np.zeros(30)))
    with pytest.raises(ValueError, match="out_of_range"):
        M.check(rows, 20)
    with pytest.raises(ValueError, match="weight_width"):
        M.check(rows, 30, W.from_array(spark, np.zeros(29)))
    broken = micro.withColumn("values", F.slice("values", 1, 1))
    with pytest.raises(ValueError, match="length_mismatch"):
        M.check(broken, 3)
    assert {r["label"]: r["n"] for r in M.label_histogram(micro).collect()} == {1.0: 3, -1.0: 3}


def test_hot_features(random_rows):
    rows, X, _ = random_rows
    assert M.hot_features(M.to_coo(rows), 0.1) == [0]


def test_width_limits(spark, random_rows, monkeypatch):
    rows, *_ = random_rows
    monkeypatch.setattr(M, "MAX_BROADCAST_FEATURES", 10)
    monkeypatch.setattr(obj, "MAX_BROADCAST_FEATURES", 10)
    with pytest.raises(ValueError):
        M.dense_margins(rows, np.zeros(30))
    with pytest.raises(ValueError):
        obj.Blocks(rows, 30)
    with obj.Blocks(rows, any_width=True) as b:
        assert b.n_features == 30


def test_a_feature_beyond_the_width_is_an_error(spark, random_rows):
    rows, *_ = random_rows
    v = W.from_arrays(spark, w=np.ones(20), s=np.ones(20))
    for strategy in ("auto", "coo"):
        for make in (obj.objective, obj.gradient, obj.hessian_vector):
            with pytest.raises(Exception, match="does not fit into 20 columns"):
                make(rows, v, "lr", 1.0, 20, strategy=strategy).collect()
    with obj.Blocks(rows, 20) as b, pytest.raises(Exception, match="does not fit into 20 columns"):
        b.loss_and_slope(losses.get_loss("lr"), np.ones(20))


@pytest.mark.parametrize("direct", [16 << 20, 0])
@pytest.mark.parametrize("fan", [64, 2])
def test_sums_meet_by_range(random_rows, monkeypatch, direct, fan):
    """A pass ships a record for each task and range of features, and every way of adding them gives the same."""
    from sparselin.operators import kernels
    rows, X, y = random_rows
    monkeypatch.setattr(kernels, "SLICE", 8)
    monkeypatch.setattr(obj, "DIRECT_BYTES", direct)
    monkeypatch.setattr(obj, "FAN", fan)
    loss, w = losses.get_loss("lr"), np.linspace(-1, 1, 30)
    want = X.T @ loss.residual(X @ w, y, np)
    records, slices = [], obj.Blocks.slices
    def counted(self, task):
        found = slices(self, task)
        records.append((found.count(), found.rdd.getNumPartitions()))
        return found
    monkeypatch.setattr(obj.Blocks, "slices", counted)
    with obj.Blocks(rows, 30) as b:
        total, slope = b.loss_and_slope(loss, w)
    assert slope == pytest.approx(want) and total == pytest.approx(loss.value(X @ w, y, np).sum())
    # 30 features and the loss are 4 ranges of 8.
    assert records == [(5 * 4, 5)]
    v = W.from_arrays(rows.sparkSession, w=w, s=w)
    assert column(obj.gradient(rows, v, loss, 1.0, 30), "g", 30) == pytest.approx(w + want)


def test_indices_are_stored_in_32_bits_where_they_fit():
    import pyarrow as pa

    from sparselin.operators import kernels
    for top, kind in ((7, np.int32), (1 << 31, np.int64)):
        batch = pa.RecordBatch.from_pydict({"label": [1.0, -1.0], "indices": pa.array([[0, top], []], pa.list_(pa.int64())),
                                            "values": pa.array([[1.0, 2.0], []], pa.list_(pa.float64()))})
        block, = (b for rb in kernels.pack(iter([batch])) for b in kernels.from_blocks(rb))
        assert block.indices.dtype == kind and list(block.indices) == [0, top] and list(block.values) == [1.0, 2.0]


def test_blocks_split_at_row_borders():
    import pyarrow as pa

    from sparselin.operators import kernels
    batch = pa.RecordBatch.from_pydict({
        "label": [1.0, -1.0, 1.0, 1.0], "indices": pa.array([[0, 1, 2], [], [5], [1, 2]], pa.list_(pa.int64())),
        "values": pa.array([[1.0, 2.0, 3.0], [], [4.0], [5.0, 6.0]], pa.list_(pa.float64()))})
    limit, kernels.BLOCK_ENTRIES = kernels.BLOCK_ENTRIES, 2
    try:
        blocks = [b for rb in kernels.pack(iter([batch.slice(0, 4)])) for b in kernels.from_blocks(rb)]
        tail = [b for rb in kernels.pack(iter([batch.slice(2, 2)])) for b in kernels.from_blocks(rb)]
    finally:
        kernels.BLOCK_ENTRIES = limit
    assert [list(b.labels) for b in blocks] == [[1.0], [-1.0, 1.0], [1.0]]
    assert [list(b.values) for b in blocks] == [[1.0, 2.0, 3.0], [4.0], [5.0, 6.0]]
    assert [list(b.indices) for b in tail] == [[5], [1, 2]]


@pytest.mark.parametrize("solver", ["lr", "l2svm"])
def test_row_local_sums_exchange_features_only(spark, random_rows, solver):
    """Within the broadcast bound no row is exchanged, and the numbers are those of the joins."""
    rows, X, y = random_rows
    rng = np.random.default_rng(8)
    v = W.from_arrays(spark, w=rng.normal(size=30), s=rng.normal(size=30))
    for make, name in ((obj.gradient, "g"), (obj.hessian_vector, "h")):
        near, far = (make(rows, v, solver, 0.7, 30, strategy=s) for s in ("auto", "coo"))
        assert column(near, name, 30) == pytest.approx(column(far, name, 30))
        plan = near._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(row_id" not in plan and plan.count("Exchange hashpartitioning") <= 2
    near, far = (obj.objective(rows, v, solver, 0.7, 30, strategy=s) for s in ("auto", "coo"))
    assert near.first()["f"] == pytest.approx(far.first()["f"])
    with pytest.raises(ValueError):
        obj.objective(rows, v, solver, 0.7, 30, strategy="other")


def test_blocks_are_packed_before_the_first_pass(random_rows):
    """No pass runs beside the packing: each holds a Python worker, and workers live on."""
    rows, *_ = random_rows
    with obj.Blocks(rows, 30) as b:
        b.slices(lambda batches: iter(()))
        leaves = b.blocks._jdf.queryExecution().withCachedData().collectLeaves()
        assert leaves.apply(0).cacheBuilder().isCachedColumnBuffersLoaded()
