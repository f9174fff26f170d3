"""Run logs, tags, gaps and reports."""

import json
import math

import pytest
from pyspark.sql import functions as F

from sparselin import queries, sinks
from sparselin.functions import gaps, tags
from sparselin.operators import curves
from sparselin.plans import reports
from sparselin.sources import runlogs, tables
from sparselin.sources import weights as W


@pytest.fixture()
def logs(spark, tmp_path):
    def history(fs, timed=True):
        return [{"iter": i + 1, "f": f, "g_norm": f / 10, "accepted": True, **({"t_sec": 0.5 * i + 1} if timed else {})}
                for i, f in enumerate(fs)]
    docs = {
        "metrics_lr_C1e-3_eps1e-4_bias-1_rep1.json": {
            "config": {"solver": "lr", "bias": -1.0}, "history": history([9.0, 4.0, 2.0]),
            "summary": {"time_sec": 3.0, "final_f": 2.0, "weights_path": "models/a"}},
        "metrics_lr_C1e-3_eps1e-4_bias-1_rep2.json": {
            "config": {}, "history": history([9.0, 3.0, 2.5], timed=False), "summary": {"time_sec": 4.0, "final_f": 2.5}},
        "metrics_l2svm_C10_eps1e-3_bias-1_rep1.json": {"config": {"solver": ""}, "summary": {"final_f": 7.0}, "history": []},
        "metrics_mllib_lr.json": {
            "config": {"solver": "mllib_lr_lbfgs"}, "summary": {"time_sec": 1.0, "f_train": 1.5}, "history": []},
    }
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps(doc, indent=2))
    (tmp_path / "threshold_lr_C1e-3_eps1e-4_bias-1_rep1.json").write_text(
        json.dumps({"metric": "acc", "best_threshold": 0.25, "best_score": 0.9}, indent=2))
    (tmp_path / "threshold_lr_C1e-3_eps1e-4_bias-1_rep2.json").write_text("{broken")
    return tmp_path


def test_reading_runs(spark, logs):
    runs = runlogs.run_solver(runlogs.read_runs(spark, f"{logs}/metrics_*.json"))
    got = {r["tag"]: r["solver"] for r in runs.collect()}
    assert got == {
        "lr_C1e-3_eps1e-4_bias-1_rep1": "lr", "lr_C1e-3_eps1e-4_bias-1_rep2": "lr",
        "l2svm_C10_eps1e-3_bias-1_rep1": "l2svm", "mllib_lr": "mllib_lr_lbfgs"}
    assert {r["dir"].rsplit("/", 1)[1] for r in runs.collect()} == {logs.name}


def test_history_and_time_axis(spark, logs):
    runs = runlogs.read_runs(spark, f"{logs}/metrics_*.json")
    points = runlogs.run_history(runs)
    t = {(r["run_id"][-4:], r["iter"]): r["t_sec"] for r in points.collect()}
    assert t["rep1", 3] == 2.0
    assert [t["rep2", i] for i in (1, 2, 3)] == [0.0, 2.0, 4.0]
    with pytest.raises(ValueError):
        runlogs.run_history(runs, keep_empty=False)


def test_thresholds_and_weights(spark, logs):
    runs = reports.flat_runs(runlogs.read_runs(spark, f"{logs}/metrics_*.json"))
    found = runlogs.read_thresholds(spark, f"{logs}/threshold_*.json")
    assert found.count() == 1
    cut = {r["tag"]: r["threshold"] for r in reports.with_thresholds(runs, found).collect()}
    assert cut["lr_C1e-3_eps1e-4_bias-1_rep1"] == 0.25 and sum(cut.values()) == 0.25
    available = spark.createDataFrame([("models/a",), ("models/b",)], "weights_id string")
    own = runs.where(F.col("tag") == "mllib_lr").select("dir", "tag", F.lit("own").alias("weights_id"))
    chosen = {r["tag"]: r["weights_id"] for r in reports.with_weights(runs, available, own).collect()}
    assert chosen == {"lr_C1e-3_eps1e-4_bias-1_rep1": "models/a", "mllib_lr": "own"}


def test_group_report(spark, logs):
    flat = reports.flat_runs(runlogs.read_runs(spark, f"{logs}/metrics_*.json"))
    rows = reports.time_and_objective(flat).collect()
    assert [r["base"] for r in rows] == ["mllib_lr", "lr_C1e-3_eps1e-4_bias-1", "l2svm_C10_eps1e-3_bias-1"]
    lr = rows[1]
    assert (lr["n"], lr["time_sec_mean"], lr["time_sec_std"], lr["final_f_mean"], lr["label"], lr["C"]) == (
        2, 3.5, 0.5, 2.25, "C1e-3_eps1e-4", 1e-3)
    assert math.isnan(rows[2]["time_sec_mean"]) and rows[0]["final_f_mean"] == 1.5


def test_nan_is_left_out(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0), ("b", float("nan"))], "base string, x double")
    got = {r["base"]: r for r in reports.group_stats(df, ["x"]).collect()}
    assert (got["a"]["n"], got["a"]["x_mean"], got["a"]["x_std"]) == (3, 2.0, 1.0)
    assert math.isnan(got["b"]["x_mean"]) and math.isnan(got["b"]["x_std"])


def test_accuracy_report(spark):
    df = spark.createDataFrame([("lr_C1_rep1", 0.5, 0.6), ("lr_C1_rep2", 0.7, 0.8)], "tag string, accuracy double, auc double")
    r = reports.accuracy_and_auc(df).first()
    assert (r["base"], r["C"], r["n"]) == ("lr_C1", 1.0, 2)
    assert (r["accuracy_mean"], r["accuracy_std"], r["auc_mean"]) == pytest.approx((0.6, 0.1, 0.7))


def test_convergence(spark):
    nan = float("nan")
    h = spark.createDataFrame(
        [("a", 0.0, 3.0, 1.0), ("a", nan, 2.0, 1.0), ("b", nan, 9.0, 1.0), ("c", 1.0, 9.0, 1.0)],
        "run_id string, t_sec double, f double, g_norm double")
    s = spark.createDataFrame([("a", "lr"), ("b", "lr"), ("c", "l2svm")], "run_id string, solver string")
    assert sorted(r["f"] for r in reports.convergence(h, s, ["lr"]).collect()) == [2.0, 3.0]


def test_finite_points(spark):
    bad = [None, float("nan"), float("inf")]
    df = spark.createDataFrame([(1.0, 2.0)] + [(1.0, b) for b in bad] + [(b, 1.0) for b in bad], "t_sec double, f double")
    assert runlogs.finite_points(df).count() == 1


@pytest.mark.parametrize("f, best, first, expected", [
    (5.0, 1.0, 9.0, {"v1": math.log10(0.5), "v2": math.log10(4), "v3": math.log10(4), "v4": math.log10(4), "v5": math.log10(0.5)}),
    (1.0, 1.0, 9.0, {"v1": -12.0, "v2": -12.0, "v3": -12.0, "v4": -math.inf, "v5": -12.0}),
    (1.0, 1.0, 1.0, {"v1": -12.0, "v5": math.nan}),
    (0.0, 0.0, 9.0, {"v2": -12.0, "v4": math.nan}),
    (-3.0, -2.0, 9.0, {"v4": math.log10(0.5)}),
])
def test_gaps(spark, f, best, first, expected):
    row = spark.range(1).select(*(
        fn(F.lit(f), F.lit(best), F.lit(first)).alias(k) for k, fn in gaps.GAPS.items())).first()
    for k, v in expected.items():
        assert math.isnan(row[k]) if math.isnan(v) else row[k] == pytest.approx(v)


def test_curves(spark):
    h = spark.createDataFrame(
        [("a", 1, 10.0, 5.0), ("a", 2, 4.0, 6.5), ("b", 1, 8.0, 1.0), ("b", 2, 2.0, 2.0), ("b", 3, float("nan"), 4.0)],
        "run_id string, iter int, f double, t_sec double")
    s = {r["run_id"]: r for r in reports.compare_curves(h).collect()}
    assert (s["a"]["f_first"], s["a"]["f_last"], s["b"]["f_min"], s["a"]["f_best"]) == (10.0, 4.0, 2.0, 2.0)
    e = {(r["run_id"], r["iter"]): r["elapsed"] for r in curves.elapsed(h).collect()}
    assert e["a", 2] == 1.5 and e["b", 3] == 3.0
    g = {(r["run_id"], r["iter"]): r["gap"] for r in curves.relative_gap(h.where("f is not null"), "v1").collect()}
    assert g["a", 1] == 0.0 and g["b", 2] == -12.0
    t = {(r["run_id"], r["iter"]): r["cum"] for r in curves.cumulative(h, "t_sec", "iter", ["run_id"], "cum").collect()}
    assert t["b", 3] == 7.0 and t["a", 1] == 5.0


def test_tags(spark):
    path = F.lit("file:/x/y.z/metrics_lr_C0.1_eps1e-3_bias-1_rep12.json")
    tag = tags.run_tag(path)
    r = spark.range(1).select(
        tag, tags.run_folder(path), tags.base_tag(tag), tags.c_from_tag(tag), tags.short_label(tags.base_tag(tag)),
        tags.c_from_tag(F.lit("none")), tags.solver_name(F.lit(None).cast("string"), F.lit("xyz")), tags.utc_stamp()).first()
    assert list(r)[:7] == [
        "lr_C0.1_eps1e-3_bias-1_rep12", "file:/x/y.z", "lr_C0.1_eps1e-3_bias-1", 0.1, "C0.1_eps1e-3", 0.0, "?"]
    assert r[7].endswith("Z") and r[7][10] == "T"
    assert tags.reg_param(2.0, 500) == 1e-3


def test_timings_per_file(spark, tmp_path):
    (tmp_path / "map_run.json").write_text(json.dumps({"t_map": [1.0, 2.0], "f_map": [5.0, 5.0]}, indent=2))
    (tmp_path / "mappart_run.json").write_text(json.dumps({"t_mappart": [0.5], "f_mappart": [5.0]}, indent=2))
    got = runlogs.read_timings(spark, f"{tmp_path}/*_run.json").collect()
    assert sorted((r["strategy"], r["iter"], r["t_sec"]) for r in got) == [("map", 1, 1.0), ("map", 2, 2.0), ("mappart", 1, 0.5)]


def test_weights(spark, tmp_path):
    import numpy as np
    path = str(tmp_path / "w")
    for scale in (1.0, 2.0):  # a later model replaces an earlier one
        sinks.write_weights(W.from_array(spark, scale * np.arange(5.0), "r"), path)
    back = W.read_weights(spark, path)
    assert W.weight_width(back) == 5 and list(W.to_array(back)) == [0.0, 2.0, 4.0, 6.0, 8.0]
    assert list(W.to_array(back, 7))[5:] == [0.0, 0.0]


def test_missing_threshold_files_give_no_threshold(spark, tmp_path):
    found = runlogs.read_thresholds(spark, f"{tmp_path}/threshold_*.json")
    runs = spark.createDataFrame([("d", "t")], "dir string, tag string")
    assert reports.with_thresholds(runs, found).first()["threshold"] == 0.0


def test_convergence_leaves_out_runs_without_times(spark):
    nan = float("nan")
    rows = [("a", 1, 0.5), ("a", 2, nan), ("b", 1, nan), ("c", 1, None), ("c", 2, None), ("d", 1, None), ("d", 2, 3.0)]
    history = spark.createDataFrame([(r, i, t, 1.0, 1.0) for r, i, t in rows], "run_id string, iter int, t_sec double, f double, g_norm double")
    solvers = spark.createDataFrame([("a", "lr"), ("b", "lr"), ("c", "l2svm"), ("d", "l2svm")], "run_id string, solver string")
    kept = {(r["run_id"], r["solver"]) for r in reports.convergence(history, solvers).collect()}
    assert kept == {("a", "lr"), ("d", "l2svm")}
    assert {r["run_id"] for r in reports.convergence(history, solvers, ["lr"]).collect()} == {"a"}


def test_run_folders_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "scratch_path", lambda _, name: str(tmp_path / name))
    read = queries.run_order(spark, "/root/testdata/sf0.001").collect()
    files = list((tmp_path / "many-runs").glob("user=*/part-*.json"))
    # A file in each folder, and not all from one task.
    assert len(files) == len({f.parent for f in files}) == len(read)
    assert len({f.name[:10] for f in files}) > 1
