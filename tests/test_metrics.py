"""Evaluation, prefix sums and splits against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparselin.operators import curves, metrics, prefix, split
from sparselin.plans import evaluate
from sparselin.schema import SCORES


def scores(spark, pairs):
    return spark.createDataFrame([(i, float(y), float(m)) for i, (y, m) in enumerate(pairs)], SCORES)


MICRO = [(1, 0.65), (-1, -0.3), (1, 0.2), (-1, -0.05), (-1, 0.1), (1, 0.0)]


def brute_auc(pairs):
    pos = [m for y, m in pairs if y > 0]
    neg = [m for y, m in pairs if y <= 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_threshold(pairs, metric):
    y = np.array([p[0] for p in pairs], float)
    m = np.array([p[1] for p in pairs], float)
    best = (0.0, -1.0)
    for t in [*sorted(set(m)), 0.0]:
        guess = np.where(m >= t, 1, -1)
        tp, fp, fn = ((guess > 0) & (y > 0)).sum(), ((guess > 0) & (y < 0)).sum(), ((guess < 0) & (y > 0)).sum()
        value = (guess == y).mean() if metric == "acc" else (2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0)
        if value > best[1]:
            best = (t, value)
    return best


def test_micro(spark):
    s = scores(spark, MICRO)
    assert metrics.roc_auc(s).first()["auc"] == pytest.approx(8 / 9)
    for metric, expected in (("acc", 5 / 6), ("f1", 6 / 7)):
        best = metrics.best_threshold(s, metric).first()
        assert (best["best_threshold"], best["best_score"]) == (0.0, pytest.approx(expected))


def test_ties_count_half(spark):
    assert metrics.roc_auc(scores(spark, [(1, 0.5), (-1, 0.5)])).first()["auc"] == 0.5


def test_one_class(spark):
    assert math.isnan(metrics.roc_auc(scores(spark, [(1, 0.5), (1, 0.7)])).first()["auc"])


def test_zero_wins_only_below_all_margins(spark):
    best = metrics.best_threshold(scores(spark, [(-1, -0.3), (-1, -0.2), (1, -0.5)])).first()
    assert (best["best_threshold"], best["best_score"]) == (0.0, pytest.approx(2 / 3))


def test_smallest_threshold_among_ties(spark):
    best = metrics.best_threshold(scores(spark, [(1, 0.1), (-1, 0.2), (1, 0.3)])).first()
    assert (best["best_threshold"], best["best_score"]) == (0.1, pytest.approx(2 / 3))


@pytest.mark.parametrize("seed, hot", [(0, 0.0), (1, 0.4), (2, 0.9)])
def test_against_brute_force(spark, seed, hot):
    """Random scores, of which a share has one and the same value."""
    rng = random.Random(seed)
    pairs = []
    for _ in range(400):
        m = 0.25 if rng.random() < hot else round(rng.gauss(-0.5, 1), 2)
        pairs.append((1 if rng.random() < 0.3 else -1, m))
    s = scores(spark, pairs)
    assert metrics.roc_auc(s).first()["auc"] == pytest.approx(brute_auc(pairs))
    for metric in ("acc", "f1"):
        best = metrics.best_threshold(s, metric).first()
        t, value = brute_threshold(pairs, metric)
        assert (best["best_threshold"], best["best_score"]) == (t, pytest.approx(value))


def test_grouped_metrics(spark):
    rng = random.Random(7)
    data = [(g, i, 1.0 if rng.random() < 0.5 else -1.0, float(rng.randrange(20)))
            for g, n in (("a", 300), ("b", 20), ("c", 5)) for i in range(n)]
    s = spark.createDataFrame(data, "run_id string, row_id bigint, label double, margin double")
    auc = {r["run_id"]: r["auc"] for r in metrics.roc_auc(s, ["run_id"]).collect()}
    best = {r["run_id"]: r for r in metrics.best_threshold(s, "f1", ["run_id"]).collect()}
    done = {r["run_id"]: r for r in evaluate.summarize(s, 7.0, ["run_id"]).collect()}
    for g in "abc":
        pairs = [(y, m) for k, _, y, m in data if k == g]
        assert auc[g] == pytest.approx(brute_auc(pairs)) == pytest.approx(done[g]["auc"])
        assert (best[g]["best_threshold"], best[g]["best_score"]) == (
            brute_threshold(pairs, "f1")[0], pytest.approx(brute_threshold(pairs, "f1")[1]))
        assert done[g]["accuracy"] == pytest.approx(np.mean([(m >= 7) == (y > 0) for y, m in pairs]))


def test_confusion_and_decision(spark):
    s = scores(spark, MICRO + [(1, float("nan"))])
    c = metrics.confusion(metrics.predict(s, 0.1)).first()
    assert (c["tp"], c["fp"], c["fn"], c["tn"]) == (2, 1, 2, 2)
    assert c["f1"] == pytest.approx(4 / 7)
    none = metrics.confusion(metrics.predict(scores(spark, [(-1, -1.0)]))).first()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)
    assert metrics.accuracy(metrics.predict(s, 0.1)).first()["accuracy"] == pytest.approx(4 / 7)
    with pytest.raises(ValueError):
        metrics.best_threshold(s, "mcc")


@pytest.mark.parametrize("rows", [1 << 20, 200, 40, 7])
def test_running_totals(spark, rows):
    """A key with most of the records is spread over the ranges; with few rows in each their own totals need ranges."""
    rng = random.Random(rows)
    data = []
    for key, n in (("big", 3000), ("small", 40), ("one", 1)):
        data += [(key, o, rng.randrange(9)) for o in rng.sample(range(-10**6, 10**6), n)]
    df = spark.createDataFrame(data, "k string, o bigint, v bigint").repartition(6)
    got = prefix.running_totals(df, "o", {"upto": "v"}, ["k"], {"all": "v"}, rows).collect()
    assert len(got) == len(data)
    for key in ("big", "small", "one"):
        total, expected = 0, {}
        for _, o, v in sorted(d for d in data if d[0] == key):
            total += v
            expected[o] = total
        mine = {r["o"]: (r["upto"], r["all"]) for r in got if r["k"] == key}
        assert mine == {o: (t, total) for o, t in expected.items()}


def test_ranges_follow_the_records(spark, monkeypatch):
    """Whatever the session's partitions, a range has a bounded number of records."""
    df = spark.range(100_000).select((F.col("id") * 7919 % 100_003).cast("double").alias("o"), F.lit(1).alias("v"))
    sizes, bucketed = [], prefix.bucketed
    def counted(*args):
        found = bucketed(*args)
        sizes.extend(r["count"] for r in found.groupBy("_bucket").count().collect())
        return found
    monkeypatch.setattr(prefix, "bucketed", counted)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in (3, 200):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            done = prefix.running_totals(df, "o", {"upto": "v"}, range_rows=1000)
            row = done.agg(F.count("*"), F.max("upto"), F.sum("upto")).first()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert tuple(row) == (100_000, 100_000, 100_000 * 100_001 // 2)
        assert sum(sizes) == 100_000 and max(sizes) < 4000
        sizes.clear()


def test_running_totals_fill_the_buckets(spark):
    """However many buckets there are, none holds much more than its share of the distinct values."""
    df = spark.range(200_000).select((F.col("id") * F.col("id")).cast("double").alias("o"), (F.col("id") % 3 == 0).alias("k"))
    for by in ([], ["k"]):
        for buckets in (16, 400):
            sizes = [r["count"] for r in prefix.bucketed(df, "o", by, buckets).groupBy("_bucket").count().collect()]
            assert sum(sizes) == 200_000 and max(sizes) < 4 * 200_000 / buckets


NAN = float("nan")


@pytest.mark.parametrize("metric", ["acc", "f1"])
@pytest.mark.parametrize("data", [
    [(-1, 0.05), (1, 0.1), (1, 0.3), (-1, NAN)], [(-1, 0.1), (1, NAN)], [(1, NAN), (-1, NAN)], [(-1, NAN), (-1, -0.5), (1, -0.6)],
    [(1, 0.2), (-1, NAN), (-1, NAN), (1, 0.1), (-1, 0.15)],
])
def test_best_threshold_agrees_with_its_decisions(spark, data, metric):
    """NaN margins are negative at every threshold, as in ``predict``."""
    scores = spark.createDataFrame([(i, float(y), m) for i, (y, m) in enumerate(data)], "row_id long, label double, margin double")
    best = metrics.best_threshold(scores, metric).first()
    def value(cut):
        done = metrics.predict(scores, cut)
        return metrics.accuracy(done).first()["accuracy"] if metric == "acc" else metrics.confusion(done).first()["f1"]
    assert value(best["best_threshold"]) == pytest.approx(best["best_score"])
    assert best["best_score"] == pytest.approx(max(value(c) for c in [0.0, *(m for _, m in data if m == m)]))
    assert all(r["margin"] == r["margin"] for r in metrics.threshold_curve(scores).collect())


@pytest.mark.parametrize("n, ratio, k", [(11, 0.8, 8), (100, 0.29, 28), (5, 0.0, 0), (5, 1.0, 5), (1, 0.5, 0)])
def test_exact_sizes(spark, n, ratio, k):
    done = split.exact_split(spark.range(n), "id", ratio, 3).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in done} == {
        name: c for name, c in (("train", k), ("test", n - k)) if c}


def test_split_follows_the_seeded_order(spark):
    df = spark.range(5000)
    order = [r["id"] for r in split.seeded_order(df, "id", 9).collect()]
    assert sorted(order) == list(range(5000)) and order != list(range(5000))
    train = {r["id"] for r in split.exact_split(df.repartition(7), "id", 0.37, 9).where("split = 'train'").collect()}
    assert train == set(order[:1850])
    other = {r["id"] for r in split.exact_split(df, "id", 0.37, 10).where("split = 'train'").collect()}
    assert train != other


@pytest.mark.parametrize("ranked", [1, 40])
def test_split_refines_its_prefix(spark, monkeypatch, ranked):
    """However few records may be ranked together, the cut is the same."""
    df = spark.range(3000)
    want = {r["id"] for r in split.exact_split(df, "id", 0.43, 5).where("split = 'train'").collect()}
    monkeypatch.setattr(split, "PREFIX_DIGITS", 1)
    monkeypatch.setattr(split, "RANKED", ranked)
    assert {r["id"] for r in split.exact_split(df, "id", 0.43, 5).where("split = 'train'").collect()} == want
    assert len(want) == 1290


@pytest.mark.parametrize("ranked", [1 << 20, 5])
def test_repeated_and_missing_keys_split_exactly(spark, monkeypatch, ranked):
    """Wherever the cut falls among the copies of a key, the parts have their sizes and whole keys stay together."""
    monkeypatch.setattr(split, "RANKED", ranked)
    keys = [None] * 300 + [7] * 250 + list(range(100)) + [50] * 40
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k bigint, i bigint").repartition(6, "i")
    path = df.sparkSession.conf.get("spark.checkpoint.dir") + f"/copies-{ranked}"
    df.write.mode("overwrite").parquet(path)
    df = spark.read.parquet(path)
    order = [r["k"] for r in split.seeded_order(df, "k", 3).collect()]
    for ratio in (0.0, 0.1, 0.33, 0.5, 0.77, 0.9, 1.0):
        rows = split.exact_split(df, "k", ratio, 3).collect()
        assert sorted(r["i"] for r in rows) == list(range(690))
        train = [r["k"] for r in rows if r["split"] == "train"]
        assert sorted(train, key=str) == sorted(order[:int(ratio * 690)], key=str)
    parts = split.three_way_split(df, "k").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in parts} == {"train": 441, "val": 111, "test": 138}


def test_three_way_split(spark):
    done = split.three_way_split(spark.range(1000), "id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in done} == {"train": 640, "val": 160, "test": 200}


def test_row_offsets(micro):
    got = {r["row_id"]: (r["start"], r["stop"]) for r in curves.row_offsets(micro).collect()}
    assert got == {0: (0, 2), 1: (2, 3), 2: (3, 5), 3: (5, 6), 4: (6, 7), 7: (7, 7)}
