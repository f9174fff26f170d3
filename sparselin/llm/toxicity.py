"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A feature is whether a hashed n-gram occurs in a text. Over the training texts its log-count ratio is
r = log((p + a) / (P + 2a)) - log((n + a) / (N + 2a)), with p and n the toxic and other texts that have it
and P and N all of them. Features that fewer than ``MIN_TEXTS`` texts have are left out, and so are those whose
ratio is within ``MIN_Z`` standard errors of 0, unless they are among the ``LEAST`` that are furthest from it: few
training texts give small z whatever they say. Logistic regression on the scaled rest gives the weights.

The fit takes at most ``TRAIN_ROWS`` labelled texts, in the order of a hash of their ids; scoring takes every
whole text. Rows: a null or empty text is scored by the intercept; a null id is never a training row;
repeated rows are scored each; of contradicting labels of an id the toxic one counts; null labels are ignored;
other columns stay as they are. Without two classes to learn from, every score is the share of toxic rows (0 if none).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparselin.llm.ngrams import distinct, features, logistic
from sparselin.llm.store import Scratch, bounded_sample, extended, give_back, map_batches, named, others, slices, text_column
from sparselin.plans.fit import fit as fit_linear
from sparselin.session import ship_package

ORDERS = range(3, 6)
BITS = 20
TRAIN_ROWS = 20_000
MIN_TEXTS = 5
MIN_Z = 4.0
# Features that are kept whatever their z.
LEAST = 1 << 10
SMOOTHING = 1.0
# Bytes of text whose n-grams a task holds at once.
SLICE = 1 << 19
SCORES = "score double, predicted int"


@dataclass
class Model:
    """``weight[k]`` belongs to hashed feature ``feature[k]``; features ascend."""

    feature: np.ndarray
    weight: np.ndarray
    intercept: float


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from learning; a null id is not held out, and has no label."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """``doc_id, text, toxic`` of at most ``bound`` labelled rows that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    chosen = bounded_sample(known.groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic")), ["doc_id"], bound)
    # The broadcast side has at most ``bound`` rows of an id and a flag.
    return docs.select("doc_id", text_column()).join(F.broadcast(chosen), "doc_id")


def count_features(rows: DataFrame) -> DataFrame:
    """``feature, toxic, other``: training texts of either class that have each feature."""
    def count(batches):
        counts = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for part in slices(batch, SLICE):
                toxic = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                owner, feature = distinct(*features(part.column(0).to_pylist(), ORDERS, BITS), BITS)
                for k in range(2):
                    counts[k] += np.bincount(feature[toxic[owner] == k], minlength=1 << BITS)
        batch = part = owner = feature = None
        found = np.flatnonzero(counts.any(axis=0))
        for at in range(0, len(found), 1 << 16):
            some = found[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[1, some]), pa.array(counts[0, some])],
                                             names=["feature", "toxic", "other"])
        counts = found = some = None
        give_back()

    ship_package(rows.sparkSession)
    partial = rows.select("text", "toxic").mapInArrow(count, "feature long, toxic long, other long")
    return partial.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def scaled_rows(rows: DataFrame, feature: np.ndarray, ratio: np.ndarray) -> DataFrame:
    """Training texts as sparse rows of scaled features, with a constant one last."""
    def task(part):
        texts, toxic = part.column(0).to_pylist(), part.column(1).to_numpy(zero_copy_only=False)
        owner, own = chosen_features(texts, feature)
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        width = len(feature)
        pairs = [np.append(own[a:b], width) for a, b in zip(bounds, bounds[1:])]
        values = [np.append(ratio[p[:-1]], 1.0) for p in pairs]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(texts))), pa.array(np.where(toxic, 1.0, -1.0)),
             pa.array(pairs, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.float64()))],
            names=["row_id", "label", "indices", "values"])

    return map_batches(rows.select("text", "toxic"), task,
                       "row_id long, label double, indices array<bigint>, values array<double>", SLICE)


def chosen_features(texts: list[str], feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(text, place in feature)`` of the model's features that occur, each once per text, in order."""
    slot = np.full(1 << BITS, -1, np.int32)
    slot[feature] = np.arange(len(feature), dtype=np.int32)
    owner, found = features(texts, ORDERS, BITS)
    place = slot[found]
    keep = place >= 0
    return distinct(owner[keep], place[keep], BITS)


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> Model:
    """Fit on labelled texts; they are written once, and every pass reads them."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.table(training_rows(docs, labels, bound), "train")
    n, n_toxic = rows.agg(F.count("*"), F.coalesce(F.count_if("toxic"), F.lit(0))).first()
    if not 0 < n_toxic < n:
        share = n_toxic / n if n else 0.0
        scratch.drop("train")
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    a = SMOOTHING
    p, q = F.col("toxic") + a, F.col("other") + a
    ratio = F.log(p / (n_toxic + 2 * a)) - F.log(q / (n - n_toxic + 2 * a))
    z = F.abs("ratio") / F.sqrt(1 / p + 1 / q)
    counted = count_features(rows).where(F.col("toxic") + F.col("other") >= MIN_TEXTS).withColumn("ratio", ratio)
    ranked = scratch.table(counted.select("feature", "ratio", z.alias("z")), "features")
    # At most one row for each of the 2^20 hashed features, and only those that tell the classes apart.
    passing = ranked.where(F.col("z") >= MIN_Z)
    if passing.count() < LEAST:
        passing = ranked.orderBy(F.desc("z"), "feature").limit(LEAST)
    chosen = passing.select("feature", "ratio").orderBy("feature").collect()
    feature = np.array([r["feature"] for r in chosen], np.int64)
    ratios = np.array([r["ratio"] for r in chosen], np.float64)
    # Written, so that no task needs a Python worker for these rows and another one to pack them.
    scaled = scratch.table(scaled_rows(rows, feature, ratios), "scaled")
    fitted = fit_linear(scaled, "lr", C=1.0, eps=1e-3, strategy="partition",
                        n_features=len(feature) + 1)
    scratch.drop("train", "features", "scaled")
    return Model(feature, fitted.w[:-1] * ratios, float(fitted.w[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on), for every whole text; columns of those names are replaced."""
    names = others(docs, SCORES)
    docs = docs.select(*named(names))
    weights, intercept, feature = model.weight, model.intercept, model.feature

    def task(part):
        texts = [t or "" for t in part.column(names.index("text")).to_pylist()]
        owner, own = chosen_features(texts, feature)
        margin = intercept + np.bincount(owner, weights=weights[own], minlength=len(texts))
        scores = logistic(margin)
        yield pa.RecordBatch.from_arrays(
            [*part.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    return map_batches(docs, task, extended(docs, names, SCORES), SLICE)
