"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

The model learns from a small table of labelled URLs, ``host, path, label`` (1: block); here the distinct
host and path pairs that a rule decides, at most ``LABELLED`` of them in the order of a hash.

Rows: a null url or one without ``://`` has an empty host and path and is judged by the intercept; repeated
rows are judged each; other columns are ignored. Without two classes to learn from, every url gets the one
class that was seen, or is allowed. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparselin.llm.ngrams import distinct, features, logistic
from sparselin.llm.store import Scratch, bounded_sample, extended, map_batches
from sparselin.plans.fit import fit as fit_linear

ORDERS = range(2, 6)
BITS = 18
LABELLED = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(pages: DataFrame) -> DataFrame:
    """``pages`` with ``host`` and ``path``."""
    start = F.instr("url", "://")
    rest = F.when(start > 0, F.col("url").substr(start + 3, F.length("url")))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return (pages.withColumn("host", F.coalesce(host, F.lit("")))
            .withColumn("path", F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))))


def split_rule(rule: str) -> tuple[str, str]:
    host, _, path = rule.partition("/")
    return host, "/" + path


def ruled(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``pages`` with the longest rule ``(verdict, rule)`` that fits, and its verdict; null if none does.

    A short list, compiled into one expression.
    """
    def fits(rule: str) -> Column:
        host, path = split_rule(rule)
        return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)

    longest = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    def first(value) -> Column:
        return F.coalesce(*[F.when(fits(r[1]), F.lit(value(r))) for r in longest], F.lit(None).cast("string"))
    return pages.withColumn("rule", first(lambda r: r[1])).withColumn("ruling", first(lambda r: r[0]))


def occurring(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(url, feature)`` of the n-grams of host and path, each once per url, in order."""
    a, b = features(hosts, ORDERS, BITS, salt=1), features(paths, ORDERS, BITS, salt=2)
    return distinct(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), BITS)


def labelled(judged: DataFrame, bound: int = LABELLED) -> DataFrame:
    """The small labelled table: what the rules decide."""
    ruled_on = judged.where("ruling is not null").select("host", "path", (F.col("ruling") == "block").alias("label")).distinct()
    return bounded_sample(ruled_on, ["host", "path"], bound)


def train(table: DataFrame) -> np.ndarray:
    """Weights of the 2^18 hashed features, the intercept behind them."""
    width = 1 << BITS
    scratch = Scratch(table.sparkSession, "urls")
    table = scratch.table(table.select("host", "path", "label"), "labelled")
    n, blocked = table.agg(F.count("*"), F.count_if("label")).first()
    if not 0 < blocked < n:
        return np.append(np.zeros(width), 1.0 if n and blocked == n else -1.0)

    def task(part):
        hosts, paths = part.column(0).to_pylist(), part.column(1).to_pylist()
        owner, own = occurring(hosts, paths)
        bounds = np.searchsorted(owner, np.arange(len(hosts) + 1))
        lists = [np.append(own[a:b], width) for a, b in zip(bounds, bounds[1:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(hosts))), pa.array(np.where(part.column(2).to_numpy(zero_copy_only=False), 1.0, -1.0)),
             pa.array(lists, pa.list_(pa.int64())), pa.array([np.ones(len(p)) for p in lists], pa.list_(pa.float64()))],
            names=["row_id", "label", "indices", "values"])

    rows = map_batches(table, task, "row_id long, label double, indices array<bigint>, values array<double>")
    fitted = fit_linear(rows, "lr", C=1.0, eps=1e-2, strategy="partition", n_features=width + 1)
    scratch.drop("labelled")
    return fitted.w


def judge(pages: DataFrame, rules: list[tuple[str, str]], bound: int = LABELLED) -> DataFrame:
    """``page_id, host, path, rule, verdict, score``: the rule's verdict, else the model's."""
    judged = ruled(host_and_path(pages.select("page_id", F.col("url").cast("string").alias("url"))), rules).drop("url")
    weights = train(labelled(judged, bound))
    used = np.flatnonzero(weights[:-1])
    slot, kept, intercept = used.astype(np.int64), weights[used], float(weights[-1])
    names = judged.columns

    def task(part):
        hosts, paths = (part.column(names.index(n)).to_pylist() for n in ("host", "path"))
        weight = np.zeros(1 << BITS)
        weight[slot] = kept
        owner, own = occurring(hosts, paths)
        score = logistic(intercept + np.bincount(owner, weights=weight[own], minlength=len(hosts)))
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*names, "score"])

    by_model = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return map_batches(judged, task, extended(judged, names, "score double")).select(
        "page_id", "host", "path", "rule", F.coalesce("ruling", by_model).alias("verdict"), "score")
