"""Vectors of feature length, and the fit problems that produce them.

``DenseProblem`` keeps vectors as arrays on the driver, for widths within the
broadcast bound. ``SlicedFits`` keeps those of many fits as tables of slices beside
a grid of the examples, so models of any width can be fitted together without
collecting one. ``TableProblem`` does so for one fit by joins of ``(j, x)`` tables.
"""

from __future__ import annotations

import weakref
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparselin.functions.losses import Loss
from sparselin.operators import objective as obj
from sparselin.operators import grid as G
from sparselin.operators.matvec import hot_features, to_coo
from sparselin.session import MAX_BROADCAST_ROWS, RotatingTable, delete, materialize, scratch_path
from sparselin.sources import weights as W


class _Dense:
    """Vector operations on driver arrays."""

    def __init__(self, n_features: int):
        self.n_features = n_features

    def zeros(self) -> np.ndarray:
        return np.zeros(self.n_features)

    def dot(self, a, b) -> float:
        return float(a @ b)

    def combine(self, a, scale: float, b, kind: str):
        """a + scale * b; ``kind`` says which of the solver's vectors this is a version of."""
        return a + scale * b

    def largest(self, a) -> float:
        return float(np.max(np.abs(a), initial=0.0))

    def hold(self, *kinds: str) -> None:
        """The last vectors of these kinds stay in use until the next call."""


class DenseProblem(_Dense):
    """One objective over packed examples; every method is one Spark job."""

    def __init__(self, blocks: obj.Blocks, loss: Loss, C: float):
        super().__init__(blocks.n_features)
        self.blocks, self.loss, self.C = blocks, loss, float(C)

    def value_and_gradient(self, w):
        return self.completed(("value", w), self.blocks.loss_and_slope(self.loss, w))

    def hessian_vector(self, w, s):
        return self.completed(("product", w, s), self.blocks.curvature_product(self.loss, w, s))

    def completed(self, request: tuple, sums):
        """The answer to a request from the sums over the examples: the penalty's part is added."""
        if request[0] == "value":
            w, (total, slope) = request[1], sums
            return 0.5 * float(w @ w) + self.C * total, w + self.C * slope
        return request[2] + self.C * sums

    def to_table(self, w, spark) -> DataFrame:
        return W.from_array(spark, w)

    def from_table(self, weights: DataFrame) -> np.ndarray:
        return W.to_array(weights, self.n_features)


def _keyed(rows: DataFrame, partitions: int | None) -> DataFrame:
    """The rows hash-partitioned by ``row_id`` and persisted.

    Per-row sums and the way back to the rows then need no exchange of rows.
    Without a partition count AQE sizes the partitions.
    """
    keyed = rows.repartition(partitions, "row_id") if partitions else rows.repartition("row_id")
    return keyed.persist(StorageLevel.MEMORY_AND_DISK)


class CooProblem(_Dense):
    """The same objective by joins and aggregations, with driver vectors."""

    def __init__(self, rows: DataFrame, n_features: int, loss: Loss, C: float, partitions: int | None = None):
        super().__init__(n_features)
        self.spark = rows.sparkSession
        self.rows = _keyed(rows, partitions)
        self.loss, self.C = loss, float(C)
        self.hot = hot_features(to_coo(self.rows)) if n_features > MAX_BROADCAST_ROWS else []

    def close(self) -> None:
        self.rows.unpersist()

    def value_and_gradient(self, w):
        sums = obj.loss_and_slope(self.rows, W.from_array(self.spark, w), self.loss, self.n_features, hot=self.hot).toArrow()
        j, z = sums["j"].to_numpy(), sums["z"].to_numpy()
        slope = np.zeros(self.n_features)
        slope[j[j >= 0]] = z[j >= 0]
        total = float(z[j == obj.LOSS_ID].sum())
        return 0.5 * float(w @ w) + self.C * total, w + self.C * slope

    def hessian_vector(self, w, s):
        vectors = W.from_arrays(self.spark, w=w, s=s)
        z = obj.curvature_product(self.rows, vectors, self.loss, self.n_features, hot=self.hot)
        return s + self.C * W.to_array(z, self.n_features, "z")

    def to_table(self, w, spark) -> DataFrame:
        return W.from_array(spark, w)

    def from_table(self, weights: DataFrame) -> np.ndarray:
        return W.to_array(weights, self.n_features)


@dataclass
class TableVector:
    """A written vector ``(j, x)`` with the figures the solver asks for most; an absent feature is 0."""

    df: DataFrame
    square: float = 0.0
    largest: float = 0.0


class TableProblem:
    """The same objective with vectors as tables, for any number of features."""

    def __init__(
        self,
        rows: DataFrame,
        n_features: int,
        loss: Loss,
        C: float,
        partitions: int | None = None,
        max_broadcast: int = MAX_BROADCAST_ROWS,
    ):
        self.spark = rows.sparkSession
        self.n_features = n_features
        self.rows = _keyed(rows, partitions)
        self.loss, self.C, self.max_broadcast = loss, float(C), max_broadcast
        self.hot = hot_features(to_coo(self.rows)) if n_features > max_broadcast else []
        # Of each kind of vector the solver needs the last version, and of some a held one.
        self._tables: dict[str, RotatingTable] = {}

    def close(self) -> None:
        self.rows.unpersist()

    def _rotating(self, kind: str) -> RotatingTable:
        if kind not in self._tables:
            self._tables[kind] = RotatingTable(self.spark, kind)
        return self._tables[kind]

    def _keep(self, kind: str, df: DataFrame) -> TableVector:
        written = self._rotating(kind).write(df)
        x = F.col("x")
        figures = written.agg(
            F.coalesce(F.sum(x * x), F.lit(0.0)).alias("square"),
            F.coalesce(F.max(F.abs(x)), F.lit(0.0)).alias("largest")).first()
        return TableVector(written, **figures.asDict())

    def hold(self, *kinds: str) -> None:
        for kind in kinds:
            if kind in self._tables:
                self._tables[kind].hold()

    def _lookup(self) -> dict:
        return {"width": self.n_features, "hot": self.hot, "max_broadcast": self.max_broadcast}

    def zeros(self) -> TableVector:
        return TableVector(self.spark.createDataFrame([], "j bigint, x double"))

    def dot(self, a: TableVector, b: TableVector) -> float:
        if a is b:
            return a.square
        both = a.df.join(b.df.withColumnRenamed("x", "x2"), "j")
        return both.agg(F.coalesce(F.sum(F.col("x") * F.col("x2")), F.lit(0.0))).first()[0]

    def combine(self, a: TableVector, scale: float, b: TableVector, kind: str) -> TableVector:
        both = a.df.join(b.df.withColumnRenamed("x", "x2"), "j", "full_outer")
        total = F.coalesce("x", F.lit(0.0)) + scale * F.coalesce("x2", F.lit(0.0))
        return self._keep(kind, both.select("j", total.alias("x")))

    def largest(self, a: TableVector) -> float:
        return a.largest

    def value_and_gradient(self, w: TableVector):
        weights = w.df.withColumnRenamed("x", "w")
        sums = self._rotating("sums").write(
            obj.loss_and_slope(self.rows, weights, self.loss, **self._lookup()))
        total = sums.where(F.col("j") == obj.LOSS_ID).agg(F.coalesce(F.sum("z"), F.lit(0.0))).first()[0]
        slope = TableVector(sums.where(F.col("j") >= 0).withColumnRenamed("z", "x"))
        return 0.5 * w.square + self.C * total, self.combine(w, self.C, slope, "gradient")

    def hessian_vector(self, w: TableVector, s: TableVector) -> TableVector:
        vectors = w.df.withColumnRenamed("x", "w").join(s.df.withColumnRenamed("x", "s"), "j", "full_outer").select(
            "j", F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("s", F.lit(0.0)).alias("s"))
        h = obj.hessian_vector(self.rows, vectors, self.loss, self.C, strategy="coo", **self._lookup())
        return self._keep("product", h.withColumnRenamed("h", "x"))

    def to_table(self, w: TableVector, spark) -> DataFrame:
        return w.df.withColumnRenamed("x", "w")

    def from_table(self, weights: DataFrame) -> TableVector:
        return self._keep("weights", weights.select("j", F.col("w").alias("x")))


class Stored:
    """A written table of slices, deleted when no vector in it is in use any more."""

    def __init__(self, spark: SparkSession, df: DataFrame):
        path = scratch_path(spark, "slices")
        self.df = materialize(df, path)
        weakref.finalize(self, delete, spark, path).atexit = False


@dataclass(eq=False)
class SlicedVector:
    """The slices of a written table under one number; a missing slice is 0, and so is a vector without a table."""

    stored: Stored | None = None
    ask: int = 0
    square: float = 0.0
    largest: float = 0.0
    # The vector whose inner product with this one came with it, and that product.
    partner: SlicedVector | None = None
    dot: float = 0.0


class SlicedProblem:
    """One of several fits on the same examples; ``SlicedFits`` answers what it asks for."""

    def __init__(self, fits: SlicedFits, loss: Loss, C: float):
        self.fits, self.loss, self.C, self.n_features = fits, loss, float(C), fits.n_features

    def zeros(self) -> SlicedVector:
        return SlicedVector()

    def hold(self, *kinds: str) -> None:
        """A vector stays as long as something refers to it."""

    def largest(self, a: SlicedVector) -> float:
        return a.largest

    def to_table(self, w: SlicedVector, spark) -> DataFrame:
        """``(j, w)``, written, so that it outlives the fit."""
        found = G.unsliced(self.fits.slices([(w, 0, 1.0)]), self.fits.grid.span).select("j", "w")
        return materialize(found, scratch_path(spark, "weights"))

    def from_table(self, weights: DataFrame) -> SlicedVector:
        terms = G.sliced(weights, self.fits.grid.span).select("ask", "span", F.lit(1.0).alias("scale"), "x", F.lit(False).alias("partner"))
        return self.fits._keep(G.weighted_sums(terms), 1)[0][0]


class SlicedFits:
    """Fits in lockstep with all vectors in tables: a pass, and a step of arithmetic, serves every fit that waits for it."""

    def __init__(self, rows: DataFrame, n_features: int, span: int | None = None, cell_bytes: int | None = None):
        self.spark, self.n_features = rows.sparkSession, n_features
        self.grid = G.Grid(obj.within(rows, n_features), n_features, span, cell_bytes)

    def close(self) -> None:
        self.grid.close()

    def slices(self, wanted: Sequence[tuple[SlicedVector, int, float]], partner: bool = False) -> DataFrame:
        """``TERMS`` of ``(vector, new number, scale)``; each table is read once."""
        by_table: dict[int, tuple[Stored, list]] = {}
        for vector, ask, scale in wanted:
            if vector.stored is not None:
                by_table.setdefault(id(vector.stored), (vector.stored, []))[1].append((vector.ask, ask, float(scale)))
        # As many rows as vectors are asked for.
        parts = [stored.df.where(F.col("span") != G.HEAD).join(
            F.broadcast(self.spark.createDataFrame(names, "ask int, _to int, scale double")), "ask").select(
            F.col("_to").alias("ask"), "span", "scale", "x") for stored, names in by_table.values()]
        terms = reduce(DataFrame.unionAll, parts) if parts else self.spark.createDataFrame([], "ask int, span int, scale double, x binary")
        return terms.withColumn("partner", F.lit(partner))

    def _keep(self, sums: DataFrame, n: int) -> tuple[list[SlicedVector], list[float]]:
        """The written sums as vectors, and their totals of span ``HEAD``; the figures are columns of their own beside the slices."""
        stored = Stored(self.spark, sums)
        head = F.col("span") == G.HEAD
        # A row a vector. (An observation of the write would save this job, but a session that has made one can
        # not run Spark ML models any more.)
        rows = stored.df.groupBy("ask").agg(
            *(F.sum(F.when(~head, F.col(c))).alias(c) for c in ("square", "dot")), F.max(F.when(~head, F.col("largest"))).alias("largest"),
            F.sum(F.when(head, F.col("dot"))).alias("total")).collect()
        found = {r["ask"]: {name: x or 0.0 for name, x in r.asDict().items()} for r in rows}
        none = {"square": 0.0, "largest": 0.0, "dot": 0.0, "total": 0.0}
        each = [found.get(k, none) for k in range(n)]
        return [SlicedVector(stored, k, x["square"], x["largest"], None, x["dot"]) for k, x in enumerate(each)], [x["total"] for x in each]

    def _combine(self, requests: list[list[tuple]]) -> list[list[SlicedVector]]:
        each = [one for some in requests for one in some]
        wanted = [x for k, (a, scale, b, _) in enumerate(each) for x in ((a, k, 1.0), (b, k, scale))]
        made = iter(self._keep(G.weighted_sums(self.slices(wanted)), len(each))[0])
        return [[next(made) for _ in some] for some in requests]

    def _dots(self, requests: list[list[tuple]]) -> list[list[float]]:
        def known(a, b):
            if a is b:
                return a.square
            if not (a.stored and b.stored):
                return 0.0
            return a.dot if a.partner is b else b.dot if b.partner is a else None

        apart = {(id(a), id(b)): (a, b) for pairs in requests for a, b in pairs if known(a, b) is None}
        place, found = {pair: k for k, pair in enumerate(apart)}, {}
        if apart:
            sides = [self.slices([(pair[side], k, 1.0) for k, pair in enumerate(apart.values())]) for side in (0, 1)]
            found = {r["ask"]: r["dot"] for r in G.inner_products(reduce(DataFrame.unionAll, sides).select("ask", "span", "x")).collect()}
        return [[found.get(place[id(a), id(b)], 0.0) if (x := known(a, b)) is None else x for a, b in pairs] for pairs in requests]

    def _pass(self, problems: list[SlicedProblem], requests: list[tuple]) -> list:
        vectors = [(x, 2 * k + i, 1.0) for k, (_, *xs) in enumerate(requests) for i, x in enumerate(xs)]
        # The penalty's part: w of a value, s of a product.
        more = self.slices([(xs[-1], k, 1.0) for k, (_, *xs) in enumerate(requests)], partner=True)
        sums = self.grid.sums(self.slices(vectors), [(p.loss, kind) for p, (kind, *_) in zip(problems, requests)], [p.C for p in problems], more)
        found, totals = self._keep(sums, len(requests))
        for x, (_, *xs) in zip(found, requests):
            x.partner = xs[-1]
        return [x if kind == "product" else (0.5 * w.square + p.C * total, x)
                for x, total, p, (kind, w, *_) in zip(found, totals, problems, requests)]

    def answers(self, asked: list[tuple[SlicedProblem, tuple]]) -> list:
        """What ``newton.minimize_together`` asks: arithmetic, or passes."""
        out: list = [None] * len(asked)

        def put(kinds, answer) -> None:
            places = [i for i, (_, request) in enumerate(asked) if request[0] in kinds]
            if places:
                for i, x in zip(places, answer([asked[i] for i in places])):
                    out[i] = x

        put(("combine",), lambda some: self._combine([request[1] for _, request in some]))
        put(("dots",), lambda some: self._dots([request[1] for _, request in some]))
        size = G.VECTORS // 2
        put(("value", "product"), lambda some: [
            x for i in range(0, len(some), size) for x in self._pass([p for p, _ in some[i:i + size]], [r for _, r in some[i:i + size]])])
        return out
