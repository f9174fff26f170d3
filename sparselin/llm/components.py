"""Connected components of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparselin.llm.store import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, component``: every node of ``links`` (``a, b``) with the smallest node it reaches.

    A round points each node to the smallest of itself and its neighbours. Pointers are then doubled until all end at
    a node that points to itself, so a path of any order takes a logarithm of its length, and the ends of all links
    are renamed; links within one name vanish. Names stay connected as their nodes were, since a node's link to the
    node it points to becomes one between their names. Of two rounds one at least halves the names that have
    links: those left after a round have no link among each other before it, so no more than half of them
    are without a smaller neighbour twice. Rounds end when no link is left. Each step is a written table, so links and
    names never meet in the driver and a lost executor repeats one step at most; a table is dropped when the next
    one is written.
    """
    edges = scratch.table(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-0")
    names, round_ = None, 0
    while not edges.isEmpty():
        round_ += 1
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointers = both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).select(F.col("a").alias("from"), "to")
        step, jumps = scratch.table(pointers, f"{name}-step-{round_}-0"), 0
        while True:
            jumps += 1
            onward = step.select(F.col("from").alias("to"), F.col("to").alias("end"))
            ahead = scratch.table(step.join(onward, "to").select("from", F.col("end").alias("to"), (F.col("end") < F.col("to")).alias("moved")),
                                  f"{name}-step-{round_}-{jumps}")
            scratch.drop(f"{name}-step-{round_}-{jumps - 1}")
            step = ahead.select("from", "to")
            if ahead.where("moved").isEmpty():
                break
        moved = (edges.join(step.select(F.col("from").alias("a"), F.col("to").alias("x")), "a")
                 .join(step.select(F.col("from").alias("b"), F.col("to").alias("y")), "b")
                 .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        edges = scratch.table(moved, f"{name}-{round_}")
        if names is None:
            named = step.select(F.col("from").alias("node"), F.col("to").alias("component"))
        else:
            named = names.join(step, names["component"] == step["from"], "left").select("node", F.coalesce("to", "component").alias("component"))
        names = scratch.table(named, f"{name}-names-{round_}")
        scratch.drop(f"{name}-{round_ - 1}", f"{name}-step-{round_}-{jumps}", f"{name}-names-{round_ - 1}")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")) if names is None else names
