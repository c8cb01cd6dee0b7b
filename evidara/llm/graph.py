"""Connected components of an edge table, by alternating large and small stars.

A large star joins every larger neighbour of a node to the smallest node around it, a small star every smaller one; both keep
components and each pair of them about halves the depth, until every node hangs on the smallest of its component. All steps
are aggregates with partial results and joins in which a hub is dealt over several tasks; each round is written to the shared
folder. Nodes are of any ordered type, structs as well.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.skew import attach
from evidara.llm.workspace import Workspace


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one edge and no centre is a node that hangs on another."""
    twice = edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
    inner = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi")
    return twice.union(inner).isEmpty()


def components(edges: DataFrame, space: Workspace) -> DataFrame:
    """``edges`` (a, b) of any ordered type; node and root (the smallest node of its component) of every node of an edge
    between two nodes that is not the root itself."""
    u, v = F.greatest("a", "b"), F.least("a", "b")
    now = space.save(edges.filter("a != b").select(u.alias("u"), v.alias("v")).distinct(), "stars0")
    step = 0
    while not _stars(now):
        step += 1
        both = space.save(now.union(now.select("v", "u")), f"both{step}")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        joined = attach(both, low.drop("n"), "u", low.select("u", "n"))
        large = space.save(joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), f"large{step}")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = attach(large, low.drop("n"), "u", low.select("u", "n"))
        small = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        now = space.save(small.distinct(), f"stars{step}")
        space.drop(f"both{step}", f"large{step}", f"stars{step - 1}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def merge(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i] in ``roots``, where each node points at the smallest node of its set."""
    while len(a):
        x, y = roots[a], roots[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(roots, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = roots[roots]
            if (further == roots).all():
                break
            roots[:] = further
