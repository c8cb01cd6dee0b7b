"""Related proteins: affine global alignment, identity, position groups and twins across a split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.operators.graph import connected

# A substitution matrix as published (BLOSUM62), rows and columns in the order of ``ORDER``.
ORDER = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62 = """
 4 -1 -2 -2  0 -1 -1  0 -2 -1 -1 -1 -1 -2 -1  1  0 -3 -2  0
-1  5  0 -2 -3  1  0 -2  0 -3 -2  2 -1 -3 -2 -1 -1 -3 -2 -3
-2  0  6  1 -3  0  0  0  1 -3 -3  0 -2 -3 -2  1  0 -4 -2 -3
-2 -2  1  6 -3  0  2 -1 -1 -3 -4 -1 -3 -3 -1  0 -1 -4 -3 -3
 0 -3 -3 -3  9 -3 -4 -3 -3 -1 -1 -3 -1 -2 -3 -1 -1 -2 -2 -1
-1  1  0  0 -3  5  2 -2  0 -3 -2  1  0 -3 -1  0 -1 -2 -1 -2
-1  0  0  2 -4  2  5 -2  0 -3 -3  1 -2 -3 -1  0 -1 -3 -2 -2
 0 -2  0 -1 -3 -2 -2  6 -2 -4 -4 -2 -3 -3 -2  0 -2 -2 -3 -3
-2  0  1 -1 -3  0  0 -2  8 -3 -3 -1 -2 -1 -2 -1 -2 -2  2 -3
-1 -3 -3 -3 -1 -3 -3 -4 -3  4  2 -3  1  0 -3 -2 -1 -3 -1  3
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4 -2  2  0 -3 -2 -1 -2 -1  1
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5 -1 -3 -1  0 -1 -3 -2 -2
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5  0 -2 -1 -1 -1 -1  1
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6 -4 -2 -2  1  3 -1
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7 -1 -1 -4 -3 -2
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4  1 -3 -2 -2
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5 -2 -2  0
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11  2 -3
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7 -1
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""
MATRIX = np.array([[int(x) for x in line.split()] for line in BLOSUM62.strip().splitlines()], np.float64)


def align(a: str, b: str, opening: int = 11, extending: int = 1) -> tuple[float, list[tuple[int, int]]]:
    """Global alignment with affine gaps, free at the ends: its score and the aligned positions from 1. Row by row; the gap along
    a row is a running maximum, so each row is a few vector operations."""
    a, b = a.upper(), b.upper()
    n, m = len(a), len(b)
    codes = {c: i for i, c in enumerate(ORDER)}
    scores = np.full((len(ORDER) + 1, len(ORDER) + 1), -1.0)  # residues beyond the twenty
    scores[:-1, :-1] = MATRIX
    x, y = (np.array([codes.get(c, len(ORDER)) for c in s], int) for s in (a, b))
    best, up = np.zeros((n + 1, m + 1)), np.full((n + 1, m + 1), -np.inf)
    left = np.full((n + 1, m + 1), -np.inf)
    j = np.arange(m + 1)
    for i in range(1, n + 1):
        up[i] = np.maximum(best[i - 1] - opening, up[i - 1] - extending)
        now = np.maximum(up[i], np.r_[0.0, best[i - 1, :-1] + scores[x[i - 1], y]])
        now[0] = 0.0
        left[i, 1:] = np.maximum.accumulate(now + j * extending)[:-1] - opening + extending - j[1:] * extending
        best[i] = np.maximum(now, left[i])
        best[i, 0] = 0.0
    i, k = (n, int(best[n].argmax())) if best[n].max() >= best[:, m].max() else (int(best[:, m].argmax()), m)
    score, pairs = float(best[i, k]), []
    while i > 0 and k > 0:
        if best[i, k] == best[i - 1, k - 1] + scores[x[i - 1], y[k - 1]]:
            pairs.append((i, k))
            i, k = i - 1, k - 1
        elif best[i, k] == up[i, k]:
            while up[i, k] != best[i - 1, k] - opening:
                i -= 1
            i -= 1
        else:
            gap = 1
            while best[i, k - gap] - opening - (gap - 1) * extending < best[i, k] - 1e-9:
                gap += 1
            k -= gap
    return score, pairs[::-1]


ALIGNED = "struct<score:double,identity_shorter:double,identity_aligned:double,first:array<int>,second:array<int>>"


def _aligned(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for left, right in parts:
        rows = []
        for a, b in zip(left, right, strict=True):
            score, pairs = align(a, b)
            same = sum(a[i - 1].upper() == b[j - 1].upper() for i, j in pairs)
            rows.append((score, same / max(1, min(len(a), len(b))), same / max(1, len(pairs)), [i for i, _ in pairs], [j for _, j in pairs]))
        yield pd.DataFrame(rows, columns=["score", "identity_shorter", "identity_aligned", "first", "second"])


def candidate_pairs(sequences: DataFrame, k: int = 3, least: float = 0.0) -> DataFrame:
    """Pairs of sequences (a < b) that share words of ``k`` residues, with the share of the shorter one's; joined by word."""
    from evidara.functions.text import kmers

    words = sequences.select("uniprot_id", F.explode(kmers(F.col("sequence"), k)).alias("w"))
    sizes = words.groupBy("uniprot_id").agg(F.count("*").alias("n"))
    a = words.join(sizes, "uniprot_id").select(F.col("uniprot_id").alias("a"), "w", F.col("n").alias("na"))
    b = words.join(sizes, "uniprot_id").select(F.col("uniprot_id").alias("b"), "w", F.col("n").alias("nb"))
    shared = a.join(b, "w").filter("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    return shared.withColumn("containment", F.col("shared") / F.least("na", "nb")).filter(F.col("containment") >= least).select("a", "b", "containment")


def alignments(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """Pairs (a, b) with their alignment."""
    s = sequences.select("uniprot_id", "sequence")
    both = pairs.join(s.withColumnsRenamed({"uniprot_id": "a", "sequence": "sa"}), "a").join(s.withColumnsRenamed({"uniprot_id": "b", "sequence": "sb"}), "b")
    return both.withColumn("alignment", F.pandas_udf(_aligned, ALIGNED)("sa", "sb")).select("a", "b", "alignment.*")


def position_groups(aligned: DataFrame) -> DataFrame:
    """(uniprot_id, position, cluster_id): aligned residues share a group, through others too."""
    residue = lambda who, at: F.concat_ws(":", who, F.col(at).cast("string"))
    each = aligned.select("a", "b", F.explode(F.arrays_zip("first", "second")).alias("p"))
    edges = each.select(residue(F.col("a"), "p.first").alias("a"), residue(F.col("b"), "p.second").alias("b"))
    parts = F.split("node", ":")
    return connected(edges).select(F.element_at(parts, 1).alias("uniprot_id"), F.element_at(parts, 2).cast("bigint").alias("position"), F.col("component").alias("cluster_id"))


def twins(test: DataFrame, train: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: test variants whose aligned position trains in another protein, and those with the same residues there."""
    at = ["uniprot_id", "position"]
    t = test.join(groups, at).withColumnRenamed("uniprot_id", "test_id")
    r = train.join(groups, at).select("cluster_id", F.col("uniprot_id").alias("train_id"), F.col("wt_aa").alias("w"), F.col("mut_aa").alias("m")).distinct()
    hit = t.join(r, "cluster_id").filter("test_id != train_id").groupBy("test_id", "position", "wt_aa", "mut_aa").agg(F.max(((F.col("w") == F.col("wt_aa")) & (F.col("m") == F.col("mut_aa"))).cast("int")).alias("exact"))
    return hit.agg(F.count("*").alias("n_position"), F.coalesce(F.sum("exact"), F.lit(0)).alias("n_exact"))


def identity_clusters(aligned: DataFrame, sequences: DataFrame, threshold: float = 0.25, metric: str = "identity_shorter") -> DataFrame:
    """Single linkage: sequences joined by a chain of pairs at or above the threshold; the rest stand alone."""
    found = connected(aligned.filter(F.col(metric) >= threshold).select("a", "b")).withColumnsRenamed({"node": "uniprot_id", "component": "cluster"})
    return sequences.select("uniprot_id").join(found, "uniprot_id", "left").withColumn("cluster", F.coalesce("cluster", "uniprot_id"))
