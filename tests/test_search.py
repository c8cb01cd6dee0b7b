"""Vector search against plain sums."""

import functools
import math
import random

from pyspark.sql import functions as F

from evidara.operators import search


def plain_cosine(a, b):
    if len(a) != len(b) or None in a or None in b:
        return None
    dot = lambda x, y: functools.reduce(lambda n, p: n + p[0] * p[1], zip(x, y), 0.0)  # noqa: E731  not sum(), which is compensated
    size = math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))
    return dot(a, b) / size if size > 0 else None


def test_vector_top_over_cells_with_copies_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_VECTORS", 40)
    monkeypatch.setattr(search, "BLOCK_QUERIES", 7)
    draw = random.Random(5)
    vectors = [(i, [draw.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    vectors += [(200 + i, list(vectors[3][1])) for i in range(20)]  # copies tie, by key
    vectors += [(300, [0.0] * 6), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [1.0, 2.0]), (303, [2.0, 4.0]), (304, None), (305, []), (306, [1e-160] * 6), (307, [1e-160] * 5 + [2e-160])]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    queries = rows.filter("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in search.vector_top(rows, queries, 4, "vec_id").collect()}
    want = {}
    for q, a in vectors:
        if q % 3 == 0 and a is not None:
            scored = [(plain_cosine(a, b), k) for k, b in vectors if b is not None]
            best = sorted(((-s, k) for s, k in scored if s is not None and s > 0))[:4]
            want |= {(q, n + 1): (k, -s) for n, (s, k) in enumerate(best)}
    assert got == want


def test_vector_top_compares_blocks_not_pairs_of_rows(spark):
    rows = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id"), F.sin(F.col("id") * 7)).alias("embedding"))
    plan = search.vector_top(rows, rows.withColumnRenamed("vec_id", "query_id"), 2, "vec_id")._jdf.queryExecution().toString()
    assert "Join" not in plan  # a join makes a row of each pair


def test_terms_know_their_documents_length(spark):
    """Texts are dealt by key once; rows of one key are one document, and a document's terms carry its number of tokens."""
    from evidara.operators import search

    docs = spark.createDataFrame([(1, "Alpha beta-gamma alpha"), (1, "delta"), (2, "alpha"), (3, ""), (4, None), (None, "alpha beta")], "d long, text string")
    terms = search.tokenised(docs, "d", "text")
    got = sorted((r.d, r.term, r.tf, r.length) for r in search.postings(terms, "d").collect())
    assert got == [(1, "alpha", 2, 6), (1, "beta", 1, 6), (1, "beta-gamma", 1, 6), (1, "delta", 1, 6), (1, "gamma", 1, 6), (2, "alpha", 1, 1)]
    assert search.corpus_figures(docs, terms).first() == (6, 9 / 6)
