"""Search: postings, BM25, vectors, rank fusion and filters. An index is a few tables; queries are a table too."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from evidara.functions.text import TOKEN, token_parts, tokens
from evidara.operators.graph import _shared
from evidara.operators.ranking import top_k_by_group

K1, B, FUSION = 1.5, 0.75, 60
#: Rows of a block of vectors and of queries, and queries of one matrix product.
BLOCK_VECTORS, BLOCK_QUERIES, STRIP = 8192, 4096, 128
#: More than a cosine of a matrix product can differ from one summed in order, for vectors whose squares sum to between these.
ERROR, SQUARES = 1e-9, (1e-200, 1e200)


def tokenised(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, length), written once: tokens are read word by word in plain columns, so texts are gone over a single time.
    Texts are dealt by key first, and all that follows counts where they are; length is the document's number of tokens."""
    dealt = documents.select(key, F.coalesce(F.col(text), F.lit("")).alias("__t")).repartition(key)
    words = dealt.select(key, F.explode(F.regexp_extract_all("__t", F.lit(TOKEN), F.lit(0))).alias("word"))
    counted = words.groupBy(key, F.lower("word").alias("word")).agg(F.count("*").alias("times"))
    each = counted.select(key, "times", F.explode(token_parts(F.col("word"))).alias("term"))
    terms = each.groupBy(key, "term").agg(F.sum("times").alias("tf"))
    return _shared(terms.withColumn("length", F.sum("tf").over(Window.partitionBy(key))))


def postings(terms: DataFrame, key: str) -> DataFrame:
    """(term, key, tf, length) from ``tokenised``: one row for each term of each document."""
    return terms.select("term", key, "length", "tf").filter(F.col(key).isNotNull())


def corpus_figures(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """One row: number of documents and their mean length in tokens."""
    return terms.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total")).join(F.broadcast(documents.agg(F.count("*").alias("n_docs")))).select("n_docs", (F.col("total") / F.col("n_docs")).alias("avg_length"))


def bm25(index: DataFrame, figures: DataFrame, queries: DataFrame, key: str, query: str = "query_id", text: str = "text") -> DataFrame:
    """(query, key, score) of all documents with a term of the query; a query's terms count once."""
    terms = queries.select(query, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    asked = index.join(terms.select("term").distinct(), "term", "left_semi")
    df = asked.groupBy("term").agg(F.count("*").alias("df"))
    weighed = asked.join(df, "term").join(F.broadcast(figures))  # figures is one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    return weighed.select("term", key, part.alias("part")).join(terms, "term").groupBy(query, key).agg(F.sum("part").alias("score"), F.count("*").alias("n_terms"))


def search_all_then_any(scored: DataFrame, queries: DataFrame, k: int, key: str, query: str = "query_id", text: str = "text") -> DataFrame:
    """The best k documents of each query: those with all its terms first, filled up with the rest."""
    sizes = queries.select(query, F.size(F.array_distinct(tokens(F.col(text)))).alias("n_all"))
    ranked = scored.join(sizes, query).withColumn("order", F.when(F.col("n_terms") == F.col("n_all"), F.lit(1e9)).otherwise(0.0) + F.col("score"))
    return top_k_by_group(ranked, [query], "order", key, k).drop("order", "n_all")


def _best_of_cell(xq: np.ndarray, xv: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the queries, rows of the vectors and cosines of each query's k largest positive cosines, ties by ``order``. A matrix
    product finds the vectors within its error of the k-th; their cosines are summed in order, so that copies tie."""
    squares = lambda x: sum((x[:, c] * x[:, c] for c in range(x.shape[1])), np.zeros(len(x)))
    sq, sv = squares(xq), squares(xv)
    nq, nv = np.sqrt(sq), np.sqrt(sv)
    plain = lambda s: (s > SQUARES[0]) & (s < SQUARES[1])
    rough = (xq @ xv.T) / (nq[:, None] * nv)
    odd = ~(plain(sq)[:, None] & plain(sv)) | np.isnan(rough)  # judged by the sums alone
    rough[odd] = -np.inf
    least = np.maximum(np.partition(rough, -k, axis=1)[:, -k] if k < len(xv) else -np.inf, 0.0)
    i, j = np.nonzero(odd | (rough >= least[:, None] - ERROR) if k < len(xv) else odd | (rough >= -ERROR))
    dot = np.zeros(len(i))
    for c in range(xq.shape[1]):
        dot += xq[i, c] * xv[j, c]
    size = nq[i] * nv[j]
    score = dot / size
    good = ~(size <= 0) & ~(score <= 0)
    i, j, score = i[good], j[good], score[good]
    by = np.lexsort((order[j], np.where(np.isnan(score), -np.inf, -score), i))
    i, j, score = i[by], j[by], score[by]
    first = np.searchsorted(i, i)  # where the query's rows start
    kept = np.arange(len(i)) - first < k
    return i[kept], j[kept], score[kept]


def vector_top(vectors: DataFrame, queries: DataFrame, k: int, key: str, vector: str = "embedding", query: str = "query_id") -> DataFrame:
    """The k vectors of largest positive cosine with each query vector, ties by key. ``queries`` is a stated set that is held
    against all rows: vectors and queries are dealt to blocks, and each pair of blocks (a cell) is one matrix product in numpy that
    gives k vectors a query. Blocks hold the same number of rows however many there are. A vector that is null or holds a null
    has no cosine."""
    whole = lambda c: c.isNotNull() & ~F.exists(c, lambda x: x.isNull()) & (F.size(c) > 0)
    v, q = vectors.select(key, F.col(vector).cast("array<double>").alias("__x")).filter(whole(F.col("__x"))), queries.select(query, F.col(vector).cast("array<double>").alias("__x")).filter(whole(F.col("__x")))
    n_v, n_q = -(-v.count() // BLOCK_VECTORS) or 1, -(-q.count() // BLOCK_QUERIES) or 1
    dealt = lambda rows, c, own, n, other, m: rows.withColumn(own, F.pmod(F.xxhash64(c, "__x"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    v, q = dealt(v, key, "__v", n_v, "__q", n_q), dealt(q, query, "__q", n_q, "__v", n_v)

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.empty(len(left), np.int64)
        order[pc.sort_indices(left, sort_keys=[(key, "ascending")], null_placement="at_start").to_numpy()] = np.arange(len(left))
        out = []
        sizes_v, sizes_q = (pc.list_value_length(t["__x"]).to_numpy() for t in (left, right))
        matrix = lambda t, at, d: pc.list_flatten(t["__x"].take(pa.array(at))).to_numpy().reshape(-1, d)
        for d in np.intersect1d(sizes_v, sizes_q):
            at_v, at_q = np.flatnonzero(sizes_v == d), np.flatnonzero(sizes_q == d)
            xv, xq = matrix(left, at_v, d), matrix(right, at_q, d)
            for s in range(0, len(xq), STRIP):
                with np.errstate(all="ignore"):
                    i, j, score = _best_of_cell(xq[s : s + STRIP], xv, order[at_v], k)
                out.append(pa.table([right[query].take(pa.array(at_q[s + i])), left[key].take(pa.array(at_v[j])), pa.array(score)], names=[query, key, "score"]))
        return pa.concat_tables(out) if out else pa.table([right[query].slice(0, 0), left[key].slice(0, 0), pa.array([], pa.float64())], names=[query, key, "score"])

    schema = T.StructType([T.StructField(query, queries.schema[query].dataType), T.StructField(key, vectors.schema[key].dataType), T.StructField("score", T.DoubleType())])
    scored = v.groupBy("__v", "__q").cogroup(q.groupBy("__v", "__q")).applyInArrow(cell, schema)
    return top_k_by_group(scored, [query], "score", key, k)


def fuse(rankings: Sequence[DataFrame], key: str, query: str = "query_id", constant: int = FUSION) -> DataFrame:
    """Reciprocal rank fusion of (query, key, rank from 1): sum of 1 / (constant + rank), with the rank that makes."""
    every = rankings[0].select(query, key, "rank")
    for r in rankings[1:]:
        every = every.union(r.select(query, key, "rank"))
    fused = every.groupBy(query, key).agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), F.asc(key))))


def hybrid(documents: DataFrame, queries: DataFrame, key: str, k: int = 6, candidates: int = 40) -> DataFrame:
    """BM25 and vectors, ``candidates`` of each, fused, the best k. Terms are scored to six decimals, so that no tie hangs on the
    order of a sum; a query that is null or empty in one of the two is answered by the other."""
    terms = tokenised(documents, key, "text")
    scored = bm25(postings(terms, key), corpus_figures(documents, terms), queries, key).withColumn("score", F.round("score", 6))
    words = top_k_by_group(scored, ["query_id"], "score", key, candidates)
    near = vector_top(documents, queries, candidates, key)
    return fuse([words, near], key).filter(F.col("rank") <= k)


def as_of(documents: DataFrame, date: str | None, excluded: DataFrame | None = None, on: str = "variant_id") -> DataFrame:
    """Documents known by a date (undated ones are not) without those of excluded variants."""
    out = documents.filter(F.col("date") <= date) if date else documents
    return out.join(excluded.select(on), on, "left_anti") if excluded is not None else out


def fetch(documents: DataFrame, ranked: DataFrame, key: str) -> DataFrame:
    return ranked.join(documents, key).orderBy("query_id", "rank") if "query_id" in ranked.columns else ranked.join(documents, key).orderBy("rank")
