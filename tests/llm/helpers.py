"""Fixtures with the rows that break things: nulls, empty and long texts, ties, repeats, and columns with clashing names."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WILD = DOCS + ", size long, __size string, bucket string, score string, component_id string, embedding string"


def documents(spark, texts, wild: bool = False):
    rows = [(i, t, "en", None if i % 5 == 4 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    if wild:
        return spark.createDataFrame([(*r, 1, "x", "y", "z", "q", "e") for r in rows], WILD)
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \t\n", "a", "a", "one two three", "one two three", "word " * 5000, "ÄÖ ß 日本 語 x", "MIT License", "x" * 20000, "\u0000 nul", "the MIT license and the Apache License"]


def odd(spark, wild: bool = False):
    """The odd texts with a null doc_id and a repeated row."""
    docs = documents(spark, ODD, wild)
    none = docs.filter("doc_id = 5").selectExpr(*["cast(null as bigint) as doc_id" if c == "doc_id" else f"`{c}`" for c in docs.columns])
    return docs.union(none).union(docs.filter("doc_id = 6"))


def empty(spark):
    return spark.createDataFrame([], DOCS)


def write_tables(spark, folder, docs, labels=None, pages=None, embeddings=None):
    docs.write.parquet(f"{folder}/documents.parquet")
    if labels is not None:
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    if pages is not None:
        spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    if embeddings is not None:
        spark.createDataFrame(embeddings, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def components(n: int, pairs) -> list[int]:
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
