"""Templates of whole texts."""

import hashlib

from pyspark.sql import functions as F

from evidara.functions import text as T
from evidara.plans import registry


def test_template_finds_mentions_inside_longer_words(spark):
    said = [("exon2:c.12G>A,x", "exon2: _hgvs_ ,x"), ("MLH1=MSH2", "_gene_ = _gene_"), ("seen 12% twice", "seen _num_ % twice"), ("(p.Gly12Val) rs5", "( _hgvs_ _id_"), ("alanine-rich", "_aa_ -rich"), (None, "")]
    rows = spark.createDataFrame(said, "text string, want string").select(T.template(F.col("text")).alias("got"), "want")
    assert [r.got for r in rows.collect()] == [want for _, want in said]


def test_template_text_replaces_in_the_whole_text():
    assert "unnest" not in registry.oracle_sql()["template_text"]  # its SQL does not cut the text first


#: Texts, and templates as the SQL gives them; None is no template.
ODD = [
    (None, None), ("", None), (" \n\t\x0b", None), ("pmid", "_id_"), ("see pmids of pmid: 12", "see _id_ of _id_"), ("\u00a0a \u3000", "a"), ("\u2003", ""),
    ("\u0391\u03a3 \u03a3", "\u03b1\u03c3 \u03c3"), ("\u0130x \u0130soleucine", "ix _aa_"), ("a.\u2028 MLH1\u0085 12\u2029", "a.\u2028 mlh1\u0085 12\u2029"), ("(MLH1.\u2028", "(mlh1.\u2028"),
    ("aspartic\x0bacid", "aspartic\x0bacid"), ("a\u017fpartic acid", "_aa_"), ("Aspartic acid (MLH1).", "_aa_ (_gene_)."),
]


def templates(spark, tmp_path, rows):
    """What the query gives for documents (id, text), and its SQL's rows."""
    import duckdb

    root = str(tmp_path / "tables")
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{root}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{root}/documents.parquet/*.parquet'")
    order = lambda found: sorted((tuple(r) for r in found), key=repr)
    return order(registry.queries()["document_templates"](spark, root).collect()), order(con.execute(registry.oracle_sql()["document_templates"]).fetchall())


def test_document_templates_of_odd_texts(spark, tmp_path):
    got, want = templates(spark, tmp_path, list(enumerate(text for text, _ in ODD)))
    assert got == want
    said = {i: template for i, (_, template) in enumerate(ODD)}
    assert {i: digest for i, digest, _ in got} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in said.items()}
    assert {i for i, _, n in got if n is None} == {i for i, t in said.items() if t is None}


def test_document_templates_of_rows_that_share_an_id_or_have_none(spark, tmp_path):
    rows = [(1, "Seen in MLH1, twice."), (1, "Seen in MLH1, twice."), (2, "alone 12%"), (3, None), (3, "rs12 x"), (4, " "), (4, None), (None, "MSH2"), (None, "MSH2")]
    got, want = templates(spark, tmp_path, rows)
    assert len(got) == len(rows) and got == want


def test_document_templates_of_long_runs(spark, tmp_path):
    got, want = templates(spark, tmp_path, [(1, "1," * 40_000 + "1"), (2, "." * 200_000 + "x"), (3, "x" + ")" * 200_000), (4, "1.2." * 20_000 + "a")])
    assert got == want


def test_normalized_text_is_that_of_sql(spark, tmp_path):
    said = ["\u00a0A  b\u2003", "\u0391\u03a3", "\u0130", "a\x0bb", "a \r\n\x0c b"]
    rows = spark.createDataFrame(list(enumerate(said)), "i int, text string").select("i", T.normalized(F.col("text")).alias("t"))
    assert [r.t for r in rows.orderBy("i").collect()] == ["a b", "\u03b1\u03c3", "i", "a\x0bb", "a b"]
