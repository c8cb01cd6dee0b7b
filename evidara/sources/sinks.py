"""Writers: declared Parquet tables, sharded text corpora, stores that never overwrite, and manifests written last."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions import hashing
from evidara.functions.validation import conform


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small driver-side file on whatever store the path is in: written beside and renamed."""
    fs, at = _fs(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(at):
        fs.delete(at, False)
    fs.rename(beside, at)


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def table(rows: DataFrame, schema: str, path: str, partition: Sequence[str] = (), mode: str = "overwrite") -> DataFrame:
    """Rows under a declared schema (other columns go, absent ones are null) as Parquet."""
    made = conform(rows, schema)
    writer = made.write.mode(mode)
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    return rows.sparkSession.read.schema(made.schema).parquet(path)


def manifest(spark: SparkSession, root: str, meta: Mapping | None = None) -> dict:
    """Bytes and SHA-256 of every file under a folder, as manifest.json, which is written last."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = files.filter(~F.col("path").rlike(r"/[._][^/]*$|/manifest\.json$")).select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length", F.sha2("content", 256).alias("sha256"))
    made = {"meta": dict(meta or {}), "artefacts": sorted((r.asDict() for r in rows.collect()), key=lambda r: r["path"])}
    write_text(spark, f"{root}/manifest.json", json.dumps(made, indent=1, sort_keys=True))
    return made


def bundle(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], meta: Mapping | None = None) -> dict:
    """Named tables as Parquet, then the manifest of all."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{root}/{name}")
    return manifest(spark, root, meta)


class FeatureStore:
    """Blocks of features by family, tag and the digest of what identifies them; a block that exists is never replaced."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def path(self, family: str, tag: str, identity: Mapping) -> str:
        return f"{self.root}/{family}/{tag}/{hashing.entry_key(identity)}"

    def write(self, family: str, tag: str, identity: Mapping, block: DataFrame, key: str = "variant_id") -> str:
        path = self.path(family, tag, identity)
        block.repartitionByRange(F.col(key)).write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/block")
        write_text(self.spark, f"{path}/identity.json", json.dumps(dict(identity), sort_keys=True))
        return path

    def read(self, family: str, tag: str, identity: Mapping) -> DataFrame:
        return self.spark.read.parquet(f"{self.path(family, tag, identity)}/block")

    def rows(self, family: str, tag: str, identity: Mapping, wanted: DataFrame, key: str = "variant_id") -> DataFrame:
        """The wanted rows; one that the block lacks fails the query."""
        block = self.read(family, tag, identity).withColumn("__there", F.lit(True))
        joined = wanted.select(key).join(block, key, "left")
        return joined.filter(F.when(F.col("__there"), True).otherwise(F.raise_error(F.concat(F.lit("absent: "), F.col(key).cast("string"))).cast("boolean"))).drop("__there")


def fasta(rows: DataFrame, path: str, identifier: str = "id", sequence: str = "sequence", width: int = 60) -> None:
    wrapped = F.regexp_replace(F.regexp_replace(sequence, f"(.{{{width}}})", "$1\n"), "\n$", "")
    rows.select(F.concat(F.lit(">"), F.col(identifier), F.lit("\n"), wrapped).alias("value")).write.mode("overwrite").text(path)


def jsonl(rows: DataFrame, path: str, shard_rows: int = 500_000, partition: Sequence[str] = ()) -> None:
    """JSON lines in files of at most so many rows."""
    writer = rows.write.mode("overwrite").option("maxRecordsPerFile", shard_rows)
    (writer.partitionBy(*partition) if partition else writer).json(path)


def corpus(documents: DataFrame, path: str, key: str = "document_id", excluded: Sequence[tuple[DataFrame, str]] = (), per_mille: int = 10, shard_rows: int = 500_000) -> DataFrame:
    """Documents without the excluded ones (each a table of keys and the column they are in) as sharded JSON by split; gives
    counts by source and split."""
    for keys, column in excluded:
        documents = documents.join(keys.select(column), column, "left_anti")
    made = documents.withColumn("split", F.when(hashing.in_validation(F.col(key).cast("string"), per_mille), "validation").otherwise("train"))
    jsonl(made, path, shard_rows, ["split"])
    return made.groupBy("source_id", "split").agg(F.count("*").alias("n_documents"), F.sum(F.length("text")).alias("n_chars"))


def token_stream(documents: DataFrame, encode, end: int, path: str, key: str = "document_id", text: str = "text") -> None:
    """Token ids of each document and an end mark, as arrays, sorted by key in each file. ``encode``: list of texts to lists."""
    import pandas as pd

    @F.pandas_udf("array<int>")
    def ids(batch: pd.Series) -> pd.Series:
        return pd.Series([[*map(int, x), end] for x in encode(batch.fillna("").tolist())])

    documents.select(key, ids(text).alias("tokens")).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def search_index(documents: DataFrame, path: str, key: str, text: str) -> str:
    """Postings sorted by term and documents, with a digest over both; returns the digest."""
    from evidara.operators.search import postings, tokenised

    postings(tokenised(documents, key, text), key).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    documents.write.mode("overwrite").parquet(f"{path}/documents")
    digest = hashing.split_digest(documents.select(F.concat_ws("\t", F.col(key).cast("string"), F.sha2(text, 256)).alias("k")), "k").first()["split_hash"]
    write_text(documents.sparkSession, f"{path}/digest.json", json.dumps({"digest": digest}))
    return digest


def latex(headers: Sequence[str], rows: Sequence[Sequence], caption: str, label: str, digits: int = 3) -> str:
    """A small table as LaTeX."""
    cell = lambda v: "--" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("_", r"\_")
    lines = [" & ".join(map(cell, line)) + r" \\" for line in (headers, *rows)]
    return "\n".join([r"\begin{table}", rf"\caption{{{caption}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{'l' * len(headers)}}}", lines[0], r"\hline", *lines[1:], r"\end{tabular}", r"\end{table}"])


def markdown(stats: Mapping, title: str = "Statistics") -> str:
    """A mapping of figures, or of mappings of figures, as a list."""
    out = [f"# {title}", ""]
    for k, v in stats.items():
        out += [f"- {k}:", *(f"  - {a}: {b}" for a, b in v.items())] if isinstance(v, Mapping) else [f"- {k}: {v}"]
    return "\n".join(out) + "\n"
