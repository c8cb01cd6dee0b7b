"""Token counts through a digest cache.

A count is stored under two digests: of the content (SHA-256 of its UTF-8 bytes) and of the tokenizer's version (library,
its version, options and the vocabulary file's bytes). Content is normalised only as far as every tokenizer is known to
ignore it: null counts as empty text; anything more could change a count. Digests are always joined to the cache first; those without a stored count are the misses. One text for each miss is encoded
(copies are dropped before the shuffle, so a text that fills a third of the table is moved once per task), counts are appended
to the cache, and all documents read their count from it.

Repeated rows get equal rows, empty texts have 0 bytes and 0 tokens, an empty table gives no rows, null doc_id stays, and
further columns are ignored. Texts are encoded whole, in slices of about ``SLICE`` bytes, so a batch needs bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm.skew import attach
from evidara.llm.workspace import Workspace

SLICE = 1 << 20
CACHE = "digest binary, version string, n_tokens long"


def load(path: str):
    """A function from texts to token counts, by the library for the file's kind."""
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def version_of(path: str) -> str:
    """Digest of the library, its version and the vocabulary file."""
    from importlib.metadata import version

    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library} {version(library)} plain ".encode() + f.read()).hexdigest()


def encoded(texts: DataFrame, path: str) -> DataFrame:
    """digest and n_tokens of (digest, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for batch in batches:
            counts, slice_, held = [], [], 0
            for text in batch.column("text"):
                slice_.append(text.as_py())
                held += len(slice_[-1])
                if held >= SLICE:
                    counts += counter(slice_)
                    slice_, held = [], 0
            counts += counter(slice_) if slice_ else []
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(count, "digest binary, n_tokens long")


class Cache:
    """Stored counts, as Parquet that is only ever appended to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def read(self, version: str) -> DataFrame:
        """digest and n_tokens of one version; a digest that was appended twice counts once."""
        if not self.exists():
            return self.spark.createDataFrame([], "digest binary, n_tokens long")
        stored = self.spark.read.schema(CACHE).parquet(self.path).filter(F.col("version") == version)
        return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame, version: str) -> None:
        counts.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(self.path)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text). ``cache``: a folder that all executors
    see; without one, the cache lives as long as this call's result."""
    space = Workspace(docs.sparkSession, "tokens")
    store, version = Cache(docs.sparkSession, cache or space.path("cache")), version_of(tokenizer)
    text = F.coalesce(F.col("text"), F.lit(""))
    digested = docs.select("doc_id", text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    keys = space.save(digested.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "keys")
    # one text for each digest, dealt by digest, so the join to the cache moves no text again
    misses = digested.select("digest", "text").dropDuplicates(["digest"]).join(store.read(version), "digest", "left_anti")
    store.append(encoded(misses, tokenizer), version)
    counted = attach(keys, store.read(version), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    # written, since a plan that reads the same folder at two times would take both for one table
    return space.save(counted, "counted")
