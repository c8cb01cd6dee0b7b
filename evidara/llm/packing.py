"""Packing: length buckets of least padding, and token-budget batches inside each.

Lengths are words (runs of characters other than ASCII white space), or those of a column the caller names, such as token
counts. A text longer than ``longest`` words is cut into pieces of that many words and a rest, so no word is lost and the
histogram of piece lengths, taken over all documents, has at most ``longest`` rows, whatever the input. With a caller's lengths,
or without ``longest``, documents stay whole; then lengths are rounded up to a grain that leaves ``CLASSES`` of them at most.
Dynamic programming over it chooses the ends of at most ``buckets`` buckets so that
padding every piece to the end of its bucket wastes the fewest words; of equal choices the lower end wins.

A batch of a bucket holds as many pieces as fit its word budget when padded: floor(budget / end), one at least. Pieces are
numbered in the order of a seeded digest of doc_id, text and, among rows equal in both, a number: buckets are cut into shards by ranges of the digest, pieces are numbered within
their shard, and the shards' sizes give where each starts. So no task holds a bucket, batches are full but for the last one
of each bucket, and reruns agree.

Null or empty text has one piece of no words, in the first bucket. Null doc_id and repeated rows are pieces like any others,
those equal in both told apart by a number. A null length counts 0. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidara.llm.repeats import digest_of, numbered
from evidara.llm.skew import attach
from evidara.llm.words import WORD, word_count
from evidara.llm.workspace import Workspace

SHARD, BITS, CLASSES = 20_000, 24, 4096


def bucket_ends(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Ends of the buckets of least padding for ascending ``lengths`` with their ``counts``."""
    n = len(lengths)
    if not n:
        return []
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    pieces = np.r_[0, np.cumsum(counts)]
    words = np.r_[0, np.cumsum(counts * lengths)]
    best = lengths * pieces[1:] - words[1:]  # one bucket over the first j + 1 lengths
    froms = []
    for _ in range(min(buckets, n) - 1):
        now, choice = best.copy(), np.full(n, -1)
        for j in range(1, n):
            cost = best[:j] + lengths[j] * (pieces[j + 1] - pieces[1 : j + 1]) - (words[j + 1] - words[1 : j + 1])
            i = int(cost.argmin())
            if cost[i] < best[j]:
                now[j], choice[j] = cost[i], i
        froms.append(choice)
        best = now
    ends, j = [int(lengths[-1])], n - 1
    for choice in reversed(froms):
        if choice[j] >= 0:
            j = int(choice[j])
            ends.append(int(lengths[j]))
    return ends[::-1]


def lot(doc_id: Column, piece: Column, digest: Column, ordinal: Column, seed: int) -> Column:
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), piece, digest, ordinal)
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


PIECE = ["doc_id", "digest", "ordinal", "piece", "first_word", "n_words"]


def pieces(rows: DataFrame, longest: int | None) -> DataFrame:
    """``numbered`` rows (doc_id, words, and their digest as text) as their pieces: ``PIECE``, with piece from 0."""
    sized = rows.select("doc.doc_id", F.col("doc.text").alias("digest"), "ordinal", "doc.words")
    if longest is None:
        return sized.select("doc_id", "digest", "ordinal", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("first_word"), F.col("words").alias("n_words"))
    last = F.greatest(F.lit(0), F.ceil(F.col("words") / longest) - 1).cast("int")
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).withColumn("first_word", F.col("piece").cast("long") * longest)
    return cut.withColumn("n_words", F.least(F.lit(longest), F.col("words") - F.col("first_word")).cast("int")).select(PIECE)


def key_of(doc_id: Column, digest: Column) -> Column:
    """What equal documents share."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), digest)


def text_pieces(docs: DataFrame, longest: int | None) -> DataFrame:
    """key, piece and text of the pieces of each different document; joined together, they are its text."""
    word = re.compile(WORD.encode())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, item in zip(batch.column("key").to_pylist(), batch.column("data"), strict=True):
                data = item.as_py()
                if longest is None or len(data.split()) <= longest:  # bytes: at ASCII white space only
                    rows.append((key, 0, data.decode()))
                    continue
                starts = [m.start() for i, m in enumerate(word.finditer(data)) if i % longest == 0]
                bounds = [0, *starts[1:], len(data)]
                rows += [(key, i, data[a:b].decode()) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string()), strict=True)], ["key", "piece", "text"])

    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.select(key_of(F.col("doc_id"), digest_of(text)).alias("key"), text.cast("binary").alias("data")).groupBy("key").agg(F.first("data").alias("data"))
    return one.mapInArrow(cut, "key string, piece int, text string")


def pack(docs: DataFrame, buckets: int = 8, budget: int = 16384, longest: int | None = 2048, seed: int = 7, texts: bool = False, length: str | None = None) -> DataFrame:
    """doc_id, piece, first_word, n_words, bucket (its end), batch (from 0 within the bucket) and slot (from 0 within the batch)
    of every piece of ``docs`` (doc_id, text), and with ``texts`` its text. ``length``: a column of lengths that stand for words;
    then, or without ``longest``, documents are packed whole."""
    space = Workspace(docs.sparkSession, "packing")
    longest = None if length else longest
    words = word_count(F.col("text")) if length is None else F.coalesce(F.col(f"`{length}`").cast("long"), F.lit(0).cast("long"))
    # documents are numbered by their digests, so no text moves
    narrow = space.save(docs.select("doc_id", digest_of(F.col("text")).alias("text"), words.alias("words")), "narrow")
    bare = space.save(pieces(numbered(narrow, space), longest), "pieces")
    grain = max(1, -(-(bare.agg(F.max("n_words")).first()[0] or 0) // CLASSES)) if longest is None else 1
    rounded = (F.ceil(F.col("n_words") / grain) * grain).cast("long") if grain > 1 else F.col("n_words")
    histogram = bare.groupBy(rounded.alias("n_words")).agg(F.count("*").alias("n")).orderBy("n_words").collect()  # ``longest`` + 1 or ``CLASSES`` + 1 rows at most
    ends = bucket_ends(np.array([r["n_words"] for r in histogram]), np.array([r["n"] for r in histogram]), buckets)
    bucket, shards = F.lit(None).cast("int"), F.lit(1)
    for end, below in reversed(list(zip(ends, [-1, *ends], strict=False))):
        size = sum(r["n"] for r in histogram if below < r["n_words"] <= end)
        bucket = F.when(F.col("n_words") <= end, end).otherwise(bucket)
        shards = F.when(F.col("n_words") <= end, -(-size // SHARD)).otherwise(shards)

    def dealt(cut: DataFrame) -> DataFrame:
        placed = cut.withColumn("bucket", bucket).withColumn("lot", lot(F.col("doc_id"), F.col("piece"), F.col("digest"), F.col("ordinal"), seed))
        return placed.withColumn("shard", F.floor(F.col("lot") * shards / 2**BITS).cast("int"))

    sizes = dealt(bare).groupBy("bucket", "shard").agg(F.count("*").alias("size"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = space.save(sizes.select("bucket", "shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start")), "starts")
    order = Window.partitionBy("bucket", "shard").orderBy("lot", "doc_id", "piece", "digest", "ordinal")
    placed = dealt(bare).withColumn("place", F.row_number().over(order)).join(starts, ["bucket", "shard"])
    number = F.col("start") + F.col("place") - 1
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket"), F.lit(1)))).cast("long")
    placed = placed.withColumn("batch", F.floor(number / each).cast("long")).withColumn("slot", F.pmod(number, each).cast("int"))
    out = ["doc_id", "piece", "first_word", "n_words", "bucket", "batch", "slot"]
    if not texts:
        return placed.select(out)
    placed = space.save(placed.select(*out, key_of(F.col("doc_id"), F.col("digest")).alias("key")), "placed")
    # one text of each different document goes to its pieces; a document that is repeated often is dealt
    return attach(placed, text_pieces(docs, longest), ["key", "piece"]).select(*out, "text")
