"""Quality classifier: a byte-level convolutional network in numpy.

Every byte has a learned vector; ``FILTERS`` learned filters of four bytes run over the whole document at every byte. The
document is cut into chunks of 256 bytes that start every 192, each filter's largest response in a chunk is kept (not below
0), and the means of these maxima over all chunks are combined by a logistic unit into one probability. Two filter bytes are
summed in a table of byte pairs, so a response is the sum of two rows of tables that a task builds once.

Learning: log loss, Adam, ``EPOCHS`` rounds or as many as make ``STEPS`` steps, on at most ``SAMPLE`` labelled documents (those
whose seeded digest of doc_id is smallest), each with all of its chunks. That number of rows is a parameter and the only bound;
the sampled texts, whole, are all that reaches the driver, and a step works through them in strips of ``ROWS`` chunks. It is
serial: its time depends on the sample, not on the input. Only the text's bytes are inputs. Rows held out (crc32 of doc_id as text, modulo 5, is 0) are never
learned from. With one class or no labelled rows, scores are the share of label 1 (0.5 without any).

Null counts as empty text; an empty text has no chunks, so its score is the logistic unit's own bias. Byte 0 is a blank.
Labels that are null or of null doc_id are not learned from; a doc_id with two labels counts with both. Equal texts get equal
scores; an empty table gives no rows. Long texts go through in strips, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS, WIDTH, DIM = 24, 4, 6
BLOCK, SPAN, STEP = 64, 4, 3  # a chunk is four blocks of 64 bytes; the next one starts three blocks further
SAMPLE, EPOCHS, STEPS, BATCH, SEED = 3000, 12, 300, 64, 5
STRIP, ROWS = 1 << 15, 512


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def chunked(data: bytes) -> np.ndarray:
    """A document as rows of one chunk each (and the three bytes after it that its last filters see), blank at the end."""
    n = len(data)
    if not n:
        return np.zeros((0, BLOCK * SPAN + WIDTH - 1), np.uint8)
    starts = range(0, max(1, n - BLOCK * (SPAN - STEP)), BLOCK * STEP)
    raw = np.zeros(starts[-1] + BLOCK * SPAN + WIDTH - 1, np.uint8)
    raw[:n] = np.frombuffer(data, np.uint8)[: len(raw)]
    return np.lib.stride_tricks.sliding_window_view(raw, BLOCK * SPAN + WIDTH - 1)[:: BLOCK * STEP]


class Net:
    """vectors: 256 x DIM; filters: WIDTH x DIM x FILTERS; bias, weight: FILTERS; offset."""

    def __init__(self, vectors, filters, bias, weight, offset):
        self.parts = [vectors, filters, bias, weight, np.asarray(offset, np.float32)]
        self._tables = None

    @staticmethod
    def fresh(seed: int) -> Net:
        rng = np.random.default_rng(seed)
        f32 = np.float32
        vectors = rng.normal(0, 0.5, (256, DIM)).astype(f32)
        vectors[0] = 0
        return Net(vectors, rng.normal(0, 0.5, (WIDTH, DIM, FILTERS)).astype(f32), np.zeros(FILTERS, f32), rng.normal(0, 0.3, FILTERS).astype(f32), f32(0))

    def pair_tables(self) -> tuple[np.ndarray, np.ndarray]:
        if self._tables is None:
            vectors, filters = self.parts[:2]
            one = [vectors @ filters[k] for k in range(WIDTH)]
            self._tables = tuple(np.ascontiguousarray((one[k][:, None, :] + one[k + 1][None, :, :]).reshape(65536, FILTERS)) for k in (0, 2))
        return self._tables

    def block_maxima(self, raw: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each block of 64 positions; raw: blocks * 64 + 3 bytes."""
        first, second = self.pair_tables()
        pair = (raw[:-1].astype(np.int32) << 8) | raw[1:]
        n = len(raw) - WIDTH + 1
        out = np.empty((n // BLOCK, FILTERS), np.float32)
        for i in range(0, n, STRIP):
            m = min(STRIP, n - i)
            y = first.take(pair[i : i + m], axis=0)
            y += second.take(pair[i + 2 : i + 2 + m], axis=0)
            out[i // BLOCK : (i + m) // BLOCK] = y.reshape(-1, BLOCK, FILTERS).max(axis=1)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 of each whole text."""
        _, _, bias, weight, offset = self.parts
        means = np.zeros((len(texts), FILTERS), np.float64)
        # blocks of all texts lie behind each other, with a blank block after each, so that no filter sees two texts
        sizes = [-(-len(t) // BLOCK) + 1 if t else 0 for t in texts]
        raw = np.zeros(sum(sizes) * BLOCK + WIDTH - 1, np.uint8)
        at = 0
        for text, size in zip(texts, sizes, strict=True):
            raw[at : at + len(text)] = np.frombuffer(text, np.uint8)
            at += size * BLOCK
        blocks = np.maximum(self.block_maxima(raw) + bias, 0)
        at = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            size = -(-len(text) // BLOCK)
            own = blocks[at : at + size]
            at += sizes[i]
            starts = np.arange(0, max(1, size - (SPAN - STEP)), STEP)
            ends = np.minimum(starts + SPAN, size)
            bounds = np.stack([starts, ends], axis=1).ravel()
            top = np.maximum.reduceat(np.concatenate([own, np.zeros((1, FILTERS), np.float32)]), bounds, axis=0)[::2]
            if starts[-1] * BLOCK + SPAN * BLOCK > len(text):  # the last chunk ends with blanks, as in learning
                top[-1] = np.maximum(top[-1], np.maximum(bias, 0))
            means[i] = top.mean(axis=0)
        return 1 / (1 + np.exp(-np.clip(means @ weight.astype(np.float64) + float(offset), -30, 30)))

    def learn(self, documents: list[np.ndarray], labels: np.ndarray, epochs: int, batch: int, seed: int) -> None:
        """documents: chunks as rows of bytes."""
        rng = np.random.default_rng(seed)
        first, second = [np.zeros_like(p) for p in self.parts], [np.zeros_like(p) for p in self.parts]
        step, rate = 0, 0.01
        for epoch in range(epochs):
            order = rng.permutation(len(documents))
            for b in range(0, len(order), batch):
                chosen = order[b : b + batch]
                grads = self._gradients([documents[i] for i in chosen], labels[chosen])
                step += 1
                for k, g in enumerate(grads):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    now = rate * (1 - epoch / epochs) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    self.parts[k] = (self.parts[k] - now).astype(np.float32)
                self.parts[0][0] = 0
                self._tables = None

    def _pooled(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter in each chunk (rows of ``raw``), with its bias, and where it stands."""
        vectors, filters, bias = self.parts[:3]
        seen = vectors[raw]
        n = raw.shape[1] - WIDTH + 1
        # each position with the vectors of the bytes after it, as one row of a product with all filters
        runs = np.lib.stride_tricks.as_strided(seen, (len(raw), n, WIDTH * DIM), seen.strides)
        y = (runs.reshape(-1, WIDTH * DIM) @ filters.reshape(WIDTH * DIM, FILTERS)).reshape(len(raw), n, FILTERS)
        place = y.argmax(axis=1)
        return np.take_along_axis(y, place[:, None, :], axis=1)[:, 0] + bias, place

    def _gradients(self, documents: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
        vectors, filters, _, weight, offset = self.parts
        of = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
        raw = np.concatenate(documents)
        strips = [self._pooled(raw[i : i + ROWS]) for i in range(0, len(raw), ROWS)]
        top = np.concatenate([t for t, _ in strips]) if strips else np.zeros((0, FILTERS), np.float32)
        place = np.concatenate([p for _, p in strips]) if strips else np.zeros((0, FILTERS), np.int64)
        active = top > 0
        share = 1 / np.maximum(np.bincount(of, minlength=len(documents)), 1)
        means = np.zeros((len(documents), FILTERS))
        np.add.at(means, of, np.where(active, top, 0))
        means *= share[:, None]
        p = 1 / (1 + np.exp(-np.clip(means @ weight + offset, -30, 30)))
        off = (p - labels) / len(labels)
        to_top = (off[of] * share[of])[:, None] * weight * active
        grads = [np.zeros_like(vectors), np.zeros_like(filters), to_top.sum(axis=0), off @ means + 1e-4 * weight, off.sum()]
        row = np.arange(len(raw))[:, None]
        for k in range(WIDTH):
            byte = raw[row, place + k]
            grads[1][k] = np.einsum("cfd,cf->df", vectors[byte], to_top)
            for d in range(DIM):
                grads[0][:, d] += np.bincount(byte.ravel(), (to_top * filters[k][d]).ravel(), 256)
        return grads


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> list[tuple[int, bytes]]:
    """Quality and text of the learning documents, whole."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select("doc_id", F.col("quality").cast("int").alias("quality")).join(docs.select("doc_id").filter("doc_id is not null"), "doc_id", "left_semi")
    drawn = known.distinct().orderBy(F.md5(F.concat_ws(":", F.lit(str(SEED)), "doc_id")), "doc_id", "quality").limit(rows)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data")
    # at most ``rows`` rows are broadcast; a doc_id that stands for several texts is learned from the smallest
    found = docs.join(F.broadcast(drawn), "doc_id").select("doc_id", "quality", text).groupBy("doc_id", "quality").agg(F.min("data").alias("data"))
    return [(r.quality, bytes(r.data)) for r in found.orderBy("doc_id", "quality").collect()]


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, epochs: int = EPOCHS) -> Net:
    found = sample(docs, labels, rows)
    y = np.array([q for q, _ in found], np.float64)
    net = Net.fresh(SEED)
    if len(set(y)) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        net.parts[3][:] = 0
        net.parts[4] = np.float32(np.log(share / (1 - share)))
        return net
    net.learn([chunked(d) for _, d in found], y, max(epochs, -(-STEPS // -(-len(found) // BATCH))), BATCH, SEED)
    return net


def scorer(net: Net):
    """A column function: the probability of label 1 of each whole text."""
    from pyspark.sql import SparkSession
    from pyspark.sql.pandas.functions import arrow_udf

    parts = SparkSession.active().sparkContext.broadcast(net.parts)  # a few thousand numbers

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Net(*parts.value)
        for batch in batches:
            out, held, size = [], [], 0
            for item in batch:
                held.append(item.as_py())
                size += len(held[-1])
                if size >= 1 << 21:
                    out.append(own.scores(held))
                    held, size = [], 0
            if held:
                out.append(own.scores(held))
            yield pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())

    return lambda text: score(F.coalesce(text, F.lit("")).cast("binary"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text); ``labels``: doc_id, quality."""
    score = scorer(train(docs.select("doc_id", "text"), labels))
    scored = docs.select("doc_id", score(F.col("text")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns, whatever their names."""
    score = scorer(train(docs.select("doc_id", "text"), labels))
    return docs.filter(score(F.col("text")) >= threshold)
