import random
import zlib

import numpy as np

from evidara.llm import quality
from tests.llm.helpers import documents, empty, odd


def corpus(n=400):
    rng = random.Random(2)
    words = ["ther", "onand", "hering", "stion", "ble", "éaux", "wh"]
    good = lambda: " ".join(rng.choice(words) + rng.choice(words) for _ in range(rng.randint(5, 80))) + "."
    bad = lambda: "".join(rng.choice(words).upper() + rng.choice(["!! ", "$$$ ", "### "]) for _ in range(rng.randint(5, 60)))
    return [bad() if i % 4 == 0 else good() for i in range(n)], [(i, int(i % 4 != 0), 0) for i in range(n) if i % 3]


def test_held_out_accuracy_and_rules(spark):
    texts, labels = corpus()
    docs = documents(spark, texts, wild=True)
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, frame).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) > 0.97
    again = {r.doc_id: r.score for r in quality.classify(docs.repartition(5), frame).collect()}
    assert all(again[r.doc_id] == r.score for r in rows)
    # labels of held-out rows make no difference
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels], frame.schema)
    assert all(abs(again[r.doc_id] - r.score) < 1e-12 for r in quality.classify(docs, flipped).collect())
    kept = quality.keep_good(docs, frame)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.predicted}


def test_scores_are_of_whole_texts_alone():
    net = quality.Net.fresh(1)
    texts = [b"", b"a", b"x" * 63, b"y" * 64, b"ab" * 700, b"z" * 193, b"q" * 4000 + b"!!"]
    together = net.scores(texts)
    for text, score in zip(texts, together):
        assert abs(net.scores([text])[0] - score) < 1e-12
        raw, n = np.frombuffer(text, np.uint8), len(text)
        tops = []
        for start in range(0, max(1, n - 64), 192) if n else []:
            part = np.zeros(256 + 3, np.uint8)
            piece = raw[start : start + 259]
            part[: len(piece)] = piece
            seen = net.parts[0][part].astype(np.float64)
            y = sum(seen[k : k + 256] @ net.parts[1][k] for k in range(4))
            tops.append(np.maximum(y.max(axis=0) + net.parts[2], 0))
        mean = np.mean(tops, axis=0) if tops else np.zeros(quality.FILTERS)
        assert abs(1 / (1 + np.exp(-(mean @ net.parts[3] + net.parts[4]))) - score) < 1e-5


def test_gradients():
    rng = np.random.default_rng(0)
    net = quality.Net.fresh(3)
    net.parts = [p.astype(np.float64) for p in net.parts]
    docs = [quality.chunked(bytes(rng.integers(97, 110, n).astype(np.uint8))) for n in (30, 300, 500)]
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        total = 0.0
        for d, t in zip(docs, y):
            seen = net.parts[0][d]
            top = np.maximum(sum(seen[:, k : k + 256] @ net.parts[1][k] for k in range(4)).max(axis=1) + net.parts[2], 0).mean(axis=0)
            p = 1 / (1 + np.exp(-(top @ net.parts[3] + net.parts[4])))
            total -= t * np.log(p) + (1 - t) * np.log(1 - p)
        return total / len(docs) + 0.5e-4 * (net.parts[3] ** 2).sum()

    grads = net._gradients(docs, y)
    for k, at in ((0, (100, 2)), (1, (1, 3, 4)), (2, (5,)), (3, (6,))):
        old = net.parts[k][at]
        net.parts[k][at] = old + 1e-5
        up = loss()
        net.parts[k][at] = old - 1e-5
        down = loss()
        net.parts[k][at] = old
        assert abs((up - down) / 2e-5 - grads[k][at]) < 1e-4


def test_odd_rows_without_labels_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd_labels = spark.createDataFrame([(None, 1, 0), (3, None, 0), (4, 1, 0), (4, 0, 0), (5, 7, 0)], none.schema)
    for labels in (none, odd_labels):
        rows = quality.classify(odd(spark, wild=True), labels).collect()
        assert len(rows) == 15 and all(0 <= r.score <= 1 for r in rows)
    assert quality.classify(empty(spark), none).count() == 0


def test_learns_from_every_chunk_of_the_sampled_texts(spark, monkeypatch):
    long = "plain words here " * 3000 + "ZZZZ!!!! " * 40 + "plain words here " * 3000
    docs = documents(spark, ["short", long, "other", "more text", "again"])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    found = quality.sample(docs, labels, 100)
    assert (1, long.encode()) in found or zlib.crc32(b"1") % 5 == 0
    chunks = quality.chunked(long.encode())
    assert chunks[:, :192].tobytes()[: len(long)] == long.encode()[: chunks[:, :192].size] and len(chunks) * 192 + 64 >= len(long)
    net = quality.Net.fresh(4)
    several = [chunks, quality.chunked(b"short"), quality.chunked(b"")]
    whole = net._gradients(several, np.array([1.0, 0.0, 1.0]))
    monkeypatch.setattr(quality, "ROWS", 7)
    for a, b in zip(whole, net._gradients(several, np.array([1.0, 0.0, 1.0]))):
        assert np.allclose(a, b, atol=1e-6)
    # the passage in the middle has its share in the gradient
    without = [quality.chunked(long.replace("ZZZZ!!!! ", "plain wor").encode()), *several[1:]]
    assert not np.allclose(whole[0][ord("Z")], net._gradients(without, np.array([1.0, 0.0, 1.0]))[0][ord("Z")])


def test_callers_columns_stay(spark):
    texts, labels = corpus(60)
    docs = documents(spark, texts).withColumnsRenamed({"lang": "__score"})
    kept = quality.keep_good(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns and {r["__score"] for r in kept.collect()} == {"en"}
