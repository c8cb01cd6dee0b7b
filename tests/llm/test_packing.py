import itertools

import numpy as np

from evidara.llm import packing
from tests.llm.helpers import documents, empty, odd


def padding(lengths, counts, ends):
    return sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts))


def test_boundaries_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = np.unique(rng.integers(0, 40, 9))
        counts = rng.integers(1, 30, len(lengths))
        for k in (1, 2, 3, 20):
            ends = packing.bucket_ends(lengths, counts, k)
            best = min(padding(lengths, counts, [*c, lengths[-1]]) for m in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], m))
            assert padding(lengths, counts, ends) == best and len(ends) <= k and ends == sorted(set(ends))


def test_pieces_and_batches(spark):
    docs = documents(spark, ["  a  b " * (3 + i * 11 % 60) + f"end{i}" for i in range(120)])
    rows = packing.pack(docs, buckets=4, budget=64, longest=20, texts=True).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        assert r.n_words <= r.bucket <= 20 and r.first_word == r.piece * 20 and len(r.text.split()) == r.n_words
    for k, parts in by.items():
        assert "".join(r.text for r in sorted(parts, key=lambda r: r.piece)) == text[k]
    held = {}
    for r in rows:
        held.setdefault((r.bucket, r.batch), []).append(r.slot)
    for (bucket, batch), slots in held.items():
        each = max(1, 64 // max(1, bucket))
        last = max(b for k, b in held if k == bucket)
        assert sorted(slots) == list(range(len(slots))) and (len(slots) == each or batch == last and len(slots) <= each)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, packing.pack(docs.repartition(5), buckets=4, budget=64, longest=20, texts=True).collect()))


def test_odd_rows_and_empty_tables(spark):
    for texts in (False, True):
        rows = packing.pack(odd(spark, wild=True), longest=1000, texts=texts).collect()
        assert len(rows) == 15 + 4  # one text of 5,000 words is five pieces
        assert packing.pack(empty(spark), texts=texts).count() == 0


def test_repeated_ids_are_spread_and_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 20)
    rows = [(None, f"a {i % 3} b", "en", "s", 5) for i in range(150)] + [(4, "same text", "en", "s", 9)] * 150
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    got = packing.pack(docs, buckets=2, budget=12, texts=True).collect()
    assert len(got) == 300 and len({(r.bucket, r.batch, r.slot) for r in got}) == 300
    again = packing.pack(docs.repartition(2), buckets=2, budget=12, texts=True).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    bare = packing.pack(docs, buckets=2, budget=12).collect()
    assert sorted((r.bucket, r.batch, r.slot) for r in bare) == sorted((r.bucket, r.batch, r.slot) for r in got)


def test_whole_documents_by_lengths_of_the_caller(spark):
    docs = documents(spark, ["w " * (i * 37 % 500) for i in range(90)]).selectExpr("*", "if(doc_id = 3, null, doc_id * 1000) as n_tokens")
    for texts in (False, True):
        rows = packing.pack(docs, buckets=3, budget=200_000, length="n_tokens", texts=texts).collect()
        assert sorted(r.doc_id for r in rows) == list(range(90)) and all(r.n_words == (0 if r.doc_id == 3 else r.doc_id * 1000) <= r.bucket for r in rows)
        batches = {}
        for r in rows:
            batches.setdefault((r.bucket, r.batch), []).append(r.n_words)
        assert all(len(v) * b <= 200_000 or len(v) == 1 for (b, _), v in batches.items())
    assert {r.n_words for r in packing.pack(docs, longest=None).collect()} == {len(("w " * (i * 37 % 500)).split()) for i in range(90)}
