import re

import pytest

from evidara.llm import mixing
from tests.llm.helpers import documents, empty, odd


def water(sizes, weights, total, cap):
    """Targets by sharing the excess of clamped sources until none is above."""
    clamped = {}
    while True:
        free = {s: w for s, w in weights.items() if s not in clamped}
        left = total - sum(clamped.values())
        share = {s: left * w / sum(free.values()) for s, w in free.items()} if free else {}
        over = {s for s, t in share.items() if t > cap * sizes[s] + 1e-9}
        if not over:
            return clamped | share
        clamped |= {s: cap * sizes[s] for s in over}


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_taken(spark):
    docs = documents(spark, [("w " * (1 + i * 7 % 40)) for i in range(600)])
    got = mixing.mix(docs).collect()
    sizes, taken = {}, {}
    for r in got:
        assert r.size == count(r.doc.text)
        sizes[r.doc.source] = sizes.get(r.doc.source, 0) + r.size
        taken[r.doc.source] = taken.get(r.doc.source, 0) + r.size * r.times
    order = sorted(s for s in sizes if s is not None) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = water(sizes, weights, 1.5 * sum(sizes.values()), 2)
    for r in got:
        assert r.source_size == sizes[r.doc.source] and r.target == pytest.approx(want[r.doc.source]) and 0 <= r.times <= 2
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 40
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=repr)


@pytest.mark.parametrize("same_text", [False, True])
def test_null_and_repeated_ids_meet_their_target(spark, same_text):
    rows = [(None if i < 600 else 7, "same words here" if same_text else f"text {i} here", "en", "s0" if i % 3 else "s1", 5) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = mixing.mix(docs).collect()
    assert len(got) == 900
    for s in ("s0", "s1"):
        mine = [r for r in got if r.doc.source == s]
        assert abs(sum(r.size * r.times for r in mine) - mine[0].target) <= 12 and mine[0].source_size == 3 * len(mine)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mixed_rows_repeat_as_planned(spark):
    docs = documents(spark, [f"t{i} x y" for i in range(50)], wild=True).withColumnsRenamed({"bucket": "__bin", "score": "doc", "embedding": "digest"})
    times = {r.doc.doc_id: r.times for r in mixing.mix(docs).collect()}
    rows = mixing.mixed_rows(docs.union(docs.limit(0)))
    assert rows.columns == docs.columns
    got = {}
    for r in rows.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
        assert r["__size"] == "x" and r["doc"] == "z"
    assert got == {k: v for k, v in times.items() if v}


def test_odd_rows_and_empty_tables(spark):
    got = mixing.mix(odd(spark, wild=True)).collect()
    assert len(got) == 15 and all(r.size == count(r.doc.text) for r in got)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed_rows(empty(spark)).count() == 0
    blank = mixing.mix(documents(spark, ["", None, " "])).collect()
    assert [r.target for r in blank] == [0.0] * 3
