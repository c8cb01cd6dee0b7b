import random

import pytest

from evidara.llm import jaccard
from tests.llm.helpers import components, documents, empty, odd


def grams(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(texts, k, num, den):
    sets = [grams(t, k) for t in texts]
    pairs = []
    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and sets[j] and den * shared >= num * len(a | sets[j]):
                pairs.append((j, i))
    return [(len(s), c) for s, c in zip(sets, components(len(texts), pairs))]


def corpus(seed, n=220):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    bases = [[rng.choice(words) for _ in range(rng.randint(20, 80))] for _ in range(12)]
    out = []
    for i in range(n):
        t = list(bases[i % 12] if i % 4 else [rng.choice(words) for _ in range(rng.randint(1, 60))])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append(" ".join(t) + (" " + passage if i % 3 == 0 else ""))
    return out + [out[1], out[1].upper(), "", None, "two words", "Two words"]


@pytest.mark.parametrize("limits", [(32, 2048), (3, 7)])
@pytest.mark.parametrize("size,num,den", [(4, 85, 100), (5, 80, 100)])
def test_against_all_pairs(spark, monkeypatch, limits, size, num, den):
    monkeypatch.setattr(jaccard, "HEAVY", limits[0])
    monkeypatch.setattr(jaccard, "BLOCK", limits[1])
    texts = corpus(size)
    got = sorted(map(tuple, jaccard.jaccard_components(documents(spark, texts, wild=True).repartition(6), size, num, den).collect()))
    assert got == [(i, n, c) for i, (n, c) in enumerate(brute(texts, size, num, den))]


def test_one_of_each(spark):
    texts = corpus(9)
    docs = documents(spark, texts)
    want = {c for _, c in brute(texts, 5, 80, 100)}
    kept = jaccard.one_of_each(docs.union(docs.filter("doc_id = 1")))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_odd_rows_and_empty_tables(spark):
    got = jaccard.jaccard_components(odd(spark, wild=True)).collect()
    assert len(got) == 15
    by = {r.doc_id: r for r in got}
    assert by[3].component_id == by[4].component_id == 3 and by[6].component_id == 5 and by[None].component_id == 5 and by[0].component_id == 0 and by[2].n_shingles == 0
    ids = [r.doc_id for r in jaccard.one_of_each(odd(spark)).collect()]
    assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 5, 7, 8, 9, 10, 11, 12] and None not in ids
    assert jaccard.jaccard_components(empty(spark)).count() == 0 and jaccard.one_of_each(empty(spark)).count() == 0
