import hashlib
import random
import re
import zlib

import pytest

from evidara.llm import licences, media, queries, token_counts
from tests.llm.helpers import documents, empty, odd, write_tables

PHRASES = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}


def spec_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_base_phrases_against_a_plain_search(spark):
    rng = random.Random(4)
    pool = "mit license apache general public gnu the licensed under version 2 ÄMit license, Lizenz MIT-LICENSE released".split()
    more = documents(spark, [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(150)])
    docs = odd(spark).filter("doc_id is not null").distinct().union(more.selectExpr("doc_id + 100", "text", "lang", "source", "n_chars"))
    for r in licences.scan_licences(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        words = spec_words(r.text)
        hits = [(i, k) for k, p in PHRASES.items() for i in range(len(words)) if words[i : i + len(p)] == p]
        starts = [i for i, _ in hits]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({k for _, k in hits})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) or not r.base_labels


def test_matching_statistics_against_all_runs():
    rng = random.Random(1)
    templates = [("a", "x y z w x y", "x"), ("b", "y z q x y z w", "q"), ("c", "w x q q", "q")]
    automaton = licences.Automaton(templates, [("p", "y z"), ("q", "z w x")])
    runs = [t[1].split() for t in templates] + [["y", "z"], ["z", "w", "x"]]
    inside = lambda part: any(part == r[i : i + len(part)] for r in runs for i in range(len(r)))
    for _ in range(300):
        words = [rng.choice("xyzwq!") for _ in range(rng.randint(0, 25))]
        places, found = automaton.scan([w.encode() for w in words])
        assert sorted(places) == sorted((i, k) for k, p in enumerate((["y", "z"], ["z", "w", "x"])) for i in range(len(words)) if words[i : i + len(p)] == p)
        longest = {}
        for end in range(1, len(words) + 1):
            n = next((n for n in range(end, 0, -1) if inside(words[end - n : end])), 0)
            longest[end] = n
        want = [(end - n, n) for end, n in longest.items() if n >= licences.MIN_RUN and longest.get(end + 1, 0) <= n and longest.get(end + 1) != n + 1]
        assert sorted((s, n) for s, n, _ in found) == sorted(want)


def test_spans_of_whole_and_partial_templates(spark):
    notice = next(t[1] for t in licences.TEMPLATES if t[0] == "bsd")
    words = notice.split()
    docs = documents(spark, [f"start {notice.upper()} end", " ".join(words[: len(words) * 3 // 4]), " ".join(words[:5]), "plain prose"])
    rows = {r.doc_id: r for r in licences.scan_licences(docs).collect()}
    assert rows[0].labels == "bsd" and rows[0].score == 1.0 and rows[0].spans[0].first == 1 and rows[0].spans[0].last == len(words)
    assert rows[1].labels == "bsd" and 0.5 <= rows[1].score < 1 and rows[2].labels == "" and rows[3].score == 0


def test_every_template_is_found_in_its_own_text(spark):
    texts = [t[1] for t in licences.TEMPLATES] + ["(c) 2020 Foo. ALL RIGHTS RESERVED.", "all rights; all rights reserved, all rights reserved", "all rights", "rights reserved"]
    rows = {r.doc_id: r for r in licences.scan_licences(documents(spark, texts)).collect()}
    for i, (label, text, _) in enumerate(licences.TEMPLATES):
        assert [tuple(s) for s in rows[i].spans] == [(label, 0, len(text.split()) - 1, 1.0)] and label in rows[i].labels.split(",") and rows[i].score == 1.0
    at = len(licences.TEMPLATES)
    assert [tuple(s) for s in rows[at].spans] == [("reserved", 3, 5, 1.0)] and rows[at].n_base == 0
    assert [(s.first, s.last) for s in rows[at + 1].spans] == [(2, 4), (5, 7)]
    assert rows[at + 2].labels == rows[at + 3].labels == "" and rows[at + 2].score == 0


def test_labels_of_notices(spark):
    said = {
        "Licensed under CC BY 4.0.": "cc-by",
        "CC BY-ND": "cc-by-nd",
        "Licensed under CC BY-NC-SA 4.0": "cc-by-nc-sa",
        "This work is licensed under the Apache License": "apache",
        "Released under the MIT terms": "",
        "Released under the MIT License.": "mit",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
        # the base phrase stands in the notice
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License": "agpl,gpl",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License": "gpl",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License": "gpl,lgpl",
        "Permission is hereby granted, free of charge, to any person who asks.": "",
    }
    rows = {r.doc_id: r.labels for r in licences.scan_licences(documents(spark, list(said))).collect()}
    assert [rows[i] for i in range(len(said))] == list(said.values())


def test_chains_against_all_chains():
    rng = random.Random(6)
    automaton = licences.Automaton([("a", "a b c d e f g h i j k l", "a"), ("b", "a b c d m n o p q r", "m"), ("c", "e f g h a b c d", "e")], [])
    plain = [r for r in automaton.runs]
    for _ in range(150):
        words = []
        while len(words) < 40:
            r = rng.choice(plain)
            i = rng.randrange(len(r))
            words += r[i : i + rng.randint(3, 9)] + [b"?"] * rng.choice([0, 0, 1, 2, 14])
        _, runs = automaton.scan(words)
        anchors = [(n, s, s + held, end - held, end) for s, held, state in runs for n, end in automaton.ends[state]]
        best: dict = {}

        def weight(x):  # of the heaviest chain that ends with the anchor
            if x not in best:
                sums = automaton.weights[x[0]]
                before = [weight(y) for y in anchors if y[0] == x[0] and y[2] <= x[1] <= y[2] + licences.MAX_GAP and y[4] <= x[3]]
                best[x] = max(before, default=0.0) + sums[x[4]] - sums[x[3]]
            return best[x]

        want = sorted((x[0], x[2], round(weight(x), 9)) for x in anchors)
        assert sorted((n, end, round(w, 9)) for n, _, end, w in automaton.chains(runs)) == want
        kept = automaton.spans(words, runs)
        assert all(a[2] < b[1] for a, b in zip(kept, kept[1:])) and all(0.5 <= k[3] <= 1 for k in kept)
        for number, first, end, w in automaton.chains(runs):  # a heavy chain with its phrase stands, or another in its place does
            if w >= 0.5 * automaton.weights[number][-1] and automaton.needs[number][0] in words[first:end]:
                assert any(k[1] < end and first <= k[2] for k in kept)


def test_short_template_inside_a_longer_run():
    automaton = licences.Automaton([("a", "x y z", "x y"), ("b", "w x y z q v", "q v")], [])
    words = [w.encode() for w in "w x y z q v".split()]
    found, runs = automaton.scan(words)
    assert automaton.spans(words, runs, found) == [("b", 0, 5, 1.0)]


def test_media_round_trip(spark):
    docs = odd(spark)
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = media.media_columns(docs).collect()
    assert len(rows) == 15
    for r in rows:
        data = (text[r.doc_id] or "").encode()
        payload = media.padded(data)
        assert len(payload) % 576 == 0 and len(payload) > 0 and payload.startswith(data) and media.read(media.store(payload)) == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media.store(payload)), hashlib.sha256(media.store(payload)).hexdigest())
        assert r.feature.startswith(f"{len(r.codes)}:") and len(r.times) == len(r.codes)
    by = {r.doc_id: r.feature for r in rows}
    assert by[3] == by[4] and by[5] == by[6] and by[7] != by[10]
    assert media.media_columns(empty(spark)).count() == 0


def test_media_column_is_read_back(spark, tmp_path):
    docs = odd(spark)
    media.media_columns(docs).write.parquet(str(tmp_path / "media"))
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = spark.read.parquet(str(tmp_path / "media")).collect()
    assert len(rows) == 15
    for r in rows:
        assert media.read(bytes(r.media)) == media.padded((text[r.doc_id] or "").encode())
        assert (len(r.media), hashlib.sha256(r.media).hexdigest()) == (r.media_bytes, r.media_sha256)
    write_tables(spark, tmp_path, docs)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    made = queries.op6_media_columns(spark, str(tmp_path))
    assert made.columns == names
    assert sorted(map(tuple, made.collect()), key=repr) == sorted((tuple(r[n] for n in names) for r in rows), key=repr)


def test_texts_of_one_block_have_fingerprints(spark):
    rng = random.Random(3)
    words = "the licence text of a short page with some words that are drawn at random from this list".split()
    texts = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 90)))[:576] for _ in range(200)} | {"a" * 576, "b" * 575 + "a"})
    rows = media.media_columns(documents(spark, ["", *texts])).collect()
    assert all(r.payload_bytes == 576 and len(r.codes) == len(r.times) == 24 for r in rows)
    assert len({r.feature for r in rows}) == len(texts) + 1


def test_every_sample_stands_in_two_frames():
    for blocks in (1, 4):
        assert len(media.peaks(media.np.zeros(blocks * media.BLOCK, "u1"))) == blocks * media.BLOCK // media.HOP + 1


def test_feature_against_a_plain_transform(spark):
    np = media.np
    rng = random.Random(12)
    texts = ["".join(rng.choice("abc defghij.,\n") for _ in range(rng.randint(1, 3000))) for _ in range(12)]
    rows = {r.doc_id: r for r in media.media_columns(documents(spark, texts)).collect()}
    angle = np.exp(-2j * np.pi * np.outer(np.arange(576), np.arange(289)) / 576)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(576) / 576)
    for i, text in enumerate(texts):
        samples = np.frombuffer(media.padded(text.encode()), "u1").astype(float) / 128 - 1
        samples = np.concatenate([np.zeros(288), samples, np.zeros(288)])
        found = []
        for at in range(0, len(samples) - 575, 288):
            power = np.abs((samples[at : at + 576] * window) @ angle) ** 2
            power[power < 1e-22 * power.sum()] = 0
            found.append([low + int(power[low:high].argmax()) for low, high in ((1, 12), (12, 36), (36, 100), (100, 289))])
        want = [(t, found[t][b] << 12 | found[t + ahead][o] << 2 | ahead) for ahead in (1, 2, 3) if ahead < len(found) for b in range(4) for o in (b, (b + 1) % 4) for t in range(len(found) - ahead)]
        r = rows[i]
        assert list(zip(r.times, r.codes)) == want
        arrays = np.array([t for t, _ in want], "<i4").tobytes() + np.array([c for _, c in want], "<i4").tobytes()
        assert r.feature == f"{len(want)}:{sum(media.padded(text.encode()))}:{hashlib.sha256(arrays).hexdigest()[:32]}"


def test_rows_of_many_bytes_come_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(media, "OUTPUT", 2000)
    docs = documents(spark, ["x" * (i * 700) for i in range(20)]).coalesce(1)
    rows = media.media_columns(docs).collect()
    assert [(r.doc_id, r.n_bytes) for r in rows] == [(i, i * 700) for i in range(20)]


def test_token_counts_and_cache(spark, tmp_path):
    tokenizers = pytest.importorskip("public_tokenizers")
    docs = odd(spark, wild=True)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for name in ("piece_bpe_32k.model", "byte_bpe_50k.json"):
        path = tokenizers.path(name)
        count = token_counts.load(path)
        rows = token_counts.count_tokens(docs, path, cache=str(tmp_path / "cache"), limit=3).collect()
        assert len(rows) == 15
        for r in rows:
            n = count([text[r.doc_id]])[0]
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), n, n > 3)
    stored = spark.read.parquet(str(tmp_path / "cache"))
    distinct = len(set(text.values()))
    assert stored.count() == 2 * distinct and stored.select("version").distinct().count() == 2
    more = docs.union(documents(spark, ["another text"], wild=True))
    assert token_counts.count_tokens(more, tokenizers.path("piece_bpe_32k.model"), cache=str(tmp_path / "cache")).count() == 16
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 2 * distinct + 1  # only the miss was encoded
    assert token_counts.count_tokens(empty(spark), tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_token_query_finds_stored_digests(spark, tmp_path, monkeypatch):
    tokenizers = pytest.importorskip("public_tokenizers")
    texts = [f"text number {i % 7}" for i in range(40)] + [None, ""]
    sf = write_tables(spark, tmp_path / "sf", odd(spark).union(documents(spark, texts)))
    hits = []
    plain = token_counts.Cache.read

    def seen(self, version):
        found = plain(self, version)
        hits.append(found.count())
        return found

    monkeypatch.setattr(token_counts.Cache, "read", seen)
    rows = queries.op8_token_counts(spark, sf).collect()
    count = token_counts.load(tokenizers.path("piece_bpe_32k.model"))
    every = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted(((i, len(t.encode()), count([t])[0]) for i, t in every), key=repr)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in rows), key=repr) == want
    assert hits[0] == 0 < hits[2] < hits[3] == len({t for _, t in every})  # the second half starts from what the first stored
