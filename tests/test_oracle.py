"""Every registered library query against its SQL, on the smallest supplied tables."""

import math
import os

import pytest

from evidara.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


def rows(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in table.to_pylist()), key=repr)


def facts(duck):
    """Documents and labels as plain rows, for the queries that SQL does not express."""
    return duck.execute("select doc_id, lang, source, text, quality, n_chars from documents left join labels using (doc_id)").fetchall()


def plain_auc(rows):
    pos, neg = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None


def by_lang(duck, score):
    out = {}
    for _, lang, _, _, quality, n in facts(duck):
        if quality is not None:
            out.setdefault(lang, []).append((quality, score(n)))
    return out


def check_bootstrap_ci(rows, duck):
    want = by_lang(duck, lambda n: n % 997 / 997)
    assert {r["lang"] for r in rows} == set(want)
    for r in rows:
        auc = plain_auc(want[r["lang"]])
        assert r["n"] == len(want[r["lang"]]) and (auc is None) == (r["auc"] is None)
        assert auc is None or abs(r["auc"] - auc) < 1e-9 and r["ci_low"] <= r["auc"] <= r["ci_high"]


def check_paired_arms(rows, duck):
    base, other = by_lang(duck, lambda n: n % 997 / 997), by_lang(duck, lambda n: n % 499 / 499)
    for r in rows:
        a, b = plain_auc(other[r["gene"]]), plain_auc(base[r["gene"]])
        assert r["arm"] == "other" and r["n"] == len(base[r["gene"]]) and (a is None) == (r["delta"] is None)
        assert a is None or abs(r["delta"] - (a - b)) < 1e-9 and r["ci_low"] <= r["ci_high"]


def check_calibrated_scores(rows, duck):
    """Platt's scores of a cell are one logistic curve of the logit, fitted to its even documents: the gradient of their log loss is 0."""
    fit = {}
    for doc_id, lang, _, _, quality, n in facts(duck):
        if quality is not None and doc_id % 2 == 0:
            fit.setdefault(lang, []).append((quality, n % 997 / 997))
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    cells = {}
    for r in rows:
        cells.setdefault(r["lang"], []).append((logit(r["score"]), logit(r["calibrated"])))
    for lang, points in cells.items():
        (x0, y0), (x1, y1) = min(points), max(points)
        if len({y for y, _ in fit[lang]}) < 2 or x0 == x1:
            continue
        slope = (y1 - y0) / (x1 - x0)
        shift = y0 - slope * x0
        assert all(abs(slope * x + shift - y) < 1e-4 for x, y in points)
        off = [1 / (1 + math.exp(-(slope * logit(p) + shift))) - y for y, p in fit[lang]]
        assert abs(sum(off)) < 1e-3 * len(off) and abs(sum(o * logit(p) for o, (_, p) in zip(off, fit[lang]))) < 1e-3 * len(off)


def covered(units, texts, start, end, span):
    """Spans are where they say, in order, without overlap, and leave out only white space."""
    for key, text in texts.items():
        mine = sorted((u[start], u[end], u[span]) for u in units.get(key, []))
        at = 0
        for a, b, s in mine:
            assert text[a:b] == s and a >= at and not text[at:a].strip()
            at = b
        assert not text[at:].strip()


def grouped(rows, *keys):
    out = {}
    for r in rows:
        out.setdefault(tuple(r[k] for k in keys), []).append(r)
    return out


def turns(duck):
    return {(c, t): text or "" for c, t, text in duck.execute("select conv_id, turn, text from conversations").fetchall()}


def check_sentence_units(rows, duck):
    covered(grouped(rows, "conv_id", "turn"), turns(duck), "start", "end", "text")


def check_evidence_units(rows, duck):
    covered(grouped(rows, "document_id"), {(d[0],): d[3] or "" for d in facts(duck)}, "char_start", "char_end", "text_span")
    assert {r["sentence_role"] for r in rows} <= {"evidence", "background", "conclusion"} and all(0 < r["confidence"] <= 1 for r in rows)


def check_masked_conclusions(rows, duck):
    said = turns(duck)
    assert len(rows) == len(said)
    for r in rows:
        assert r["n_masked"] >= 1 and r["n_codes"] >= 2 and "was classified as pathogenic" not in r["text"] and "PM2 and PP3 criteria were met." in r["text"]


def check_document_clusters(rows, duck):
    import re

    sets = {}
    for doc_id, _, _, text, *_ in facts(duck):
        words = re.findall("[a-z0-9<>_]+", " ".join((text or "").lower().split()))
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    tops = [find(k) for k in ids]
    for r in rows:
        top = find(r["document_id"])
        assert r["near_dup_cluster"] == (top if tops.count(top) > 1 else None)


WITHOUT_SQL = {name[6:]: check for name, check in list(globals().items()) if name.startswith("check_")}


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, duck, name):
    made = registry.queries()[name](spark, SF).toArrow()
    if name in registry.oracle_sql():
        got = rows(made)
        assert got == rows(duck.execute(registry.oracle_sql()[name]).to_arrow_table())
        assert got[1], "a query without rows shows nothing"
    else:
        assert made.num_rows
        WITHOUT_SQL[name](made.to_pylist(), duck)
