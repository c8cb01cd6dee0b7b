import hashlib
import random
import re

from evidara.llm import queries, secrets
from tests.llm.helpers import DOCS, empty, odd, write_tables

HEX40 = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
OPAQUE = "Zx8kLm29QwErTy47UiOpAs"


def plain_base(text):
    """The contract's own wording, without the operator's shortcuts."""
    found = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end(), m[2]))
    for kind, pattern, least in ((1, r"AKIA[A-Z0-9]+", 16), (2, r"[0-9a-f]+", 32)):
        found += [(m.start(), kind, m.end(), m[0]) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(found)


def brute(rows):
    """doc_id, counts, digest, spans and classes of rows (doc_id, text, lang, source)."""
    found = []
    live = lambda v: bool(re.search("[A-Za-z]", v) and re.search("[0-9]", v) and len(set(v)) >= secrets.VARIETY)
    for _, text, *_ in rows:
        text = text or ""
        base = plain_base(text)
        more = [(m.start(), 3, m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_=-]+", text) if secrets.OPAQUE_LEAST <= len(m[0]) <= secrets.OPAQUE_MOST and live(m[0])]
        found.append(sorted(base + [o for o in more if not any(b[0] < o[2] and b[2] > o[0] for b in base)]))
    owners, places = {}, {}
    for (_, _, lang, source), spans in zip(rows, found, strict=True):
        for s in spans:
            owners.setdefault(s[3], set()).add(source or "")
            places.setdefault(s[3], set()).add((source or "", lang or ""))
    copied = lambda v: len(owners[v]) >= secrets.OWNERS or len(places[v]) >= secrets.REPOSITORIES
    out = []
    for (doc_id, *_), spans in zip(rows, found, strict=True):
        spans = [s for s in spans if s[1] < 3 or not copied(s[3])]
        said = lambda some: ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e, _ in some)
        classes = ["copied" if copied(v) else "live" if live(v) else "weak" for *_, v in spans]
        out.append((doc_id, *(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(said([s for s in spans if s[1] < 3]).encode()).hexdigest(), said(spans), *map(classes.count, ("live", "copied", "weak"))))
    return sorted(out, key=repr)


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, lang, source, 0) for i, t, lang, source in rows], DOCS)
    assert sorted(map(tuple, secrets.summary(secrets.scan_secrets(docs)).collect()), key=repr) == brute(rows)


def texts():
    rng = random.Random(3)
    parts = [
        f'token = "{HEX40}"', "token:api_key: abcdefghij", "PassWd='short'", "api_key=abc.def-ghi_jkl", "secret  :  x" + "y" * 9, "ſecret=abcdefgh12", "toKen=abcdefgh12", "AKIA" + "B" * 11, "AKIA" + "B7" * 6,
        "AKIAAKIA", HEX40.upper(), "0" * 32, "f" * 31, OPAQUE, OPAQUE[:-3], "pre-" + OPAQUE, OPAQUE + "." + OPAQUE[::-1], "x1Y2" * 40, "ü" + HEX40 + "g", "token=secret=abcdefgh12", "password==========", "token\n=abcdefghij",
    ]
    return [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(120)] + parts


def test_against_plain_patterns(spark):
    rng = random.Random(4)
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d", None])) for i, t in enumerate(texts())]
    assert all(sorted((s, k, e, v) for k, s, e, v in secrets.base_spans(t)) == plain_base(t) for _, t, *_ in rows)
    check(spark, rows)


def test_owner_specific_values_are_told_from_copied_ones(spark):
    rows = [(i, f"api_key: {OPAQUE} and {HEX40.upper()}", "en", f"o{i}") for i in range(3)]  # three owners: copied
    rows += [(10 + i, f"token={HEX40} {OPAQUE}mine{i % 2}", "en", "o1") for i in range(4)]  # one owner, however often
    rows += [(20, "password = password", "en", "o1"), (21, "nothing here", "en", "o1")]
    check(spark, rows)
    docs = spark.createDataFrame([(i, t, lang, s, 0) for i, t, lang, s in rows], DOCS)
    told = {r.doc_id: (r.spans, r.n_live, r.n_copied, r.n_weak) for r in secrets.summary(secrets.scan_secrets(docs)).collect()}
    assert told[0] == (f"assign:0:{9 + len(OPAQUE)}", 0, 1, 0)  # the opaque word that three owners hold is an example
    assert told[10][1:3] == (3, 0) and "opaque" in told[10][0]
    assert told[20][3] == 1 and told[21] == ("", 0, 0, 0)


def test_odd_rows(spark):
    for wild in (False, True):
        rows = [tuple(r) for r in odd(spark, wild).select("doc_id", "text", "lang", "source").collect()]
        got = secrets.summary(secrets.scan_secrets(odd(spark, wild))).collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows)
    assert secrets.scan_secrets(empty(spark)).count() == 0
    check(spark, [(1, None, None, None), (None, f"token={HEX40}", None, None), (None, f"token={HEX40}", None, None), (2, "token=" + "a1B2c3D4" * 400_000 + " " + "word " * 600_000 + OPAQUE, "en", "s")])


def test_a_value_that_is_everywhere_is_dealt(spark, monkeypatch):
    from evidara.operators import skew

    monkeypatch.setattr(skew, "LEAST", 3)
    monkeypatch.setattr(skew, "SHARE", 50)
    check(spark, [(i, f"token={HEX40} {OPAQUE}{i}", "en", f"o{i % 4}") for i in range(90)])


def test_other_owners_and_repositories(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"token={HEX40}", i % 2, i) for i in range(8)], "doc_id int, text string, team int, repo int")
    found = secrets.scan_secrets(docs, F.col("team"), F.lit("all")).collect()
    assert {(r.found[0]["class"], r.found[0].owners, r.found[0].repositories, r.found[0].n) for r in found} == {("live", 2, 1, 16)}
    found = secrets.scan_secrets(docs, F.col("team"), F.col("repo")).collect()
    assert {(r.found[0]["class"], r.found[0].repositories) for r in found} == {("copied", 8)}


def test_query_reads_whole_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "word " * 50_000 + f"token={HEX40}", "en", "s", 0), (2, None, "en", None, 0)], DOCS)
    got = sorted(queries.op12_secret_scan(spark, write_tables(spark, tmp_path / "sf", docs)).collect())
    assert [(r.doc_id, r.n_assign, r.n_hex, r.spans) for r in got] == [(1, 1, 1, "assign:250000:250046,hex:250006:250046"), (2, 0, 0, "")]
