"""Secret scans: candidates are judged by who else holds them.

Every whole text is scanned for candidates: assignments of a value to a secret's name, access keys, long runs of hexadecimal
digits, and opaque words (``OPAQUE_LEAST`` to ``OPAQUE_MOST`` characters of a key's alphabet that overlap none of the others).
Only the digest of a value leaves the scan. Over the whole corpus each digest's distinct owners and repositories are counted:
a value held by ``OWNERS`` owners or ``REPOSITORIES`` repositories is a widely copied example; one of fewer that looks live
(a letter, a digit and ``VARIETY`` different characters) is owner-specific. An opaque word is a secret only if it is
owner-specific; candidates of the other kinds always are, each with its class (live, copied or weak).

A match of the first three kinds is kept whatever its class. Scanning goes on behind a match that fails its length. Positions
are code points, the end is exclusive.

Null counts as empty text, which has no spans; a null owner or repository is one owner, one repository. A row is a document,
so repeated rows and null doc_ids are told apart and each is answered, but copies with one owner are still one owner. An empty
table gives no rows; further columns are ignored. Texts are scanned whole; a run that is longer than ``OPAQUE_MOST`` is data
and no opaque word by definition.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.llm.skew import attach
from evidara.llm.workspace import Workspace

OWNERS, REPOSITORIES = 3, 6
OPAQUE_LEAST, OPAQUE_MOST, VARIETY = 20, 128, 10

# The kinds in the order in which they are listed, and their patterns and least lengths.
KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")  # runs of 32 and more: what is left of all runs
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
NAMES = ("passw", "secret", "token", "api")

OPAQUE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{OPAQUE_LEAST},{OPAQUE_MOST}}}(?![A-Za-z0-9+/_=-])")
LETTER, DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")

SPAN = "struct<start: int, kind: int, end: int, digest: binary, live: boolean>"
SCANNED = f"doc_id long, owner string, repository string, spans array<{SPAN}>"


def base_spans(text: str) -> Iterator[tuple[int, int, int, str]]:
    """(kind, start, end, value) of the first three kinds; value is what is secret of the match."""
    low = text.lower()
    if any(name in low for name in NAMES):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LEAST:
                yield 0, m.start(), m.end(), m[2]
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_LEAST:
                yield 1, m.start(), m.end(), m[0]
    for m in HEX.finditer(text):
        yield 2, m.start(), m.end(), m[0]


def looks_live(value: str) -> bool:
    return bool(LETTER.search(value) and DIGIT.search(value)) and len(set(value)) >= VARIETY


def candidates(text: str) -> list[dict]:
    """All candidates of a text by start, then kind."""
    found = sorted((start, kind, end, value) for kind, start, end, value in base_spans(text))
    reach, at, more = -1, 0, []
    for m in OPAQUE.finditer(text):
        # spans before the word's end reach at most as far as ``reach``
        while at < len(found) and found[at][0] < m.end():
            reach = max(reach, found[at][2])
            at += 1
        if reach <= m.start() and looks_live(m[0]):
            more.append((m.start(), 3, m.end(), m[0]))
    return [{"start": s, "kind": k, "end": e, "digest": hashlib.sha256(v.encode("utf-8", "surrogatepass")).digest(), "live": looks_live(v)} for s, k, e, v in sorted(found + more)]


def scan(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """``SCANNED`` for every row of ``docs`` (doc_id, text)."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("digest", pa.binary()), ("live", pa.bool_())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = pa.array([candidates(text.as_py()) for text in batch.column("text")], pa.list_(span))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "owner", "repository")), spans], ["doc_id", "owner", "repository", "spans"])

    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), name(owner).alias("owner"), name(repository).alias("repository"), text.alias("text")).mapInArrow(each, SCANNED)


def ownership(occurrences: DataFrame) -> DataFrame:
    """digest, n, owners, repositories and copied of every candidate value, from (digest, owner, repository). Equal
    pairs are summed where they are read, so a value that is everywhere is a few rows a task."""
    by_owner = occurrences.groupBy("digest", "owner").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("owners"), F.sum("n").alias("n"))
    by_repository = occurrences.select("digest", "repository").distinct().groupBy("digest").agg(F.count("*").alias("repositories"))
    return by_owner.join(by_repository, "digest").withColumn("copied", (F.col("owners") >= OWNERS) | (F.col("repositories") >= REPOSITORIES))


def scan_secrets(docs: DataFrame, owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """doc_id and ``found`` of every row of ``docs`` (doc_id, text and what ``owner`` and ``repository`` name): an array of
    (start, kind, end, digest, class, owners, repositories, n) by start, then kind. By default a source is an owner and each
    language of it a repository."""
    space = Workspace(docs.sparkSession, "secrets")
    owner = F.col("source") if owner is None else owner
    if repository is None:
        repository = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    scanned = space.save(scan(docs, owner, repository).withColumn("row", F.monotonically_increasing_id()), "scanned")
    some = space.save(scanned.filter(F.size("spans") > 0).select("row", "doc_id", "owner", "repository", F.inline("spans")), "spans")
    known = space.save(ownership(some), "known")
    told = attach(some.drop("owner", "repository"), known, "digest", known.select("digest", "n"))
    kind = F.when(F.col("copied"), "copied").when(F.col("live"), "live").otherwise("weak")
    # an opaque word is there only if it looks live
    told = told.filter((F.col("kind") < 3) | ~F.col("copied")).withColumn("class", kind)
    item = F.struct("start", "kind", "end", "digest", "class", "owners", "repositories", "n")
    found = told.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(item)).alias("found"))
    found = space.save(found, "found")  # as large as the spans of the documents
    none = scanned.join(found.select("row"), "row", "left_anti").select("doc_id", F.array().cast(found.schema["found"].dataType).alias("found"))
    return found.select("doc_id", "found").unionByName(none)


def joined(found: Column, base: bool) -> Column:
    """kind:start:end of the spans, comma-joined; ``base``: of the first three kinds only."""
    kinds = F.array(*map(F.lit, KINDS))
    spans = F.filter(found, lambda x: x["kind"] < 3) if base else found
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")


def summary(found: DataFrame) -> DataFrame:
    """Counts and digests of spans for each row of ``scan_secrets``."""

    def many(field: str, value: int | str) -> Column:
        return F.size(F.filter("found", lambda x: x[field] == value)).cast("long").alias(f"n_{KINDS[value] if field == 'kind' else value}")

    counts = [many("kind", k) for k in range(len(KINDS))]
    classes = [many("class", c) for c in ("live", "copied", "weak")]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("found"), True), 256).alias("base_sha256"), joined(F.col("found"), False).alias("spans"), *classes)
