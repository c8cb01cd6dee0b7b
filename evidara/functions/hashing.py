"""Draws, folds and digests that do not depend on the order or the partitioning of rows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _hex_number(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10)


def bucket(key: Column, seed: int) -> Column:
    """A uniform draw in [0, 1) for a key: 52 bits of SHA-1."""
    return _hex_number(F.sha1(F.concat(F.lit(f"{seed}:"), key)), 13).cast("double") / F.lit(float(1 << 52))


def fold(key: Column, folds: int, seed: int) -> Column:
    """A fold number for a key: 32 bits of SHA-256."""
    return (_hex_number(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 8).cast("bigint") % folds).cast("int")


def in_validation(key: Column, per_mille: int = 10) -> Column:
    """Whether a key is one of ``per_mille`` in a thousand."""
    return _hex_number(F.sha1(key), 8).cast("bigint") % 1000 < per_mille


def side(draw: Column, validation: float, test: float) -> Column:
    return F.when(draw < test, "test").when(draw < test + validation, "validation").otherwise("train")


def short_digest(text: Column, digits: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def split_hash(rows: DataFrame, key: str) -> tuple[str, int]:
    """16 hex digits of a held-out split: the digest of its keys as text, sorted, one a line; and their number. The digest runs
    over the sorted keys, so they stream through the driver range by range; no more than a range is held at once. For tables of
    any size there is ``split_digest``."""
    digest, n = hashlib.sha256(), 0
    for row in rows.select(F.col(key).cast("string").alias("k")).orderBy("k").toLocalIterator(prefetchPartitions=True):
        digest.update((b"\n" if n else b"") + row.k.encode())
        n += 1
    return digest.hexdigest()[:16], n


def split_digest(rows: DataFrame, key: str) -> DataFrame:
    """One row with the digest of a set of keys in any order, in one pass of aggregates. Keys are digested apart and the digests'
    sorted list by a shard of its first bytes: 256 shards, 16 times as many for each 16-fold of four million keys, so no row
    holds more than some ten thousand digests; ``split_hash`` is the digest of the shards' digests in order."""
    each = rows.select(F.sha2(F.col(key).cast("string"), 256).alias("d")).distinct()
    digits, left = 2, rows.count() >> 22
    while left:
        digits, left = digits + 1, left >> 4
    shards = each.withColumn("s", F.substring("d", 1, digits)).groupBy("s").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256).alias("d"), F.count("*").alias("n"))
    return shards.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "d"))), lambda x: x["d"]), "\n"), 256).alias("split_hash"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_keys"))


def schema_hash(columns: Iterable[str]) -> str:
    """16 hex digits of a set of column names in any order."""
    return hashlib.sha256("\n".join(sorted(set(columns))).encode()).hexdigest()[:16]


def entry_key(identity: Mapping) -> str:
    """Digest of a mapping that identifies a stored table."""
    return hashlib.sha256(json.dumps(identity, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def derived_seed(seed: int, split: int | str) -> int:
    """A seed of its own for each split."""
    return int.from_bytes(hashlib.sha256(f"{seed}:{split}".encode()).digest()[:4], "big")
