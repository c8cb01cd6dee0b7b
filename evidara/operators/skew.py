"""Joins of many rows to one row for each key, where a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key that one task may always take, and the share of all rows beyond which a key is split.
LEAST, SHARE = 1000, 10_000


def fresh(name: str, *tables: DataFrame) -> str:
    """A column name that none of ``tables`` has, in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name in taken:
        name += "_"
    return name


def attach(many: DataFrame, one: DataFrame, key: str | list[str], counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``many`` joined to ``one`` (one row for each ``key``, a column or several). A key of more than ``LEAST`` rows and more than a ``SHARE``-th of
    all is dealt over several tasks, its row of ``one`` to each of them; fewer than ``SHARE`` keys can be like that, so their
    list is broadcast. ``many`` is counted, so it should be a written table. ``counts``: ``key`` and n, if already known."""
    keys = [key] if isinstance(key, str) else list(key)
    limit = max(LEAST, many.count() // SHARE)
    counts = many.groupBy(keys).agg(F.count("*").alias("n")) if counts is None else counts
    parts, salt = fresh("parts", many, one), fresh("salt", many, one)
    hot = F.broadcast(counts.filter(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).alias(parts)))
    # which task takes a row makes no difference, so equal rows are told apart by where they stand
    left = many.join(hot, keys, "left").withColumn(salt, F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col(parts)), F.lit(0))).drop(parts)
    right = one.join(hot, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(parts), F.lit(1)) - 1))).drop(parts)
    return left.join(right, [*keys, salt], how).drop(salt)
