"""Joins: many-to-one with defaults, intervals, points, exact sequences, exploded lists, and edge lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def many_to_one(rows: DataFrame, side: DataFrame, on: Sequence[str], defaults: Mapping | None = None) -> DataFrame:
    """Left join that fails if the side has a key twice; columns of the same name are replaced; misses take the defaults.
    Spark broadcasts the side only where it is under its own size limit."""
    on = list(on)
    extra = [c for c in side.columns if c not in on]
    once = side.groupBy(*on).agg(F.count("*").alias("__n"), *[F.any_value(F.struct(F.col(c))).getField(c).alias(c) for c in extra])
    once = once.filter(F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.lit("a key of the side table is not unique")).cast("boolean"))).drop("__n")
    out = rows.drop(*extra).join(once, on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in (defaults or {}).items()})


def interval_join(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, width: int = 256) -> DataFrame:
    """Inner join of points with the intervals of their key that hold them (both ends included). Each interval is filed under the
    bins of ``width`` that it touches and a point under its own, so the join is one of equal keys whatever the lengths are."""
    bins = F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor(F.col(end) / width).cast("long"))
    filed = intervals.filter(F.col(start) <= F.col(end)).withColumn("__bin", F.explode(bins))
    return points.withColumn("__bin", F.floor(F.col(at) / width).cast("long")).join(filed, [key, "__bin"]).filter(F.col(at).between(F.col(start), F.col(end))).drop("__bin")


def attach_intervals(rows: DataFrame, intervals: DataFrame, key: str, at: str, name: str, out: str, start: str = "start", end: str = "end") -> DataFrame:
    """Rows with the sorted distinct names of the intervals that hold them, joined by a bar, and a flag."""
    points = rows.select(key, at).filter(F.col(key).isNotNull() & F.col(at).isNotNull()).distinct()
    found = interval_join(points, intervals.select(key, name, start, end), key, at, start, end)
    listed = found.groupBy(key, at).agg(F.array_join(F.array_sort(F.collect_set(name)), "|").alias(out))
    joined = rows.join(listed, [key, at], "left")
    return joined.withColumns({out: F.coalesce(out, F.lit("")), f"in_{out}": F.col(out).isNotNull().cast("int")})


def attach_points(rows: DataFrame, sites: DataFrame, key: str, at: str, name: str, out: str) -> DataFrame:
    """As ``attach_intervals`` for single positions."""
    listed = sites.groupBy(key, at).agg(F.array_join(F.array_sort(F.collect_set(name)), "|").alias(out))
    joined = rows.join(listed, [key, at], "left")
    return joined.withColumns({out: F.coalesce(out, F.lit("")), f"has_{out}": F.col(out).isNotNull().cast("int")})


def join_by_sequence(left: DataFrame, right: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Inner join on equal sequences, by digest first so that long keys are not shuffled twice."""
    a, b = left.withColumn("__d", F.sha2(sequence, 256)), right.withColumn("__d", F.sha2(sequence, 256))
    return a.join(b.drop(sequence), "__d").drop("__d")


def exploded_ids(rows: DataFrame, ids: str, out: str, payload: Sequence[str], order: str, sep: str = ";") -> DataFrame:
    """A list of ids as rows; an id of several rows keeps the first in order and counts the others."""
    each = rows.withColumn(out, F.explode(F.filter(F.transform(F.split(ids, sep), lambda x: F.trim(x)), lambda x: x != "")))
    best = F.min_by(F.struct(*payload), order).alias("__p")
    return each.groupBy(out).agg(best, (F.count_distinct(F.struct(*payload)) - 1).alias("n_conflicts")).select(out, "__p.*", "n_conflicts")


def only_in(rows: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return rows.join(keys.select(*on), list(on), "left_semi")


def not_in(rows: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return rows.join(keys.select(*on), list(on), "left_anti")


def edges(kinds: Mapping[str, tuple[DataFrame, str, str]], source: str) -> DataFrame:
    """Union of edge kinds, each (table, subject column, object column), as subject, predicate, object and source."""
    out = None
    for kind, (table, subject, target) in kinds.items():
        part = table.select(F.col(subject).cast("string").alias("subject"), F.lit(kind).alias("predicate"), F.col(target).cast("string").alias("object"), F.lit(source).alias("source_id")).dropna(subset=["subject", "object"]).distinct()
        out = part if out is None else out.unionByName(part)
    return out


def nested_view(parent: DataFrame, key: str, children: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """One record for each parent with its children as arrays of structs, each ordered by the column named with it."""
    out = parent
    for name, (child, order) in children.items():
        fields = [c for c in child.columns if c != key]
        first = [order, *[c for c in fields if c != order]]
        grouped = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*first))).alias(name))
        out = out.join(grouped, key, "left")
    return out.withColumns({name: F.coalesce(F.col(name), F.array().cast(dict(out.dtypes)[name])) for name in children})


def reclassified(old: DataFrame, new: DataFrame, key: str = "variation_id") -> DataFrame:
    """Uncertain variants of an older release with what the newer one says: 1, 0, or null while still open."""
    later = new.select(key, F.col("label5").alias("later"))
    outcome = F.when(F.col("later").isin("pathogenic", "likely_pathogenic"), 1.0).when(F.col("later").isin("benign", "likely_benign"), 0.0)
    return old.filter("label5 = 'vus'").join(later, key, "left").withColumn("outcome", outcome)


def compare_wide(ours: DataFrame, theirs: DataFrame, key: str, models: Sequence[str]) -> DataFrame:
    """Two wide tables of scores matched by row and by model name without case and punctuation: correlation, mean absolute
    difference and the share within 0.01, for each model."""
    from evidara.functions.text import model_key

    long = lambda t, v: t.unpivot([key], [c for c in t.columns if c != key], "model", v).withColumn("model", model_key(F.col("model")))
    both = long(ours.select(key, *models), "ours").join(long(theirs, "theirs"), [key, "model"])
    off = F.abs(F.col("ours") - F.col("theirs"))
    return both.groupBy("model").agg(F.corr("ours", "theirs").alias("pearson"), F.avg(off).alias("mean_abs_diff"), F.avg((off <= 0.01).cast("double")).alias("share_within"), F.count("*").alias("n"))
