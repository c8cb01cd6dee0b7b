"""Splits and folds: by hash, group, text, time, and leave-one-group-out, with guards against straddling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidara.functions import hashing
from evidara.operators.graph import sharing

SIDES = {"train": 0, "validation": 1, "test": 2}


def hash_split(rows: DataFrame, key: str, seed: int, validation: float = 0.1, test: float = 0.1) -> DataFrame:
    draw = hashing.bucket(F.col(key).cast("string"), seed)
    return rows.withColumn("split", hashing.side(draw, validation, test))


def group_split(rows: DataFrame, group: str, seed: int, validation: float = 0.1, test: float = 0.1) -> DataFrame:
    """All rows of a group on one side: the draw is of the group's own key, so no join is needed."""
    return hash_split(rows.withColumn("__g", F.col(group).cast("string")), "__g", seed, validation, test).drop("__g")


def most_held_out(rows: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Every group on the most held-out side that any of its rows is on."""
    rank = F.element_at(F.create_map(*[F.lit(x) for p in SIDES.items() for x in p]), F.col(split))
    worst = rows.groupBy(group).agg(F.max(rank).alias("__rank"))
    back = F.element_at(F.create_map(*[F.lit(x) for k, v in SIDES.items() for x in (v, k)]), F.col("__rank"))
    return rows.join(worst, group).withColumn(split, back).drop("__rank")


def largest_group(rows: DataFrame, group: str) -> DataFrame:
    """One row: the number of groups and the share of the largest."""
    return rows.groupBy(group).agg(F.count("*").alias("n")).agg(F.count("*").alias("n_groups"), (F.max("n") / F.sum("n")).alias("largest_share"))


def day_at(rows: DataFrame, day: str, share: float) -> str | None:
    """The day on which the row at that share of all rows stands, in order of days: rows are counted by day, and one row for each
    day is summed."""
    days = rows.groupBy(day).agg(F.count("*").alias("n"))
    upto = days.withColumn("upto", F.sum("n").over(Window.orderBy(day))).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))
    found = upto.filter(F.col("upto") > F.floor(F.col("total") * share)).agg(F.min(day)).first()
    return found[0]


def by_time(rows: DataFrame, group: str, date: str, cutoff: str, mode: str = "novel", seed: int = 0, validation: float = 0.1) -> DataFrame:
    """Rows before the cutoff train; ``novel``: groups first seen from it on are the test and later rows of older groups are
    left out; ``reinterpretation``: all rows from it on are the test. Undated rows are left out (null)."""
    first = rows.groupBy(group).agg(F.min(date).alias("__first"))
    joined = rows.join(first, group, "left")
    late, new = F.col(date) >= cutoff, F.col("__first") >= cutoff
    train = F.when(hashing.bucket(F.col(group).cast("string"), seed) < validation, "validation").otherwise("train")
    told = F.when(F.col(date).isNull(), F.lit(None).cast("string")).when(~late, train)
    return joined.withColumn("split", told.when(new, "test") if mode == "novel" else told.when(late, "test")).drop("__first")


def make_split(rows: DataFrame, scheme: str, seed: int = 42, validation: float = 0.1, test: float = 0.1, **options) -> DataFrame:
    """Rows (document_id, variant_id, gene, submitter, disease, date, cluster) with ``split`` under one of the schemes random,
    variant, text, laboratory, gene, disease, temporal, functional and panel."""
    if scheme == "random":
        return hash_split(rows, "document_id", seed, validation, test)
    if scheme in ("laboratory", "gene", "disease"):
        return group_split(rows, {"laboratory": "submitter"}.get(scheme, scheme), seed, validation, test)
    if scheme in ("variant", "text"):
        columns = options.get("columns") or (["variant_id"] if scheme == "variant" else ["variant_id", "cluster"])
        groups = sharing(rows, "document_id", columns).withColumnRenamed("component", "variant_group")
        return group_split(rows.join(groups, "document_id"), "variant_group", seed, validation, test)
    if scheme == "temporal":
        return by_time(rows, "variant_id", "date", options["cutoff"], options.get("mode", "novel"), seed, validation)
    if scheme in ("functional", "panel"):
        held = options["held_out"].select(options.get("on", "variant_id")).distinct().withColumn("__held", F.lit(True))
        drawn = group_split(rows, "variant_id", seed, validation, 0.0)
        return drawn.join(held, options.get("on", "variant_id"), "left").withColumn("split", F.when(F.col("__held"), "test").otherwise(F.col("split"))).drop("__held")
    raise ValueError(f"unknown scheme {scheme}")


def leave_one_out(rows: DataFrame, group: str, least: int = 1) -> DataFrame:
    """(fold, group, n_train, n_test) for each group of at least ``least`` rows: the fold's rows are tested, all others train.
    A fold is a predicate (group = fold), so rows are never copied for it."""
    sizes = rows.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n_test"))
    total = sizes.agg(F.sum("n_test").alias("n"))
    return sizes.filter(F.col("n_test") >= least).join(F.broadcast(total)).select(F.col(group).alias("fold"), (F.col("n") - F.col("n_test")).alias("n_train"), "n_test")


def fold_side(group: Column, fold: Column) -> Column:
    return F.when(group == fold, "test").otherwise("train")


def family_of(group: Column, families: Mapping[str, str]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in families.items() for x in p]), group), group)


def hash_folds(rows: DataFrame, key: str, folds: int, seed: int) -> DataFrame:
    return rows.withColumn("fold", hashing.fold(F.col(key).cast("string"), folds, seed))


def purge(train: DataFrame, test: DataFrame, cluster: str) -> DataFrame:
    """Training rows whose cluster no test row has; rows without a cluster stay."""
    return train.join(test.select(cluster).filter(F.col(cluster).isNotNull()).distinct(), cluster, "left_anti")


def straddling(rows: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups with rows both in training and held out, with how many of each."""
    counts = rows.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count_if(F.col(split) == "train").alias("n_train"), F.count_if(F.col(split) != "train").alias("n_held_out"))
    return counts.filter("n_train > 0 and n_held_out > 0")


def crossing(rows: DataFrame, group: str, split: str = "split") -> DataFrame:
    """One row: groups that straddle, and the rows that are in them."""
    return straddling(rows, group, split).agg(F.count("*").alias("n_groups"), F.coalesce(F.sum(F.col("n_train") + F.col("n_held_out")), F.lit(0)).alias("n_rows"))


def fill_clusters(members: DataFrame, cluster: str, fraction: float, seed: int) -> DataFrame:
    """Clusters in seeded order go to validation until it has its share of rows. Order and running sizes are over clusters."""
    from evidara.operators.ranking import running

    sizes = members.groupBy(cluster).agg(F.count("*").alias("n")).withColumn("__draw", hashing.bucket(F.col(cluster).cast("string"), seed))
    total = sizes.agg(F.sum("n").alias("__total"))
    run = running(sizes, [], "__draw", {"__upto": "n"}, ties=[F.asc(cluster)]).join(F.broadcast(total))
    side = F.when(F.col("__upto") - F.col("n") < F.col("__total") * fraction, "validation").otherwise("train")
    return members.join(run.select(cluster, side.alias("split")), cluster)


def stratified_group_folds(rows: DataFrame, group: str, label: str, folds: int, seed: int) -> DataFrame:
    """Groups dealt to folds so that both classes spread: groups of like label share, in seeded order, go round the folds.
    Order is kept within 64 bands of label share and each band starts at another fold."""
    stats = rows.groupBy(group).agg(F.avg(label).alias("__rate"), F.count("*").alias("__n"))
    band = F.coalesce(F.floor(F.col("__rate") * 63), F.lit(0))
    spot = F.row_number().over(Window.partitionBy("__band", F.pmod(F.xxhash64(group), F.lit(64))).orderBy(hashing.bucket(F.col(group).cast("string"), seed)))
    dealt = stats.withColumn("__band", band).withColumn("fold", F.pmod(spot + F.col("__band") + F.pmod(F.xxhash64(group), F.lit(64)), F.lit(folds)).cast("int"))
    return rows.join(dealt.select(group, "fold"), group)


def balanced(rows: DataFrame, group: str, label: str, seed: int, key: str) -> DataFrame:
    """In each group as many rows of each class as the smaller one has, seeded."""
    sizes = rows.groupBy(group, label).agg(F.count("*").alias("__n")).groupBy(group).agg(F.min("__n").alias("__least"), F.count("*").alias("__classes"))
    draw = hashing.bucket(F.col(key).cast("string"), seed)
    return capped(rows.join(sizes.filter("__classes > 1"), group), [group, label], F.col("__least"), draw).drop("__least", "__classes")


def capped(rows: DataFrame, groups: Sequence[str], most: Column, draw: Column) -> DataFrame:
    """At most ``most`` rows of each group: those of the smallest draw."""
    from evidara.operators.ranking import running

    run = running(rows.withColumns({"__draw": draw, "__one": F.lit(1)}), groups, "__draw", {"__place": "__one"})
    return run.filter(F.col("__place") <= most).drop("__draw", "__one", "__place")


def reserved(splits: Sequence[DataFrame], key: str = "variant_id", independent: DataFrame | None = None) -> DataFrame:
    """Distinct keys that any split holds out, and those of the independent set."""
    out = independent.select(key) if independent is not None else None
    for s in splits:
        held = s.filter("split != 'train'").select(key)
        out = held if out is None else out.union(held)
    return out.filter(F.col(key).isNotNull()).distinct()


def exclusions(documents: DataFrame, citations: DataFrame, held_out: DataFrame, publications: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Documents of held-out variants, and publications that they cite, in a table or in their text, or that are named."""
    docs = documents.join(held_out.select("variant_id"), "variant_id", "left_semi")
    cited = citations.join(docs.select("variation_id").distinct(), "variation_id", "left_semi").select(F.col("citation_id").alias("pmid"))
    named = docs.select(F.explode("text_pmids").alias("pmid"))
    out = cited.union(named)
    if publications:
        out = out.union(documents.sparkSession.createDataFrame([(p,) for p in publications], "pmid string"))
    return docs.select("document_id").distinct(), out.distinct()


def roles(split: Column, variant: Column, independent: Column) -> Column:
    """What a row may be used for; members of the independent set are test rows whatever their split is."""
    return F.when(independent, "independent_test").when(split == "train", "training").when(split == "validation", "development").otherwise("test")
