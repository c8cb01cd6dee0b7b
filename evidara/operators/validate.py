"""Validation of tables: cascades with drop counts, keys, cardinalities, shares, schemas. Every check is one aggregate."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions.residues import LETTERS, wild_type_fits


def no_nan(rows: DataFrame) -> DataFrame:
    """NaN becomes null in all floating columns, so that missing means one thing."""
    return rows.select([F.when(~F.isnan(F.col(f"`{n}`")), F.col(f"`{n}`")).alias(n) if t in ("double", "float") else F.col(f"`{n}`") for n, t in rows.dtypes])


def cascade(rows: DataFrame, rules: Mapping[str, Column], reason: str = "reason") -> DataFrame:
    """Adds the name of the first rule that a row fails, null where it passes all; a null outcome fails."""
    out = F.lit(None).cast("string")
    for name, good in reversed(rules.items()):
        out = F.when(F.coalesce(good, F.lit(False)), out).otherwise(F.lit(name))
    return rows.withColumn(reason, out)


def drop_counts(checked: DataFrame, rules: Iterable[str], reason: str = "reason") -> DataFrame:
    """One row: kept, and how many rows each rule dropped."""
    return checked.agg(F.count_if(F.col(reason).isNull()).alias("kept"), *[F.count_if(F.col(reason) == r).alias(r) for r in rules])


def substitution_rules(sequence: Column | None = None) -> dict[str, Column]:
    """Rules of a record of one substitution: residues, position, change, and the sequence's own residue if it is given."""
    residue = f"^[{LETTERS}]$"
    rules = {
        "residue": F.col("wt_aa").rlike(residue) & F.col("mut_aa").rlike(residue),
        "position": F.col("position") >= 1,
        "synonymous": F.col("wt_aa") != F.col("mut_aa"),
    }
    if sequence is not None:
        rules["sequence"] = sequence.isNull() | wild_type_fits(sequence, F.col("position"), F.col("wt_aa"))
    return rules


def valid_records(rows: DataFrame, sequences: DataFrame | None = None) -> DataFrame:
    """Records with their drop reason; ``sequences`` (uniprot_id, sequence) are joined where given."""
    if sequences is not None:
        rows = rows.join(sequences.select("uniprot_id", F.col("sequence").alias("__sequence")), "uniprot_id", "left")
        return cascade(rows, substitution_rules(F.col("__sequence"))).drop("__sequence")
    return cascade(rows, substitution_rules())


def normalise_keys(rows: DataFrame) -> DataFrame:
    """Keys of one type and spelling: position as a whole number (``10.0`` too), residues trimmed and in capitals."""
    whole = F.col("position").cast("string").try_cast("double")
    rows = rows.withColumn("position", F.when(whole == F.floor(whole), whole.cast("bigint")))
    return rows.withColumns({c: F.upper(F.trim(c)) for c in ("wt_aa", "mut_aa") if c in rows.columns})


def require(rows: DataFrame, good: Column, message: str) -> DataFrame:
    """The rows, failing the query at the first for which ``good`` is not true."""
    return rows.filter(F.when(F.coalesce(good, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def duplicate_keys(rows: DataFrame, keys: Sequence[str], limit: int = 20) -> DataFrame:
    """The most frequent keys of several rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1").orderBy(F.desc("n_rows"), *keys).limit(limit)


def cardinality(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row: duplicate keys on either side, and the kind of join that makes."""
    twice = lambda t, name: t.groupBy(*on).agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias(name))
    both = twice(left, "left_duplicates").join(twice(right, "right_duplicates"))  # one row each
    l, r = F.col("left_duplicates") > 0, F.col("right_duplicates") > 0
    return both.withColumn("kind", F.when(l & r, "many_to_many").when(l, "many_to_one").when(r, "one_to_many").otherwise("one_to_one"))


def key_difference(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row: distinct keys of both sides, of the left alone and of the right alone. One aggregate over the union of keys."""
    sided = left.select(*on, F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select(*on, F.lit(0), F.lit(1)))
    each = sided.groupBy(*on).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return each.agg(F.count_if(F.expr("l = 1 and r = 1")).alias("in_both"), F.count_if(F.expr("l = 1 and r = 0")).alias("left_only"), F.count_if(F.expr("l = 0 and r = 1")).alias("right_only"))


def missing_shares(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each column: its share of nulls."""
    shares = rows.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return shares.unpivot([], list(columns), "column", "missing_share")


def class_shares(rows: DataFrame, label: str) -> DataFrame:
    """Share of each class among labelled rows."""
    counts = rows.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))
    return counts.join(F.broadcast(total)).select(label, "n", (F.col("n") / F.col("__total")).alias("share"))  # total is one row


def violations(rows: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """One row for each check: how many rows break it (null counts as broken), in one pass."""
    counts = rows.agg(*[F.count_if(~F.coalesce(good, F.lit(False))).alias(name) for name, good in checks.items()])
    return counts.unpivot([], list(checks), "check", "n_violations")


def groups_absent(rows: DataFrame, column: str, expected: DataFrame) -> DataFrame:
    """Expected groups (in a column of the same name) that no row has."""
    return expected.select(column).distinct().join(rows.select(column).distinct(), column, "left_anti")


def schema_problems(rows: DataFrame, expected: Mapping[str, str]) -> list[str]:
    """Messages for columns that are absent or of another type."""
    have = dict(rows.dtypes)
    return [f"{c}: absent" if c not in have else f"{c}: {have[c]} instead of {t}" for c, t in expected.items() if have.get(c) != t]


def gene_constant_columns(rows: DataFrame, columns: Sequence[str], group: str, tolerance: float = 1e-12) -> DataFrame:
    """One row for each column: whether it is constant within every group."""
    spans = rows.groupBy(group).agg(*[(F.max(c) - F.min(c)).alias(c) for c in columns])
    widest = spans.agg(*[F.coalesce(F.max(c), F.lit(0.0)).cast("double").alias(c) for c in columns])
    return widest.unpivot([], list(columns), "column", "widest").withColumn("constant", F.col("widest") <= tolerance)


def offsets_fit(units: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: units whose span is not the document's text at their offsets."""
    joined = units.join(documents.select("document_id", "text"), "document_id", "left")
    same = F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) == F.col("text_span")
    return joined.agg(F.count_if(~F.coalesce(same, F.lit(False))).alias("n_bad"))


def all_of(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)


# Families of feature columns, by a word in their name; the first that fits counts.
FAMILIES = (("label", ("label",)), ("frequency", ("gnomad", "af", "acmg")), ("prior", ("score", "pllr", "alphamissense")), ("structure", ("plddt", "sasa", "contact")), ("domain", ("domain", "site")))


def family_of(column: str) -> str | None:
    words = column.lower().split("_")
    return next((name for name, keys in FAMILIES if any(k in words or k in column.lower() and len(k) > 3 for k in keys)), None)


def without_families(columns: Sequence[str], dropped: Sequence[str], proxies: Mapping[str, str] | None = None) -> list[str]:
    """Columns left after an ablation; refuses to leave a proxy (column: family it stands for) of a dropped family."""
    left = [c for c in columns if family_of(c) not in dropped]
    if kept := [c for c in left if (proxies or {}).get(c) in dropped]:
        raise ValueError(f"proxies of dropped families remain: {kept}")
    return left


def check_forbidden(names: Iterable[str], words: Sequence[str] = ("label", "classification", "significance")) -> None:
    """Feature names that describe the label are refused."""
    if bad := [n for n in names if any(w in n.lower() for w in words)]:
        raise ValueError(f"features that describe the label: {bad}")


def align_columns(available: Sequence[str], wanted: Sequence[str]) -> list[str]:
    """The wanted columns in their order; those that are absent are named in the error."""
    if absent := [c for c in wanted if c not in available]:
        raise ValueError(f"absent columns: {absent}")
    return list(wanted)
