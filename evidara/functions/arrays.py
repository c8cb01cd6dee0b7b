"""Vectors of probabilities, votes and embeddings as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    raised = F.transform(logits, lambda x: F.exp(x.cast("double") - top))
    return F.transform(raised, lambda x: x / total(raised))


def entropy(shares: Column) -> Column:
    return -F.aggregate(shares, F.lit(0.0), lambda a, p: a + F.when(p > 0, p.cast("double") * F.log(p.cast("double"))).otherwise(0.0))


def margin(shares: Column) -> Column:
    """The largest share less the second."""
    low_first = F.array_sort(shares)
    return F.element_at(low_first, -1) - F.element_at(low_first, -2)


def mean_vector(samples: Column) -> Column:
    """Mean of an array of vectors of one length."""
    n = F.size(samples)
    summed = F.aggregate(F.slice(samples, 2, 1 << 30), F.get(samples, F.lit(0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.transform(summed, lambda x: x / n)


def mutual_information(samples: Column) -> Column:
    """Entropy of the mean less the mean entropy."""
    return entropy(mean_vector(samples)) - total(F.transform(samples, entropy)) / F.size(samples)


def argmax(shares: Column) -> Column:
    """Position from 0 of the first largest share."""
    return F.array_position(shares, F.array_max(shares)).cast("int") - 1


def one_hot_brier(shares: Column, label: Column) -> Column:
    """Squared distance from the vector that is 1 at ``label``, counted from 0."""
    return F.aggregate(F.transform(shares, lambda p, i: F.pow(p - (i == label).cast("double"), F.lit(2))), F.lit(0.0), lambda a, x: a + x)


def multi_hot(codes: Column, vocabulary: list[str]) -> Column:
    return F.transform(F.array(*[F.lit(v) for v in vocabulary]), lambda v: F.coalesce(F.array_contains(codes, v), F.lit(False)).cast("int"))


def reasons(**checks: Column) -> Column:
    """Names of the checks that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))


def abstain(shares: Column, least: float = 0.5, information: Column | None = None, most: float | None = None, evidence: Column | None = None) -> Column:
    """Why a prediction should be withheld; empty if it should not."""
    checks = {"low_confidence": F.array_max(shares) < least}
    if information is not None and most is not None:
        checks["high_disagreement"] = information > most
    if evidence is not None:
        checks["no_evidence"] = F.coalesce(evidence, F.lit(0)) == 0
    return reasons(**checks)


def keywords_match(text: Column, groups: Column) -> Column:
    """Every group of alternatives has one that the text contains, in any case."""
    low = F.lower(text)
    return F.forall(groups, lambda g: F.exists(g, lambda k: low.contains(F.lower(k))))
