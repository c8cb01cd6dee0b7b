"""Sources by name, with what each provides."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from evidara.sources import delimited, nested


@dataclass(frozen=True)
class Source:
    name: str
    load: Callable[[SparkSession, str], DataFrame]
    columns: tuple[str, ...]
    label_precedence: int | None = None
    licence: str = ""


SOURCES = {
    s.name: s
    for s in (
        Source("clinvar", delimited.variant_summary, ("variation_id", "gene", "significance", "stars"), 1, "public domain"),
        Source("clinvar_submissions", delimited.submissions, ("document_id", "variation_id", "text"), None, "public domain"),
        Source("gnomad", nested.population_variants, ("gene", "position", "af"), None, "cc0"),
        Source("cimra", delimited.odds_table, ("gene", "position", "oddspath"), 3),
        Source("pubmed", nested.abstracts, ("pmid", "title", "abstract")),
        Source("mondo", nested.ontology_terms, ("document_id", "title", "text"), None, "cc-by"),
    )
}


def load(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name not in SOURCES:
        raise KeyError(f"unknown source {name}; known: {sorted(SOURCES)}")
    rows = SOURCES[name].load(spark, path)
    if absent := set(SOURCES[name].columns) - set(rows.columns):
        raise ValueError(f"{name} lacks {sorted(absent)}")
    return rows
