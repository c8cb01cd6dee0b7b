"""What a run has to say of itself: task policies, split manifests, provenance records, and the checks that hold data to them."""

from __future__ import annotations

import json
import platform
import time
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions import hashing
from evidara.functions.residues import AMINO_ACIDS
from evidara.operators import metrics, search
from evidara.operators.graph import _shared
from evidara.sources import sinks


@dataclass(frozen=True)
class TaskPolicy:
    """What a task's inputs must not say."""

    task: str
    mask_conclusions: bool = True
    mask_codes: bool = True
    forbidden: tuple[str, ...] = ("review_status", "stars", "number_submitters", "submitter")


#: The tasks, and those whose inputs keep their criteria codes.
TASKS = ("classify", "classify_from_codes", "acmg_codes", "evidence_type", "evidence_polarity", "vus_priority", "explanation", "pretraining")
KEEP_CODES = ("classify_from_codes", "pretraining")


def task_policy(task: str) -> TaskPolicy:
    if task not in TASKS:
        raise KeyError(f"{task} has no leakage policy; known: {TASKS}")
    return TaskPolicy(task, mask_codes=task not in KEEP_CODES)


def policy_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p.task, p.mask_conclusions, p.mask_codes, len(p.forbidden)) for p in map(task_policy, TASKS)], "task string, mask_conclusions boolean, mask_codes boolean, n_forbidden int")


def keep_policy(features: Sequence[str], task: str) -> list[str]:
    """The features, unless a policy forbids one of them."""
    if bad := [f for f in features if f in task_policy(task).forbidden]:
        raise ValueError(f"{task} forbids {bad}")
    return list(features)


# The 28 criteria, and those that are off for all genes and for the mismatch-repair genes.
CODES = tuple("PVS1 PS1 PS2 PS3 PS4 PM1 PM2 PM3 PM4 PM5 PM6 PP1 PP2 PP3 PP4 PP5 BA1 BS1 BS2 BS3 BS4 BP1 BP2 BP3 BP4 BP5 BP6 BP7".split())
OFF = {"*": ("PP5", "BP6"), "MLH1": ("PM1", "PP2", "BP1"), "MSH2": ("PM1", "PP2", "BP1"), "MSH6": ("PM1", "PP2", "BP1"), "PMS2": ("PM1", "PP2", "BP1")}


def applicable_codes(gene: Column, off: Mapping[str, Sequence[str]] = OFF) -> Column:
    """Codes that may be predicted for a gene."""
    lists = F.create_map(*[c for g, codes in off.items() for c in (F.lit(g), F.array(*[F.lit(x) for x in codes]))])
    own = F.coalesce(F.element_at(lists, F.upper(gene)), F.array().cast("array<string>"))
    return F.array_except(F.array_except(F.array(*[F.lit(c) for c in CODES]), F.element_at(lists, F.lit("*"))), own)


# Manifests


def dataset_digest(spark: SparkSession, path: str) -> str:
    """Digest over the names' order, sizes and contents of all files of a dataset; each file is digested where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    each = files.filter(~F.col("path").rlike(r"/[._][^/]*$")).select(F.substring_index("path", "/", -1).alias("name"), "length", F.sha2("content", 256).alias("d"))
    return each.select(F.concat_ws("\t", "d", "length").alias("k")).transform(lambda t: hashing.split_digest(t, "k")).first()["split_hash"]


def split_manifest(spark: SparkSession, path: str, dataset: str, seed: int, **groups: Sequence[str]) -> dict:
    """Writes which groups a split trains, validates, tests and holds out on, and the digest of the dataset it was made for."""
    sides = {side: sorted({g.upper() for g in names}) for side, names in groups.items()}
    every = [g for names in sides.values() for g in names]
    if twice := sorted({g for g in every if every.count(g) > 1}):
        raise ValueError(f"groups on two sides: {twice}")
    made = {"version": 1, "seed": seed, "groups": sides, "dataset": dataset, "dataset_digest": dataset_digest(spark, dataset), "created": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
    sinks.write_text(spark, path, json.dumps(made, indent=1, sort_keys=True))
    return made


def verify_dataset(spark: SparkSession, manifest: Mapping, dataset: str) -> None:
    if (found := dataset_digest(spark, dataset)) != manifest["dataset_digest"]:
        raise ValueError(f"{dataset} is not the split's dataset: {found} instead of {manifest['dataset_digest']}")


def leave_one_out_manifest(spark: SparkSession, path: str, groups: Iterable[str]) -> dict:
    names = [g.upper() for g in groups]
    made = {"strategy": "leave_one_group_out", "splits": [{"held_out": g, "train": [x for x in names if x != g]} for g in names]}
    sinks.write_text(spark, path, json.dumps(made, indent=1))
    return made


def provenance_record(spark: SparkSession, dataset: str, features: Iterable[str], held_out: DataFrame, key: str, sources: Sequence[str]) -> dict:
    import numpy
    import pyarrow

    return {
        "dataset_digest": dataset_digest(spark, dataset), "feature_schema": hashing.schema_hash(features), "split_hash": hashing.split_hash(held_out, key)[0], "sources": sorted(sources),
        "versions": {"spark": spark.version, "numpy": numpy.__version__, "pyarrow": pyarrow.__version__}, "platform": {"machine": platform.machine(), "system": platform.system(), "python": platform.python_version()},
    }


def policy_record(task: str) -> dict:
    return asdict(task_policy(task))


# Checks


def orientation(functional: DataFrame, anchor: str, assay: str = "assay", damage: str = "damage_score", least: int = 30, floor: float = 0.1) -> DataFrame:
    """Rank correlation of damage with an independent score, by assay: null under ``least`` rows that have both, and the query fails
    for an assay that is clearly the wrong way round."""
    rho = metrics.spearman(functional, [assay], damage, anchor)
    known = F.when(F.col("n") >= least, F.col("spearman"))
    good = F.when(F.coalesce(known, F.lit(0.0)) >= -floor, True).otherwise(F.raise_error(F.concat(F.lit("wrong direction: "), F.col(assay))).cast("boolean"))
    return rho.filter(good).select(assay, "n", known.alias("spearman"))


def slice_report(rows: DataFrame, label: str, scores: Sequence[str], inside: Column, name: str, threshold: float = 0.5) -> DataFrame:
    """AUC and the panel at a threshold of several scores on the rows of a slice."""
    long = rows.filter(inside & F.col(label).isNotNull()).select(F.col(label).alias("y"), *scores).unpivot(["y"], list(scores), "score", "p").filter("p is not null")
    counts = metrics.panel(metrics.confusion(long, ["score"], "y", F.col("p") >= threshold))
    auc = metrics.roc_auc(long, ["score"], "y", "p").select("score", "auc")
    return counts.join(auc, "score").select(F.lit(name).alias("slice"), "score", "n", "auc", "mcc", "precision", "recall")


def design_rows(rows: DataFrame, key: str) -> DataFrame:
    """One-hot design of substitutions as (key, column, value): 1 at the new residue of a position, -1 at the old one. Columns run
    over positions from 1 and the twenty residues in order of their letters."""
    letters = "".join(sorted(AMINO_ACIDS.values()))
    at = lambda c: ((F.col("position") - 1) * len(letters) + F.instr(F.lit(letters), F.col(c)) - 1).cast("long")
    pair = F.array(F.struct(at("mut_aa").alias("column"), F.lit(1.0).alias("value")), F.struct(at("wt_aa").alias("column"), F.lit(-1.0).alias("value")))
    return rows.select(key, F.explode(pair).alias("e")).select(key, "e.column", "e.value")


# Roles that an index used in training may hold.
INDEX_ROLES = ("TRAINING", "PRETRAINING", "KNOWLEDGE_BASE", "REFERENCE_ONLY", "UNKNOWN")
HELD_ROLES = ("TEST", "VALIDATION", "HOLDOUT")


def evidence_index(units: DataFrame, roles: DataFrame, for_training: bool = True) -> tuple[DataFrame, DataFrame]:
    """Units of evidence with their document's role, and their postings. A unit of a held-out document fails a training index."""
    kept = units.filter(F.col("sentence_role").isin("evidence", "code_list")).join(roles.select("document_id", "role"), "document_id", "left").withColumn("role", F.coalesce("role", F.lit("UNKNOWN")))
    if for_training:
        held = F.when(F.col("role").isin(*HELD_ROLES), F.raise_error(F.concat(F.lit("held-out unit: "), "evidence_id")).cast("boolean")).otherwise(F.col("role").isin(*INDEX_ROLES))
        kept = kept.filter(held)
    kept = _shared(kept)
    return kept, search.postings(search.tokenised(kept, "evidence_id", "text_span"), "evidence_id")
