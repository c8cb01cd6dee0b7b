"""Protein and coding changes as column expressions: parsing, rendering and keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Three-letter and one-letter residue names, and the two rare residues that are only rendered.
AMINO_ACIDS = {
    "Ala": "A", "Arg": "R", "Asn": "N", "Asp": "D", "Cys": "C", "Gln": "Q", "Glu": "E", "Gly": "G", "His": "H", "Ile": "I",
    "Leu": "L", "Lys": "K", "Met": "M", "Phe": "F", "Pro": "P", "Ser": "S", "Thr": "T", "Trp": "W", "Tyr": "Y", "Val": "V",
}
RARE = {"Sec": "U", "Pyl": "O"}
LETTERS = "".join(sorted(AMINO_ACIDS.values()))

CHANGE = "struct<wt_aa:string,position:bigint,mut_aa:string>"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def one_letter(name: Column) -> Column:
    """Residue letter of a three-letter name in any case; null for others."""
    return _lookup({k.lower(): v for k, v in AMINO_ACIDS.items()}, F.lower(name))


def three_letter(letter: Column) -> Column:
    return _lookup({v: k for k, v in (AMINO_ACIDS | RARE).items()}, F.upper(letter))


def _part(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def _change(wt: Column, position: Column, mut: Column) -> Column:
    """A substitution, null unless both residues are known and differ."""
    at = position.try_cast("bigint")
    good = wt.isNotNull() & mut.isNotNull() & at.isNotNull() & (wt != mut)
    return F.when(good, F.struct(wt.alias("wt_aa"), at.alias("position"), mut.alias("mut_aa")))


def three_letter_change(text: Column, anchored: bool = False) -> Column:
    """``p.Gly67Arg`` or ``p.(Gly67Arg)``, anywhere in the text or as all of it. A lower-case letter behind the second residue
    (frame shifts, extensions) makes it no substitution."""
    body = r"p\.\(?([A-Z][a-z]{2})(\d+)([A-Z][a-z]{2})"
    pattern = rf"^{body}\)?$" if anchored else rf"{body}(?![a-z])"
    return _change(one_letter(_part(text, pattern, 1)), _part(text, pattern, 2), one_letter(_part(text, pattern, 3)))


def one_letter_change(text: Column, prefix: str = "") -> Column:
    """``G67R``, or ``p.G67R`` with ``prefix``; residues must be of the twenty."""
    pattern = rf"^{prefix}([{LETTERS}])(\d+)([{LETTERS}])$"
    return _change(_part(text, pattern, 1), _part(text, pattern, 2), _part(text, pattern, 3))


def protein_substitution(protein_change: Column, name: Column) -> Column:
    """The one-letter column first, then the three-letter form in the full name."""
    return F.coalesce(one_letter_change(F.trim(protein_change)), three_letter_change(name))


def normalized_change(text: Column) -> Column:
    """Three- and one-letter forms with or without ``p.`` and brackets."""
    bare = F.regexp_replace(F.trim(text), r"^p\.|[()]", "")
    return F.coalesce(three_letter_change(F.concat(F.lit("p."), bare), anchored=True), one_letter_change(bare))


def mutant_tokens(text: Column) -> Column:
    """``A2V:Q4L`` as an array of changes, each null where its token is none."""
    return F.transform(F.split(text, ":"), lambda x: one_letter_change(x))


def variant_name(name: Column) -> Column:
    """``NM_000249.4(MLH1):c.199G>A (p.Gly67Arg)`` as transcript, gene, change and protein; parts that are absent are null."""
    pattern = r"^([A-Z]{2}_\d+(?:\.\d+)?)(?:\(([^)]+)\))?:([cgnm]\.[^\s(]+)(?:\s+\((p\.[^)]*\)?)\))?"
    text = F.trim(name)
    protein = F.coalesce(_part(text, pattern, 4), _part(text, r"\((p\.[^)]+)\)", 1))
    return F.struct(_part(text, pattern, 1).alias("transcript"), _part(text, pattern, 2).alias("gene"), _part(text, pattern, 3).alias("change"), protein.alias("protein"))


def coding_snv(text: Column) -> Column:
    """``c.199G>A`` as position, ref and alt."""
    pattern = r"^c\.(\d+)([ACGT])>([ACGT])$"
    at = _part(text, pattern, 1).try_cast("bigint")
    return F.when(at.isNotNull(), F.struct(at.alias("position"), _part(text, pattern, 2).alias("ref"), _part(text, pattern, 3).alias("alt")))


def codon_of(position: Column) -> Column:
    """Codon that a coding position lies in."""
    return F.floor((position - 1) / 3).cast("bigint") + 1


def hgvs_consistency(coding: Column, position: Column) -> Column:
    """Whether a coding change lies in the codon of the protein position."""
    found = coding_snv(coding)["position"]
    return F.when(found.isNull() | position.isNull(), "unknown").when(codon_of(found) == position, "consistent").otherwise("inconsistent")


def transcript_status(gene: Column, transcript: Column, chosen: dict[str, str]) -> Column:
    """mane, mane_version_mismatch, non_mane or unknown, against the chosen transcript of each gene."""
    want = _lookup(chosen, gene) if chosen else F.lit(None).cast("string")
    bare = lambda c: F.element_at(F.split(c, r"\."), 1)
    return (
        F.when(transcript.isNull() | (transcript == "") | want.isNull(), "unknown")
        .when(transcript == want, "mane")
        .when(bare(transcript) == bare(want), "mane_version_mismatch")
        .otherwise("non_mane")
    )


def format_change(wt: Column, position: Column, mut: Column) -> Column:
    """``p.Gly67Arg``; a residue without a three-letter name is written as it is, so the result is null only for null parts."""
    return F.concat(F.lit("p."), F.coalesce(three_letter(wt), wt), position.cast("bigint").cast("string"), F.coalesce(three_letter(mut), mut))


def variant_id(accession: Column, position: Column, wt: Column, mut: Column) -> Column:
    return F.concat(accession, F.lit(":"), position.cast("bigint").cast("string"), F.lit(":"), wt, F.lit(">"), mut)


def parse_variant_id(text: Column) -> Column:
    pattern = r"^([^:]+):(\d+):([^>]+)>(.+)$"
    return F.struct(
        _part(text, pattern, 1).alias("uniprot_id"), _part(text, pattern, 2).try_cast("bigint").alias("position"),
        _part(text, pattern, 3).alias("wt_aa"), _part(text, pattern, 4).alias("mut_aa"),
    )


def group_key(accession: Column, position: Column) -> Column:
    """All changes of one residue share a key."""
    return F.concat_ws(":", accession, position.cast("bigint").cast("string"))


def genomic_key(chromosome: Column, position: Column, ref: Column, alt: Column, assembly: str = "GRCh38") -> Column:
    """``GRCh38:2:47410107:G:A``, null unless every part is there."""
    parts = [chromosome, position.cast("string"), ref, alt]
    present = reduce(lambda a, b: a & b, [p.isNotNull() & ~F.lower(F.trim(p)).isin("", "-", "na", "nan", "none", "-1") for p in parts])
    return F.when(present, F.concat_ws(":", F.lit(assembly), *parts))


def wild_type_fits(sequence: Column, position: Column, wt: Column) -> Column:
    """Whether the residue at a position from 1 is the stated one; false outside the sequence."""
    inside = (position >= 1) & (position <= F.length(sequence))
    return F.coalesce(inside & (F.substring(sequence, position.cast("int"), F.lit(1)) == wt), F.lit(False))


def window(sequence: Column, position: Column, radius: int = 3, pad: str = "-") -> Column:
    """The residues within ``radius`` of a position, padded beyond the ends."""
    padded = F.concat(F.lit(pad * radius), sequence, F.lit(pad * radius))
    return F.substring(padded, position.cast("int"), F.lit(2 * radius + 1))


def local_windows(sequence: Column, position: Column, mut: Column, radius: int = 3, pad: str = "-") -> Column:
    """Both windows around a position: as it is, and with the other residue in the middle."""
    wild = window(sequence, position, radius, pad)
    return F.struct(wild.alias("wild"), F.overlay(wild, mut, radius + 1, 1).alias("mutated"))


def centered_span(length: Column, at: Column, size: int) -> Column:
    """A window of ``size`` around a position from 0, moved inside the chain; the whole chain where that is shorter."""
    start = F.greatest(F.lit(0), F.least(at - size // 2, length - size))
    return F.struct(start.alias("start"), F.least(length, start + size).alias("end"))


def asymmetric_span(length: Column, at: Column, size: int) -> Column:
    """The window at the nearer end of the chain if it holds the position, else the centred one."""
    centred = centered_span(length, at, size)
    head, tail = F.struct(F.lit(0).cast("long").alias("start"), F.least(length, F.lit(size)).cast("long").alias("end")), F.struct(F.greatest(F.lit(0), length - size).cast("long").alias("start"), length.cast("long").alias("end"))
    wide = F.struct(centred["start"].cast("long").alias("start"), centred["end"].cast("long").alias("end"))
    return F.when((at < size) & (at <= length - 1 - at), head).when((at >= length - size) & (at > length - 1 - at), tail).otherwise(wide)


def sliding_spans(length: Column, size: int = 1022, overlap: int = 256) -> Column:
    """Overlapping windows over a chain; the last one ends with it."""
    step = size - overlap
    starts = F.when(length <= size, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), (F.ceil((length - size) / step) * step).cast("long"), F.lit(step).cast("long")))
    return F.transform(starts, lambda s: F.struct(F.least(s, F.greatest(length.cast("long") - size, F.lit(0))).alias("start"), F.least(length.cast("long"), s + size).alias("end")))


# Variant types that are not changes of a sequence.
CNV_TYPES = ("copy number loss", "copy number gain", "deletion (cnv)")
STRUCTURAL_TYPES = ("inversion", "translocation", "complex", "fusion", "tandem duplication", "variation")


def consequence(kind: Column, name: Column, length: Column) -> Column:
    """Coarse consequence class of a variant from its type, its name and its length."""
    kind, parsed = F.lower(F.trim(F.coalesce(kind, F.lit("")))), variant_name(name)
    protein, change = F.coalesce(parsed["protein"], F.lit("")), F.coalesce(parsed["change"], F.lit(""))
    residue = r"[A-Z][a-z]{2}"
    utr = F.when(change.rlike(r"^[cn]\.-"), "utr5_or_upstream").when(change.rlike(r"^[cn]\.\*"), "utr3_or_downstream")
    offset = F.abs(_part(change, r"^[cn]\.[-*]?\d+([+-]\d+)", 1).try_cast("int"))
    near = F.when(offset <= 2, "splice_site").when(offset <= 8, "splice_region").when(offset.isNotNull(), "intronic")
    coding = F.coalesce(utr, near)
    by_protein = (
        F.when(protein.rlike(r"^p\.\(?Met1(?!\d)"), "start_loss")
        .when(protein.rlike(rf"^p\.\(?(?:Ter|\*)\d+{residue}"), "stop_loss")
        .when(protein.rlike(r"fs"), "frameshift")
        .when(protein.rlike(rf"^p\.\(?{residue}\d+(?:Ter|\*)"), "nonsense")
        .when(protein.rlike(rf"^p\.\(?(?:{residue}\d+)?="), "synonymous")
        .when(protein.rlike(rf"^p\.\(?({residue})\d+\1\)?$"), "synonymous")
        .when(protein.rlike(rf"^p\.\(?{residue}\d+{residue}\)?$"), "missense")
        .when(protein.rlike(r"del|ins|dup"), "inframe_indel")
    )
    return (
        F.when(kind.isin(*CNV_TYPES), "cnv")
        .when(kind.isin(*STRUCTURAL_TYPES), "structural")
        .when((length > 1000) & kind.isin("deletion", "duplication"), "cnv")
        .when(length > 1000, "structural")
        .when(change.startswith("n."), F.when(near.isin("splice_site", "splice_region"), near).otherwise("noncoding_transcript"))
        .when(by_protein.isNotNull(), by_protein)
        .when(change.startswith("c.") & coding.isNotNull(), coding)
        .otherwise("other")
    )


def normalised_cdna(text: Column) -> Column:
    """``C.199g>a`` as ``c.199G>A``: the prefix and words in lower case, bases in upper case."""
    low = F.lower(F.regexp_replace(text, r"\s+", ""))
    base = F.translate(F.substring(low, 3, 10000), "acgt", "ACGT")
    words = reduce(lambda c, w: F.replace(c, F.lit("".join(x.upper() if x in "acgt" else x for x in w)), F.lit(w)), ["del", "dup", "ins", "inv"], base)
    return F.concat(F.substring(low, 1, 2), words)


def short_protein(text: Column) -> Column:
    """``p.Gly67Arg`` as ``G67R``, a stop as ``*``."""
    pattern = r"^p\.\(?([A-Z][a-z]{2})(\d+)([A-Z][a-z]{2}|\*|=)\)?$"
    wt, mut = one_letter(_part(text, pattern, 1)), _part(text, pattern, 3)
    last = F.when((mut == "Ter") | (mut == "*"), "*").when(mut == "=", wt).otherwise(one_letter(mut))
    return F.concat(wt, _part(text, pattern, 2), last)
