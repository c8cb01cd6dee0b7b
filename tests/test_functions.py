import math

import pytest
from pyspark.sql import functions as F

from evidara.functions import arrays, clinical, passages, residues, verdicts
from evidara.functions import text as T


def one(spark, column, **values):
    rows = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    v = rows.select(column.alias("v")).first().v
    return v.asDict(recursive=True) if hasattr(v, "asDict") else v


@pytest.mark.parametrize("text,want", [("p.Gly67Arg", ("G", 67, "R")), ("p.(Gly67Arg)", ("G", 67, "R")), ("p.Lys5AlafsTer10", None), ("p.Gly67Gly", None), ("p.Gly67Xyz", None), (None, None), ("", None)])
def test_three_letter_changes(spark, text, want):
    got = one(spark, residues.three_letter_change(F.lit(text).cast("string")))
    assert (tuple(got.values()) if got else None) == want


def test_changes_and_names(spark):
    assert one(spark, residues.one_letter_change(F.lit("A119D"))) == {"wt_aa": "A", "position": 119, "mut_aa": "D"}
    assert one(spark, residues.one_letter_change(F.lit("A2X"))) is None and one(spark, residues.one_letter_change(F.lit("A2A"))) is None
    assert one(spark, residues.normalized_change(F.lit("G67R"))) == one(spark, residues.normalized_change(F.lit("p.(Gly67Arg)")))
    tokens = one(spark, residues.mutant_tokens(F.lit("A2V:Q4L")))
    assert [t["position"] for t in tokens] == [2, 4]
    name = one(spark, residues.variant_name(F.lit("NM_000249.4(MLH1):c.199G>A (p.Gly67Arg)")))
    assert name == {"transcript": "NM_000249.4", "gene": "MLH1", "change": "c.199G>A", "protein": "p.Gly67Arg"}
    assert one(spark, residues.coding_snv(F.lit("c.199G>A"))) == {"position": 199, "ref": "G", "alt": "A"}
    assert [one(spark, residues.codon_of(F.lit(i))) for i in (1, 3, 4)] == [1, 1, 2]
    assert one(spark, residues.format_change(F.lit("G"), F.lit(67), F.lit("U"))) == "p.Gly67Sec"
    assert one(spark, residues.parse_variant_id(residues.variant_id(F.lit("P1"), F.lit(5), F.lit("A"), F.lit("C")))) == {"uniprot_id": "P1", "position": 5, "wt_aa": "A", "mut_aa": "C"}
    assert one(spark, residues.genomic_key(F.lit("2"), F.lit(7), F.lit("-"), F.lit("A"))) is None
    assert one(spark, residues.local_windows(F.lit("ACDEF"), F.lit(1), F.lit("W"))) == {"wild": "---ACDE", "mutated": "---WCDE"}
    assert one(spark, residues.short_protein(F.lit("p.Gly67Ter"))) == "G67*"
    assert one(spark, residues.normalised_cdna(F.lit("C.199g>a"))) == "c.199G>A" and one(spark, residues.normalised_cdna(F.lit("c.1_2delag"))) == "c.1_2delAG"
    assert [tuple(s) for s in one(spark, residues.sliding_spans(F.lit(25), 10, 4))] == [(0, 10), (6, 16), (12, 22), (15, 25)]
    assert [tuple(s) for s in one(spark, residues.sliding_spans(F.lit(8), 10, 4))] == [(0, 8)]
    assert one(spark, residues.centered_span(F.lit(30), F.lit(29), 10)) == {"start": 20, "end": 30}
    assert one(spark, residues.transcript_status(F.lit("A"), F.lit("NM_1.2"), {"A": "NM_1.3"})) == "mane_version_mismatch"


@pytest.mark.parametrize(
    "kind,name,length,want",
    [
        ("single nucleotide variant", "NM_1.1(A):c.4G>A (p.Gly2Arg)", 1, "missense"),
        ("single nucleotide variant", "NM_1.1(A):c.4G>A (p.Gly2Ter)", 1, "nonsense"),
        ("single nucleotide variant", "NM_1.1(A):c.4G>A (p.Gly2=)", 1, "synonymous"),
        ("Deletion", "NM_1.1(A):c.4del (p.Gly2fs)", 1, "frameshift"),
        ("single nucleotide variant", "NM_1.1(A):c.1A>G (p.Met1Val)", 1, "start_loss"),
        ("single nucleotide variant", "NM_1.1(A):c.10+1G>A", 1, "splice_site"),
        ("single nucleotide variant", "NM_1.1(A):c.10-7G>A", 1, "splice_region"),
        ("single nucleotide variant", "NM_1.1(A):c.10-70G>A", 1, "intronic"),
        ("single nucleotide variant", "NM_1.1(A):c.-7G>A", 1, "utr5_or_upstream"),
        ("Deletion", "x", 5000, "cnv"),
        ("Inversion", "x", 5, "structural"),
        ("Deletion", "NM_1.1(A):c.4_6del (p.Gly2del)", 3, "inframe_indel"),
    ],
)
def test_consequences(spark, kind, name, length, want):
    assert one(spark, residues.consequence(F.lit(kind), F.lit(name), F.lit(length))) == want


def test_clinical_rules(spark):
    classify = lambda t, s=2: one(spark, clinical.classify_significance(F.lit(t).cast("string"), F.lit(s)))
    assert classify("Pathogenic/Likely pathogenic") == {"kind": "labelled", "label": 1.0} and classify("Pathogenic", 0) is None
    assert classify("Uncertain significance", 0)["kind"] == "vus" and classify("Conflicting interpretations") is None and classify("Pathogenic|drug response") is None and classify(None) is None
    assert one(spark, clinical.stars(F.lit("Reviewed by expert panel"))) == 3 and one(spark, clinical.stars(F.lit("criteria provided, conflicting classifications"), 1)) == 1
    ids = one(spark, clinical.condition_ids(F.lit("MONDO:MONDO:1,MedGen:C1|OMIM:5|-|MONDO:MONDO:2")))
    assert ids == ["MedGen:C1", "OMIM:5", "MONDO:2"]
    found = one(spark, clinical.reported_phenotypes(F.lit("C0009405:Lynch syndrome;other; -")))
    assert found == {"ids": ["MedGen:C0009405"], "names": ["Lynch syndrome", "other"]}
    assert [one(spark, clinical.iso_date(F.lit(t))) for t in ("Dec 17, 2024", "2024-12-17", "20241217", "2024", "-")] == ["2024-12-17"] * 3 + ["2024-01-01", None]
    assert one(spark, clinical.frequency_flags(F.lit(None).cast("double"))) == {"ba1": 0, "bs1": 0, "pm2": 1, "log10_af": -7.0, "observed": 0}
    assert [one(spark, clinical.odds_strength(F.lit(v))) for v in (400.0, 1.0, 0.4, 0.001, math.nan)] == ["PS3_very_strong", "indeterminate", "BS3_supporting", "BS3_very_strong", "indeterminate"]
    assert one(spark, clinical.tier(F.lit("clinvar"), F.lit("criteria provided, single submitter"), F.lit("clinical testing"), F.lit("x" * 50))) == 2
    assert one(spark, clinical.licence_code(F.lit("CC BY-NC 4.0"))) == "cc-by-nc" and one(spark, clinical.licence_code(F.lit("CC0"))) == "cc0"


def test_text_functions(spark):
    assert one(spark, T.tokens(F.lit("The c.199G>A variant every 2 yrs"))) == ["c.199g>a", "199g", "variant", "every", "2", "years"]
    assert one(spark, T.exact_group(F.lit(" A  b"))) == one(spark, T.exact_group(F.lit("a B\n")))
    assert one(spark, T.jaccard(T.shingles(F.lit("a b c d e f")), T.shingles(F.lit("a b c d e f")))) == 1.0 and one(spark, F.size(T.shingles(F.lit(None).cast("string")))) == 0
    m = one(spark, T.mentions(F.lit("Is MLH1 c.199G>A p.Gly67Arg rs63750217 bad?"), ["MLH1"]))
    assert m == {"genes": ["MLH1"], "cdna": ["c.199G>A"], "protein": ["p.Gly67Arg"], "rsid": ["rs63750217"]}
    assert one(spark, T.clean_markup(F.lit("<p>a &lt; b</p><script>x</script> c"))) == "a < b c"
    assert one(spark, T.cell_parts(F.lit("train-a__x__gbm__seed42"))) == {"arm": "train-a__x", "model": "gbm", "seed": 42}
    assert one(spark, T.codes_list(F.lit("PM2_supporting, pvs1; PM2_supporting"))) == ["PM2_Supporting", "PVS1"]
    assert one(spark, T.residual_assertions(F.lit("It is likely pathogenic."))) and not one(spark, T.residual_assertions(F.lit("No effect.")))
    assert T.model_column("ESM-1v (ens)") == "zs_esm_1v_ens"


def test_arrays(spark):
    shares = F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3))
    assert one(spark, arrays.entropy(shares)) == pytest.approx(-sum(p * math.log(p) for p in (0.2, 0.5, 0.3)))
    assert one(spark, arrays.margin(shares)) == pytest.approx(0.2) and one(spark, arrays.argmax(shares)) == 1
    assert sum(one(spark, arrays.softmax(shares))) == pytest.approx(1) and one(spark, arrays.multi_hot(F.array(F.lit("b")), ["a", "b"])) == [0, 1]
    assert one(spark, arrays.keywords_match(F.lit("Colon cancer"), F.array(F.array(F.lit("colon"), F.lit("x")), F.array(F.lit("CANCER")))))


def test_sentences_and_masking():
    text = "Seen in 2 cases, e.g. Smith et al. found it. Then lost. This variant was classified as likely pathogenic. Other variants at this residue are classified as pathogenic."
    parts = passages.split_sentences(text)
    assert all(text[a:b] == s for a, b, s in parts) and len(parts) == 4
    left, n, gone = passages.mask_conclusions(text)
    assert n == 4 and gone == ["classification_statement"] and "likely pathogenic" not in left and "Other variants" in left
    assert verdicts.category("Classified as pathogenic by other laboratories.") == "external_classification"
    assert verdicts.category("REVEL score: benign") is None and verdicts.category("Classification: Pathogenic") == "heading"
    codes = passages.find_codes("Criteria: PM2_Supporting met; PS3 not met.")
    assert [(c, s, m) for c, s, *_, m in codes] == [("PM2", "supporting", True), ("PS3", None, False)]
    assert passages.mask_codes("Applied (PM2, PP3) here.") == ("Applied here.", 2)
    assert passages.check_citations("The gene repairs DNA errors. [1] It also binds other proteins [9].", 3) == (2, 1, [9])
    assert passages.polarity("damaging and rare") == "pathogenic" and passages.polarity("tolerated, benign") == "benign"
    verdict = [
        "Therefore, this variant is classified as pathogenic.", "Based on the evidence above, the variant was classified as likely pathogenic.",
        "We classify this variant as a variant of uncertain significance.", "This variant is likely benign.", "It was reclassified from VUS to likely benign.",
        "In summary, the available evidence is currently insufficient to determine the role of this variant in disease.",
        "This variant meets ACMG criteria to be classified as likely pathogenic.", "Final interpretation - Benign", "Likely benign", "Result > pathogenic",
        "The clinical significance of this variant is currently unknown.", "Taken together, the data support a benign role.",
    ]
    assert all(verdicts.category(v) for v in verdict)
    evidence = [
        "The variant was absent from population databases.", "It was observed in trans with a pathogenic variant in a patient.", "Pathogenic variants in MLH1 cause Lynch syndrome.",
        "In silico tools predict a benign effect on protein function.", "Other missense changes at this residue have been reported as pathogenic.",
        "The evidence was reviewed.", "CADD score: benign", "",
    ]
    assert not any(verdicts.category(e) for e in evidence)
    assert passages.split_sentences(None) == [] and passages.mask_conclusions(None) == ("", 0, [])


def test_needles_leave_out_no_pattern():
    """What the parts in lower case skip, the patterns do not find, in any case and with letters that patterns fold."""
    import random
    import re

    from evidara.functions import passages as P
    from evidara.functions import verdicts

    words = [w for k in P.KINDS.values() for w in re.sub(r"[()?:|.]", " ", k).split()]
    words += "This variant was classified as Likely Pathogenic BENIGN VUS uncertain significance . ! PM2 pp3_strong BS1 not met no effect PMID: 12345 evidence data is insufficient to classify \n \u017f \u0130 \u212a Loss-of-function de novo clas\u017fified".split(" ")
    draw = random.Random(2)
    for _ in range(300):
        text = " ".join(draw.choice(words) for _ in range(draw.randrange(1, 60)))
        units = P.evidence_units(text)
        for start, end, body, role, kinds, side, codes, _, _ in units:
            assert kinds == [k for k, p in P._KINDS.items() if p.search(body)] and side == P.polarity(body)
            assert (role == "conclusion") == (verdicts.category(body) is not None)
            assert codes == sorted({c if s is None else f"{c}_{s}" for c, s, _, _, met in P.find_codes(body, require_context=False) if met})
        assert P.mask_conclusions(text)[2] == [c for _, _, b in P.split_sentences(text) if (c := verdicts.category(b))]


def test_results_of_few_texts_are_held():
    """A batch of Arrow is answered in slices, so that the results of one are held and not those of 10,000 texts."""
    import pandas as pd

    from evidara.functions import passages as P

    batch = pd.Series(["One. Two benign ones."] * 1000)
    for made in (P._masked(iter([batch])), P._records(P.evidence_units, P.UNIT_FIELDS)(iter([batch]))):
        sizes = [len(part) for part in made]
        assert sum(sizes) == 1000 and max(sizes) <= P.SLICE
