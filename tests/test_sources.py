import gzip
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from evidara.sources import archives, delimited, nested, registry, sinks
from evidara.streaming import incremental

SUMMARY = "#" + "\t".join(delimited.SUMMARY)


def summary_row(**v):
    base = dict.fromkeys(delimited.SUMMARY, "-") | {"Type": "single nucleotide variant", "GeneSymbol": "MLH1", "Assembly": "GRCh38", "Start": "5", "Stop": "5", "ReviewStatus": "criteria provided, multiple submitters, no conflicts"}
    return "\t".join(str(x) for x in (base | v).values())


def test_variant_releases(spark, tmp_path):
    rows = [
        summary_row(VariationID=1, Assembly="GRCh37", Name="NM_1.1(MLH1):c.4G>A (p.Gly2Arg)", ClinicalSignificance="Benign"),
        summary_row(VariationID=2, Name="NM_1.1(MLH1):c.7G>A (p.Gly3Arg)", ClinicalSignificance="Uncertain significance", PhenotypeIDS="MedGen:C1|-", PhenotypeList="Lynch|not provided"),
        summary_row(VariationID=1, Name="NM_1.1(MLH1):c.4G>A (p.Gly2Arg)", ClinicalSignificance="Pathogenic", Chromosome="3", PositionVCF="9", ReferenceAlleleVCF="G", AlternateAlleleVCF="A"),
        summary_row(VariationID=3, GeneSymbol="OTHER", Name="x", ClinicalSignificance="Benign"),
        "ragged\trow",
    ]
    path = tmp_path / "v.txt.gz"
    path.write_bytes(gzip.compress("\n".join([SUMMARY, *rows]).encode()))
    made = delimited.variant_summary(spark, str(path), ["mlh1"])
    got = {r.variation_id: r for r in made.collect()}
    assert set(got) == {1, 2} and got[1].significance == "Pathogenic" and got[1].genomic_key == "GRCh38:3:9:G:A" and got[1].consequence == "missense" and got[1].stars == 2
    assert got[2].disease_ids == ["MedGen:C1", None] and got[2].label5 == "vus"
    records = delimited.missense_records(made, spark.createDataFrame([("MLH1", "P40692")], "gene string, uniprot_id string")).collect()
    assert [(r.uniprot_id, r.position, r.wt_aa, r.mut_aa, r.label) for r in records] == [("P40692", 2, "G", "R", 1.0)]
    with pytest.raises(ValueError, match="absent columns"):
        delimited.table(spark, str(path), ["Nothing"])
    assert registry.load(spark, "clinvar", str(path)).count() == 3
    with pytest.raises(KeyError):
        registry.load(spark, "nothing", "x")


def test_submissions_and_citations(spark, tmp_path):
    head = "\t".join(delimited.SUBMISSION)
    row = "\t".join(["1", "Likely pathogenic", "Dec 17, 2024", "Seen in PMID: 12345 with others, long enough to count.", "C01:Lynch", "criteria provided, single submitter", "clinical testing", "OMIM", "SCV1", "MLH1"])
    (tmp_path / "s.txt").write_text(f"##comment\n##more\n#{head}\n{row}\n-\tx\n")
    r = delimited.submissions(spark, str(tmp_path / "s.txt")).first()
    assert (r.document_id, r.label5, r.date, r.tier, r.restricted, r.text_pmids, r.disease_ids) == ("SCV1", "likely_pathogenic", "2024-12-17", 2, True, ["12345"], ["MedGen:C01"])
    (tmp_path / "c.txt").write_text("#AlleleID\tVariationID\trs\tnsv\tcitation_source\tcitation_id\n1\t2\t-\t-\tPubMed\t9\n1\t-\t-\t-\tPubMed\t9\n")
    assert [tuple(r) for r in delimited.citations(spark, str(tmp_path / "c.txt")).collect()] == [(2, 1, "PubMed", "9")]


def test_score_tables(spark, tmp_path):
    (tmp_path / "am.tsv").write_text("# c\nuniprot_id\tprotein_variant\tam_pathogenicity\tam_class\nP1\tA2C\t0.9\tpathogenic\nP2\tA2C\t0.1\tbenign\nP1\tbad\t0.1\tx\n")
    got = delimited.pathogenicity_scores(spark, str(tmp_path / "am.tsv"), spark.createDataFrame([("P1", "G")], "uniprot_id string, gene string")).collect()
    assert [(r.uniprot_id, r.position, r.mut_aa) for r in got] == [("P1", 2, "C")]
    (tmp_path / "odds.csv").write_text("gene,position,wt_aa,mut_aa,cimra_oddspath,mechanism\nG,2,a,c,20,\nG,2,A,C,1,\nG,3,A,C,-1,\nG,4,A,C,3,Splicing\n")
    got = delimited.odds_table(spark, str(tmp_path / "odds.csv")).collect()
    assert [(r.position, r.strength) for r in got] == [(2, "PS3_strong")]
    (tmp_path / "m.csv").write_text("hgvs_pro,score\np.Gly2Arg,0.5\np.Gly2Arg,0.7\np.Gly2=,1\n")
    got = delimited.score_set(spark, str(tmp_path / "m.csv"), "G", "P1", "urn:1", higher_is_damaging=False).collect()
    assert [(r.position, r.raw_score, r.damage_score) for r in got] == [(2, 0.5, -0.5)]
    (tmp_path / "e.csv").write_text("gene,label,hgvs_p,position,wt_aa,mut_aa\nG,1,p.Gly2Arg,,,\nG,0,,7,A,C\n")
    assert sorted(r.position for r in delimited.expert_labels(spark, str(tmp_path / "e.csv"), "x").collect()) == [2, 7]
    (tmp_path / "f.fa").write_text(">A desc\nMK\nTA\n>B\nGG\n")
    assert {r.id: r.sequence for r in delimited.fasta(spark, str(tmp_path / "f.fa")).collect()} == {"A": "MKTA", "B": "GG"}
    (tmp_path / "q.jsonl").write_text('// note\n{"q": "x"}\n\n{"q": "y"}\n')
    assert [r.q for r in delimited.jsonl(spark, str(tmp_path / "q.jsonl"), "q string").collect()] == ["x", "y"]


def test_nested_sources(spark, tmp_path):
    gene = {"data": {"gene": {"symbol": "G", "gnomad_constraint": {"pLI": 0.5}, "variants": [{"variant_id": "a", "hgvsp": "p.Gly2Arg", "exome": {"ac": 1, "an": 10}, "genome": None}, {"variant_id": "b", "hgvsp": "p.Gly2Arg", "exome": {"ac": 4, "an": 10}, "genome": {"ac": 0, "an": 10}}, {"variant_id": "c", "hgvsp": None}]}}}
    (tmp_path / "g.json").write_text(json.dumps(gene))
    v = nested.population_variants(spark, str(tmp_path / "g.json"))
    assert sorted(r.af for r in v.collect()) == [0.1, 0.2] and nested.most_frequent(v).first().source_id == "b" and nested.gene_constraint(spark, str(tmp_path / "g.json")).first().pLI == 0.5
    entry = {"primaryAccession": "P1", "sequence": {"value": "MKTAY", "length": 5}, "features": [{"type": "Domain", "description": "d", "location": {"start": {"value": 2}, "end": {"value": 3}}}, {"type": "Disulfide bond", "description": "", "location": {"start": {"value": 1}, "end": {"value": 5}}}]}
    (tmp_path / "p.json").write_text(json.dumps(entry))
    p = nested.proteins(spark, str(tmp_path / "p.json"))
    table = {r.position: (r.in_domain, r.has_site) for r in nested.residue_table(p).collect()}
    assert table == {1: (0, 1), 2: (1, 0), 3: (1, 0), 4: (0, 0), 5: (0, 1)}
    with pytest.raises(Exception, match="another length"):
        nested.sequences(p, {"P1": 4}).collect()
    ipr = {"results": [{"metadata": {"accession": "IPR1", "name": "n", "type": "domain"}, "proteins": [{"accession": "p1", "entry_protein_locations": [{"fragments": [{"start": 1, "end": 4}]}]}]}]}
    (tmp_path / "i.json").write_text(json.dumps(ipr))
    assert tuple(nested.entry_intervals(spark, str(tmp_path / "i.json")).first()) == ("P1", "IPR1", "n", "domain", 1, 4)
    atom = "ATOM      1  CA  GLY A   1      11.104   6.134  -6.504  1.00 91.50           C"
    (tmp_path / "s.pdb").write_text(f"{atom}\nENDMDL\n{atom}\n")
    assert [(r.residue, r.position, r.b_factor) for r in nested.atoms(spark, str(tmp_path / "s.pdb")).collect()] == [("G", 1, 91.5)]
    assert nested.residue_confidence(nested.atoms(spark, str(tmp_path / "s.pdb"))).first().band == "very_high"


def test_text_sources(spark, tmp_path):
    article = "<PubmedArticle><MedlineCitation><PMID>{}</PMID><Article><Journal><JournalIssue><PubDate><Year>2020</Year></PubDate></JournalIssue></Journal><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>{}</AbstractText></Abstract><Language>{}</Language><PublicationTypeList><PublicationType>{}</PublicationType></PublicationTypeList></Article></MedlineCitation></PubmedArticle>"
    (tmp_path / "pm.xml").write_text("<S>" + article.format(1, "Some text", "eng", "Journal Article") + article.format(2, "x", "ger", "Journal Article") + article.format(3, "x", "eng", "Retracted Publication") + "</S>")
    got = {r.pmid: (r.reason, r.abstract, r.year) for r in nested.abstracts(spark, str(tmp_path / "pm.xml")).collect()}
    assert got == {1: (None, "Some text", 2020), 2: ("language", "x", 2020), 3: ("retracted", "x", 2020)}
    (tmp_path / "m.obo").write_text('format-version: 1.2\n\n[Term]\nid: MONDO:1\nname: a\ndef: "text one" [x]\nsynonym: "b" EXACT []\n\n[Term]\nid: MONDO:2\nname: c\nis_obsolete: true\ndef: "y" []\n')
    assert [(r.document_id, r.text, r.synonyms) for r in nested.ontology_terms(spark, str(tmp_path / "m.obo")).collect()] == [("MONDO:1", "text one", ["b"])]


def test_archives(spark, tmp_path):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("d/A1.csv", "mutant,mutated_sequence,DMS_score,DMS_score_bin\nA2V,MV,0.5,1\nA2V:Q4L,MV,0.1,0\nA2X,M,1,0\n")
    (tmp_path / "a.zip").write_bytes(held.getvalue())
    rows = archives.zipped_tables(spark, str(tmp_path / "a.zip"))
    assert rows.count() == 3
    got = archives.assays(rows).collect()
    assert [(r.assay, r.position, r.label) for r in got] == [("A1", 2, 0.0)]
    chapter = "<book-part-wrapper><book-part id='NBK1'><book-part-meta><title-group><title>Ch</title></title-group></book-part-meta><body><sec><title>S1</title><p>One two.</p><p>Three.</p><table-wrap><table><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td rowspan='2'>x</td><td>1</td></tr><tr><td>2</td></tr></tbody></table></table-wrap><ref-list><ref>no</ref></ref-list></sec></body></book-part></book-part-wrapper>"
    (tmp_path / "ch").mkdir()
    (tmp_path / "ch" / "c.nxml").write_text(chapter)
    got = archives.chapters(spark, str(tmp_path / "ch")).orderBy("ordinal").collect()
    assert [r.text for r in got] == ["A: x; B: 1", "A: x; B: 2", "One two. Three."] or sorted(r.text for r in got) == ["A: x; B: 1", "A: x; B: 2", "One two. Three."]
    (tmp_path / "ids.txt").write_bytes("#h\na\tcafé\tNBK1\t5\n".encode() + "b\tcafé\tNBK2\t6\n".encode("cp1252"))
    assert [r.title for r in archives.chapter_ids(spark, str(tmp_path / "ids.txt")).collect()] == ["café"] * 2


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", "src", f"text {i}") for i in range(300)], "document_id string, source_id string, text string")
    counts = sinks.corpus(docs, str(tmp_path / "corpus"), excluded=[(docs.limit(10), "document_id")], per_mille=100)
    assert counts.agg(F.sum("n_documents")).first()[0] == 290 and spark.read.json(str(tmp_path / "corpus")).count() == 290
    made = sinks.bundle(spark, str(tmp_path / "b"), {"docs": docs}, {"k": 1})
    assert made["artefacts"] and json.loads(sinks.read_text(spark, str(tmp_path / "b" / "manifest.json"))) == made
    store = sinks.FeatureStore(spark, str(tmp_path / "fs"))
    block = spark.createDataFrame([("v1", [0.1, 0.2])], "variant_id string, x array<float>")
    store.write("esm", "t", {"a": 1}, block)
    with pytest.raises(Exception):
        store.write("esm", "t", {"a": 1}, block)
    assert store.rows("esm", "t", {"a": 1}, block).count() == 1
    with pytest.raises(Exception, match="absent"):
        store.rows("esm", "t", {"a": 1}, spark.createDataFrame([("v9",)], "variant_id string")).collect()
    sinks.fasta(spark.createDataFrame([("A", "M" * 130)], "id string, sequence string"), str(tmp_path / "fa"))
    assert delimited.fasta(spark, str(tmp_path / "fa")).first().sequence == "M" * 130
    assert sinks.search_index(docs, str(tmp_path / "ix"), "document_id", "text") == sinks.search_index(docs.repartition(3), str(tmp_path / "ix2"), "document_id", "text")
    assert "\\hline" in sinks.latex(["a"], [[1.0]], "c", "l") and sinks.markdown({"a": {"b": 1}}).count("- ") == 2


def test_upsert_adds_once(spark, tmp_path):
    add = incremental.upsert(str(tmp_path / "cache"), ["k"])
    rows = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    add(rows, 0)
    add(rows, 0)
    add(spark.createDataFrame([(3,)], "k int"), 1)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "cache")).collect()) == [1, 2, 3]


def test_run_summaries_are_few_files(spark, tmp_path):
    """Runs share files, of about a given number; none is lost, nulls stay, and a file of one run is read as well."""
    from evidara.plans import formats
    from evidara.sources import delimited

    runs = spark.range(1, 901).selectExpr("id as run", "case when id % 7 > 0 then id / 4 end as auc")
    formats._summaries(runs, str(tmp_path / "runs"), 100)
    files = list((tmp_path / "runs").rglob("part-*"))
    assert 5 <= len(files) <= 9
    (tmp_path / "runs" / "own").mkdir()
    (tmp_path / "runs" / "own" / "part-one").write_text('{\n "run": 901,\n "auc": 0.5\n}')
    got = {r.run: r.auc for r in delimited.run_summaries(spark, str(tmp_path / "runs"), "run long, auc double", "part-*").collect()}
    assert got == {i: i / 4 if i % 7 else None for i in range(1, 901)} | {901: 0.5}
