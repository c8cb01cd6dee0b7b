"""Declared schemas of the tables that operators exchange."""

RECORD = "uniprot_id string, position bigint, wt_aa string, mut_aa string, gene string, label double, label_source string, evidence_tier string"
VARIANTS = "variant_id string, variation_id bigint, gene string, genes array<string>, name string, consequence string, genomic_key string, label5 string, label_category string, stars int, disease_ids array<string>, disease_names array<string>, protein_variant_id string"
DOCUMENTS = "document_id string, variant_id string, variation_id bigint, gene string, submitter string, review_status string, classification_raw string, label5 string, label_soft array<double>, date string, text string, tier int, restricted boolean, text_pmids array<string>"
EVIDENCE = "evidence_id string, document_id string, char_start int, char_end int, text_span string, sentence_role string, evidence_types array<string>, evidence_polarity string, acmg_codes array<string>, confidence double"
CITATIONS = "variation_id bigint, allele_id bigint, citation_source string, citation_id string"
CRITERIA = "document_id string, variant_id string, gene string, codes_met array<string>, codes_not_met array<string>, source_id string, provenance string"
PREDICTIONS = "cell string, gene string, variant_key string, label int, score double, threshold double, fold string"
FUNCTIONAL = "uniprot_id string, position bigint, wt_aa string, mut_aa string, gene string, assay string, raw_score double, damage_score double, functional_class double"
