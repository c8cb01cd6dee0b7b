import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidara.operators import corpus, dedup, graph, homology, joins, merge, metrics, ranking, resample, splits, structure, validate


def test_merge_quarantines_and_coalesces(spark):
    rows = spark.createDataFrame(
        [("P1", 1, "A", "C", 1.0, "expert", None, 2), ("P1", 1, "A", "C", 1.0, "assay", 0.5, 1), ("P1", 2, "A", "C", 1.0, "expert", 0.1, 1), ("P1", 2, "A", "C", 0.0, "assay", 0.2, 0), ("P1", 3, "A", "C", None, "assay", 0.3, 0)],
        "uniprot_id string, position bigint, wt_aa string, mut_aa string, label double, label_source string, f double, ordinal int",
    )
    got = {r.position: r for r in merge.merge_labels(rows, merge.KEY, {"expert": 1, "assay": 2}, ["expert", "assay"], ["f"]).collect()}
    assert (got[1].label, got[1].label_source, got[1].f, got[1].label__assay) == (1.0, "expert", 0.5, 1.0)
    assert (got[2].label, got[2].label_source, got[2].quarantined, got[2].f, got[2].label__assay) == (None, None, True, 0.1, 0.0)
    assert got[3].label is None and not got[3].quarantined and got[3].f == 0.3


def test_validation(spark):
    rows = spark.createDataFrame([("P1", 1, "A", "C"), ("P1", 0, "A", "C"), ("P1", 1, "B", "C"), ("P1", 1, "A", "A"), ("P1", 2, "A", "C"), ("P9", 1, "A", "C"), (None, None, None, None)], "uniprot_id string, position bigint, wt_aa string, mut_aa string")
    sequences = spark.createDataFrame([("P1", "AKL")], "uniprot_id string, sequence string")
    reasons = [r.reason for r in validate.valid_records(rows, sequences).orderBy("uniprot_id", "position", "wt_aa", "mut_aa").collect()]
    assert sorted(r or "" for r in reasons) == ["", "", "position", "residue", "residue", "sequence", "synonymous"]
    keys = validate.normalise_keys(spark.createDataFrame([("10.0", " a", "c "), ("1.5", "A", "C")], "position string, wt_aa string, mut_aa string")).collect()
    assert tuple(keys[0]) == (10, "A", "C") and keys[1].position is None
    with pytest.raises(Exception, match="not unique"):
        joins.many_to_one(rows, spark.createDataFrame([("P1", 1), ("P1", 2)], "uniprot_id string, x int"), ["uniprot_id"]).collect()


def test_interval_join_against_all_pairs(spark):
    rng = random.Random(0)
    points = [(rng.choice("ab"), rng.randrange(2000)) for _ in range(200)]
    spans = [(rng.choice("ab"), a := rng.randrange(2000), a + rng.choice([0, 3, 700])) for _ in range(60)]
    got = joins.interval_join(spark.createDataFrame(points, "k string, p int"), spark.createDataFrame(spans, "k string, a int, b int"), "k", "p", "a", "b").collect()
    assert sorted((r.k, r.p, r.a, r.b) for r in got) == sorted((k, p, a, b) for (k, p), (j, a, b) in itertools.product(points, spans) if k == j and a <= p <= b)


def test_ranks_and_measures_against_numpy(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "y": rng.integers(0, 2, 500), "s": np.round(rng.random(500), 2), "i": range(500)})
    rows = spark.createDataFrame(pdf)
    got = {r.g: r.auc for r in metrics.roc_auc(rows, ["g"], "y", "s").collect()}
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(resample.auc(part.y.to_numpy(), part.s.to_numpy()))
    pct = pdf.groupby("g").s.rank(pct=True)
    found = {r.i: r.pct for r in ranking.percentile_rank(rows, ["g"], "s", "pct").collect()}
    assert all(found[i] == pytest.approx(pct[i]) for i in pdf.i)
    ordered = pdf.sort_values(["s", "i"], ascending=[False, True])
    precision = ordered.y.cumsum() / np.arange(1, 501)
    assert metrics.average_precision(rows, [], "y", "s", "i").first()[0] == pytest.approx(precision[ordered.y == 1].mean())
    assert metrics.roc_auc(rows.filter("y = 1"), [], "y", "s").first().auc is None


def test_components_against_union(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.connected(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == {x: find(x) for x in root}


def test_near_clusters(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
    docs = [(f"d{i}", " ".join(base * 3)) for i in range(5)] + [("e1", " ".join(base * 3) + " tail"), ("f1", "something else entirely"), ("g1", "")]
    got = dedup.near_clusters(spark.createDataFrame(docs, "document_id string, text string"), 0.8).collect()
    assert sorted(tuple(r) for r in got) == [*((f"d{i}", "d0") for i in range(5)), ("e1", "d0")]
    assert dedup.choose_bands(128, 0.8) == 16 or 128 % dedup.choose_bands(128, 0.8) == 0


def test_near_clusters_of_chains_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(dedup, "CHUNK", 2)
    docs = {f"{c:02}{p}": " ".join(f"c{c}w{i}" for i in range(2 * p, 2 * p + 10)) for c in range(12) for p in range(4)}
    docs |= {f"{c:02}x": " ".join(f"c{c}w{i}" for i in range(4, 30)) for c in range(12)}
    table = spark.createDataFrame(list(docs.items()), "document_id string, text string")
    # one permutation: all texts of a chain that share their least word are one bucket
    written = dedup._shared(table.select("document_id", dedup.T.shingles(F.col("text"), 1).alias("sh")))
    least = {r.document_id: r.s[0] for r in written.select("document_id", dedup.signature(F.col("sh"), 1, 1).alias("s")).collect()}
    words = {k: set(t.split()) for k, t in docs.items()}
    root = {k: k for k in docs}
    for a in sorted(docs):
        for b in sorted(docs):
            if least[a] == least[b] and len(words[a] & words[b]) / len(words[a] | words[b]) >= 0.6:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    want = sorted((k, v) for k, v in root.items() if list(root.values()).count(v) > 1)
    assert len({v for _, v in want}) > 5
    got = dedup.near_clusters(table, 0.6, k=1, n=1).collect()
    assert sorted(tuple(r) for r in got) == want


def test_splits(spark):
    rows = spark.range(500).select(F.col("id").cast("string").alias("document_id"), (F.col("id") % 40).cast("string").alias("variant_id"), (F.col("id") % 7).cast("string").alias("gene"), F.lit("s").alias("submitter"))
    for scheme in ("random", "gene", "variant"):
        made = splits.make_split(rows, scheme)
        assert made.count() == 500 and {r.split for r in made.select("split").distinct().collect()} <= {"train", "validation", "test"}
    assert splits.straddling(splits.make_split(rows, "variant"), "variant_id").count() == 0
    folds = splits.stratified_group_folds(rows.withColumn("y", F.col("document_id").cast("int") % 2), "variant_id", "y", 4, 1)
    assert folds.groupBy("variant_id").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0


def test_alignment_and_groups(spark):
    score, pairs = homology.align("MKTAYIAKQR", "MKTAYIAKQR")
    assert pairs == [(i, i) for i in range(1, 11)] and score == sum(homology.MATRIX[homology.ORDER.index(c)][homology.ORDER.index(c)] for c in "MKTAYIAKQR")
    _, pairs = homology.align("MKTAYIAKQRWWW", "AYIAKQRWWW")
    assert pairs == [(i + 3, i) for i in range(1, 11)]
    _, pairs = homology.align("MKTAYIAKQRHHWWPLMKTAYI", "MKTAYIAKQRWWPLMKTAYI")
    assert (1, 1) in pairs and (22, 20) in pairs
    seqs = spark.createDataFrame([("A", "MKTAYIAKQR"), ("B", "MKTAYIAKQR"), ("C", "GGGGPPPPGGGG")], "uniprot_id string, sequence string")
    aligned = homology.alignments(homology.candidate_pairs(seqs), seqs)
    assert [(r.a, r.b, r.identity_shorter) for r in aligned.collect()] == [("A", "B", 1.0)]
    groups = homology.position_groups(aligned)
    assert groups.count() == 20 and groups.select("cluster_id").distinct().count() == 10
    assert {r.uniprot_id: r.cluster for r in homology.identity_clusters(aligned, seqs).collect()} == {"A": "A", "B": "A", "C": "C"}


def test_calibrators():
    rng = np.random.default_rng(0)
    p = rng.random(4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * resample.logit(p)))).astype(float)
    a, b = resample.platt(y, p)
    assert a == pytest.approx(2, abs=0.25) and abs(b) < 0.2 and resample.temperature(y, p) == pytest.approx(0.5, abs=0.08)


def test_span_matching(spark):
    spans = "d string, label string, start int, end int"
    found = resample.match_spans(spark.createDataFrame([("a", "x", 0, 10), ("a", "x", 20, 30), ("b", "x", 0, 5)], spans), spark.createDataFrame([("a", "x", 1, 10), ("a", "x", 50, 60)], spans), "d")
    assert resample.span_f1(found).first().asDict() == pytest.approx({"precision": 1 / 3, "recall": 0.5, "f1": 0.4})


def test_units_and_geometry(spark):
    docs = spark.createDataFrame([("d1", "Allele frequency is low in gnomAD. It segregates with disease. This variant is pathogenic.")], "document_id string, text string")
    units = corpus.evidence_units(docs).orderBy("char_start").collect()
    assert [u.sentence_role for u in units] == ["evidence", "evidence", "conclusion"] and validate.offsets_fit(corpus.evidence_units(docs), docs).first().n_bad == 0
    a = np.random.default_rng(0).normal(size=(8, 3))
    turn = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    assert structure.superposed_rmsd(a, a @ turn + 5) == pytest.approx(0, abs=1e-9)


def test_covariates_and_centroids(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"y": rng.integers(0, 2, 400)})
    pdf["same"], pdf["shifted"], pdf["flag"] = rng.normal(size=400), rng.normal(size=400) + pdf.y, (rng.random(400) < 0.2 + 0.5 * pdf.y).astype(float)
    got = {r.covariate: r for r in resample.covariate_tests(spark.createDataFrame(pdf), "y", ["same", "shifted", "flag"]).collect()}
    assert got["shifted"].q < 1e-6 and got["flag"].test == "exact" and got["flag"].q < 1e-6 and got["same"].p > 0.001 and got["shifted"].effect > 0.6
    assert resample.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857142857)
    pdf["g"], pdf["fold"] = np.where(pdf.index % 2, "a", "b"), pdf.index % 5
    pdf["told"] = np.where(pdf.g == "a", 5.0, 0.0) + pdf.same
    assert metrics.centroid_accuracy(spark.createDataFrame(pdf), "g", ["told"], "fold").first().accuracy > 0.95
    assert metrics.centroid_accuracy(spark.createDataFrame(pdf), "g", ["same"], "fold").first().accuracy < 0.65
    slices = {r.slice: r.n for r in metrics.auc_by_condition(spark.createDataFrame(pdf), [], "y", "shifted", F.col("g") == "a").collect()}
    assert slices == {"all": 400, "met": 200, "not_met": 200}


def test_examples(spark):
    docs = spark.createDataFrame(
        [("d1", "v1", "G", "L", "2020-01-01", 2, False, "Absent from gnomAD controls in a large set. This variant was classified as pathogenic.", "pathogenic"), ("d2", "v2", "G", "L", "2020-01-01", 2, True, "Some text that is long enough.", "benign")],
        "document_id string, variant_id string, gene string, submitter string, date string, tier int, restricted boolean, text string, label5 string",
    )
    split = spark.createDataFrame([("d1", "train"), ("d2", "train")], "document_id string, split string")
    made = corpus.examples(docs, split)
    row = made.first()
    assert made.count() == 1 and row.input_text == "Absent from gnomAD controls in a large set." and (row.n_sentences, row.n_masked) == (2, 1)
    assert corpus.masking_totals(made).first().n_masked == 1 and corpus.examples(docs, split, holdout="gnomAD").count() == 0
    units = corpus.evidence_units(docs)
    assert {r.target_label for r in corpus.unit_examples(units, docs, split, "evidence_type").collect()} == {"population_frequency"}
    assert corpus.unit_examples(units, docs, split, "polarity").count() == 1
    criteria = spark.createDataFrame([("d1", ["PS3", "PM2"])], "document_id string, codes_met array<string>")
    assert corpus.code_examples(criteria, docs, split).first().input_text == "PM2 PS3"


def test_candidates_find_nearly_all_similar_pairs(spark):
    rng, words = random.Random(5), [f"w{i}" for i in range(300)]
    docs = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(60)]
        near = list(base)
        near[rng.randrange(60)] = "changed"
        docs += [(f"a{i:03}", " ".join(base)), (f"b{i:03}", " ".join(near))]
    table = spark.createDataFrame(docs, "document_id string, text string")
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    want = {(a[0], b[0]) for a, b in zip(docs[::2], docs[1::2]) if len(shingles(a[1]) & shingles(b[1])) / len(shingles(a[1]) | shingles(b[1])) >= 0.8}
    clusters = {r.document_id: r.cluster for r in dedup.near_clusters(table, 0.8).collect()}
    assert len(want) > 30 and all(clusters.get(b) == a for a, b in want)  # recall 1 here; 0.9 is asked for
    pairs = {(r.a, r.b) for r in dedup.similar_pairs(table, 0.8).collect()}
    assert pairs == want


def test_provenance_and_policies(spark, tmp_path):
    from evidara.operators import provenance

    path = str(tmp_path / "data")
    spark.range(20).write.parquet(path)
    made = provenance.split_manifest(spark, str(tmp_path / "split.json"), path, 3, train=["mlh1"], test=["MSH2"])
    provenance.verify_dataset(spark, made, path)
    spark.range(21).write.mode("overwrite").parquet(path)
    with pytest.raises(ValueError):
        provenance.verify_dataset(spark, made, path)
    with pytest.raises(ValueError):
        provenance.split_manifest(spark, str(tmp_path / "s2.json"), path, 3, train=["A"], test=["a"])
    assert [s["train"] for s in provenance.leave_one_out_manifest(spark, str(tmp_path / "l.json"), ["a", "b"])["splits"]] == [["B"], ["A"]]
    record = provenance.provenance_record(spark, path, ["b", "a", "a"], spark.range(3), "id", ["y", "x"])
    import hashlib

    assert record["feature_schema"] == hashlib.sha256(b"a\nb").hexdigest()[:16] and record["split_hash"] == hashlib.sha256(b"0\n1\n2").hexdigest()[:16] and record["sources"] == ["x", "y"]
    with pytest.raises(KeyError):
        provenance.task_policy("other")
    assert not provenance.task_policy("pretraining").mask_codes and provenance.keep_policy(["af"], "classify") == ["af"]
    with pytest.raises(ValueError):
        provenance.keep_policy(["stars"], "classify")
    wrong = spark.createDataFrame([("x", float(i), float(-i)) for i in range(40)], "assay string, damage_score double, prior double")
    with pytest.raises(Exception, match="wrong direction"):
        provenance.orientation(wrong, "prior").collect()
    assert provenance.orientation(wrong.limit(5), "prior").first().spearman is None


def test_bootstrap_over_counts(spark):
    from evidara.operators import resample

    rng = random.Random(1)
    rows = [("g", i % 2, rng.gauss(i % 2, 1.0)) for i in range(400)]
    got = resample.bootstrap_ci(spark.createDataFrame(rows, "g string, y int, s double"), "g", "y", "s", n=400).first()
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    exact = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(got.auc - exact) < 1e-9 and got.ci_low < exact < got.ci_high and 0.04 < got.ci_high - got.ci_low < 0.16
    direct = resample.bootstrap(np.array([y for _, y, _ in rows]), np.array([s for *_, s in rows]), 400, 1)
    assert abs(direct[1] - got.ci_low) < 0.02 and abs(direct[2] - got.ci_high) < 0.02


def test_pairs_move_only_what_may_be_similar(spark):
    """Bins lose no similar pair, also of long sets; heads hold one of the partner's shingles; copies have one name."""
    import random

    from evidara.operators import dedup

    draw = random.Random(4)
    docs = []
    for i in range(40):
        words = [f"w{draw.randrange(500)}" for _ in range(draw.choice((5, 30, 400, 3000)))]
        docs.append((2 * i, " ".join(words)))
        for at in draw.sample(range(len(words)), len(words) // draw.choice((40, 60, 90))):
            words[at] = "other"
        docs.append((2 * i + 1, " ".join(words)))
    docs.append((200, docs[0][1]))
    runs = lambda t: {tuple(w[j : j + 5]) for w in [t.split()] for j in range(max(1, len(w) - 4))}
    sets = {k: runs(t) for k, t in docs if k != 200}
    share = lambda a, b: len(a & b) / len(a | b)
    want = {(a, b): share(sets[a], sets[b]) for a in sets for b in sets if a < b and sets[a] != sets[b] and share(sets[a], sets[b]) >= 0.8}
    table = spark.createDataFrame(docs, "document_id long, text string")
    got = {(r.a, r.b): r.jaccard for r in dedup.similar_pairs(table, 0.8).collect()}
    assert want and got == pytest.approx(want)


def test_images_are_remainders():
    """The smallest image is that of the plain remainder, also at the ends of the range."""
    import numpy as np

    from evidara.operators import dedup

    shingles = np.concatenate([np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 2000), [0, -1, dedup.PRIME, -dedup.PRIME, 2**63 - 1, -(2**63)]])
    pairs = np.array([*dedup.permutations(20, 3), (dedup.PRIME - 1, dedup.PRIME - 1), (1, 0)], np.int64)
    small = np.mod(shingles, dedup.PRIME)
    want = ((small[:, None] * pairs[:, 0] + pairs[:, 1]) % dedup.PRIME).min(axis=0)
    assert np.array_equal(dedup.least_images(shingles, pairs), want) and np.array_equal(dedup.least_images(shingles, pairs, strip=7), want)


def test_near_clusters_move_no_sets_that_cannot_be_similar(spark, monkeypatch):
    moved, compared = [], dedup._compared
    monkeypatch.setattr(dedup, "_compared", lambda pairs, *a: moved.append(pairs.count()) or compared(pairs, *a))
    part = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    docs = [(f"d{i:02}", f"{part('same', 36)} {part(f'own{i}x', 24)}") for i in range(20)]  # these share bands, at a similarity of 0.4
    docs += [("e0", docs[0][1] + " more"), ("f0", ""), ("f1", None)]
    got = dedup.near_clusters(spark.createDataFrame(docs, "document_id string, text string"), 0.8).collect()
    assert {(r.document_id, r.cluster) for r in got} == {("d00", "d00"), ("e0", "d00")} and sum(moved) <= 3
