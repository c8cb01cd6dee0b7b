import random

import corpus_pipeline
from tests.llm.helpers import documents, write_tables
from tests.llm.test_jaccard import brute


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(300)]
    texts = []
    for i in range(160):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(8, 60)))
        texts.append(text.upper().replace(" ", "!! $$$ ") if i % 8 == 0 else text)
    texts += [texts[1], texts[2] + " tail", None, ""]
    docs = documents(spark, texts)
    sf = write_tables(spark, tmp_path / "sf", docs, labels=[(i, int(i % 8 != 0), 0) for i in range(160)])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "source_mix", "packing"]
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        if k < 3:
            assert now.columns == docs.columns
    ids = lambda name: sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / name)).select("doc_id").collect())
    good = ids("quality_classifier")
    assert len([i for i in good if i < 160 and i % 8]) == 140 and len([i for i in good if i < 160 and i % 8 == 0]) <= 1
    roots = brute([texts[i] for i in good], 5, 80, 100)
    assert ids("ngram_jaccard_join") == sorted({good[c] for _, c in roots})
    assert set(ids("source_mix")) <= set(ids("ngram_jaccard_join"))
    pieces = now.collect()
    assert len(pieces) == len(ids("source_mix")) and {"doc_id", "bucket", "batch", "slot", "text"} <= set(now.columns)
    rows = lambda d: sorted((r.doc_id, r.piece, r.bucket) for r in d.collect())
    assert rows(corpus_pipeline.run(spark, sf)) == rows(now)
