"""The pipeline's stages, each against what its operator says of its own input."""

import corpus_pipeline
from corvane.llm import decontamination, near_dedup, quality_rules

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
    assert all(d.columns == columns for d in seen[:-1])
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert ids[1] == {r.doc_id for r in quality_rules.quality(seen[0]).where("kept").collect()}
    assert ids[2] == {r.doc_id for r in near_dedup.near_duplicates(seen[1]).where("kept").collect()}
    bad = {r.doc_id for r in decontamination.contaminated(seen[3], spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert bad and ids[4] == ids[3] - bad
    assert ids[5] == ids[4]


def test_run_and_empty_input(spark, tmp_path):
    full = corpus_pipeline.run(spark, DATA)
    assert full.count() > 0
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_documents(spark, tmp_path):
    """Nulls, repeats, a long text and columns named like those that operators add keep their values or go as the docstring says."""
    import random

    r = random.Random(2)
    words = ["".join(r.choices("abcdefghijkl", k=r.randint(2, 8))) for _ in range(900)]
    text = lambda k, n=60: " ".join(random.Random(k).choices(words, k=n))
    rows = [(1, text(1), "a", 1, True), (1, text(1), "a", 1, True), (2, None, "b", 2, True), (3, "", "c", 3, None), (None, text(4), None, 5, False), (6, text(6, 20000), "f", 6, False), (7, text(6, 20000)[:300], "g", 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, N_words int, kept boolean")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, left, DATA).write.parquet(str(tmp_path / name))
        left = spark.read.parquet(str(tmp_path / name))
        assert left.columns == docs.columns
    got = {x.doc_id: x for x in left.collect()}
    assert set(got) == {1, None, 6} and left.count() == 3
    assert all((got[k].text, got[k].source, got[k].N_words, got[k].kept) == x for k, x in ((1, (text(1), "a", 1, True)), (None, (text(4), None, 5, False)), (6, (text(6, 20000), "f", 6, False))))
    assert corpus_pipeline.STAGES[-1][1](spark, left, DATA).count() >= 3
