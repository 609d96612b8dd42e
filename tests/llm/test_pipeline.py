"""The pipeline, stage by stage, against what each stage's plain rule keeps."""

import corpus_pipeline
from tests.llm.test_operators import input_rows, plain_components, plain_hits


def test_pipeline(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = [(d, t) for d, t in input_rows(docs) if any(c.isalpha() for c in t)]
    rows = [(d, t) for d, t in rows if d in {x[0] for x in plain_components(rows) if x[0] == x[2]}]
    rows = [(d, t) for d, t in rows if d in {x[0] for x in plain_hits(rows, items) if not x[2]}]
    columns = []

    def watched(stage):
        def run(spark, docs, folder):
            columns.append(stage(spark, docs, folder))
            return columns[-1]

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, watched(f)) for n, f in corpus_pipeline.STAGES])
    got = corpus_pipeline.run(spark, folder)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(d for d, _ in rows)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert [c.columns == docs.columns for c in columns] == [True] * 4 + [False]


def test_no_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
