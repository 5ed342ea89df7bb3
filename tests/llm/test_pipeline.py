"""The pipeline on the smallest tables, each stage against brute force on its own input."""

import glob

import corpus_pipeline
from test_operators import brute_classes, brute_hits, brute_lines

SF = "/root/testdata/sf0.001"


def by_id(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = by_id(docs)
        docs = corpus_pipeline.written(stage(spark, docs, SF))
        assert docs.columns == columns
        seen[name] = (before, by_id(docs))
    before, after = seen["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i in before if labels.get(i) == 1]
    assert len([i for i in good if i in after]) >= 0.98 * len(good)
    assert any(labels.get(i) == 0 and i not in after for i in before)  # few labels here: accuracy is tested elsewhere
    before, after = seen["line_dedup"]
    ids = sorted(before)
    assert [after[i] for i in ids] == brute_lines([before[i] for i in ids])
    before, after = seen["near_dedup"]
    ids = sorted(before)
    assert sorted(after) == [ids[i] for i, c in enumerate(brute_classes([before[i] for i in ids], 5, 80)[1]) if i == c]
    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = {i: brute_hits(t, items) for i, t in before.items()}
    assert sorted(after) == sorted(i for i, (n, hit, _) in hits.items() if not (hit and 20 * hit >= n))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(after)
    assert glob.glob(f"{SF}/*.parquet")
