from __future__ import annotations

import corpus_pipeline
import __spark_entry__


def test_stages_in_order(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        now = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert now <= ids and now
        if k < 4:
            assert out.columns == columns
        if k < 3:
            assert out.count() == len(now)
        docs, ids = out, now
    assert before > len(ids)
    slots: dict[int, list[int]] = {}
    for r in docs.select("shard", "slot").collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "text", "shard", "slot"} <= set(rows.columns) and not rows.isEmpty()


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
