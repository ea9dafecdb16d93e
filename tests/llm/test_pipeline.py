from __future__ import annotations

import tempfile

import corpus_pipeline
from made import prose


def test_stages(spark, make_docs):
    folder = tempfile.mkdtemp(prefix="spark-")
    shared = prose(99, 60)
    rows = []
    for k in range(120):
        text = " ".join(w.upper() + "!!" for w in prose(k, 60).split()) if k % 4 == 0 else prose(k, 90) + (" " + shared if k % 10 == 1 else "") + (f" name.{k}@mail.example.com " if k % 10 == 3 else "")
        rows.append((k, text))
    rows += [(200, rows[1][1]), (201, rows[1][1] + " end")]
    docs = make_docs(rows)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(120)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    quality, near, spans, masked = (docs,) + (None,) * 3
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        out.append(docs)
    quality, near, spans, masked, packed = out
    assert all(x.columns == ["doc_id", "text", "lang", "source", "n_chars"] for x in out[:4])
    kept = {r.doc_id for r in quality.collect()}
    assert kept >= {k for k in range(120) if k % 4} and len(kept & {k for k in range(0, 120, 4)}) <= 2
    assert {r.doc_id for r in near.collect()} == kept - {200, 201}
    texts = {r.doc_id: r.text for r in spans.collect()}
    assert sum(shared[:300] in t for t in texts.values()) == 1
    assert all("@mail" not in r.text for r in masked.collect())
    assert packed.select("doc_id").distinct().count() == near.count()
    assert corpus_pipeline.run(spark, folder).count() == packed.count()


def test_odd_rows_go_through(spark, odd_docs, no_docs):
    """Nulls, empty and very long texts, repeated rows and ids, no labels, an empty table, columns of names that stages use."""
    for docs in (odd_docs, no_docs):
        folder = tempfile.mkdtemp(prefix="spark-")
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
        packed = corpus_pipeline.run(spark, folder)
        rows = packed.collect()
        if docs is no_docs:
            assert rows == []
        else:
            assert {r.doc_id for r in rows} <= {1, 2, 3, 4, 5, 6, 7, 8, None} and {5, 6, 7} <= {r.doc_id for r in rows}
            assert all(r.length >= 1 for r in rows)
    quality = corpus_pipeline.keep_quality(spark, odd_docs, folder)
    assert quality.columns == odd_docs.columns and quality.count() == odd_docs.count()
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.drop_repeated_spans, corpus_pipeline.mask_personal_data):
        assert stage(spark, odd_docs, folder).columns == odd_docs.columns and stage(spark, no_docs, folder).count() == 0
