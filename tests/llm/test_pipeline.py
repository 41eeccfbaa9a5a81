"""Every stage of the pipeline against brute force, on what the one before it kept."""

from __future__ import annotations

import corpus_pipeline
from conftest_helpers import words_of
from test_operators import alnum, distance, grouped

from assayer.llm import decontaminate, tables


def test_stages_keep_clean_documents_and_their_columns(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet").where("doc_id IS NOT NULL AND doc_id <> 405")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = tables.written(stage(spark, docs, odd), name)
        assert docs.columns == columns
        seen[name] = (before, docs.collect())

    before, after = seen["language_id"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} >= {400, 401, 402, 404}
    assert len(after) >= len(before) - 8

    before, after = seen["near_dedup"]
    kept = {d for d, _, _, k in grouped([(r.doc_id, r.text) for r in before], 80) if k}
    assert {r.doc_id for r in after} == kept

    before, after = seen["substring_dedup"]
    held = {r.doc_id: r for r in after}
    assert len(held) == len({r.doc_id for r in before})
    first = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        w = words_of(r.text)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), r.doc_id)
    for r in before:
        w = words_of(r.text)
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < r.doc_id for j in range(i, i + 13)}
        assert words_of(held[r.doc_id].text) == [x for j, x in enumerate(w) if j not in gone]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)

    before, after = seen["decontaminate"]
    items = [alnum(r.text) for r in spark.read.parquet(f"{odd}/benchmark.parquet").collect()]
    items = [i for i in items if len(i) >= decontaminate.MIN_WORDS]
    leaks = {r.doc_id for r in before if len(words_of(r.text)) < 1000 and any(distance(i, alnum(r.text)) <= decontaminate.distance_allowed(len(i)) for i in items)}
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == leaks


def test_the_whole_pipeline_packs_what_is_left(spark, odd, empty):
    out = corpus_pipeline.run(spark, odd)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    pieces = out.collect()
    whole = {r.doc_id: r.doc_tokens for r in pieces}
    assert None in whole and whole[405] > 30_000  # rows without an id pass, and very long texts stay whole
    assert sum(r.length for r in pieces if r.doc_id == 405) == whole[405]
    assert corpus_pipeline.run(spark, empty).count() == 0
