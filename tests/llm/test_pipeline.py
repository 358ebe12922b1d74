from __future__ import annotations

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import odd_sketch

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_by_their_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        seen[name] = docs.collect()
    ids = {n: {r["doc_id"] for r in rows} for n, rows in seen.items()}
    assert ids["mix"] <= ids["substring_dedup"] == ids["near_dedup"] < ids["quality"]
    size = lambda r: len(r["text"].split())
    total = sum(size(r) for r in seen["substring_dedup"])
    assert abs(sum(size(r) for r in seen["mix"]) - 1.5 * total) <= 0.01 * total  # some sources have few documents
    pieces = corpus_pipeline.pack(spark, docs, SF).collect()
    rows = {}
    for r in seen["mix"]:
        rows[r["doc_id"]] = rows.get(r["doc_id"], 0) + 1
    length = {}
    for p in pieces:
        length[p["doc_id"]] = length.get(p["doc_id"], 0) + p["length"]
    tokens = {p["doc_id"]: p["doc_tokens"] for p in pieces}
    assert length == {i: n * tokens[i] for i, n in rows.items()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_on_odd_rows_and_names(spark):
    """Nulls, empty and repeated rows, ties, clashing names and empty tables have defined results in every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    odd = [(10**6, None, "en", "a", 0), (10**6 + 1, "", None, None, None), (None, "no id here", "en", "a", 10), (None, None, None, None, None), (10**6 + 2, "same words again", "en", "b", 16), (10**6 + 2, "same words again", "en", "b", 16)]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({c: F.lit(7) for c in ("_gone", "_own", "_c0", "kept", "rank", "part", "n_removed", "size", "hash")})
    key = lambda r: (r["doc_id"], r["text"])
    all_rows = sorted(map(key, rows.collect()), key=str)

    deduped = corpus_pipeline.near_dedup(spark, rows, SF)
    assert deduped.columns == rows.columns
    kept = [key(r) for r in deduped.collect()]
    gone = {r["doc_id"] for r in odd_sketch.near_duplicates(rows).where("not kept").collect()}
    assert sorted(kept, key=str) == [k for k in all_rows if k[0] not in gone]

    cut = corpus_pipeline.substring_dedup(spark, rows, SF)
    assert cut.columns == rows.columns and cut.count() == rows.count()
    assert {key(r) for r in cut.where("doc_id >= 1000000 or doc_id is null").collect()} == {(i, t) for i, t, *_ in odd}

    mixed = corpus_pipeline.mix(spark, rows, SF)
    assert mixed.columns == rows.columns
    times = Counter(key(r) for r in mixed.collect())
    assert set(times) <= set(all_rows) and all(n <= 2 * all_rows.count(k) for k, n in times.items())

    pieces = corpus_pipeline.pack(spark, rows, SF).collect()
    assert sum(p["length"] for p in pieces) == sum(p["doc_tokens"] for p in pieces if p["start"] == 0)
    assert sum(p["start"] == 0 for p in pieces) == rows.count()

    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, rows.limit(0), SF).count() == 0
    assert corpus_pipeline.quality(spark, rows.limit(0), SF).count() == 0
    good = corpus_pipeline.quality(spark, rows, SF)
    assert good.columns == rows.columns and {key(r) for r in good.collect()} <= set(all_rows)
