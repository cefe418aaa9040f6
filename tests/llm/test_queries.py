"""The queries over the smallest tables, and the pipeline."""

from __future__ import annotations

import re

import brute
import oracle
import pytest

import corpus_pipeline
from quire.llm import queries, tokenizing


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, small, con, name):
    assert oracle.difference(queries.QUERIES[name](spark, small), con, queries.ORACLE[name]) == ""


def test_brute(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = brute.edited(docs)
    for r in queries.op3_fingerprints(spark, small).collect():
        assert (r["n_chars"], r["edited_sha256"]) == (want[r["doc_id"]]["n_chars"], want[r["doc_id"]]["edited_sha256"])
        w = want[r["doc_id"]]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (w["fingerprint"], w["edited_fingerprint"])
        assert abs(r["near_edited"] - w["near"]) < 1e-9 and abs(r["near_next"] - w["near_after"]) < 1e-9
        assert abs(r["near_edited"] - w["near_edited"]) < 0.2 and abs(r["near_next"] - w["near_next"]) < 0.2
    fps = {k: brute.simhash(t) for k, t in docs}
    linked = brute.linked(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op7_simhash(spark, small).collect()}
    assert got == {k: (f"{f:016x}", linked[k]) for k, f in fps.items()}
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op9_token_output(spark, small).collect()}
    assert got == brute.tokens(docs, tokenizing.default_path(), 1)
    counted = {r["doc_id"]: r["n_tokens"] for r in queries.op2_separator_scan(spark, small).collect()}
    assert counted == {k: n for k, (_, n, _) in got.items()}


def test_toxicity_query_is_right_on_held_out_documents(spark, small):
    import zlib

    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    rows = queries.op4_toxicity(spark, small).collect()
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    judged = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in judged) >= 0.9 * len(judged)


def test_mixing_query_takes_what_is_due(spark, small):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    size = {k: len([w for w in re.split(r"[\x20\x09-\x0D]+", r["text"] or "") if w]) for k, r in docs.items()}
    names = sorted({r["source"] for r in docs.values()}, key=lambda x: (x is None, x or ""))
    sizes = [sum(size[k] for k, r in docs.items() if r["source"] == n) for n in names]
    due = dict(zip(names, brute.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(sizes), 2.0), strict=True))
    rows = queries.op6_mixing(spark, small).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    taken = dict.fromkeys(names, 0)
    for r in rows:
        source = docs[r["doc_id"]]["source"]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sizes[names.index(source)]) and abs(r["target"] - due[source]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["taken"] > 0) == bool(r["shards"])
        taken[source] += r["taken"]
    assert all(abs(taken[n] - due[n]) <= 1 for n in names)
    assert sorted(map(tuple, queries.op6_mixing(spark, small).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialise(stage(spark, docs, small), "stage")
        last = k == len(corpus_pipeline.STAGES) - 1
        assert (docs.columns == columns) != last
        if k < 3:
            assert 0.5 * before < docs.count() <= before
            before = docs.count()
    assert docs.count() > 0
