"""Nulls in every column, clashing column names, repeated rows and ids: every operator gives a defined result."""

import pytest

import corpus_pipeline
from loomgraph.llm import license_scan, near_dedup, packing, pieces, quality_model, quality_rules, secret_scan, suffix_dedup, token_counts, vector_dedup

LONG = "the quick brown fox jumps over the lazy dog " * 3
SCHEMA = "doc_id long, text string, found string, _row string, sha string, component_id long, n_chars long, start long, _id long, kept boolean, labels string"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(None, LONG + "password=abcdefgh1 all rights reserved"), (None, None), (1, LONG), (1, LONG), (2, LONG), (3, None), (3, ""), (4, "unlike " * 40), (5, "Token: 'abcdefghij' cc by")]
    return spark.createDataFrame([(i, t, "f", None, "s", 7, len(t or ""), 0, 1, True, None) for i, t in texts], SCHEMA).repartition(3)


def test_a_row_each(docs):
    n = docs.count()
    for out in (
        license_scan.digest(docs),
        quality_rules.apply_policy(quality_rules.ledger(docs)),
        secret_scan.digest(docs),
        pieces.digest(docs),
        token_counts.digest(docs),
        suffix_dedup.digest(docs),
        near_dedup.near_duplicates(docs),
        quality_model.score(docs, quality_model.Ensemble()),
    ):
        rows = out.collect()
        assert len(rows) == n and sorted((r.doc_id is None, r.doc_id) for r in rows if r.doc_id is not None)[0][1] == 1
        assert sum(r.doc_id is None for r in rows) == 2
    assert {r.doc_id for r in packing.pack(docs).collect()} == {None, 1, 2, 3, 4, 5}


def test_null_ids_count(docs):
    assert {r.n_assign for r in secret_scan.digest(docs).filter("doc_id is null").collect()} == {0, 1}
    assert {r.labels for r in license_scan.digest(docs).filter("doc_id is null").collect()} == {"", "all-rights-reserved,reserved"}
    gone = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.digest(docs).collect()}
    assert gone[1, len(LONG)] == 0 and gone[2, len(LONG)] == len(LONG) and gone[None, len(LONG) + 38] == len(LONG)


def test_repeated_rows_with_secrets(spark):
    text = "password=abcdefgh1 and token=abcdefgh22 end"
    for i in (1, None):
        docs = spark.createDataFrame([(i, text)] * 3, "doc_id long, text string").repartition(3)
        rows = secret_scan.digest(docs).collect()
        assert [(r.n_assign, r.spans) for r in rows] == [(2, "assign:0:18,assign:23:39")] * 3
        assert [r.text for r in secret_scan.redact(docs).collect()] == ["[assign] and [assign] end"] * 3


def test_stages_keep_columns(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for at in (docs, docs.limit(0)):
            out = stage(spark, at, "")
            assert out.columns == docs.columns
            out.collect()
    text = {r.doc_id: (r.text, r.n_chars, r.found) for r in secret_scan.redact(docs).filter("doc_id = 5").collect()}
    assert text == {5: ("[assign]' cc by", 15, "f")}


def test_vectors(spark):
    rows = [(None, [1.0, 0.0], 1, 5), (None, None, None, 5), (1, [1.0, 0.0], 1, 5), (1, [1.0, 0.0], 1, 5), (2, [1.0, 0.001], 1, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links long")
    out = vector_dedup.near_duplicates(df).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in out) == [(0, 0, 0), (0, 3, 1), (1, 3, 1), (1, 3, 1), (2, 3, 1)]
    nameless = spark.createDataFrame([(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (None, [1.0, 0.001], 1), (7, [0.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.n_links, r.component_id or 0, r.kept) for r in vector_dedup.near_duplicates(nameless).collect()) == [(0, 7, True), (2, 0, True), (2, 0, True), (2, 0, True)]
