"""Rows that repeat a doc_id with another text: each is a set of its own, in whatever order rows come."""

import pytest

from locusframe.llm import near_duplicates

A = " ".join(f"a{i}" for i in range(60))
NEAR = A.replace("a59", "other")
B = " ".join(f"b{i}" for i in range(60))
ROWS = [(5, A, "en"), (5, B, "en"), (6, NEAR, "en"), (7, "", "en"), (7, "", "en"), (None, A, "fr"), (8, B, "en"), (8, B, "en")]


@pytest.mark.parametrize("order", [1, -1])
def test_repeated_doc_ids(order, spark):
    docs = spark.createDataFrame(ROWS[::order], "doc_id long, text string, row string")
    got = near_duplicates.near_duplicates(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in got) == [(0, 58, None), (5, 58, 5), (5, 58, 5), (6, 58, 5), (7, 0, 7), (7, 0, 7), (8, 58, 5), (8, 58, 5)]
    kept = near_duplicates.first_of_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, A), (5, A), (5, B), (7, "")]
