"""Near duplicates at other shingles and thresholds than op4's: the pipeline's stage and the spare segments."""

import brute
import numpy as np
import pytest

import corpus_pipeline
from locusframe.llm import near_duplicates

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stage_links_scattered_changes(spark, tmp_path):
    """Of 100, 200 and 400 words, one in 50 changed: similar by five words and 80 per cent, not by op4's contract."""
    rows = []
    for k, n in enumerate((100, 200, 400)):
        words = [f"w{k}_{i}" for i in range(n)]
        changed = [f"x{k}_{i}" if i % 50 == 25 else w for i, w in enumerate(words)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(changed))]
    docs = spark.createDataFrame([(d, x, "en", "web", len(x)) for d, x in rows], DOCS)
    assert len({c for _, c in brute.jaccard_components(dict(rows)).values()}) == 6
    want = {d for d, (_, c) in brute.jaccard_components(dict(rows), 5, 80).items() if c == d}
    assert want == {0, 2, 4}
    assert {r["doc_id"] for r in corpus_pipeline.duplicate_stage(spark, docs, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("t", [80, 95])
def test_no_bucket_is_spared_that_is_needed(t, spark):
    """Families around the threshold, and pairs of sets of 62 with 61 in common whose odd shingles fall in two segments."""
    rng = np.random.default_rng(7)
    rows = []
    for n in (16, 30, 64, 100, 140, 300):
        words = [f"w{x}" for x in rng.integers(0, 10**6, n)]
        for _ in range(10):
            rows.append(" ".join(words))
            words = list(words)
            for at in rng.integers(0, n, max(1, n * (100 - t) // 1000)):
                words[at] = f"v{rng.integers(0, 10**6)}"
    for k in range(40):
        words = [f"p{k}_{i}" for i in range(62)]
        rows += [" ".join(words), " ".join([*words[:-1], "odd"])]
    got = near_duplicates.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), 1, t).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.jaccard_components(dict(enumerate(rows)), 1, t)


def test_odd_pivots_leave_few_pairs(spark, monkeypatch):
    """200 copies of 120 words with two of them changed, a few with 20, and pivots that link with none of them."""
    rng = np.random.default_rng(3)
    words, rows = [f"w{i}" for i in range(120)], []
    for k in range(200):
        changed = list(words)
        for at in rng.permutation(120)[: 20 if k % 40 == 0 else 2]:
            changed[at] = f"v{rng.integers(0, 10**6)}"
        rows.append(" ".join(changed))
    left, remaining = [], near_duplicates.remaining

    def counted(*args):
        pairs = remaining(*args)
        left.append(pairs.count())
        return pairs

    monkeypatch.setattr(near_duplicates, "pivots", lambda rows, *_: rows.limit(0).selectExpr("doc AS a", "doc AS b"))
    monkeypatch.setattr(near_duplicates, "remaining", counted)
    got = near_duplicates.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), 1, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.jaccard_components(dict(enumerate(rows)), 1, 80)
    assert sum(left) < 5 * len(rows)


def test_groups_of_few_sets_draw_nothing(spark, monkeypatch):
    """Ten texts of 100 words and a partner of each that shares buckets with it but isn't linked: no set is drawn at random for them."""
    rows, drawn, calls = [], near_duplicates.drawn, []
    for k in range(10):
        words = [f"w{k}_{i}" for i in range(100)]
        rows += [" ".join(words), " ".join(f"v{k}_{i}" if i % 8 == 0 else w for i, w in enumerate(words))]

    def counted(left, *args):
        calls.append(left.count())
        return drawn(left, *args)

    monkeypatch.setattr(near_duplicates, "drawn", counted)
    got = near_duplicates.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), 1, 80).collect()
    want = brute.jaccard_components(dict(enumerate(rows)), 1, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len({c for _, c in want.values()}) == len(rows)
    assert not calls


def test_texts_not_wanted_stay_out(spark):
    docs = spark.range(-3000, 3000).selectExpr("id * 1000003 AS doc_id", "string(id) AS text").unionByName(spark.sql("SELECT CAST(NULL AS long) AS doc_id, 'x' AS text"))
    wanted = docs.filter("doc_id % 100 = 0").selectExpr("doc_id AS of_id")
    got = {r["doc_id"] for r in near_duplicates.perhaps(docs, wanted).collect()}
    ids = {k * 1000003 for k in range(-3000, 3000, 100)}
    assert ids <= got and len(got) < len(ids) + 30
