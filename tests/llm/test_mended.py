"""Cases that operators got wrong once: repeated and null ids, doubles at their ends, labels and draws, clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from locusframe.llm import bpe, embedding_join, language, licenses, mixing, quality, url_filter


def vectors(spark, rows):
    got = embedding_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got.collect()), key=repr)


def test_repeated_ids_have_links_of_their_own(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.1], 0), (3, [0.1, 1.0], 0), (4, [0.1, 1.01], 0)]
    assert vectors(spark, rows) == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False)]


def test_null_ids_link(spark):
    rows = [(None, [1.0, 0.0], 0), (7, [1.0, 0.01], 0), (None, [0.0, 1.0], 0), (None, [0.0, 1.0], 0), (None, None, 0)]
    assert vectors(spark, rows) == sorted([(None, 1, 7, False), (7, 1, 7, True), (None, 1, None, False), (None, 1, None, False), (None, 0, None, False)], key=repr)


def test_doubles_at_their_ends_link(spark):
    rows = [(1, [1e200, 0.0], 0), (2, [1e200, 1e198], 0), (3, [1e-200, 1e-203], 0), (4, [5e-324, 0.0], 0), (5, [0.0, 1.7e308], 0), (6, [1.0, 1.7e308], 0)]
    assert vectors(spark, rows) == [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 3, 1, False), (5, 1, 5, True), (6, 1, 5, False)]


def test_a_draw_bounds_rows_that_share_an_id(spark):
    rows = [(k, f"the cat number {i} sat on the mat", "en") for i in range(6000) for k in (None, 7)]
    rows += [(7, "le chat est ici avec son ami", "fr")] * 6000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    seen = []
    real = language.counts
    model = language.train(df, 500)
    assert model.names == ["en", "fr"] and real is language.counts and not seen
    assert [r["lang_pred"] for r in language.predict(df.filter("lang = 'fr'").limit(2), model).collect()] == ["fr", "fr"]
    pages = spark.createDataFrame([(i, None if i % 2 else f"http://a{i}.com/x") for i in range(12000)], "page_id long, url string")
    d = url_filter.labelled(pages, (), F.when(F.col("page_id") % 3 == 0, F.col("page_id") % 2))
    held = []
    keep = url_filter.keep
    url_filter.keep = lambda df, name: held.append(keep(df, name)) or held[-1]
    try:
        url_filter.fit(d, 1000)
    finally:
        url_filter.keep = keep
    assert 500 < held[0].count() < 1500


def test_more_labels_than_are_scored_together(spark, monkeypatch):
    rng = np.random.default_rng(1)
    names = [f"l{k:03}" for k in range(150)]
    words = {n: ["".join(chr(97 + x) for x in rng.integers(0, 26, 5)) for _ in range(6)] for n in names}
    rows = [(i, " ".join(words[n]), n) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    assert model.names == names
    whole = model.score([r[1] for r in rows])
    assert whole[0] == names
    monkeypatch.setattr(language, "ENTRIES", 64)
    monkeypatch.setattr(language, "TOGETHER", 7)
    again = model.score([r[1] for r in rows])
    assert again[0] == names and again[1] == pytest.approx(whole[1])
    monkeypatch.setattr(language, "ROOM", 100)
    with pytest.raises(ValueError, match="languages"):
        language.train(df)


def test_scattered_words_in_one_line_are_no_notice(spark):
    notice = dict(licenses.TEMPLATES)["mit"].split()
    rows = [(1, " ".join(w + " x" * 40 for w in notice)), (2, "y " * 500 + " ".join(notice) + " z" * 500), (3, " ".join(notice)), (4, None)]
    got = {r["doc_id"]: {m["label"] for m in r["matches"]} for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: set(), 2: {"mit"}, 3: {"mit"}, 4: set()}


def test_clashing_names(spark):
    rows = [(i, f"the quick brown fox jumps over the lazy dog {i} " * 3, "en", "web", 7, 7, 7, 7, 7, "mine") for i in range(50)]
    schema = "doc_id long, text string, lang string, source string, __size int, __source_size int, __target int, __copy int, __Q_words int, lang_pred string"
    df = spark.createDataFrame(rows, schema)
    ruled = quality.apply_rules(df)
    assert {r["__Q_words"] for r in ruled.collect()} == {7} and ruled.columns[: len(df.columns)] == df.columns
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and {tuple(r)[4:] for r in mixed.collect()} == {(7, 7, 7, 7, 7, "mine")}
    staged = corpus_pipeline.language_stage(spark, df, "")
    assert staged.columns == df.columns and {r["lang_pred"] for r in staged.collect()} == {"mine"}


@pytest.mark.parametrize("few", [50_000, 0])
def test_mixing_moves_no_text_by_source(few, spark, monkeypatch):
    monkeypatch.setattr(mixing, "FEW", few)
    rows = [(i, f"some words of text {i}", None if i % 5 == 0 else f"s{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mixed = mixing.mix(df)
        plan = mixed._jdf.queryExecution().executedPlan().toString()
        got = sorted(tuple(r) for r in mixed.select("doc_id", "text").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert ("Exchange hashpartitioning" in plan) == (few == 0)
    monkeypatch.setattr(mixing, "FEW", 50_000)
    assert got == sorted(tuple(r) for r in mixing.mix(df).select("doc_id", "text").collect()) and got


def test_long_pieces_are_forgotten(monkeypatch):
    known = {}
    texts = ["x" * 5000 + " short " + "y" * 5000, "x" * 5000]
    path = bpe.vocabulary_path()
    first = list(bpe._encoded(texts, path, known))
    assert first == list(bpe._encoded(texts, path, known)) and known and max(map(len, known)) <= bpe.LONG
