"""The operators' queries against plain versions: on the smallest tables, and on tables of edge cases."""

import hashlib
import zlib

import brute
import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from locusframe.llm import bpe, chat, embedding_join, language, licenses, mixing, near_duplicates, quality, token_blocks, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long, words string, label string"
BASE = "the cat sat on the mat and it was a fine day for all of them with the sun in the sky over this old town "


def near_copies(n=60):
    words = [f"w{i}" for i in range(n)]
    return " ".join(words), " ".join([*words[:-1], "other"]), " ".join([*words[:20], "x", *words[21:40], "y", *words[41:]])


def edge_documents():
    a, near, far = near_copies()
    texts = [
        None, "", " \t\n", "word", "two words", "\u00dcber \u00c9t\u00e9 \u4f60\u597d \u2028 \u3000 x", BASE * 3, BASE * 3, BASE.upper() * 3, "same line\n" * 40,
        a, near, far, a + " ", "Under the MIT License!\nApache License, Version 2.0\ncc-by-nc", "under the mit\nlicense under the mit license",
        "#*$%&|<> " * 30, "12345 67890", "<|endoftext|> it's <|endoftext|>", "x" * 70_000, BASE * 2_000, "a\x1cb\x85c\xa0d " * 12,
    ]
    langs, sources = ["en", "fr", None], ["web", None, "code", "forum"]
    rows = [(i if i != 5 else 1_000_000, t, langs[i % 3], sources[i % 4], 1, "clash", "clash") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    """A folder of tables with edge cases, one of empty tables."""
    folder, empty = tmp_path_factory.mktemp("edges"), tmp_path_factory.mktemp("empty")
    vec = [(i, v, lab) for i, (v, lab) in enumerate([(None, 1), ([], 1), ([0.0, 0.0], 1), ([1.0, None], 1), ([float("nan"), 1.0], 1), ([1.0, 0.0], None), ([1.0, 0.0], 1), ([1.0, 0.0], 1), ([2.0, 0.1], 1), ([0.0, 1.0], 1), ([1.0, 0.0], 2), ([1.0, 0.0, 0.0], 1)])]
    made = {
        "documents": (edge_documents(), DOC),
        "conversations": ([(1, 0, "user", None), (1, 1, "assistant", "a</s>b<\\s>c"), (1, 1, "assistant", "tie"), (1, 1, "assistant", "tie"), (None, 0, None, "x"), (2, None, "tool:x]", "[ROLE:y]"), (2, 3, "assistant", "q" * 50_000), (3, 0, "system", "<<SYS>>[/INST]")], "conv_id long, turn long, role string, text string"),
        "pages": ([(0, None, "h"), (1, "", "h"), (2, "http://a.com/x?y#z", "h"), (3, "https://WWW.Example.com/en/p", "h"), (4, "http://example.com/en/", "h"), (5, "x.net/es/", "h"), (6, "ftp://b.net/fr/q", "h"), (7, "http://bnet/fr/", "h"), (8, "http://c.org\n/p://q", "h"), (9, "http://c.org?u=/en/", "h")], "page_id long, url string, html string"),
        "embeddings": (vec, "vec_id long, embedding array<float>, label int"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
        spark.createDataFrame([], schema).write.parquet(f"{empty}/{name}.parquet")
    return str(folder), str(empty)


@pytest.fixture(params=["edges", "given"])
def folder(request, edges, sf_dir):
    return edges[0] if request.param == "edges" else sf_dir


def collected(df, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) for r in df.collect()}


def texts_of(spark, folder):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


QUERIES = [chat.op1_chat_format, language.op2_language_id, licenses.op3_license_scan, near_duplicates.op4_jaccard_join, embedding_join.op5_embedding_join, url_filter.op6_url_filter, token_blocks.op7_token_blocks, bpe.op8_bpe, quality.op9_quality_rules, mixing.op10_mix_sources]


@pytest.mark.parametrize("query", QUERIES, ids=lambda q: q.__name__)
def test_empty_tables(query, spark, edges):
    assert query(spark, edges[1]).count() == (query is chat.op1_chat_format)


def test_chat_format(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    trial = "</s>[INST] ok [/INST]"
    want = brute.chats([*rows, (-7, 0, "user", trial), (-7, 1, "assistant", trial)])
    assert collected(chat.op1_chat_format(spark, folder), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == want


def test_chat_fold(spark):
    log = [
        (1, 0, "message", "m0", "user", "hi"), (1, 1, "message", "m1", "assistant", "he"), (1, 2, "delta", "m1", None, "llo"), (1, 3, "message", "m2", "user", "later"),
        (1, 4, "regenerate", "m1", None, None), (1, 5, "delta", "m1", None, "again"), (1, 6, "edit", "m0", None, "hey"), (2, 0, "message", "z", "user", "ok"),
    ]
    messages = chat.fold(spark.createDataFrame(log, "conv_id long, seq long, kind string, message_id string, role string, text string"))
    assert {(r["conv_id"], r["message_id"], r["role"], r["text"]) for r in messages.collect()} == {(1, "m0", "user", "hey"), (1, "m1", "assistant", "again"), (2, "z", "user", "ok")}
    whole = collected(chat.assemble(chat.render(messages)), "conv_id", "formatted", "loss_spans")
    text, spans = whole[1]
    assert text == "[INST]hey[/INST]<s>again</s>" and [text[s["start"] : s["end"]] for s in spans] == ["again"] and whole[2][1] == []


def test_language_id(spark, sf_dir, edges):
    got = collected(language.op2_language_id(spark, sf_dir), "doc_id", "held_out", "lang_pred", "score")
    true = {r["doc_id"]: (r["text"], r["lang"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all(got[d][0] == brute.held_out(d) and 0 <= got[d][2] <= 1 for d in true)
    asked = [d for d, (text, lang) in true.items() if got[d][0] and lang and text and len(text) > 50]
    assert asked and sum(got[d][1] == true[d][1] for d in asked) >= 0.95 * len(asked)
    odd = collected(language.op2_language_id(spark, edges[0]), "doc_id", "lang_pred")
    assert len(odd) == len(edge_documents()) and odd[0] == odd[1] == odd[17] == ("und",) and odd[3][0] in ("en", "fr")


def test_language_counts_in_pieces(monkeypatch):
    text = "".join(chr(97 + i * i % 26) for i in range(500))
    whole = language.counts(text)
    monkeypatch.setattr(language, "PIECE", 37)
    assert (language.counts(text) == whole).all()


def test_license_scan(spark, folder):
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    found = licenses.op3_license_scan(spark, folder).collect()
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in found} == {d: brute.licenses(t) for d, t in texts_of(spark, folder).items()}
    templates = [(label, set(t.split())) for label, t in licenses.TEMPLATES]
    texts = texts_of(spark, folder)
    for r in found:
        want = set(filter(None, r["base_labels"].split(",")))
        words = brute.LICENSE_WORD.findall((texts[r["doc_id"]] or "").translate(brute.LOWER))
        for (label, t), (_, text) in zip(templates, licenses.TEMPLATES, strict=True):
            run = licenses.run_of(len(text.split()))
            if any(len(t & set(words[i : i + run])) >= licenses.need(len(t)) for i in range(max(1, len(words) - run + 1))):
                want.add(label)
        assert r["labels"] == ",".join(sorted(want)) and 0 <= r["score"] <= 1


def test_jaccard_join(spark, folder):
    got = collected(near_duplicates.op4_jaccard_join(spark, folder), "doc_id", "n_shingles", "component_id")
    assert got == brute.jaccard_components(texts_of(spark, folder))


def test_jaccard_join_of_chains(spark, tmp_path):
    """Families of near copies around the threshold: some link directly, some by way of others."""
    rng = np.random.default_rng(11)
    rows = []
    for n in (12, 25, 60, 150, 400):
        words = [f"w{x}" for x in rng.integers(0, 500, n)]
        for _ in range(14):
            rows.append(" ".join(words))
            words = list(words)
            for at in rng.integers(0, n, max(1, n // 70)):
                words[at] = f"v{rng.integers(0, 10**6)}"
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = brute.jaccard_components(dict(enumerate(rows)))
    assert 5 < len({c for _, c in want.values()}) < len(rows)
    assert collected(near_duplicates.op4_jaccard_join(spark, str(tmp_path)), "doc_id", "n_shingles", "component_id") == want


def test_embedding_join(spark, folder):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert collected(embedding_join.op5_embedding_join(spark, folder), "vec_id", "n_links", "component_id", "kept") == brute.cosine_components(rows)


def test_url_filter(spark, folder):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = collected(url_filter.op6_url_filter(spark, folder), "page_id", "host", "path", "rule", "verdict")
    assert set(got) == set(urls)
    for page, url in urls.items():
        host, path, rule, verdict = brute.url_rule(url)
        assert got[page][:3] == (host, path, rule), url
        assert got[page][3] == verdict or (verdict is None and got[page][3] in ("allow", "block"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def test_token_blocks(spark, folder, library):
    want, start = {}, 0
    for d, t in sorted(texts_of(spark, folder).items()):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert collected(token_blocks.op7_token_blocks(spark, folder), "doc_id", "start", "n_tokens", "ids_crc32") == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=600), st.integers(0, 600), st.integers(0, 600))
def test_blocks_round_trip(ids, lo, hi):
    x = np.array(ids, np.uint32)
    data = token_blocks.pack(x)
    assert (token_blocks.unpack(data) == x).all() and (token_blocks.unpack(data, lo, hi) == x[lo:hi]).all()


def test_bpe(spark, folder, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for d, t in texts_of(spark, folder).items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert collected(bpe.op8_bpe(spark, folder), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_quality_rules(spark, folder):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = collected(quality.op9_quality_rules(spark, folder), "doc_id", *names, "kept")
    assert {d: g[:-1] for d, g in got.items()} == {d: brute.quality(t) for d, t in texts_of(spark, folder).items()}
    assert not any(g[-1] and g[-2] for g in got.values())


def test_quality_rules_replace_columns_of_the_same_name(spark):
    docs = spark.createDataFrame([(1, BASE * 2, "own", 7)], "doc_id long, text string, q_n_words string, other int")
    row = quality.apply_rules(docs).first()
    assert row["q_n_words"] == len(brute.WORD.findall(BASE * 2)) and row["other"] == 7


def test_mix_sources(spark, folder):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    size, total, taken_of = {}, {}, {}
    for d, text, source in rows:
        size[d] = len(brute.WORD.findall(text or ""))
        total[source] = total.get(source, 0) + size[d]
    target = brute.mix_targets(total)
    got = collected(mixing.op10_mix_sources(spark, folder), "doc_id", "size", "source_size", "target", "taken")
    for d, _, source in rows:
        own, whole, aim, taken = got[d]
        assert (own, whole) == (size[d], total[source]) and aim == pytest.approx(float(target[source]), rel=1e-12)
        assert taken in {own * int(aim // whole), own * (int(aim // whole) + 1)} if whole else taken == 0
        assert taken <= 2 * own
        taken_of[source] = taken_of.get(source, 0) + taken
    assert got == collected(mixing.op10_mix_sources(spark, folder), "doc_id", "size", "source_size", "target", "taken")


def test_mix_sources_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    want = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.OP10_SQL})").fetchall()}
    assert collected(mixing.op10_mix_sources(spark, sf_dir), "doc_id", "size", "source_size", "target", "taken") == want


def test_rare_labels_are_learned(spark):
    rows = [(i, "abc " * 5, "x") for i in range(6)] + [(10 + i, "qqq " * 5, "y") for i in range(4)] + [(20, "zzz", "z")]
    assert language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).names == ["x", "y", "z"]


def test_language_model_against_plain_bayes(spark, sf_dir):
    """Every n-gram of every document counted plainly, in double precision."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    grams = lambda t: [int(b) for b in language.buckets(t.lower())]
    total = {}
    for d, text, lang in rows:
        if lang is not None and not brute.held_out(d) and language.has_letter(text):
            own = total.setdefault(lang, [language.ALPHA] * language.BUCKETS)
            for b in grams(text):
                own[b] += 1
    logs = {lang: np.log(np.array(c) / sum(c)) for lang, c in sorted(total.items())}
    got = collected(language.op2_language_id(spark, sf_dir), "doc_id", "lang_pred", "score")
    for d, text, _ in rows:
        if language.has_letter(text):
            at = grams(text)
            scores = {lang: x[at].sum() for lang, x in logs.items()}
            best = max(scores, key=scores.get)
            share = 1 / sum(np.exp(v - scores[best]) for v in scores.values())
            assert got[d][0] == best and got[d][1] == pytest.approx(share, abs=1e-3), d
        else:
            assert got[d] == ("und", 0.0)
