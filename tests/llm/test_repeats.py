"""Substring dedup against a plain version: planted passages, repeats within a text, nulls, repeated ids, odd windows."""

import hashlib
import random
import re

import pytest

from locusframe.llm import repeats

R = random.Random(3)
WORDS = [f"w{i}" for i in range(400)]
PASSAGE = " ".join(R.choice(WORDS) for _ in range(55))


def text(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


COPY = text(90)
ROWS = [
    (1, text(30) + " " + PASSAGE + "\n" + text(12), "x"), (2, PASSAGE, "x"), (3, text(8) + "\t" + PASSAGE.replace(" ", "  ") + " end", "y"), (4, COPY, "z"), (9, COPY, "z"), (9, COPY, "z"), (None, COPY + " more", None),
    (5, None, "x"), (6, "", "x"), (7, " \n", "x"), (8, "a b " * 30, "x"), (10, "a b " * 7, "x"), (11, text(19), "x"), (12, "same " * 200, "x"), (13, "É " * 25 + "Same " * 19, "x"), (-4, " ".join(PASSAGE.split()[20:]), "n"),
]


def plain(rows, window):
    """Words of each row (in order of doc_id, nulls last) and whether each goes."""
    cut = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))]
    seen, out = set(), []
    for i, words in cut:
        gone = [False] * len(words)
        for at in range(len(words) - window + 1):
            k = tuple(words[at : at + window])
            if k in seen:
                gone[at : at + window] = [True] * window
            seen.add(k)
        out.append((i, words, gone))
    return out


@pytest.mark.parametrize("window", [20, 7, 1, 2])
@pytest.mark.parametrize("order", [1, -1])
def test_removed_words(window, order, spark):
    docs = spark.createDataFrame(ROWS[::order], "doc_id long, text string, number string").repartition(3)
    got = sorted((repr(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in repeats.without_repeats(docs, window).collect())
    assert got == sorted((repr(i), len(w), sum(g), " ".join(x for x, y in zip(w, g, strict=True) if not y)) for i, w, g in plain(ROWS, window))


def test_query_on_tables(spark, sf_dir, tmp_path):
    rows = [(r["doc_id"], r["text"], None) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {i: (len(w), sum(g), hashlib.sha256(" ".join(x for x, y in zip(w, g, strict=True) if not y).encode()).hexdigest()) for i, w, g in plain(rows, 20)}
    got = repeats.op13_substring_dedup(spark, sf_dir)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert repeats.op13_substring_dedup(spark, str(tmp_path)).collect() == []


def test_doubling_until_none_repeats(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, extra string")
    got = sorted((repr(r["doc_id"]), r["length"], r["first_word"], r["last_word"]) for r in repeats.repeat_lengths(docs, 10).collect())
    want, length = [], 10
    texts = plain(ROWS, 10)
    while True:
        often = {}
        for _, words, _ in texts:
            for at in range(len(words) - length + 1):
                k = tuple(words[at : at + length])
                often[k] = often.get(k, 0) + 1
        level = []
        for i, words, _ in texts:
            inside = [False] * (len(words) + 1)
            for at in range(len(words) - length + 1):
                if often[tuple(words[at : at + length])] > 1:
                    inside[at : at + length] = [True] * length
            at = 0
            while at < len(words):
                if inside[at]:
                    end = inside.index(False, at)
                    level.append((repr(i), length, at, end - 1))
                    at = end
                at += 1
        if not level:
            break
        want += level
        length *= 2
    assert length > 80
    assert got == sorted(want)
