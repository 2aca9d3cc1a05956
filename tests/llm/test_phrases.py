"""Collocations against a plain version, on random texts of few words and on the smallest tables."""

import random
import re
from collections import Counter

import pytest

from locusframe.llm import phrases

R = random.Random(11)
WORDS = "the a of new york times It is's Été \x00 -".split(" ")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain(rows, longest, least, top, inside=80):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang or "und", tuple(words[i : i + size])] += 1
    out = []
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for lang in n:
        found = []
        for (at, p), a in candidates.items():
            if at != lang:
                continue
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in candidates.items() if x == lang):
                continue
            score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def texts(n):
    return [(R.choice(["", " ", "\t"]).join(R.choice(WORDS) + R.choice([" ", "  ", " ", "\n", ". ", ","]) for _ in range(R.randint(0, 60))), R.choice(["en", "fr", None, "und"])) for _ in range(n)]


@pytest.mark.parametrize(("longest", "least", "top"), [(4, 5, 2000), (3, 3, 7), (2, 4, 50), (5, 6, 20)])
def test_random_texts(longest, least, top, spark):
    rows = [*texts(120), (None, "en"), ("", None), ("new york times " * 50, "en")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    got = sorted(tuple(r) for r in phrases.collocations(docs, longest, least, top).collect())
    assert got == plain(rows, longest, least, top)


def test_query_and_empty_table(spark, sf_dir, tmp_path):
    rows = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = phrases.op12_collocations(spark, sf_dir)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 4, 30, 2000)
    spark.createDataFrame([], "doc_id long, text string, lang string, f int").write.parquet(f"{tmp_path}/documents.parquet")
    assert phrases.op12_collocations(spark, str(tmp_path)).collect() == []


def test_a_full_map_changes_nothing(spark, monkeypatch):
    """Where every digest is marked, all phrases are counted, and the result is the same."""
    rows = texts(60)
    docs = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(phrases, "frequent_map", lambda found: phrases.np.full(1 << (phrases.BITS - 6), 2**64 - 1, phrases.np.uint64))
    assert sorted(tuple(r) for r in phrases.collocations(docs, 4, 4, 100).collect()) == plain(rows, 4, 4, 100)
