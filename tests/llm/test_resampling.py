"""Importance resampling against a plain version, for single words and for longer n-grams."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from locusframe.llm import resampling

R = random.Random(5)
WORDS = ["the", "Cat", "Über", "42", "x y", "sat", "on"]
TARGET = [("The cat sat on the cat",), (None,), ("",), ("42 x",)]


def rows():
    out = [(i, R.choice([" ", "-", "\n"]).join(R.choice(WORDS) for _ in range(R.randint(0, 60)))) for i in range(90)]
    return [*out, (None, "the cat " * 15), (None, "the cat " * 15), (7, "sat " * 30), (200, None), (201, ""), (202, "!?"), (-3, "x " * 5000)]


def plain(docs, target, orders, buckets, percent, least, seed="2024"):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(orders[0], orders[1] + 1) for i in range(len(w) - n + 1)]

    own, aim = Counter(b for _, t in docs for b in features(t)[1]), Counter(b for (t,) in target for b in features(t)[1])
    s, t = sum(own.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((own[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        n, f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    can = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = can[: percent * len(can) // 100]
    ranked = [(*r, k) for k, r in enumerate(drawn, 1)]
    for r in drawn:
        out.remove(r)
    return sorted(ranked + [(*r, None) for r in out], key=repr)


@pytest.mark.parametrize(("orders", "buckets", "percent", "least"), [((1, 1), 10_000, 10, 20), ((1, 2), 97, 50, 20), ((2, 4), 1000, 100, 1), ((1, 1), 3, 0, 5)])
def test_against_plain(orders, buckets, percent, least, spark):
    docs = rows()
    d = spark.createDataFrame([(*r, 1.0) for r in docs], "doc_id long, text string, score double").repartition(4)
    t = spark.createDataFrame(TARGET, "text string")
    got = resampling.ranked(d, t, orders, buckets, percent, least)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(docs, TARGET, orders, buckets, percent, least)


def test_rows_drawn_keep_all_columns(spark):
    docs = [(i, t, i * 2) for i, t in rows() if i is not None and not (i == 7 and t.startswith("sat"))]
    d = spark.createDataFrame(docs, "doc_id long, text string, rank long")
    got = resampling.resampled(d, spark.createDataFrame(TARGET, "text string"), percent=30)
    want = {r[0] for r in plain([r[:2] for r in docs], TARGET, (1, 1), 10_000, 30, 20) if r[-1]}
    assert got.columns == d.columns
    assert sorted(map(tuple, got.collect())) == sorted(r for r in docs if r[0] in want)


def test_empty_tables(spark):
    none, t = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(TARGET, "text string")
    assert resampling.ranked(none, t).collect() == []
    docs = spark.createDataFrame([(1, "a b " * 30)], "doc_id long, text string")
    assert [tuple(r) for r in resampling.ranked(docs, t.limit(0), percent=100).collect()] == [tuple(plain([(1, "a b " * 30)], [], (1, 1), 10_000, 100, 20)[0])]
