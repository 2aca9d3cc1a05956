"""Shingling of batches against plain words."""

import brute
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from locusframe.llm import near_duplicates

TEXT = st.one_of(st.none(), st.text(st.sampled_from("aAbB \t\n\x0b\x1c\x85Éé　\U0001f600"), max_size=40))


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=8), st.integers(1, 5), st.integers(0, 3))
def test_shingles_of_batches(texts, size, skip):
    got = near_duplicates.shingle_sets(pa.array(["x y", *texts], pa.string())[min(skip, len(texts)) :], size)
    want = [brute.shingles(t, size) for t in ["x y", *texts][min(skip, len(texts)) :]]
    assert [len(h) for h in got] == list(map(len, want))
    for g, w in zip(got, want, strict=True):
        for h, v in zip(got, want, strict=True):
            assert len(np.intersect1d(g, h)) == len(w & v)


def test_long_texts_in_pieces():
    text = " ".join("w" * (i % 70) + str(i % 1000) for i in range(40_000)) + " " + "z" * 100_000 + " end"
    raw = np.frombuffer(text.encode(), np.uint8)
    whole, _ = near_duplicates.word_hashes(raw, np.array([0, len(raw)]))
    parts = [near_duplicates.word_hashes(x, np.array([0, len(x)]))[0] for x in near_duplicates._pieces(raw, 5_000)]
    assert len(parts) > 100 and (np.concatenate(parts) == whole).all() and len(whole) == 40_002
