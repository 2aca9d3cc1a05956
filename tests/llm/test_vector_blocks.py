"""The embedding join with many blocks a label, with double vectors, and blocks against one matrix product."""

import brute
import numpy as np
import pytest

from locusframe.llm import embedding_join


def made(n, dims=12):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(n // 6, dims)) + 1.5
    x = np.concatenate([base, *(base + rng.normal(size=base.shape) * s for s in (0.05, 0.2, 0.35, 0.4, 0.5))])
    return [(i, [float(v) for v in row], int(i % 3 == 0)) for i, row in enumerate(x)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_many_blocks(kind, spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "BLOCK", 16)
    rows = made(420)
    got = embedding_join.near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")).collect()
    plain = brute.cosine_components(rows)
    assert 20 < len({c for _, c, _ in plain.values()}) < len(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == plain


def test_double_vectors_are_not_rounded(spark):
    """The cosine lies above the threshold by less than floats can tell."""
    a = np.array([1.0, 0.0])
    b = np.array([0.93 + 1e-12, (1 - (0.93 + 1e-12) ** 2) ** 0.5])
    c = np.array([0.93 - 1e-12, (1 - (0.93 - 1e-12) ** 2) ** 0.5])
    rows = [(1, a.tolist(), 1), (2, b.tolist(), 1), (3, a.tolist(), 2), (4, c.tolist(), 2)]
    got = embedding_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == {1: 1, 2: 1, 3: 0, 4: 0}


def test_blocks_against_one_product(monkeypatch):
    monkeypatch.setattr(embedding_join, "LEAF", 8)
    x = embedding_join.unit(np.array([r[1] for r in made(300)]))
    x = x[np.lexsort(np.floor(x[:, :3] / 0.2).T)]
    linked = embedding_join.join_blocks(x[:170], x[170:], x[:170, :5], x[170:, :5], float(np.sqrt(2 - 2 * 0.93)) + 1e-9, 0.93)
    assert (linked == (x[:170] @ x[170:].T >= 0.93)).all() and linked.any()
