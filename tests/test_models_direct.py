"""Scans, pruning and clumping against direct computations."""

import numpy as np
import pytest

from locusframe.operators import ld, models, tables
from locusframe.operators.genotype import dosage_matrix


def panel(spark, rows=40, samples=30):
    g = np.random.default_rng(5).integers(-1, 3, (rows, samples))
    data = [(i, i % 2 + 1, 100 * (i // 2), [int(x) for x in r]) for i, r in enumerate(g)]
    df = spark.createDataFrame(data, "variant_index long, CHR int, pos long, dosages array<tinyint>")
    return df, dosage_matrix(df.orderBy("variant_index").toArrow().column("dosages").combine_chunks())


def test_ols_scan_is_least_squares(spark):
    df, x = panel(spark)
    rng = np.random.default_rng(6)
    y, pcs = rng.normal(size=30), rng.normal(size=(30, 3))
    for r in models.ols_scan(df, {"T": y}, pcs, [0, 2]).collect():
        design = np.column_stack((np.ones(30), pcs[:, : r["n_pcs"]], x[r["variant_index"]]))
        coef, rss = np.linalg.lstsq(design, y)[:2]
        se = np.sqrt(rss[0] / (30 - design.shape[1]) * np.linalg.inv(design.T @ design)[-1, -1])
        assert (r["beta"], r["se"], r["t"]) == pytest.approx((coef[-1], se, coef[-1] / se), rel=1e-8)


def test_ols_scan_takes_a_batch_in_pieces(spark, monkeypatch):
    df, _ = panel(spark)
    rng = np.random.default_rng(6)
    traits, pcs = {"T": rng.normal(size=30)}, rng.normal(size=(30, 3))
    by = ["variant_index", "n_pcs"]
    whole = models.ols_scan(df.coalesce(1), traits, pcs, [0, 2]).orderBy(*by).toPandas()
    monkeypatch.setattr(models, "SCANNED", 8 * 30 * 7)
    seen = spark.sparkContext.accumulator(0)
    block = models.ols_block

    def counted(x, *rest):
        seen.add(1)
        assert len(x) <= 7
        return block(x, *rest)

    monkeypatch.setattr(models, "ols_block", counted)
    pieces = models.ols_scan(df.coalesce(1), traits, pcs, [0, 2]).orderBy(*by).toPandas()
    assert np.allclose(whole[["beta", "se", "t", "p"]], pieces[["beta", "se", "t", "p"]]) and len(whole) == 80
    assert seen.value >= 2 * 6


def test_mixed_model_is_generalised_least_squares(spark):
    _, x = panel(spark)
    rng = np.random.default_rng(7)
    z = rng.normal(size=(30, 60))
    k, y = z @ z.T / 60, rng.normal(size=30)
    model = models.MixedModel(y, k)
    got = model.test(x)

    def ml(lam, design):
        h = lam * k + np.eye(30)
        inv = np.linalg.inv(h)
        e = y - design @ np.linalg.solve(design.T @ inv @ design, design.T @ inv @ y)
        q = e @ inv @ e
        return 15 * (np.log(30 / (2 * np.pi)) - 1) - 0.5 * np.linalg.slogdet(h)[1] - 15 * np.log(q), inv, q

    one = np.ones((30, 1))
    grid = 10 ** np.linspace(-5, 5, 2001)
    assert model.null_ml >= max(ml(v, one)[0] for v in grid) - 1e-9
    assert model.null_ml == pytest.approx(ml(model.null_lambda, one)[0], rel=1e-8)
    for i in range(5):
        design = np.column_stack((one, x[i]))
        _, inv, q = ml(got["l_remle"][i], design)
        a = np.linalg.inv(design.T @ inv @ design)
        assert got["beta"][i] == pytest.approx((a @ design.T @ inv @ y)[1], rel=1e-6)
        assert got["se"][i] == pytest.approx(np.sqrt(a[1, 1] * q / 28), rel=1e-6)


def r2(x, a, b):
    return np.corrcoef(x[a], x[b])[0, 1] ** 2


def test_prune_is_the_greedy_loop(spark):
    df, x = panel(spark)
    kept = []
    for i in sorted(range(40), key=lambda i: (i % 2, i // 2)):
        near = [j for j in kept if j % 2 == i % 2 and abs(j // 2 - i // 2) * 100 <= 500]
        if all(r2(x, i, j) < 0.05 for j in near):
            kept.append(i)
    assert [r["variant_index"] for r in ld.prune(df, 500, 0.05).orderBy("structure_marker_rank").collect()] == kept
    assert 0 < len(kept) < 40


def test_candidates_map_by_name_and_position(spark):
    mapping = spark.createDataFrame([(1, "a", 1, 10), (2, "b", 1, 20)], "variant_index long, snp string, CHR int, pos long")
    leads = spark.createDataFrame([("b", 1, 20)], "lead_snp string, CHR int, pos long")
    assert [r["variant_index"] for r in tables.map_candidates(leads, mapping).collect()] == [2]
    for bad in (("b", 1, 21), ("c", 1, 20)):
        with pytest.raises(ValueError):
            tables.map_candidates(spark.createDataFrame([bad], "lead_snp string, CHR int, pos long"), mapping)
    with pytest.raises(ValueError):
        tables.map_candidates(leads, mapping.union(mapping))
