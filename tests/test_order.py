"""Numbers, quantiles and top shares along an order against NumPy, with ties and nulls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import phenotype, ranking, tables
from locusframe.operators.numbering import numbered

R = np.random.default_rng(8)


@pytest.mark.parametrize("rows", [0, 1, 2, 3000])
def test_numbers_follow_the_order(rows, spark):
    data = [(int(a), None if b == 3 else float(b), f"k{i}") for i, (a, b) in enumerate(R.integers(0, 5, (rows, 2)))]
    df = spark.createDataFrame(data, "a long, b double, k string").repartition(9)
    got = numbered(df, [F.col("a").desc(), F.col("b").asc_nulls_last(), F.col("k")], "n").collect()
    want = sorted(data, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r["n"])] == want
    assert sorted(r["n"] for r in got) == list(range(rows))


def test_plan_has_no_single_task(spark):
    d = spark.range(0, 5000, numPartitions=6).withColumn("p", F.rand(1))
    plan = numbered(d, [F.col("p")], "n")._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


def test_quantiles_by_group(spark):
    values = {"a": R.random(1001), "b": R.integers(0, 4, 400).astype(float), "c": np.array([2.5]), "d": np.repeat([1.0, 7.0], 50)}
    rows = [(g, float(x)) for g, v in values.items() for x in v] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5).persist()
    shares = [0.0, 0.3, 0.5, 0.99, 1.0]
    got = {r["g"]: [r[f"q{i}"] for i in range(5)] for r in ranking.quantiles(df, "v", "g", shares).collect()}
    assert set(got) == set(values)
    for g, v in values.items():
        assert got[g] == pytest.approx(np.quantile(v, shares).tolist(), abs=1e-12)


def test_top_shares_with_ties_and_nulls(spark):
    p = [None if x > 60 else float(x) / 8 for x in R.integers(0, 70, 500)]
    df = spark.createDataFrame(list(enumerate(p)), "variant_index long, p double").repartition(7)
    order = sorted(range(500), key=lambda i: (p[i] is None, p[i] or 0, i))
    ks = [1, 5, 77, 250, 499, 500]
    both = df.withColumn("g", F.lit("x")).unionByName(df.withColumn("g", F.lit("y")).withColumn("p", -F.col("p")))
    limits = {r["g"]: r for r in ranking.top_limits(both, "g", "p", [k / 500 for k in ks], "variant_index").collect()}
    down = sorted(range(500), key=lambda i: (p[i] is None, -(p[i] or 0), i))
    for g, sign, want in (("x", 1, order), ("y", -1, down)):
        for i, k in enumerate(ks):
            value = [float("inf") if v is None else sign * v for v in p]
            inside = {j for j in range(500) if value[j] < limits[g][f"edge{i}"] or value[j] == limits[g][f"edge{i}"] and j <= limits[g][f"last{i}"]}
            assert limits[g][f"k{i}"] == k and inside == set(want[:k])


def test_jaccard_moves_no_rows_to_one_task(spark):
    df = spark.range(0, 4000, numPartitions=6).select(F.col("id").alias("variant_index"), F.rand(2).alias("a"), F.rand(3).alias("b")).persist()
    rows = df.toPandas()
    got = {r["top_fraction"]: r for r in ranking.jaccard_top(df, "a", "b", [0.01, 0.1, 0.5]).collect()}
    for f in (0.01, 0.1, 0.5):
        k = round(4000 * f)
        both = len(set(rows.nsmallest(k, "a")["variant_index"]) & set(rows.nsmallest(k, "b")["variant_index"]))
        assert (got[f]["k"], got[f]["overlap"], got[f]["jaccard"]) == (k, both, pytest.approx(both / (2 * k - both)))
    assert ranking.jaccard_top(df.limit(0), "a", "b", [0.1]).collect() == []


def test_plot_points_keep_a_p_of_zero(spark):
    p = [0.0, 0.5, 0.9, 1.5, None, float("nan"), 0.5]
    got = {r["variant_index"]: (r["expected"], r["observed"]) for r in ranking.qq_points(spark.createDataFrame(list(enumerate(p)), "variant_index long, p double"), "p").collect()}
    order = [0, 1, 6, 2, 3]
    assert set(got) == set(order)
    for place, i in enumerate(order):
        assert got[i] == (pytest.approx(-np.log10((place + 0.5) / 5)), pytest.approx(-np.log10(min(max(p[i], 1e-300), 1))))


def least_squares(rows, covariates):
    """Means, errors, rank and degrees of freedom from the whole design."""
    ids, strata = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    c = np.array([r[3 : 3 + covariates] for r in rows], float).reshape(len(rows), covariates)
    x = np.column_stack([np.ones(len(rows)), *(np.array([r[0] == i for r in rows], float) for i in ids[1:]), *(np.array([r[1] == s for r in rows], float) for s in strata[1:]), c - c.mean(axis=0)])
    y = np.array([r[2] for r in rows])
    beta, _, rank, _ = np.linalg.lstsq(x, y)
    df = max(len(rows) - rank, 1)
    cov = np.linalg.pinv(x.T @ x) * float((y - x @ beta) @ (y - x @ beta)) / df
    contrast = np.zeros((len(ids), x.shape[1]))
    contrast[:, 0] = 1
    contrast[np.arange(1, len(ids)), np.arange(1, len(ids))] = 1
    contrast[:, len(ids) : len(ids) + len(strata) - 1] = 1 / len(strata)
    return {i: (m, s) for i, m, s in zip(ids, contrast @ beta, np.sqrt(np.einsum("ij,jk,ik->i", contrast, cov, contrast)), strict=True)}, rank, df


def field(ids, strata, seed, apart=False):
    rng, out = np.random.default_rng(seed), []
    for i in range(ids):
        for s in range(strata):
            if apart and (i < ids // 2) != (s < strata // 2):
                continue
            out += [(f"I{i:03}", f"S{s}", float(100 + i % 7 - s + rng.normal()), float(rng.normal() * 3 + s), float(rng.random())) for _ in range(rng.integers(0, 4))]
    return out


@pytest.mark.parametrize(("ids", "strata", "covariates", "apart"), [(40, 6, 0, False), (40, 6, 2, False), (25, 1, 1, False), (24, 6, 0, True), (24, 6, 1, True)])
def test_adjusted_means_are_least_squares(ids, strata, covariates, apart, spark):
    rows = field(ids, strata, ids + covariates, apart)
    names = ["c1", "c2"][:covariates]
    df = spark.createDataFrame([*rows, ("I000", None, 1.0, 1.0, 1.0), (None, "S0", 1.0, 1.0, 1.0)], "ID_std string, Stratum string, INC double, c1 double, c2 double").repartition(4)
    got = phenotype.adjusted_means(df, "INC", names, "X").collect()
    want, rank, dof = least_squares(rows, covariates)
    assert {r["ID_std"] for r in got} == set(want) and {(r["X_RANK"], r["X_DF"]) for r in got} == {(rank, dof)}
    for r in got:
        assert (r["X_ADJ_RAW"], r["X_ADJ_RAW_LSM_SE"]) == pytest.approx(want[r["ID_std"]], rel=1e-7)
        assert r["X_ADJ_RAW_N_PLOTS"] == sum(x[0] == r["ID_std"] for x in rows)


def test_designs_that_do_not_suffice(spark, monkeypatch):
    schema = "ID_std string, Stratum string, INC double, c1 double, c2 double"
    with pytest.raises(ValueError, match="suffice"):
        phenotype.adjusted_means(spark.createDataFrame(field(9, 3, 1), schema), "INC")
    apart = spark.createDataFrame(field(24, 6, 24, True), schema)
    monkeypatch.setattr(phenotype, "WHOLE", 10)
    with pytest.raises(ValueError, match="too many"):
        phenotype.adjusted_means(apart, "INC")
    monkeypatch.setattr(phenotype, "STRATA", 3)
    with pytest.raises(ValueError, match="strata"):
        phenotype.adjusted_means(apart, "INC")


def test_profile_uses_exact_medians(spark):
    rows = [(i, *map(float, R.random(8))) for i in range(333)]
    df = spark.createDataFrame(rows, "variant_index long, " + ", ".join(f"{k}_{m} double" for m in tables.METHODS for k in ("p", "q")))
    frame = df.toPandas()
    from statistics import NormalDist

    for r in tables.profile(df, "score").collect():
        chi = [NormalDist().inv_cdf(x / 2) ** 2 for x in frame[f"p_{r['method']}"]]
        assert r["lambda_gc"] == pytest.approx(np.median(chi) / 0.4549364231195727, rel=1e-9)
        assert (r["n_variants"], r["hits"]) == (333, int((frame[f"q_{r['method']}"] < 0.1).sum()))


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_inflation_from_the_middle_p_values(n, spark):
    from statistics import NormalDist

    p = [float(x) for x in R.choice([0.001, 0.2, 0.21, 0.6, 0.99, 1.0], n)]
    odd = [None, 0.0, 1.5, -0.1, float("nan")]
    df = spark.createDataFrame([("a", x) for x in p + odd] + [("none", None)], "g string, p double").repartition(3)
    got = {r["g"]: r["lambda_gc"] for r in ranking.lambda_gc(df, "p", "g").collect()}
    want = np.median([NormalDist().inv_cdf(x / 2) ** 2 for x in p]) / 0.4549364231195727
    assert got.keys() == {"a"} and got["a"] == pytest.approx(want, rel=1e-9)


def test_step_up_adds_up_no_frame_anew_for_every_row(spark):
    """A frame of values that ends with its partition is quadratic; those of a few ranges may."""
    df = spark.range(50).select("id", (F.col("id") / 50).alias("p"))
    plan = ranking.bh_columns(df, {"p": "q"}, "id")._jdf.queryExecution().optimizedPlan().toString()
    frames = [x for x in plan.split("windowspecdefinition(")[1:] if "currentrow$(), unboundedfollowing$()" in x[:300]]
    assert "windowspecdefinition(" in plan and not frames


def test_limits_of_ranges_are_told_once(spark):
    """Approximate quantiles told anew for each reader differ, and q-values of 1.2 million rows were off by 1e-3."""
    df = spark.range(1000).selectExpr("'a' AS g", "cast(id AS double) AS p")
    assert "percentile_approx" not in ranking.ranged(df, "p", "g")._jdf.queryExecution().toString()
    assert ranking.ranged(df, "p", "g").select("_range").distinct().count() == ranking.RANGES
