"""Runs of linkage, scan summaries, component spaces, power tables, candidates' effects and small files."""

import numpy as np
import pytest

from locusframe.operators import ld, models, ranking, tables
from locusframe.operators.genotype import dosage_matrix
from locusframe.sources import records


def gapped(spark, rows=60, samples=25):
    rng = np.random.default_rng(11)
    pos = np.cumsum(rng.choice([0, 40, 90, 100, 101, 400], rows))
    g = rng.integers(0, 3, (rows, samples))
    g[2::4] = g[::4]
    data = [(i, f"S{i}", i % 2 + 1, int(pos[i]), float((i * 37) % 61 + 1) / 62, [int(x) for x in r]) for i, r in enumerate(g)]
    df = spark.createDataFrame(data, "variant_index long, snp string, CHR int, pos long, p double, dosages array<tinyint>")
    return df, data, g.astype(float)


def r2(g, a, b):
    return np.corrcoef(g[a], g[b])[0, 1] ** 2


def test_prune_and_clump_across_gaps(spark):
    df, data, g = gapped(spark)
    near = lambda i, j: data[i][2] == data[j][2] and abs(data[i][3] - data[j][3]) <= 100
    kept = []
    for i in sorted(range(60), key=lambda i: (data[i][2], data[i][3], i)):
        if all(r2(g, i, j) < 0.2 for j in kept if near(i, j)):
            kept.append(i)
    assert [r["variant_index"] for r in ld.prune(df, 100, 0.2).orderBy("structure_marker_rank").collect()] == kept
    free, want = set(range(60)), {}
    for i in sorted(range(60), key=lambda i: (data[i][4], data[i][2], data[i][3], i)):
        if i in free and data[i][4] <= 0.5:
            want[i] = {j for j in free if j == i or (data[j][4] <= 0.9 and near(i, j) and r2(g, i, j) >= 0.2)}
            free -= want[i]
    leads, members = ld.clump(df, "p", 0.5, 0.9, 100, 0.2, 5)
    got = {r["lead_variant_index"]: set() for r in leads.collect()}
    for r in members.collect():
        got[r["lead_variant_index"]].add(r["variant_index"])
    assert got == want and any(len(x) > 1 for x in want.values())


def test_scan_summary_and_its_comparison(spark):
    rng = np.random.default_rng(2)
    p = {("A", 0): rng.random(400) ** 3, ("A", 1): np.r_[rng.random(50), 0.0, 1.0, np.full(5, 0.2)], ("B", 0): rng.random(30)}
    df = spark.createDataFrame([(t, k, float(x)) for (t, k), v in p.items() for x in v], "trait string, n_pcs int, p double")
    got = ranking.scan_summary(df, ["trait", "n_pcs"], "p")
    for r in got.collect():
        x = np.sort(np.clip(p[r["trait"], r["n_pcs"]], 1e-300, 1))
        q = np.minimum.accumulate((x * len(x) / np.arange(1, len(x) + 1))[::-1])[::-1]
        assert (r["n"], r["minimum_p"], r["fdr_significant"]) == (len(x), x[0], int((q < 0.1).sum()))
    lam = {(r["trait"], r["n_pcs"]): r["lambda_gc"] for r in got.collect()}
    assert lam["A", 0] > 2 and len(lam) == 3
    same = tables.compare_summaries(got, got, ["trait", "n_pcs"])
    assert same.count() == 9 and same.filter("passed").count() == 9
    off = tables.compare_summaries(got, got.filter("trait = 'A'").withColumn("lambda_gc", got["lambda_gc"] + 1e-5), ["trait", "n_pcs"])
    assert off.filter("passed").count() == 4


def test_component_spaces(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(20, 5))
    columns, spaces = models.pc_geometry(a, a * [-1, 1, 1, -1, 1] + 3)
    assert all(c["column_correlation_check_passed"] for c in columns) and [c["same_column_correlation"] < 0 for c in columns] == [True, False, False, True, False]
    assert [s["n_pc"] for s in spaces] == [1, 2, 3, 5] and all(s["equivalent_within_numerical_tolerance"] for s in spaces)
    columns, spaces = models.pc_geometry(a, a[:, [1, 0, 2, 3, 4]])
    assert columns[0]["best_reference_PC"] == "PC2" and [s["equivalent_within_numerical_tolerance"] for s in spaces] == [False, True, True, True]
    for bad in (a[:, :4], np.where(a == a[0, 0], np.nan, a), np.c_[a[:, :4], np.ones(20)], np.c_[a[:, :4], a[:, 0]]):
        with pytest.raises(ValueError):
            models.pc_geometry(bad, bad)


def test_components_of_stated_markers(spark):
    df, data, g = gapped(spark)
    markers = spark.createDataFrame([(i,) for i in range(0, 60, 2)], "variant_index long")
    samples = list(range(20))
    x = g[::2][:, samples]
    f = np.clip(x.mean(axis=1, keepdims=True) / 2, 1e-6, 1 - 1e-6)
    z = (x - 2 * f) / np.sqrt(2 * f * (1 - f))
    k = z.T @ z
    values, vectors = np.linalg.eigh(k / np.mean(np.diag(k)))
    want = vectors[:, ::-1][:, :5] * np.sqrt(values[::-1][:5])
    assert all(s["equivalent_within_numerical_tolerance"] for s in models.pc_geometry(want, models.structure_components(df, markers, samples))[1])
    for bad in (markers.union(markers), markers.limit(5), markers.union(spark.createDataFrame([(99,)], "variant_index long"))):
        with pytest.raises(ValueError):
            models.structure_components(df, bad)


def test_power_tables(spark):
    made = models.power_table(spark, [100], [0.05, 0.3], {"x": 1e-5}, [0.8])
    row = models.reproduce_power(made).first()
    assert row["rows"] == 2 and row["passed"] and row["maximum_absolute_difference"] < 1e-8
    old = made.withColumnRenamed(records.EFFECT, records.EFFECT_BEFORE).selectExpr("*", "1.0 AS variance_explained_now")
    assert records.current_power_columns(old).columns == made.columns
    assert not models.reproduce_power(made.withColumn(records.EFFECT, made[records.EFFECT] + 1e-6)).first()["passed"]
    assert not models.reproduce_power(made.limit(0)).first()["passed"]
    with pytest.raises(ValueError):
        records.current_power_columns(made.drop(records.EFFECT))


def test_candidates_effects(spark):
    scan = spark.createDataFrame([(v, t, b, 0.1, 0.01 * v) for v, b in ((1, 0.5), (2, -0.5), (3, 1.0)) for t in ("INC", "SEV")], "variant_index long, trait string, beta double, se double, p_score double")
    candidates = spark.createDataFrame([(1, "a", 0.01, 0.01), (2, "b", 0.02, 0.02)], "variant_index long, lead_snp string, p_INC_score double, p_SEV_score double")
    rows = [(s, w, 0.3, -0.3, 0.1, 0.2) for s in "ab" for w in ("x", "y")]
    schema = "lead_snp string, omitted_location string, beta_INC_score double, beta_SEV_score double, p_INC_score double, p_SEV_score double"
    omissions = spark.createDataFrame(rows, schema)
    got = {(r["lead_snp"], r["trait"], r["omitted_location"]): r["direction_preserved"] for r in tables.candidate_score_effects(scan, candidates, omissions, 2).collect()}
    assert got == {(s, t, w): (s == "a") == (t == "INC") for s in "ab" for t in ("INC", "SEV") for w in "xy"}
    wrong = candidates.withColumn("p_INC_score", candidates["p_INC_score"] * 1.001)
    for c, o in ((candidates, omissions.limit(3)), (candidates, omissions.union(omissions.limit(1))), (wrong, omissions)):
        with pytest.raises(ValueError):
            tables.candidate_score_effects(scan, c, o, 2)


def test_small_files(tmp_path):
    (tmp_path / "b.csv").write_text("x")
    assert records.first_file(tmp_path, ["a.csv", "b.csv"]).name == "b.csv"
    with pytest.raises(FileNotFoundError):
        records.first_file(tmp_path, ["a.csv"])
    path = tmp_path / "deep" / "m.json"
    records.write_manifest(path, {"n": np.int64(3), "x": np.array([1.5]), "p": tmp_path})
    assert records.read_manifest(path) == {"n": 3, "x": [1.5], "p": str(tmp_path)}
    assert records.source_entry(tmp_path, tmp_path / "b.csv") == {"relative_source": "b.csv", "sha256": "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"}
