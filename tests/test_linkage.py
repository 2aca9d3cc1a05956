"""Bit planes, r2 of a band, and rounds of decisions against the plain loops, on dense chromosomes and with missing calls."""

import numpy as np
import pytest

from locusframe.operators import genotype, ld, packed
from locusframe.plans import queries
from locusframe.plans import views as v


def dense(spark, rows=300, samples=70, step=10, seed=4):
    """A chromosome without a gap, with blocks of linkage, missing calls, constant rows and equal positions."""
    rng = np.random.default_rng(seed)
    g = rng.integers(0, 3, (rows, samples))
    for i in range(1, rows):
        same = rng.random(samples) < rng.choice([0.2, 0.7, 0.95])
        g[i, same] = g[i - 1, same]
    g[rng.random(g.shape) < 0.05] = -1
    g[7], g[8], g[9] = 2, -1, 1
    g[9, :5] = -1
    pos = np.cumsum(rng.choice([0, step], rows))
    p = rng.permutation(rows) / rows
    data = [(i, f"S{i}", 1 + i // (rows // 2 + 1), int(pos[i]), float(p[i]), [int(x) for x in r]) for i, r in enumerate(g)]
    return spark.createDataFrame(data, "variant_index long, snp string, CHR int, pos long, p double, dosages array<tinyint>").repartition(7), data, g


def filled(g, impute):
    x = g.astype(float)
    if impute:
        for r in x:
            r[r < 0] = r[r >= 0].mean() if (r >= 0).any() else 0
    return x


def r2_matrix(g, impute):
    x = filled(g, impute)
    x = x - x.mean(axis=1, keepdims=True)
    ss = (x * x).sum(axis=1)
    ok = np.outer(ss, ss) > 1e-12
    return np.clip(np.divide((x @ x.T) ** 2, np.outer(ss, ss), out=np.zeros_like(ok, float), where=ok), 0, 1), ss > 1e-9


@pytest.mark.parametrize("impute", [True, False])
@pytest.mark.parametrize("samples", [1, 63, 64, 65, 200])
def test_r2_of_planes(samples, impute):
    g = np.random.default_rng(samples).integers(-1, 3, (30, samples)).astype(np.int8)
    bits = packed.planes(g)
    assert np.array_equal(packed.unpacked(bits, samples), g)
    i, j = np.triu_indices(30)
    assert np.allclose(packed.r2_of_pairs(bits, samples, impute, i, j), r2_matrix(g, impute)[0][i, j], atol=1e-12)


@pytest.mark.parametrize("tile", [4, 256])
def test_band_has_each_pair_once(tile, spark, monkeypatch):
    monkeypatch.setattr(packed, "TILE", tile)
    df, data, g = dense(spark, 120)
    want = r2_matrix(g, True)[0]
    got = [(r["a"], r["b"], r["r2"]) for r in genotype.r2_pairs(df, 45).collect()]
    pairs = {(i, j) for i in range(120) for j in range(i + 1, 120) if data[i][2] == data[j][2] and abs(data[i][3] - data[j][3]) <= 45}
    assert len(got) == len(pairs) and {x[:2] for x in got} == pairs
    assert all(abs(r - want[a, b]) < 1e-12 for a, b, r in got)


def loop_prune(data, g, window, r2):
    m, varies = r2_matrix(g, True)
    kept = []
    for i in sorted(range(len(data)), key=lambda i: (data[i][2], data[i][3], i)):
        if varies[i] and all(m[i, j] < r2 for j in kept if data[i][2] == data[j][2] and abs(data[i][3] - data[j][3]) <= window):
            kept.append(i)
    return kept


@pytest.mark.parametrize(("window", "r2", "stretch"), [(60, 0.2, 1), (60, 0.2, 16), (400, 0.5, 2), (0, 0.1, 4)])
def test_prune_of_a_dense_chromosome(window, r2, stretch, spark, monkeypatch):
    monkeypatch.setattr(ld, "STRETCH", stretch)
    df, data, g = dense(spark)
    want = loop_prune(data, g, window, r2)
    got = ld.prune(df, window, r2).orderBy("structure_marker_rank").collect()
    assert [r["variant_index"] for r in got] == want and 10 < len(want) < 290
    assert [r["structure_marker_rank"] for r in got] == list(range(1, len(want) + 1))


def test_a_chain_through_many_stretches(spark):
    """Each variant is linked with the next one only: every other one stays, whatever the rounds."""
    n = 60
    nodes = spark.createDataFrame([(i, 1, 10 * i) for i in range(n)], "id long, CHR int, pos long")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long")
    got = {r["id"]: r["kept"] for r in ld.first_come(nodes, pairs, 10).collect()}
    assert got == {i: i % 2 == 0 for i in range(n)}


def loop_clump(data, g, index_p, second_p, window, r2, impute):
    m, varies = r2_matrix(g, impute)
    near = lambda i, j: data[i][2] == data[j][2] and abs(data[i][3] - data[j][3]) <= window
    index = [i for i in range(len(data)) if data[i][4] <= index_p]
    second = set(index) if second_p is None else {i for i in range(len(data)) if data[i][4] <= second_p}
    free, out = set(range(len(data))), {}
    for i in sorted(index, key=lambda i: (data[i][4], data[i][2], data[i][3], i)):
        if i in free:
            own = {j for j in free if j == i and varies[i] or j != i and j in second and near(i, j) and m[i, j] >= r2}
            out[i] = {j: 1.0 if i == j else m[i, j] for j in own}
            free -= own
    return out


@pytest.mark.parametrize(("index_p", "second_p", "missing", "stretch"), [(0.3, 0.9, "raw", 2), (0.6, None, "impute", 1), (0.9, 0.2, "raw", 16)])
def test_clumps_of_a_dense_chromosome(index_p, second_p, missing, stretch, spark, monkeypatch):
    monkeypatch.setattr(ld, "STRETCH", stretch)
    df, data, g = dense(spark, 200, seed=9)
    want = loop_clump(data, g, index_p, second_p, 80, 0.15, missing == "impute")
    leads, members = ld.clump(df, "p", index_p, second_p, 80, 0.15, 5, missing)
    leads, members = leads.orderBy("lead_rank").collect(), members.collect()
    assert [r["lead_variant_index"] for r in leads] == list(want) and [r["lead_rank"] for r in leads] == list(range(1, len(want) + 1))
    assert {r["lead_variant_index"]: r["n_local_members"] for r in leads} == {i: len(x) for i, x in want.items()}
    got = {i: {} for i in want}
    for r in members:
        got[r["lead_variant_index"]][r["variant_index"]] = pytest.approx(r["r2_to_lead"], abs=1e-9)
    assert got == want and max(map(len, want.values())) > 2


def test_queries_of_linkage(spark, sf_dir):
    """l2 and both tables of l4 over the whole table."""
    rows = sorted(v.genotypes(spark, sf_dir).collect(), key=lambda r: r["variant_index"])
    g = np.array([r["dosages"] for r in rows])
    data = [(r["variant_index"], None, r["CHR"], r["pos"], (r["variant_index"] * 7919 % 101 + 1) / 102) for r in rows]
    ids = [r[0] for r in data]
    got = queries.l2_ld_prune(spark, sf_dir).orderBy("structure_marker_rank").collect()
    assert [r["variant_index"] for r in got] == [ids[i] for i in loop_prune(data, g, 3000, 0.02)]
    want = loop_clump(data, g, 0.2, 0.8, 3000, 0.002, False)
    assert [r["lead_variant_index"] for r in queries.l4_ld_clump(spark, sf_dir).orderBy("lead_rank").collect()] == [ids[i] for i in want]
    members = {(r["lead_variant_index"], r["variant_index"]): pytest.approx(r["r2_to_lead"], abs=1e-9) for r in queries.l4_clump_members(spark, sf_dir).collect()}
    assert members == {(ids[i], ids[j]): r for i, x in want.items() for j, r in x.items()}


def test_bins_of_few_rows_share_a_group_and_lose_no_pair(spark):
    """A group for each pair of neighbouring bins had a row or two each, so that time went into their number."""
    rng = np.random.default_rng(3)
    window, rows = 10, 3000
    pos = np.sort(rng.integers(-500, 40_000, rows))
    pos[600:1300] = rng.integers(5000, 5012, 700)  # crowded bins among those of few rows
    pos[1300:1500] = rng.integers(2555, 2566, 200)  # beside the end of a pack
    chrom, g = rng.integers(1, 3, rows), rng.integers(-1, 3, (rows, 12))
    geno = spark.createDataFrame([(i, int(chrom[i]), int(pos[i]), g[i].tolist()) for i in range(rows)], "id long, CHR int, pos long, dosages array<tinyint>").repartition(5)
    d = packed.packed(geno)
    near = (chrom[:, None] == chrom) & (np.abs(pos[:, None] - pos) <= window) & (np.arange(rows)[:, None] < np.arange(rows))
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)}
    got = [(r["a"], r["b"]) for r in packed.links(d, window).select("a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    groups = packed.tiled(d, window).groupBy("CHR", "_tile").count()
    assert groups.count() < 150 and groups.agg({"count": "max"}).first()[0] <= 4 * packed.TILE
