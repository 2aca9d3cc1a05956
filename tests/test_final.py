"""The composed last stage against plain Python, from scans to candidates and their genes."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.plans import final
from locusframe.sources.workbooks import read_workbook

N, SAMPLES = 60, 16
SETTINGS = final.Settings(index_p=0.02, secondary_p=0.2, window_kb=15, r2=0.3, candidates=6, flank_kb=2, sample_sizes=(16,), top_rows=7)
TRAITS = ("INC", "SEV", "SEV_COND", "SEV_POS")


def inputs(spark, seed=5):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, 3, (N, SAMPLES))
    for i in range(1, N):
        if i % 3:
            same = rng.random(SAMPLES) < (1.0 if i % 7 == 1 else 0.8)
            g[i, same] = g[i - 1, same]
    g[21], g[33] = 2 - g[20], g[2]  # a complement next to it, an equal vector of another chromosome
    place = [(i // 20 + 1, 1000 + i % 20 * 1500) for i in range(N)]
    p = {(t, k): rng.random(N) ** 2 for t in TRAITS for k in final.TESTS}
    beta = rng.normal(size=N)
    rows = [("loco", t, i, f"S{i}", *place[i], 0.3, 0.0, float(beta[i]), 0.2, *(float(p[t, k][i]) for k in final.TESTS), "x") for t in TRAITS for i in range(N)]
    rows.append(("global", "INC", 999, "other", 1, 5, 0.3, 0.0, 1.0, 0.2, 0.0, 0.0, 0.0, "x"))
    scans = spark.createDataFrame(rows, "context string, trait string, variant_index long, snp string, CHR int, pos long, MAF double, missing_rate double, beta double, se double, p_score double, p_lrt double, p_wald double, candidate_rank string")
    genotypes = spark.createDataFrame([(i, [int(x) for x in r], "x") for i, r in enumerate(g)], "variant_index long, dosages array<tinyint>, snp string")
    genes = spark.createDataFrame([(1, 900, 1200, "near"), (2, 90_000, 91_000, "far"), (3, 5000, 9000, "wide")], "CHR int, start long, end long, gene string")
    return scans.repartition(5), genotypes.repartition(3), genes, g, place, p


def acat(a, b):
    t = (math.tan((0.5 - a) * math.pi) + math.tan((0.5 - b) * math.pi)) / 2
    return 0.5 - math.atan(t) / math.pi


def plain_leads(p, g, place):
    """Smallest p of each vector, then the loop over leads."""
    canon = [min(tuple(r), tuple(2 - r)) for r in g]
    best = {}
    for i in sorted(range(N), key=lambda i: (p[i], i)):
        best.setdefault(canon[i], i)
    unique = sorted(best.values(), key=lambda i: (p[i], *place[i], i))
    index, second = [i for i in unique if p[i] <= SETTINGS.index_p], [i for i in unique if p[i] <= SETTINGS.secondary_p]
    assert index
    taken, out = set(), []
    for i in index:
        if i in taken:
            continue
        own = []
        for j in second:
            near = place[i][0] == place[j][0] and abs(place[i][1] - place[j][1]) <= SETTINGS.window_kb * 1000
            if near and j not in taken and (j == i or np.corrcoef(g[i], g[j])[0, 1] ** 2 >= SETTINGS.r2):
                own.append(j)
        taken |= {*own, i}
        out.append((i, len(own)))
    return out, canon


def test_candidates_and_their_tables(spark, tmp_path):
    scans, genotypes, genes, g, place, p = inputs(spark)
    got = final.final_results(scans, genotypes, genes, f"file://{tmp_path}/run", SETTINGS)
    both = [acat(a, b) for a, b in zip(p["INC", "score"], p["SEV", "score"], strict=True)]
    pool = {}
    for source, values in (("score_ACAT", both), ("score_SEV", p["SEV", "score"])):
        leads, canon = plain_leads(values, g, place)
        stored = {(r["lead_variant_index"], r["n_local_members"]) for r in got[f"leads_{source[6:]}"].collect()}
        assert stored == set(leads)
        for i, _ in leads:
            pool.setdefault(i, source)
    want = sorted(pool, key=lambda i: (both[i], p["SEV", "score"][i], *place[i]))[: SETTINGS.candidates]
    rows = got["candidates"].orderBy("candidate_rank").collect()
    assert [r["variant_index"] for r in rows] == want and len(want) > 2
    for r in rows:
        i = r["variant_index"]
        assert (r["candidate_source"], r["CHR"], r["pos"], r["lead_snp"]) == (pool[i], *place[i], f"S{i}")
        assert r["p_ACAT_score"] == pytest.approx(both[i]) and r["p_INC_lrt"] == pytest.approx(p["INC", "lrt"][i])
        assert r["p_SEV_conditional_score"] == pytest.approx(p["SEV_COND", "score"][i]) and r["p_SEV_positive_only_score"] == pytest.approx(p["SEV_POS", "score"][i])
        assert r["ci_low_INC"] == pytest.approx(r["beta_INC"] - 1.96 * 0.2) and r["beta_SEV_conditional"] == r["beta_SEV"]
        alike = [j for j in range(N) if canon[j] == canon[i]]
        assert r["global_alias_class_size"] == len(alike) and r["test_class_size"] == sum(place[j][0] == place[i][0] for j in alike)
        assert r["alias_mappings"] == "; ".join(f"S{j}@chr{place[j][0]}:{place[j][1]}" for j in alike)
    hits = {r["figure"]: r["value"] for r in got["summary"].collect()}
    assert (hits["n_samples"], hits["n_variants"], hits["candidates"]) == (SAMPLES, N, len(want))
    assert hits["unique_tests"] == len({(canon[i], place[i][0]) for i in range(N)})
    assert hits["score_ACAT_minimum_p"] == pytest.approx(min(both))
    assert got["profile"].count() == 20 and got["test_comparison"].count() == 12 and got["top_lrt"].count() == 7
    named = {(r["lead_snp"], r["gene"]) for r in got["candidate_genes"].select("lead_snp", "gene").distinct().collect()}
    # One gene a chromosome: within reach or the nearest, it is named.
    assert named == {(f"S{i}", {1: "near", 2: "far", 3: "wide"}[place[i][0]]) for i in want}

    final.publish(got, f"file://{tmp_path}/tables", str(tmp_path / "results.xlsx"))
    back = spark.read.option("header", True).csv(f"file://{tmp_path}/tables/candidates")
    assert [r[0] for r in back.orderBy(F.col("candidate_rank").cast("int")).select("variant_index").collect()] == [str(i) for i in want]
    assert set(read_workbook(str(tmp_path / "results.xlsx"))) == {n[:31] for n in final.SHEETS}


def test_a_run_goes_on_where_it_ended_and_only_on_its_own_inputs(spark, tmp_path, monkeypatch):
    scans, genotypes, genes, *_ = inputs(spark)
    made, keep, support, lost = [], final.Store.keep, final.supported_candidates, [True]

    def supported(*args):
        if lost:
            raise RuntimeError("lost")
        return support(*args)

    def kept(self, name, build):
        made.extend([] if self.whole(name) else [name])
        return keep(self, name, build)

    monkeypatch.setattr(final.Store, "keep", kept)
    monkeypatch.setattr(final, "supported_candidates", supported)
    folder = f"file://{tmp_path}/run"
    with pytest.raises(RuntimeError, match="lost"):
        final.Run(scans, genotypes, genes, folder, SETTINGS).table("candidate_genes")
    before = set(made) - {"candidates", "candidate_genes"}
    made.clear()
    lost.clear()
    got = final.Run(scans.repartition(2), genotypes, genes, folder, SETTINGS).table("candidates")
    assert got.count() > 2 and "candidates" in made and not before & set(made) and {"all_score", "leads_SEV", "members_SEV", "global_classes"} <= before
    keys = {final.run_key({"scans": df}, s) for df in (scans, scans.filter("variant_index > 0"), scans.withColumn("beta", F.col("beta") * 2)) for s in (SETTINGS, replace(SETTINGS, r2=0.5))}
    assert len(keys) == 6
    assert final.run_key({"scans": scans.repartition(9)}, SETTINGS) == final.run_key({"scans": scans}, SETTINGS)


def test_inputs_that_dont_fit_stop_the_run(spark, tmp_path):
    scans, genotypes, genes, *_ = inputs(spark)
    folder = f"file://{tmp_path}/run"
    with pytest.raises(ValueError, match="no primary scan of SEV"):
        final.final_results(scans.filter("trait <> 'SEV'"), genotypes, genes, folder, SETTINGS)
    with pytest.raises(ValueError, match="score scans"):
        final.Run(scans.filter("trait <> 'SEV' OR variant_index <> 4"), genotypes, genes, folder, SETTINGS).table("all_score")
    with pytest.raises(ValueError, match="genotypes"):
        final.Run(scans, genotypes.filter("variant_index <> 4"), genes, folder, SETTINGS).table("candidates")


def test_a_run_reads_its_inputs_twice(spark, tmp_path):
    """Once for the key and once for the copy that all tables are made from, not anew for each of them."""
    scans, genotypes, genes, g, *_ = inputs(spark)
    seen = {name: spark.sparkContext.accumulator(0) for name in ("scans", "genotypes")}

    def counted(df, name):
        def run(batches):
            for batch in batches:
                seen[name].add(batch.num_rows)
                yield batch

        return df.mapInArrow(run, df.schema)

    run = final.Run(counted(scans, "scans"), counted(genotypes, "genotypes"), genes, f"file://{tmp_path}/run", SETTINGS)
    before = seen["scans"].value  # which traits there are, and the key
    assert run.table("candidates").count() > 2
    assert seen["genotypes"].value == 2 * N and seen["scans"].value - before == len(TRAITS) * N + 1
