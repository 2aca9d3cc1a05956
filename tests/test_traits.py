"""Leave-one-location-out traits against dense least squares, and detectable effects by variant."""

from statistics import NormalDist

import numpy as np
import pytest

from locusframe.operators import models, phenotype

PLACES = ["North Farm", "South", "West"]


def plots():
    rng, out = np.random.default_rng(5), []
    for i in range(14):
        for k, place in enumerate(PLACES):
            for block in range(2):
                if (i + k + block) % 7:
                    out.append((f"ID{i}", place, f"{place}_B{block}", float(rng.normal(i % 4, 1)), float(rng.normal(k, 1))))
    return out


def means(rows, value, covariate=None):
    """Mean of each id over equally weighted strata, the covariate at its mean."""
    ids, strata = sorted({r[0] for r in rows}), sorted({r[2] for r in rows})
    x = np.zeros((len(rows), len(ids) + len(strata) - 1 + (covariate is not None)))
    for n, r in enumerate(rows):
        x[n, ids.index(r[0])] = 1
        if r[2] != strata[0]:
            x[n, len(ids) + strata.index(r[2]) - 1] = 1
    if covariate is not None:
        own = np.array([r[covariate] for r in rows])
        x[:, -1] = own - own.mean()
    beta = np.linalg.lstsq(x, np.array([r[value] for r in rows]), rcond=None)[0]
    effects = beta[len(ids) : len(ids) + len(strata) - 1].sum() / len(strata)
    return {name: beta[k] + effects for k, name in enumerate(ids)}


def normal(found):
    """Values have no ties."""
    order = sorted(found, key=found.get)
    return {name: NormalDist().inv_cdf((k + 0.5) / len(order)) for k, name in enumerate(order)}


def test_traits_without_one_location(spark):
    rows = plots()
    table = spark.createDataFrame(rows, "ID_std string, Location string, Stratum string, INC double, SEV double")
    got = {r["ID_std"]: r for r in phenotype.omission_traits(table, PLACES).collect()}
    assert len(got) == 14
    for place, label in zip(PLACES, ("NORTH_FARM", "SOUTH", "WEST"), strict=True):
        rest = [r for r in rows if r[1] != place]
        for name, want in {"INC": means(rest, 3), "SEV": means(rest, 4), "SEV_COND": means(rest, 4, 3)}.items():
            for own, z in normal(want).items():
                assert got[own][f"{name}_LOO_{label}"] == pytest.approx(z, abs=1e-7)


def test_an_id_of_the_omitted_location_only_has_no_trait(spark):
    rows = plots() + [("LONE", "West", "West_B0", 1.0, 1.0)]
    table = spark.createDataFrame(rows, "ID_std string, Location string, Stratum string, INC double, SEV double")
    lone = phenotype.omission_traits(table, PLACES).filter("ID_std = 'LONE'").first()
    assert lone["INC_LOO_WEST"] is None and lone["INC_LOO_SOUTH"] is not None


@pytest.mark.parametrize("traits", [phenotype.accession_traits, lambda d: phenotype.omission_traits(d, PLACES)], ids=["accession", "omission"])
def test_plots_are_read_once_for_all_models(traits, spark):
    rows, read = plots(), spark.sparkContext.accumulator(0)
    schema = "ID_std string, Location string, Stratum string, INC double, SEV double"

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    assert traits(spark.createDataFrame(rows, schema).mapInArrow(counted, schema)).count() == 14
    assert read.value == len(rows)


def test_missing_values_leave_out_the_models_that_need_them(spark):
    rows = [(a, b, c, None if k % 11 == 3 else x, float("nan") if k % 13 == 5 else y) for k, (a, b, c, x, y) in enumerate(plots())]
    table = spark.createDataFrame(rows, "ID_std string, Location string, Stratum string, INC double, SEV double")
    got = {r["ID_std"]: r for r in phenotype.accession_traits(table).collect()}
    sound = lambda v: v is not None and v == v
    whole = {"INC": means([r for r in rows if sound(r[3])], 3), "SEV": means([r for r in rows if sound(r[4])], 4), "SEV_POS": means([r for r in rows if sound(r[4]) and sound(r[3]) and r[3] > 0], 4), "SEV_COND": means([r for r in rows if sound(r[3]) and sound(r[4])], 4, 3)}
    for name, want in whole.items():
        for own, value in want.items():
            assert got[own][f"{name}_ADJ_RAW"] == pytest.approx(value, abs=1e-9)
    for own, r in got.items():
        inc = [x[3] for x in rows if x[0] == own and x[3] is not None]
        assert r["INC_SIMPLE_RAW"] == pytest.approx(sum(inc) / len(inc)) and r["N_PLOTS_TOTAL"] == sum(x[0] == own for x in rows)


def test_power_of_variants(spark):
    rows = [(100, 0.05), (100, 0.05), (100, 0.95), (60, 0.2), (None, 0.2), (60, None), (60, 0.0), (2, 0.3)]
    got = models.variant_power(spark.createDataFrame(rows, "n_samples int, maf double"), {"all": None, "one": 1e-3}, [0.8])
    found = {(r["n_samples"], None if r["maf"] is None else round(r["maf"], 9), r["alpha_definition"]): r for r in got.collect()}
    assert len(found) == 2 * 6 and sum(r["n_variants"] for r in found.values()) == 2 * len(rows) and found[100, 0.05, "all"]["alpha"] == 0.05 / 8
    effect = "minimum_detectable_beta_residual_SD_per_allele"
    for n, maf in ((100, 0.05), (60, 0.2)):
        for name, alpha in (("all", 0.05 / 8), ("one", 1e-3)):
            assert models.power(found[n, maf, name][effect], n, maf, alpha) == pytest.approx(0.8, abs=1e-6)
    assert all(found[n, m, "one"][effect] is None for n, m in ((None, 0.2), (60, None), (60, 0.0), (2, 0.3)))
    assert models.variant_power(spark.createDataFrame([], "n_samples int, maf double"), {"all": None}, [0.8]).count() == 0
