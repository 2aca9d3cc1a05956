"""A sound project passes; each broken input stops with its reason."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import models
from locusframe.operators.inputs import MARKER, PCS, Inputs, primary_inputs

TRAITS = ("INC", "SEV")
SHAPE = (30, 350, 32)


@pytest.fixture(scope="module")
def project(spark):
    rng = np.random.default_rng(9931)
    g = rng.binomial(2, 0.35, (350, 32)).astype(int)
    g[::8, 5] = -1
    ids = [f"L{i:03}" for i in range(32)]
    geno = spark.createDataFrame([(i, [int(x) for x in r]) for i, r in enumerate(g)], "variant_index long, dosages array<tinyint>").persist()
    meta = spark.createDataFrame([(i, f"S01_{i + 1}", 1, i + 1) for i in range(350)], "variant_index long, snp string, CHR int, pos long").persist()
    markers = meta.filter("variant_index < 180").persist()
    samples = spark.createDataFrame([(i, x, i < 30) for i, x in enumerate(ids)], "sample_index int, ID_std string, PRIMARY_ELIGIBLE boolean").persist()
    y = rng.normal(size=(32, 2))
    traits = spark.createDataFrame([(x, *map(float, r)) for x, r in zip(ids, y, strict=True)], "ID_std string, INC double, SEV double").persist()
    pc = models.structure_components(geno, markers.select("variant_index"), list(range(30)))
    pcs = spark.createDataFrame([(x, *map(float, r)) for x, r in zip(ids, pc, strict=False)], "ID_std string, " + ", ".join(f"{c} double" for c in PCS)).persist()
    return Inputs(samples, traits, pcs, meta, markers, geno)


def test_a_sound_project_passes(project):
    turned = replace(project, pcs=project.pcs.withColumn("PC2", -F.col("PC2")))
    got = primary_inputs(project, turned, SHAPE, TRAITS)
    assert {k: v.count() for k, v in got.items()} == {"ids": 30, "traits": 30, "metadata": 350, "markers": 180, "genotypes": 350}
    assert got["markers"].columns == list(MARKER)


def at(column, key, where, value):
    return lambda df: df.withColumn(column, F.when(F.col(key) == where, F.expr(value)).otherwise(F.col(column)))


BROKEN = [
    ("given", "samples", at("ID_std", "ID_std", "L007", "'X'"), "sample order differs"),
    ("given", "samples", at("ID_std", "ID_std", "L031", "'L030'"), "duplicate"),
    ("given", "samples", lambda df: df.filter("sample_index < 31"), "number of samples"),
    ("given", "traits", at("SEV", "ID_std", "L003", "SEV + 1e-6D"), "match the reference: SEV"),
    ("given", "traits", lambda df: df.filter("ID_std <> 'L003'"), "match the reference: INC"),
    ("given", "traits", lambda df: df.union(df.limit(1)), "several rows"),
    ("given", "metadata", lambda df: df.filter("variant_index <> 200"), "metadata order"),
    ("given", "metadata", lambda df: df.filter("variant_index < 349"), "number of variants"),
    ("expected", "markers", at("pos", "variant_index", 0, "99"), "marker list differs"),
    ("given", "markers", lambda df: df.filter("variant_index > 0"), "marker list differs"),
    ("both", "markers", lambda df: df.union(df.limit(1).withColumn("variant_index", F.lit(1000).cast("long"))), "out of range"),
    ("both", "markers", at("snp", "variant_index", 4, "'other'"), "disagree with genotype metadata"),
    ("given", "genotypes", lambda df: df.filter("variant_index <> 200"), "number of variants"),
    ("given", "genotypes", at("dosages", "variant_index", 200, "slice(dosages, 1, 9)"), "differ in length"),
    ("given", "pcs", at("PC1", "ID_std", "L000", "PC1 + 0.2D"), "stored PCs disagree"),
    ("given", "pcs", lambda df: df.filter("ID_std <> 'L001'"), "no components"),
    ("given", "genotypes", at("dosages", "variant_index", 11, "reverse(dosages)"), "reconstruction"),
]


@pytest.mark.parametrize(("side", "name", "change", "reason"), BROKEN, ids=[f"{b[1]}-{b[3].split()[-1]}-{i}" for i, b in enumerate(BROKEN)])
def test_a_broken_input_stops(side, name, change, reason, project):
    other = replace(project, **{name: change(getattr(project, name))})
    given, expected = (project if side == "expected" else other), (project if side == "given" else other)
    with pytest.raises(ValueError, match=reason):
        primary_inputs(given, expected, SHAPE, TRAITS)
