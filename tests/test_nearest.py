"""The nearest gene across ranges of a chromosome, against a loop over all genes."""

import random

import pytest

from locusframe.operators import annotate

GENES, LEADS = "CHR int, start long, end long, gene string", "lead_snp string, CHR int, pos long"


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain(leads, genes, flank):
    out = set()
    for name, chrom, pos in leads:
        own = sorted((max(a - pos, pos - b, 0), a, g, b) for c, a, b, g in genes if c == chrom)
        out |= {(name, pos, g, a, b, d, True) for d, a, g, b in own if d <= flank} or {(name, pos, g, a, b, d, False) for d, a, g, b in own[:1]}
    return out


@pytest.mark.parametrize("flank", [0, 40])
def test_nearest_gene_is_that_of_the_loop(flank, spark, many_ranges):
    rng = random.Random(flank)
    genes = [(rng.choice([1, 1, 1, 2]), a := rng.randrange(20_000) * 5, a + rng.randrange(4) * 5, f"g{k}") for k in range(120)]
    genes += [(1, 500, 510, "b"), (1, 500, 510, "a"), (3, 7, 7, "only")]
    leads = [(f"s{k}", rng.choice([1, 1, 1, 2, 3, 4]), rng.randrange(110_000)) for k in range(300)] + [("first", 1, 0), ("last", 1, 10**9), ("twice", 2, 77)] * 2
    got = annotate.nearby_genes(spark.createDataFrame(leads, LEADS), spark.createDataFrame(genes, GENES), flank).collect()
    assert {(r["lead_snp"], r["lead_pos"], r["gene"], r["gene_start"], r["gene_end"], r["distance_bp"], r["within_flank"]) for r in got} == plain(leads, genes, flank)
    assert not any(r["CHR"] == 4 for r in got)


def test_empty_sides(spark):
    one = spark.createDataFrame([("s", 1, 10), ("n", None, 10)], LEADS)
    assert annotate.nearby_genes(one, spark.createDataFrame([], GENES), 5).count() == 0
    assert annotate.nearby_genes(one.limit(0), spark.createDataFrame([(1, 1, 2, "g")], GENES), 5).count() == 0
    assert [r["lead_snp"] for r in annotate.nearby_genes(one, spark.createDataFrame([(1, 100, 200, "g"), (None, 100, 200, "h")], GENES), 5).collect()] == ["s"]
