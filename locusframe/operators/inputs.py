"""Checks of a run's primary inputs as side results of reading them.

Each table is read once, by the pass that writes the checked copy which later steps use; its counts of rows that break a
rule are observed on the way, exact and without a second scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from locusframe.operators.guards import cut, require
from locusframe.operators.models import pc_geometry, structure_components
from locusframe.operators.numbering import numbered

MARKER = ("variant_index", "snp", "CHR", "pos")
PCS = tuple(f"PC{k}" for k in range(1, 6))


class Watched:
    """Rules on tables; they are settled after the tables were read."""

    def __init__(self) -> None:
        self._rules: list[tuple[str, Observation, str, Callable[[dict], bool]]] = []

    def read(self, df: DataFrame, rules: Sequence[tuple[str, Column, Callable[[int], bool]]]) -> DataFrame:
        """The checkpointed rows. A rule: what is wrong where it fails, an aggregate, and whether its value will do."""
        seen = Observation()
        names = [f"_{i}" for i in range(len(rules))]
        watched = df.observe(seen, *(F.coalesce(c, F.lit(0)).alias(n) for (_, c, _), n in zip(rules, names, strict=True)))
        self._rules += [(what, seen, n, ok) for (what, _, ok), n in zip(rules, names, strict=True)]
        return cut(watched)

    def settle(self) -> None:
        """Stops at the first rule that doesn't hold, in the order in which they were given."""
        for what, seen, name, ok in self._rules:
            require(ok(seen.get[name]), what)
        self._rules.clear()


def _none(n: int) -> bool:
    return n == 0


@dataclass
class Inputs:
    """samples (sample_index, ID_std, PRIMARY_ELIGIBLE) of all genotyped; traits and pcs by ID_std; metadata of all variants
    and markers of the structure (MARKER columns); genotypes (variant_index, dosages)."""

    samples: DataFrame
    traits: DataFrame
    pcs: DataFrame
    metadata: DataFrame
    markers: DataFrame
    genotypes: DataFrame


def _differs(a: Sequence[str], b: Sequence[str]) -> Column:
    out = F.lit(False)
    for x, y in zip(a, b, strict=True):
        out = out | ~F.col(x).eqNullSafe(F.col(y))
    return out


def _ordered(samples: DataFrame) -> DataFrame:
    """place and ID_std of the eligible samples."""
    return numbered(samples.filter("PRIMARY_ELIGIBLE").select("sample_index", "ID_std"), [F.col("sample_index")], "place")


def _components(ids: DataFrame, pcs: DataFrame, what: str) -> np.ndarray:
    """Five columns, samples in rows, in the order of ``ids``; a row a sample."""
    rows = ids.join(pcs.select("ID_std", *PCS), "ID_std", "left").orderBy("place").select(*(F.col(c).cast("double") for c in PCS)).toArrow()
    require(not any(c.null_count for c in rows.columns), f"{what}: a sample has no components")
    return np.column_stack([c.to_numpy() for c in rows.columns])


def primary_inputs(given: Inputs, expected: Inputs, dimensions: tuple[int, int, int], traits: Sequence[str]) -> dict[str, DataFrame]:
    """Checked copies of a run's inputs, or an error that says what differs from what was published.

    ``expected`` holds the published samples, traits, pcs and markers (its metadata and genotypes aren't read);
    ``dimensions``: eligible samples, variants, all samples. Components are compared as spaces, and those rebuilt from the
    markers' genotypes with the stored ones.
    """
    n_ids, n_variants, n_all = dimensions
    watch = Watched()
    both = _ordered(given.samples).join(_ordered(expected.samples).select("place", F.col("ID_std").alias("_id")), "place", "full")
    ids = watch.read(both, [("primary sample order differs from the reference", F.count_if(_differs(["ID_std"], ["_id"])), _none), ("unexpected number of primary samples", F.count("*"), lambda n: n == n_ids)]).select("place", "sample_index", "ID_std")
    everyone = given.samples.groupBy("ID_std").count()
    watch.read(everyone, [("duplicate or missing sample identifiers", F.count_if((F.col("count") > 1) | F.col("ID_std").isNull()), _none), ("unexpected number of samples", F.sum("count"), lambda n: n == n_all)])
    watch.settle()

    other = expected.traits.select(F.col("ID_std").alias("_id"), *(F.col(t).alias(f"_{t}") for t in traits))
    near = lambda t: F.coalesce(F.abs(F.col(t) - F.col(f"_{t}")) <= 1e-9 + 1e-10 * F.abs(F.col(f"_{t}")), F.lit(False))
    own = ids.join(given.traits.select("ID_std", *traits), "ID_std", "left").join(other, F.col("ID_std") == F.col("_id"), "left")
    values = watch.read(own, [*((f"phenotype doesn't match the reference: {t}", F.count_if(~near(t)), _none) for t in traits), ("a sample has several rows of phenotypes", F.count("*"), lambda n: n == n_ids)]).select("place", "ID_std", *traits)

    listed = [f"_{c}" for c in MARKER]
    meta = numbered(given.metadata.select(*MARKER), [F.col("variant_index")], "_number")
    metadata = watch.read(meta, [("genotype metadata order is invalid", F.count_if(~F.col("variant_index").eqNullSafe(F.col("_number"))), _none), ("unexpected number of variants", F.count("*"), lambda n: n == n_variants)]).drop("_number")
    published = expected.markers.select(*(F.col(c).alias(x) for c, x in zip(MARKER, listed, strict=True)), F.lit(True).alias("_published"))
    stated = given.markers.select(*MARKER, F.lit(True).alias("_own"))
    pairs = stated.join(published, F.col("variant_index") == F.col("_variant_index"), "full")
    known = metadata.select(*(F.col(c).alias(f"_m_{c}") for c in MARKER))
    pairs = pairs.join(known, F.col("variant_index") == F.col("_m_variant_index"), "left")
    markers = watch.read(pairs, [
        ("structure-marker list differs from the reference", F.count_if(F.col("_own").isNull() | F.col("_published").isNull() | _differs(MARKER, listed)), _none),
        ("structure-marker index is out of range", F.count_if(F.col("_m_variant_index").isNull()), _none),
        ("structure markers disagree with genotype metadata", F.count_if(_differs(MARKER, [f"_m_{c}" for c in MARKER])), _none),
    ]).select(*MARKER)
    rows = given.genotypes.join(metadata.select(F.col("variant_index").alias("_known")), F.col("variant_index") == F.col("_known"), "left")
    genotypes = watch.read(rows, [
        ("genotype rows disagree with the number of variants", F.count("*"), lambda n: n == n_variants),
        ("genotype rows outside the metadata", F.count_if(F.col("_known").isNull()), _none),
        ("genotype rows differ in length from the samples", F.count_if(~F.size("dosages").eqNullSafe(F.lit(n_all))), _none),
    ]).select("variant_index", "dosages")
    watch.settle()

    stored = _components(ids, given.pcs, "stored PCs")
    require(_same(_components(ids, expected.pcs, "reference PCs"), stored), "stored PCs disagree with the reference basis")
    chosen = ids.orderBy("place").select("sample_index").toArrow().column(0).to_numpy()
    require(_same(stored, structure_components(genotypes, markers, chosen)), "PC reconstruction from genotype rows failed")
    return {"ids": ids, "traits": values, "metadata": metadata, "markers": markers, "genotypes": genotypes}


def _same(a: np.ndarray, b: np.ndarray) -> bool:
    return all(s["equivalent_within_numerical_tolerance"] for s in pc_geometry(a, b)[1])
