"""Equivalence classes of shared and complemented vectors, on a small matrix."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from locusframe.operators import genotype


def test_shared_and_complemented_classes(spark):
    rows = [(0, 1, 10, [0, 1, 2, -1]), (1, 1, 20, [2, 1, 0, -1]), (2, 1, 30, [0, 1, 2, -1]), (3, 1, 40, [0, 0, 2, 1]), (4, 2, 50, [0, 1, 2, -1]), (5, 2, 60, [1, 1, -1, 1])]
    got = {r["variant_index"]: r for r in genotype.equivalence_classes(spark.createDataFrame(rows, "variant_index long, CHR int, pos long, dosages array<tinyint>")).collect()}
    assert [got[i]["global_size"] for i in range(6)] == [4, 4, 4, 1, 4, 1]
    assert [got[i]["test_size"] for i in range(6)] == [3, 3, 3, 1, 1, 1]
    assert len({got[i]["global_id"] for i in (0, 1, 2, 4)}) == 1 and len({got[i]["test_id"] for i in (0, 4)}) == 2
    assert got[1]["orientation"] == -got[0]["orientation"]
    assert all(got[i]["global_id"] == "G_" + got[i]["digest"] and len(got[i]["digest"]) == 32 for i in got)


def test_dosages_are_read_once_whatever_their_lengths(spark):
    """Two group-bys and the rows that meet them read the digests, which were made anew for each."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(0, 1, 5, [-1, 1, 2, 0]), (1, 1, 6, [-1, 1, 0, 2]), (2, 2, 5, [-1, 1, 0, 2]), (3, 1, 7, [1, 1]), (4, 1, 8, []), (5, 1, 9, [1, -1, 1]), (6, 2, 9, [2]), (7, 2, 10, [0])]
    schema = "variant_index long, CHR int, pos long, dosages array<tinyint>"
    geno = spark.createDataFrame(rows, schema).repartition(2)
    got = {r["variant_index"]: r for r in genotype.equivalence_classes(geno.mapInArrow(counted, schema)).collect()}
    assert seen.value == len(rows)
    plain = {r[0]: r[1:] for r in geno.select("variant_index", genotype.orientation(F.col("dosages")), genotype.canonical(F.col("dosages"))).collect()}
    for i, (turned, canonical) in plain.items():
        digest = hashlib.blake2b(np.array(canonical, np.int8).tobytes(), digest_size=16).hexdigest().upper()
        assert (got[i]["orientation"], got[i]["global_id"]) == (turned, f"G_{digest}")
    assert [got[i]["global_size"] for i in range(8)] == [3, 3, 3, 1, 1, 1, 2, 2] and got[0]["test_size"] == 2
