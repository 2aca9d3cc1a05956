"""Genotype matrix operators. A row is a variant: (variant_index, CHR, pos, dosages array of -1, 0, 1, 2)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from locusframe.operators.guards import cut, require
from locusframe.operators.numbering import numbered
from locusframe.operators.packed import links, matrix, packed
from locusframe.operators.ranking import bh_columns
from locusframe.operators.tables import METHODS


def called(d: Column) -> Column:
    return F.filter(d, lambda x: x >= 0)


def total(d: Column) -> Column:
    return F.aggregate(called(d), F.lit(0).cast("bigint"), lambda s, x: s + x)


def allele_frequency(d: Column) -> Column:
    return F.try_divide(total(d).cast("double"), 2 * F.size(called(d)))


def maf(d: Column) -> Column:
    f = allele_frequency(d)
    return F.when(f <= 0.5, f).otherwise(1 - f)


def missing_rate(d: Column) -> Column:
    return 1 - F.size(called(d)) / F.size(d)


def imputed(d: Column) -> Column:
    """Doubles with missing entries as the mean of the called ones; 0 where none is called."""
    mean = F.coalesce(F.try_divide(total(d).cast("double"), F.size(called(d))), F.lit(0.0))
    # The mean is the variable of an outer lambda, so that it's summed once a row and not once an entry.
    return F.get(F.transform(F.array(mean), lambda m: F.transform(d, lambda x: F.when(x < 0, m).otherwise(x.cast("double")))), F.lit(0))


def orientation(d: Column) -> Column:
    """-1 where the complement 2 - x comes first in order, which the first entry of 0 or 2 decides."""
    return F.when(F.get(F.filter(d, lambda x: x.isin(0, 2)), F.lit(0)) == 2, -1).otherwise(1)


def canonical(d: Column) -> Column:
    """The vector or its complement, whichever comes first; missing entries stay."""
    return F.when(orientation(d) == -1, F.transform(d, lambda x: F.when(x >= 0, (2 - x).cast("tinyint")).otherwise(x))).otherwise(d)


def quality_controlled(calls: DataFrame, maf_min: float, missing_max: float) -> DataFrame:
    """Adds maf, missing_rate and skip: why a variant doesn't count, by the first reason that holds; null if it does."""
    d = calls.withColumn("missing_rate", missing_rate(F.col("dosages"))).withColumn("MAF", maf(F.col("dosages")))
    skip = F.when(F.size(called(F.col("dosages"))) == 0, "no_calls").when(F.col("missing_rate") > missing_max, "missing").when(F.col("MAF") < maf_min, "maf")
    return d.withColumn("skip", skip)


def digests(geno: DataFrame) -> DataFrame:
    """orientation and digest, 128 bits of the canonical vector as 32 upper hex letters, in place of dosages."""
    fields = [f for f in geno.schema if f.name != "dosages"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("dosages")
            flat = column.flatten()
            require(column.null_count == 0 and flat.null_count == 0, "dosages are null")
            x, ends = flat.to_numpy(zero_copy_only=False).astype(np.int8, copy=False), np.cumsum(column.value_lengths().to_numpy(), dtype=np.int64)
            starts = np.concatenate((np.zeros(1, np.int64), ends))[: len(ends)]
            # A row's first entry of 0 or 2, if it has one, says whether its complement comes first.
            told = np.flatnonzero((x == 0) | (x == 2))
            at = np.searchsorted(told, starts)
            has = at < np.searchsorted(told, ends)
            turned = has & (x[told[np.where(has, at, 0)]] == 2) if len(told) else has
            both = (np.ascontiguousarray(x), np.where(x >= 0, 2 - x, x).astype(np.int8))
            own = [hashlib.blake2b(both[t][a:b], digest_size=16).hexdigest().upper() for t, a, b in zip(turned.tolist(), starts.tolist(), ends.tolist(), strict=True)]
            rows = batch.select([f.name for f in fields]).append_column("orientation", pa.array(np.where(turned, -1, 1).astype(np.int32)))
            yield rows.append_column("digest", pa.array(own, pa.string()))

    schema = StructType([*fields, StructField("orientation", IntegerType(), False), StructField("digest", StringType())])
    return geno.select(*(f.name for f in fields), "dosages").mapInArrow(run, schema)


def equivalence_classes(geno: DataFrame) -> DataFrame:
    """variant_index, CHR, orientation, and index, id and size of the class over all and within the chromosome.

    The classes come from a group-by of the canonical vectors; indexes follow the digests' order. The digests are
    checkpointed, as three passes read them.
    """
    d = cut(digests(geno.select("variant_index", "CHR", "pos", "dosages")))
    whole = d.groupBy("digest").agg(F.count("*").alias("global_size"))
    whole = numbered(whole, [F.col("digest")], "global_class").withColumn("global_id", F.concat(F.lit("G_"), F.col("digest")))
    local = d.groupBy("CHR", "digest").agg(F.count("*").alias("test_size"))
    local = numbered(local, [F.col("CHR"), F.col("digest")], "test_class").withColumn("test_id", F.format_string("CHR%02d_%s", "CHR", "digest"))
    return d.join(whole, "digest").join(local, ["CHR", "digest"])


def representatives(df: DataFrame, by: str, p: str) -> DataFrame:
    """The variant of smallest p of each class; missing p last, ties by variant_index."""
    order = F.struct(F.coalesce(p, F.lit(float("inf"))).alias("p"), "variant_index")
    return df.groupBy(by).agg(F.min_by("variant_index", order).alias("representative"))


def class_tables(variants: DataFrame) -> dict[str, DataFrame]:
    """From variants with classes and p-values: test classes, global classes and a summary."""
    reps = [F.min_by("variant_index", F.struct(F.coalesce(f"p_{m}", F.lit(float("inf"))).alias("p"), "variant_index")).alias(f"representative_{m}") for m in METHODS]
    tests = variants.groupBy("test_class", "test_id", "CHR").agg(
        F.count("*").alias("class_size"), *reps, *(F.min(f"p_{m}").alias(f"minimum_p_{m}") for m in METHODS), *((F.max(f"p_{m}") - F.min(f"p_{m}")).alias(f"spread_{m}") for m in METHODS)
    )
    tests = bh_columns(tests, {f"minimum_p_{m}": f"q_unique_{m}" for m in METHODS}, "test_class")
    name = F.concat("snp", F.lit("@chr"), F.col("CHR").cast("string"), F.lit(":"), F.col("pos").cast("string"))
    whole = variants.groupBy("global_class", "global_id").agg(
        F.count("*").alias("class_size"), F.min_by("variant_index", F.struct(F.coalesce("p_ACAT", F.lit(float("inf"))).alias("p"), "variant_index")).alias("representative"),
        F.countDistinct("CHR").alias("n_chromosomes"), F.min("pos").alias("minimum_position"), F.max("pos").alias("maximum_position"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("variant_index", name.alias("name")))), lambda x: x["name"]), "; ").alias("alias_mappings"),
    )
    summary = variants.agg(F.count("*").alias("variant_rows"), F.countDistinct("global_class").alias("global_classes"), F.countDistinct("test_class").alias("test_classes"), F.count_if(F.col("global_size") > 1).alias("in_global_duplicates"), F.count_if(F.col("test_size") > 1).alias("in_test_duplicates"), F.max("global_size").alias("largest_global"), F.max("test_size").alias("largest_test"))
    return {"test_classes": tests, "global_classes": whole, "summary": summary}


def collapse(variants: DataFrame, method: str) -> DataFrame:
    """One row a test class, then one a global class: smallest p, missing last, ties by variant_index."""
    order = [F.col(f"p_{method}").asc_nulls_last(), F.col("variant_index")]
    first = lambda d, by: d.withColumn("_rn", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter("_rn = 1").drop("_rn")
    return first(first(variants, "test_class"), "global_class")


def standardized(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """(x - mean) / sqrt(2 p (1 - p)) by row, p = mean / 2 kept off 0 and 1."""
    p = np.clip(mean / 2, 1e-6, 1 - 1e-6)
    return (x - mean[:, None]) / np.sqrt(2 * p * (1 - p))[:, None]


def standardized_squares(geno: DataFrame) -> DataFrame:
    """variant_index and squares, the sum of squares of the standardised, imputed dosages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = dosage_matrix(batch.column("dosages"))
            z = standardized(x, x.mean(axis=1))
            yield pa.record_batch([batch.column("variant_index"), pa.array((z * z).sum(axis=1))], ["variant_index", "squares"])

    return geno.select("variant_index", "dosages").mapInArrow(run, "variant_index long, squares double")


def dosage_matrix(column: pa.Array) -> np.ndarray:
    """Imputed doubles of a batch: missing entries get the row's mean."""
    x = matrix(column).astype(np.float64)
    miss = x < 0
    n = (~miss).sum(axis=1)
    mean = np.where(miss, 0, x).sum(axis=1) / np.maximum(n, 1)
    return np.where(miss, mean[:, None], x)


def r2_pairs(geno: DataFrame, window_bp: int) -> DataFrame:
    """(CHR, a, b, r2) of variants of a chromosome within a window, on imputed dosages; a constant one has r2 0."""
    return links(packed(geno.select(F.col("variant_index").alias("id"), "CHR", "pos", "dosages")), window_bp)
