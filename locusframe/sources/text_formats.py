"""Readers of text formats: VCF, GFF3, association output. Executors parse; the driver reads a VCF's header line only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from locusframe.functions.stats import TINY, clip, finite
from locusframe.functions.text import chromosome_number, genotype_code, genotype_field, normalize_id, number_or_null
from locusframe.operators.genotype import quality_controlled
from locusframe.operators.guards import join_one_to_one, require
from locusframe.sources.blocks import block_lines, is_blocked


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    """Names of the samples of the first ``#CHROM`` line."""
    found = (block_lines(spark, path) if is_blocked(path) else spark.read.text(path)).filter(F.col("value").startswith("#CHROM")).limit(1).collect()
    fields = found[0][0].split("\t") if found else []
    require(len(fields) >= 10, f"{path}: no header line with samples")
    return fields[9:]


def match_samples(spark: SparkSession, samples: Sequence[str], ids: Sequence[str], at_least: int = 30) -> DataFrame:
    """sample_index, ID_std, VCF_sample, VCF_sample_index of the ids that the file has, in the order of ``ids``."""
    a = spark.createDataFrame(list(enumerate(ids)), "place long, wanted string").withColumn("ID_std", normalize_id(F.col("wanted")))
    b = spark.createDataFrame(list(enumerate(samples)), "VCF_sample_index long, VCF_sample string").withColumn("ID_std", normalize_id(F.col("VCF_sample")))
    twice = [r["ID_std"] for d in (a, b) for r in d.groupBy("ID_std").count().filter("count > 1").limit(5).collect()]
    require(not twice, f"ids that repeat: {twice}")
    out = a.join(b, "ID_std").withColumn("sample_index", F.row_number().over(W.orderBy("place")) - 1)
    n = out.count()
    require(n >= at_least, f"{n} samples match; {at_least} are needed")
    return out.select("sample_index", "ID_std", "VCF_sample", "VCF_sample_index").orderBy("sample_index")


def vcf_records(spark: SparkSession, path: str, columns: Sequence[int], region: tuple[int, int, int] | None = None) -> DataFrame:
    """Each record in file order: line, CHR, pos, snp, dosages of the sample columns, and skip, the reason to leave it out.

    Only the wanted sample fields are parsed, and only in records that the cheap conditions pass. A block-compressed file
    is read by as many tasks as it has ranges, which hand on nothing but these fields, and those of a ``region``
    (chromosome, first and last position) alone; one compressed as a whole is one task's.
    """
    if is_blocked(path):
        lines, columns = block_lines(spark, path, columns, region), range(len(columns))
    else:
        lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    lines = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = F.col("f")
    d = lines.select("line", F.split("value", "\t").alias("f"))
    d = d.withColumn("CHR", chromosome_number(F.get(f, F.lit(0)))).withColumn("pos", F.get(f, F.lit(1)).try_cast("bigint"))
    if region is not None:
        d = d.filter((F.col("CHR") == region[0]) & F.col("pos").between(region[1], region[2]))
    early = F.when(F.size("f") < 10, "short").when(F.col("CHR").isNull(), "chromosome").when(F.get(f, F.lit(4)).contains(","), "multiallelic").when(F.col("pos").isNull(), "position")
    d = d.withColumn("early", early)
    calls = F.transform(F.array(*(F.lit(9 + c) for c in columns)), lambda c: genotype_code(genotype_field(F.get(f, F.lit(8)), F.coalesce(F.get(f, c), F.lit(".")))))
    d = d.withColumn("dosages", F.when(F.col("early").isNull(), calls))
    name = F.get(f, F.lit(2))
    snp = F.when(name.isin(".", ""), F.format_string("S%02d_%d", "CHR", "pos")).otherwise(name)
    return d.select("line", "CHR", "pos", snp.alias("snp"), "dosages", "early")


def read_vcf(spark: SparkSession, path: str, columns: Sequence[int], maf_min: float, missing_max: float) -> tuple[DataFrame, DataFrame]:
    """Kept variants, numbered in file order, and the number of records by reason of leaving out."""
    d = quality_controlled(vcf_records(spark, path, columns), maf_min, missing_max)
    d = d.withColumn("skip", F.coalesce("early", "skip"))
    return numbered(d.filter(F.col("skip").isNull()).select("line", "snp", "CHR", "pos", "MAF", "missing_rate", "dosages")), d.groupBy(F.coalesce("skip", F.lit("kept")).alias("reason")).count()


def numbered(kept: DataFrame) -> DataFrame:
    """variant_index from 0 in the order of ``line``: counts by partition of the file, then ranks within."""
    part = F.shiftright("line", 33)
    d = kept.withColumn("_part", part)
    before = d.groupBy("_part").agg(F.count("*").alias("_n")).select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    d = d.join(F.broadcast(before), F.col("_part") == F.col("_p"))  # one row a split of the file
    return d.withColumn("variant_index", F.col("_before") + F.row_number().over(W.partitionBy("_part").orderBy("line")) - 1).drop("_part", "_p", "_before", "line")


def gff_attribute(attributes: Column, key: str) -> Column:
    """The last value of a key in ``k=v;k=v``; null where it is missing or empty."""
    own = F.filter(F.split(attributes, ";"), lambda t: F.trim(F.substring_index(t, "=", 1)) == key)
    own = F.filter(own, lambda t: t.contains("="))
    value = F.trim(F.regexp_replace(F.try_element_at(own, F.lit(-1)), r"^[^=]*=", ""))
    return F.when(value != "", value)


def parse_genes(lines: DataFrame) -> DataFrame:
    """CHR, start, end, gene, attributes of the gene lines of a column ``value``."""
    f = F.split("value", "\t")
    get = lambda k: F.get(f, F.lit(k))
    d = lines.filter(~F.col("value").startswith("#") & (F.size(f) >= 9)).filter(F.lower(get(2)) == "gene")
    d = d.select(chromosome_number(get(0)).alias("CHR"), get(3).try_cast("bigint").alias("start"), get(4).try_cast("bigint").alias("end"), get(8).alias("attributes"))
    name = F.coalesce(*(gff_attribute(F.col("attributes"), k) for k in ("Name", "ID", "gene_id")), F.lit(""))
    return d.dropna(subset=["CHR", "start", "end"]).select("CHR", "start", "end", F.regexp_replace(name, "^(gene:|gene-)", "").alias("gene"), "attributes")


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    return parse_genes(spark.read.text(path))


#: Spellings of the columns of association output.
ASSOC_ALIASES = {
    "chr": "chr", "chrom": "chr", "rs": "rs", "snp": "rs", "id": "rs", "ps": "ps", "pos": "ps", "bp": "ps", "n_miss": "n_miss", "n_mis": "n_miss",
    "allele1": "allele1", "a1": "allele1", "allele0": "allele0", "a0": "allele0", "a2": "allele0", "af": "af", "maf": "af", "beta": "beta", "se": "se",
    "logl_h1": "logl_H1", "l_remle": "l_remle", "l_mle": "l_mle", "p_wald": "p_wald", "p_lrt": "p_lrt", "p_score": "p_score",
}
_NUMBERS = ("ps", "n_miss", "af", "beta", "se", "logl_H1", "l_remle", "l_mle", "p_wald", "p_lrt", "p_score")


def read_assoc(spark: SparkSession, path: str) -> DataFrame:
    """Columns by their known names; numbers or null; p-values not below 1e-300."""
    lines = spark.read.text(path).withColumn("f", F.split(F.trim("value"), r"\s+"))
    head = lines.limit(1).collect()[0]["f"]
    at = {ASSOC_ALIASES[c.lower()]: k for k, c in enumerate(head) if c.lower() in ASSOC_ALIASES}
    require("rs" in at and any(c.startswith("p_") for c in at), f"{path}: no marker or no test among {head}")
    d = lines.filter((F.size("f") == len(head)) & (F.col("value") != F.lit(spark.read.text(path).first()[0])))
    out = {}
    for c, k in at.items():
        v = F.get("f", F.lit(k))
        if c in _NUMBERS:
            v = finite(number_or_null(v))
            v = clip(v, TINY, 1.0) if c.startswith("p_") else v
        out[c] = v
    return d.select(*(v.alias(c) for c, v in out.items()))


def map_assoc(assoc: DataFrame, mapping: DataFrame) -> DataFrame:
    """Association rows with the variants of their marker ids; every row needs exactly one."""
    return join_one_to_one(assoc.withColumnRenamed("rs", "gemma_id"), mapping, "gemma_id", "association output")


def write_scans(scans: DataFrame, path: str) -> None:
    """Scan rows in folders by context and trait."""
    scans.write.partitionBy("context", "trait").mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def read_scans(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length and sha256 of each file under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.upper(F.sha2("content", 256)).alias("sha256"))


def compare_inventories(listed: DataFrame, found: DataFrame) -> DataFrame:
    """Files that are missing, new or changed between two (path, sha256) tables."""
    d = listed.select("path", F.col("sha256").alias("a")).join(found.select("path", F.col("sha256").alias("b")), "path", "full")
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "new").when(F.upper("a") != F.upper("b"), "changed")
    return d.select("path", state.alias("state")).filter(F.col("state").isNotNull())


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that changes with any row of the table, whatever their order."""
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("fingerprint"))
