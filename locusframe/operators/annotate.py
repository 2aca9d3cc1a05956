"""Range joins of lead variants with genes and with other scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from locusframe.functions.stats import same_sign
from locusframe.operators.guards import cut


def gap(pos: Column, start: Column, end: Column) -> Column:
    """0 inside an interval, else the distance to its nearer end."""
    return F.when(pos < start, start - pos).when(pos > end, pos - end).otherwise(F.lit(0)).cast("bigint")


def nearby_genes(leads: DataFrame, genes: DataFrame, flank_bp: int) -> DataFrame:
    """Genes within the flank of each lead; where there is none, the nearest of the chromosome.

    Within the flank: an equality on flank-wide buckets that an interval covers. Nearest: ``nearest_outside``, for the
    leads that the first step leaves; a repeated lead counts once there.
    """
    width = max(flank_bp, 1)
    g = genes.select("CHR", F.col("start").alias("gene_start"), F.col("end").alias("gene_end"), "gene")
    at = leads.select("lead_snp", "CHR", F.col("pos").alias("lead_pos"), F.expr(f"pos div {width}").alias("bucket"))
    spans = g.withColumn("bucket", F.explode(F.sequence(F.expr(f"(gene_start - {flank_bp}) div {width} - 1"), F.expr(f"(gene_end + {flank_bp}) div {width}"))))
    near = at.join(spans, ["CHR", "bucket"]).withColumn("distance_bp", gap(F.col("lead_pos"), F.col("gene_start"), F.col("gene_end"))).filter(F.col("distance_bp") <= flank_bp)
    near = near.select("lead_snp", "CHR", "lead_pos", "gene", "gene_start", "gene_end", "distance_bp", F.lit(True).alias("within_flank"))
    lone = at.drop("bucket").join(near.select("lead_snp", "CHR", "lead_pos"), ["lead_snp", "CHR", "lead_pos"], "left_anti").distinct()
    g = g.withColumn("gene_start", F.col("gene_start").cast("bigint")).withColumn("gene_end", F.col("gene_end").cast("bigint"))
    found = nearest_outside(lone.select("CHR", F.col("lead_pos").alias("x")).distinct(), g).withColumnRenamed("x", "lead_pos")
    both = lone.join(found, ["CHR", "lead_pos"]).select("lead_snp", "CHR", "lead_pos", "gene", "gene_start", "gene_end", "distance_bp", F.lit(False).alias("within_flank"))
    return near.unionByName(both)


def nearest_outside(points: DataFrame, genes: DataFrame) -> DataFrame:
    """(CHR, x, distance_bp, gene, gene_start, gene_end): the nearest gene of points that lie in none; ties by start, then name.

    One row a place says which gene ends and which starts there. Places are dealt to ranges of (CHR, x), so that a
    chromosome of any length is many tasks; within a range, windows carry the last gene that ended and the next that
    starts, and a row for each range and chromosome carries them on to the other ranges. Points of a chromosome without a
    gene, or without a chromosome, have no row.
    """
    g = genes.select("CHR", F.struct("gene_start", "gene_end", "gene").alias("g"))
    ends = g.groupBy("CHR", F.col("g.gene_end").alias("x")).agg(F.min_by("g", F.struct("g.gene_start", "g.gene")).alias("ended"))
    starts = g.groupBy("CHR", F.col("g.gene_start").alias("x")).agg(F.min_by("g", F.struct("g.gene", "g.gene_end")).alias("starting"))
    marks = points.select("CHR", F.col("x").cast("bigint").alias("x"), F.lit(True).alias("asked")).unionByName(ends, True).unionByName(starts, True)
    places = marks.groupBy("CHR", "x").agg(F.max("asked").alias("asked"), F.first("ended", True).alias("ended"), F.first("starting", True).alias("starting"))
    dealt = cut(places.repartitionByRange("CHR", "x").withColumn("_range", F.spark_partition_id()))
    at = W.partitionBy("CHR", "_range").orderBy("x")
    inside = dealt.withColumn("before", F.last("ended", True).over(at.rowsBetween(W.unboundedPreceding, 0))).withColumn("after", F.first("starting", True).over(at.rowsBetween(0, W.unboundedFollowing)))
    own = dealt.groupBy("CHR", "_range").agg(
        F.max_by("ended", F.when(F.col("ended").isNotNull(), F.col("x"))).alias("ended"), F.min_by("starting", F.when(F.col("starting").isNotNull(), F.col("x"))).alias("starting")
    )
    order = W.partitionBy("CHR").orderBy("_range")
    others = own.select("CHR", "_range", F.last("ended", True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("earlier"), F.first("starting", True).over(order.rowsBetween(1, W.unboundedFollowing)).alias("later"))
    far = lambda c: F.when(c.isNotNull(), F.struct(gap(F.col("x"), c["gene_start"], c["gene_end"]).alias("distance_bp"), c["gene_start"].alias("gene_start"), c["gene"].alias("gene"), c["gene_end"].alias("gene_end")))
    sides = F.array(far(F.coalesce("before", "earlier")), far(F.coalesce("after", "later")))
    met = inside.filter("asked").join(F.broadcast(others), ["CHR", "_range"]).select("CHR", "x", F.array_min(sides).alias("g"))
    return met.filter(F.col("g").isNotNull()).select("CHR", "x", "g.*")


def window_minima(leads: DataFrame, scan: DataFrame, window_bp: int, columns: list[str]) -> DataFrame:
    """Smallest values of a scan's columns within a window of each lead (by lead_snp), null where there is no row."""
    width = max(window_bp, 1)
    at = leads.select("lead_snp", "CHR", F.col("pos").alias("lead_pos"), F.explode(F.sequence(F.expr(f"pos div {width} - 1"), F.expr(f"pos div {width} + 1"))).alias("bucket"))
    rows = scan.select("CHR", "pos", F.expr(f"pos div {width}").alias("bucket"), *columns)
    met = at.join(rows, ["CHR", "bucket"]).filter(F.abs(F.col("pos") - F.col("lead_pos")) <= window_bp)
    found = met.groupBy("lead_snp").agg(*(F.min(c).alias(f"min_{c}") for c in columns))
    return leads.join(found, "lead_snp", "left")


def window_support(leads: DataFrame, scan: DataFrame, window_bp: int, p_max: float) -> DataFrame:
    d = window_minima(leads.select("lead_snp", "CHR", "pos"), scan, window_bp, ["p_INC", "p_SEV"])
    ok = lambda c: F.coalesce(F.col(c) < p_max, F.lit(False))
    d = d.withColumnsRenamed({"min_p_INC": "min_p_INC_window", "min_p_SEV": "min_p_SEV_window"})
    return d.withColumn("INC_support", ok("min_p_INC_window")).withColumn("SEV_support", ok("min_p_SEV_window")).withColumn("both_support", F.col("INC_support") & F.col("SEV_support"))


def omission_stability(leads: DataFrame, full: DataFrame, omitted: DataFrame, window_bp: int) -> DataFrame:
    """Leads by omitted location: values at the lead, smallest ones in its window, agreement of directions.

    ``omitted``: rows of the scan with a column location.
    """
    f = full.select(F.col("variant_index").alias("lead_variant_index"), F.col("p_ACAT").alias("full_p_ACAT"), F.col("beta_INC").alias("fb_INC"), F.col("beta_SEV").alias("fb_SEV"))
    exact = omitted.select(F.col("variant_index").alias("lead_variant_index"), "location", *(F.col(f"p_{m}").alias(f"loo_exact_p_{m}") for m in ("INC", "SEV", "ACAT")), "beta_INC", "beta_SEV")
    d = leads.join(f, "lead_variant_index").join(exact, "lead_variant_index")
    width = max(window_bp, 1)
    at = leads.select("lead_snp", "CHR", F.col("pos").alias("lead_pos"), F.explode(F.sequence(F.expr(f"pos div {width} - 1"), F.expr(f"pos div {width} + 1"))).alias("bucket"))
    rows = omitted.select("CHR", "pos", "location", F.expr(f"pos div {width}").alias("bucket"), "p_ACAT", "p_INC", "p_SEV")
    low = at.join(rows, ["CHR", "bucket"]).filter(F.abs(F.col("pos") - F.col("lead_pos")) <= window_bp).groupBy("lead_snp", "location").agg(*(F.min(f"p_{m}").alias(f"loo_min_p_{m}_window") for m in ("ACAT", "INC", "SEV")))
    d = d.join(low, ["lead_snp", "location"], "left")
    for t in ("INC", "SEV"):
        d = d.withColumn(f"beta_{t}_direction_same", same_sign(F.col(f"beta_{t}"), F.col(f"fb_{t}")))
    return d.drop("beta_INC", "beta_SEV", "fb_INC", "fb_SEV")


def omission_support(candidates: DataFrame, full: DataFrame, omitted: DataFrame) -> DataFrame:
    """Candidates by omitted location where both scans hold the variant."""
    a = full.select("variant_index", *(F.col(f"p_{m}").alias(f"full_p_{m}") for m in ("INC", "SEV", "ACAT")))
    b = omitted.select("variant_index", "location", *(F.col(f"p_{m}").alias(f"loo_p_{m}") for m in ("INC", "SEV", "ACAT")))
    return candidates.select("variant_index", "lead_rank").join(a, "variant_index").join(b, "variant_index")


def with_effects(leads: DataFrame, scans: dict[str, DataFrame]) -> DataFrame:
    """Leads with beta, se, interval, p and n of each scan, null where a scan lacks the variant."""
    out = leads
    for name, scan in scans.items():
        s = scan.select(F.col("variant_index").alias("lead_variant_index"), F.col("beta").alias(f"beta_{name}"), F.col("se").alias(f"se_{name}"), (F.col("beta") - 1.96 * F.col("se")).alias(f"ci_low_{name}"), (F.col("beta") + 1.96 * F.col("se")).alias(f"ci_high_{name}"), F.col("p").alias(f"p_{name}"), F.col("n").alias(f"n_{name}"))
        out = out.join(s, "lead_variant_index", "left")
    return out
