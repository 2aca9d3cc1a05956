"""Association tables: joins of trait scans, combined p-values, profiles and comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from locusframe.functions import special
from locusframe.functions.stats import acat, interval, neglog10, simes
from locusframe.operators.guards import cut, join_one_to_one, require, require_columns
from locusframe.operators.ranking import bh_adjust, bh_columns, jaccard_by, jaccard_top, lambda_gc, quantiles, running_counts

META = ("variant_index", "snp", "CHR", "pos", "MAF", "missing_rate")
METHODS = ("INC", "SEV", "ACAT", "SIMES")


def _effects(df: DataFrame, p: str) -> list[str]:
    return [c for c in ("beta", "se", "l_remle", p) if c in df.columns]


def trait_pair_table(inc: DataFrame, sev: DataFrame, test: str) -> DataFrame:
    """Two scans of one test by variant, with ACAT and Simes, q-values of all four and Wald intervals."""
    p = f"p_{test}"
    for what, df in (("INC", inc), ("SEV", sev)):
        require_columns(df, {*META, p}, f"{what} scan")
    named = lambda df, t: [F.col(c).alias("p_" + t if c == p else f"{c}_{t}") for c in _effects(df, p)]
    out = join_one_to_one(inc.select(*META, *named(inc, "INC")), sev.select("variant_index", *named(sev, "SEV")), "variant_index", f"{test} scans")
    out = out.withColumn("p_ACAT", acat(F.col("p_INC"), F.col("p_SEV"))).withColumn("p_SIMES", simes(F.col("p_INC"), F.col("p_SEV")))
    out = bh_columns(out, {f"p_{m}": f"q_{m}" for m in METHODS}, "variant_index")
    for t in ("INC", "SEV"):
        if {f"beta_{t}", f"se_{t}"} <= set(out.columns):
            low, high = interval(F.col(f"beta_{t}"), F.col(f"se_{t}"))
            out = out.withColumn(f"ci_low_{t}", low).withColumn(f"ci_high_{t}", high)
    return out.withColumn("test", F.lit(test))


def single_trait_table(scan: DataFrame, test: str, trait: str) -> DataFrame:
    """One scan with q-values and intervals."""
    p = f"p_{test}"
    out = scan.select(*META, *(F.col(c).alias("p" if c == p else c) for c in _effects(scan, p)))
    out = bh_adjust(out, "p", "q_BH").withColumn("trait", F.lit(trait)).withColumn("test", F.lit(test))
    if {"beta", "se"} <= set(out.columns):
        low, high = interval(F.col("beta"), F.col("se"))
        out = out.withColumn("ci_low", low).withColumn("ci_high", high)
    return out


def long_form(table: DataFrame, *keep: str) -> DataFrame:
    """A row for each variant and method: method, p, q."""
    rows = F.array(*(F.struct(F.lit(m).alias("method"), F.col(f"p_{m}").alias("p"), F.col(f"q_{m}").alias("q")) for m in METHODS))
    return table.select(*keep, F.inline(rows))


def profile(table: DataFrame, test: str, context: str = "loco", fdr: float = 0.10) -> DataFrame:
    """By method: number of p-values, lambda GC, smallest p and q, hits."""
    long = cut(long_form(table))
    own = long.groupBy("method").agg(F.count("p").alias("n_variants"), F.min("p").alias("minimum_p"), F.min("q").alias("minimum_q"), F.count_if(F.col("q") < fdr).alias("hits"))
    out = own.join(lambda_gc(long, "p", "method"), "method", "left")
    return out.select("method", "n_variants", "lambda_gc", "minimum_p", "minimum_q", "hits", F.lit(context).alias("context"), F.lit(test).alias("test"))


def pearson(x: str, y: str):  # noqa: ANN201
    """Aggregate; null, not an error, for a constant column."""
    sxy, sxx, syy = (f(F.col(y), F.col(x)) for f in (F.regr_sxy, F.regr_sxx, F.regr_syy))
    return F.when((sxx > 0) & (syy > 0), sxy / (F.sqrt(sxx) * F.sqrt(syy)))


def spearman_by(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, rho, n). Average ranks of both columns in each group come from one pass over their distinct values.

    The columns are checkpointed, as the ranks and the rows read them.
    """
    d = cut(df.select(F.col(group).alias("_group"), F.col(x).alias("_x"), F.col(y).alias("_y")).dropna())
    named = lambda c: F.concat(F.col("_group").cast("string"), F.lit(c))
    long = d.select(F.inline(F.array(*(F.struct(named(c).alias("_name"), F.col(c).alias("_v")) for c in ("_x", "_y")))))
    ranks = running_counts(long.groupBy("_name", "_v").agg(F.count("*").alias("k")), "_v", "_name")
    ranks = ranks.select(F.col("_name").alias("_of"), F.col("_v").alias("_at"), (F.col("_upto") - (F.col("k") - 1) / 2).alias("_rank"))
    for c in ("_x", "_y"):
        own = ranks.withColumnRenamed("_rank", f"_r{c}")
        d = d.withColumn("_of_row", named(c)).join(own, (F.col("_of_row") == F.col("_of")) & (F.col(c) == F.col("_at"))).drop("_of", "_at", "_of_row")
    return d.groupBy(F.col("_group").alias(group)).agg(pearson("_r_x", "_r_y").alias("rho"), F.count("*").alias("n"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rho, n."""
    return spearman_by(df.select(F.lit("").alias("_g"), x, y), "_g", x, y).drop("_g")


#: Names and shares of the top lists that two tests are compared by.
TOPS = {"top_0p1pct_jaccard": 0.001, "top_1pct_jaccard": 0.01, "top_5pct_jaccard": 0.05}


def compare_groups(both: DataFrame, group: str, fdr: float = 0.10) -> DataFrame:
    """A row for each group of (group, variant_index, pl, ql, pr, qr): how the p- and q-values of two tests agree.

    The rows, eight numbers each, are checkpointed, as several statistics read them; groups are few.
    """
    d = both.withColumn("x", neglog10(F.col("pl"))).withColumn("y", neglog10(F.col("pr"))).withColumn("d", F.abs(F.col("x") - F.col("y")))
    d = cut(d)
    base = d.groupBy(group).agg(
        pearson("x", "y").alias("pearson"), F.max("d").alias("max_difference"), F.count_if(F.col("ql") < fdr).alias("left_hits"), F.count_if(F.col("qr") < fdr).alias("right_hits"),
        F.count_if((F.col("ql") < fdr) & (F.col("qr") < fdr)).alias("common_hits"),
    )
    middle = quantiles(d, "d", group, [0.5, 0.99]).select(group, F.col("q0").alias("median_difference"), F.col("q1").alias("p99_difference"))
    tops = jaccard_by(d, group, "pl", "pr", list(TOPS.values()))
    tops = tops.groupBy(group).agg(*(F.max(F.when(F.col("top_fraction") == f, F.col("jaccard"))).alias(name) for name, f in TOPS.items()))
    out = base.join(middle, group, "left").join(spearman_by(d, group, "x", "y").select(group, F.col("rho").alias("spearman")), group, "left")
    return out.join(tops, group)


def compare_tests(tables: dict[str, DataFrame], fdr: float = 0.10) -> DataFrame:
    """left_test, right_test, method and the figures of all pairs of tests and methods, in one pass for all.

    Each test's p- and q-values are checkpointed, as it's in several pairs.
    """
    parts, tables = [], {name: cut(long_form(df, "variant_index")) for name, df in tables.items()}
    for a, b in (("score", "lrt"), ("score", "wald"), ("lrt", "wald")):
        if a in tables and b in tables:
            own = lambda name, side: tables[name].select("variant_index", "method", F.col("p").alias(f"p{side}"), F.col("q").alias(f"q{side}"))
            parts.append(own(a, "l").join(own(b, "r"), ["variant_index", "method"]).withColumn("left_test", F.lit(a)).withColumn("right_test", F.lit(b)))
    require(bool(parts), "no two tests to compare")
    both = reduce(DataFrame.unionByName, parts).withColumn("_of", F.concat_ws(" ", "left_test", "right_test", "method"))
    named = [F.get(F.split("_of", " "), F.lit(k)).alias(c) for k, c in enumerate(("left_test", "right_test", "method"))]
    found = compare_groups(both.select("_of", "variant_index", "pl", "ql", "pr", "qr"), "_of", fdr)
    return found.select(*named, *(c for c in found.columns if c != "_of"))


def compare_pair(left: DataFrame, right: DataFrame, method: str, fdr: float = 0.10) -> DataFrame:
    """One row that compares a method's p-values between two tests, joined by variant."""
    side = lambda df, s: df.select("variant_index", F.col(f"p_{method}").alias(f"p{s}"), F.col(f"q_{method}").alias(f"q{s}"))
    return compare_groups(side(left, "l").join(side(right, "r"), "variant_index").withColumn("method", F.lit(method)), "method", fdr)


def compare_scans(full: DataFrame, other: DataFrame, label: str) -> DataFrame:
    """By method: rank correlation and smallest p of two scans, joined by variant. The joined p-values are checkpointed."""
    named = lambda df, side: df.select("variant_index", *(F.col(f"p_{m}").alias(f"{side}_{m}") for m in METHODS))
    joined, out = cut(named(full, "a").join(named(other, "b"), "variant_index")), []
    for m in METHODS:
        low = joined.agg(F.min(f"a_{m}").alias("full_min_p"), F.min(f"b_{m}").alias("other_min_p")).withColumn("_one", F.lit(1))
        out.append(spearman(joined, f"a_{m}", f"b_{m}").withColumn("_one", F.lit(1)).join(low, "_one").drop("_one").withColumn("metric", F.lit(f"p_{m}")))
    return reduce(DataFrame.unionByName, out).withColumn("comparison", F.lit(label))


def concordance(table: DataFrame, a: str = "p_INC", b: str = "p_SEV") -> tuple[DataFrame, DataFrame]:
    """Correlations of -log10 p with their p-values, and overlap of top lists with enrichment and exact test."""
    spark = table.sparkSession
    d = table.select("variant_index", a, b).withColumn("x", neglog10(F.col(a))).withColumn("y", neglog10(F.col(b)))
    n = d.count()
    found = [("Pearson", d.agg(pearson("x", "y")).first()[0]), ("Spearman", spearman(d, "x", "y").first()[0])]

    def p_of(r: float | None) -> float | None:
        if r is None or n < 3:
            return None
        return 1e-300 if abs(r) >= 1 else float(special.t_two_sided(r * ((n - 2) / (1 - r * r)) ** 0.5, n - 2))

    correlations = spark.createDataFrame([(k, r, p_of(r), n) for k, r in found], "metric string, coefficient double, p_value double, n_snps long")
    rows = []
    for r in jaccard_top(d, a, b, [0.01, 0.05, 0.10]).collect():
        k, both = r["k"], r["overlap"]
        rest, expected = n - 2 * k + both, k * k / n
        odds = float("inf") if k == both else both * rest / (k - both) ** 2
        rows.append((r["top_fraction"], k, both, r["jaccard"], expected, both / expected, odds, special.fisher_greater(both, k - both, k - both, rest)))
    tops = spark.createDataFrame(rows, "top_fraction double, top_n_each int, overlap long, jaccard double, expected_overlap double, fold_enrichment double, odds_ratio double, fisher_p double")
    return correlations, tops


def method_comparison(table: DataFrame, fdr: float = 0.10) -> DataFrame:
    """ACAT against Simes: rank correlation, hits, overlap of top lists. The columns compared are checkpointed."""
    table = cut(table.select("variant_index", "p_ACAT", "p_SIMES", "q_ACAT", "q_SIMES"))
    rho = spearman(table, "p_ACAT", "p_SIMES").select(F.lit("rank correlation").alias("comparison"), F.col("rho").alias("value"), F.lit(None).cast("double").alias("jaccard"))
    hits = table.agg(*(F.count_if(F.col(f"q_{m}") < fdr).cast("double").alias(m) for m in ("ACAT", "SIMES")))
    hits = hits.select(F.inline(F.array(*(F.struct(F.lit(f"hits {m}").alias("comparison"), F.col(m).alias("value"), F.lit(None).cast("double").alias("jaccard")) for m in ("ACAT", "SIMES")))))
    tops = jaccard_top(table, "p_ACAT", "p_SIMES", [0.01, 0.05, 0.10]).select(F.concat(F.lit("top "), F.rint(F.col("top_fraction") * 100).cast("int"), F.lit("%")).alias("comparison"), F.col("overlap").cast("double").alias("value"), "jaccard")
    return rho.unionByName(hits).unionByName(tops)


def candidate_support(leads: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]], classes: DataFrame | None = None) -> DataFrame:
    """Leads with the p- and q-values of each table, suffixed by its name, and alias classes: a chain of left joins."""
    out = leads
    for name, (df, methods) in tables.items():
        columns = [f"{k}_{m}" for m in methods for k in ("p", "q") if f"{k}_{m}" in df.columns]
        out = out.join(df.select("variant_index", *(F.col(c).alias(f"{c}_{name}") for c in columns)), "variant_index", "left")
    if classes is not None:
        out = out.join(classes, "global_alias_class_index", "left")
    return out


def map_candidates(candidates: DataFrame, mapping: DataFrame) -> DataFrame:
    """Candidates (lead_snp, CHR, pos, ...) with variant_index of the mapping's row of that snp, which must agree in position."""
    named = mapping.select(F.col("snp").alias("lead_snp"), "variant_index", F.col("CHR").alias("_chr"), F.col("pos").alias("_pos"))
    out = join_one_to_one(candidates, named, "lead_snp", "candidate mapping")
    off = out.filter(~(F.col("CHR").eqNullSafe(F.col("_chr")) & F.col("pos").eqNullSafe(F.col("_pos")))).limit(1).collect()
    require(not off, f"candidate position disagrees with the mapping: {off}")
    return out.drop("_chr", "_pos")


def enrich_candidates(candidates: DataFrame, primary: DataFrame, others: dict[str, DataFrame], classes: DataFrame) -> DataFrame:
    """Candidates with the primary scan's columns, intervals, p-values of other scans (suffixed by name) and alias classes.

    A column of the candidates that the primary scan has too is taken from the scan. Ranked by p_ACAT, p_SEV and position.
    """
    own = [c for c in candidates.columns if c == "variant_index" or c not in primary.columns]
    out = candidates.select(*own).join(primary, "variant_index", "left")
    for t in ("INC", "SEV"):
        low, high = interval(F.col(f"beta_{t}"), F.col(f"se_{t}"))
        out = out.withColumn(f"ci_low_{t}", low).withColumn(f"ci_high_{t}", high)
    for name, df in others.items():
        out = out.join(df.select("variant_index", *(F.col(f"p_{m}").alias(f"p_{m}_{name}") for m in METHODS if f"p_{m}" in df.columns)), "variant_index", "left")
    alias = classes.select("global_alias_class_index", "global_alias_class_id", F.col("class_size").alias("global_alias_count"), "n_chromosomes", "alias_mappings")
    out = out.drop("global_alias_class_size").join(alias, "global_alias_class_index", "left")
    rank = F.row_number().over(W.orderBy(F.col("p_ACAT").asc_nulls_last(), F.col("p_SEV").asc_nulls_last(), "CHR", "pos", "variant_index"))  # candidates are few
    return out.withColumn("candidate_rank", rank)


def check_reference(values: DataFrame) -> DataFrame:
    """(metric, expected, actual, mode, tolerance) rows with PASS, FAIL or, for diagnostics, WARN."""
    e, a, tol = F.col("expected"), F.col("actual"), F.col("tolerance")
    ok = F.when(F.col("mode") == "log10", F.abs(F.log10(a) - F.log10(e)) <= tol).when(F.col("mode") == "exact", a == e).otherwise(F.abs(a - e) <= tol)
    return values.withColumn("status", F.when(F.coalesce(ok, F.lit(False)), "PASS").when(F.col("mode") == "diagnostic", "WARN").otherwise("FAIL"))


#: Figures of a scan's summary, how far two runs may differ in them, and on what scale.
SUMMARY_TOLERANCES = (("lambda_gc", 2e-6, "absolute"), ("minimum_p", 2e-4, "log10"), ("fdr_significant", 0.0, "exact"))


def compare_summaries(observed: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, observed, expected, difference, tolerance, comparison_scale, passed: a row for each figure of each group.

    A group that ``expected`` lacks does not pass.
    """
    own = expected.select(*keys, *(F.col(m).alias(f"_{m}") for m, _, _ in SUMMARY_TOLERANCES))
    figures = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("observed"), F.col(f"_{m}").cast("double").alias("expected"), F.lit(t).alias("tolerance"), F.lit(s).alias("comparison_scale")) for m, t, s in SUMMARY_TOLERANCES))
    d = observed.join(own, keys, "left").select(*keys, F.inline(figures))
    log = F.abs(F.log10("observed") - F.log10("expected"))
    d = d.withColumn("difference", F.when(F.col("comparison_scale") == "log10", log).otherwise(F.abs(F.col("observed") - F.col("expected"))))
    return d.withColumn("passed", F.coalesce(F.col("difference") <= F.col("tolerance"), F.lit(False)))


def candidate_score_effects(scan: DataFrame, candidates: DataFrame, omissions: DataFrame, locations: int, traits: tuple[str, ...] = ("INC", "SEV")) -> DataFrame:
    """Each candidate's score-test effect of a scan beside those of runs that leave one location out.

    ``scan``: variant_index, trait, beta, se, p_score; ``candidates``: variant_index, lead_snp and p_<trait>_score, with
    which the scan must agree to 3e-6 of the value; ``omissions``: lead_snp, omitted_location, beta_<trait>_score and
    p_<trait>_score, a row for each candidate and location. A row that is missing, repeats or isn't finite is an error.
    """
    by_trait = lambda *cols: F.inline(F.array(*(F.struct(F.lit(t).alias("trait"), *(F.col(f"{c}_{t}_score").alias(n) for c, n in cols)) for t in traits)))
    wanted = candidates.select("variant_index", "lead_snp", by_trait(("p", "_p")))
    primary = wanted.join(scan.select("variant_index", "trait", "beta", "se", "p_score"), ["variant_index", "trait"])
    own = primary.select("lead_snp", "trait", F.col("beta").alias("primary_beta_null_ML"), F.col("se").alias("primary_se_null_ML"), F.col("p_score").alias("primary_p_score"), "_p")
    left_out = omissions.select("lead_snp", "omitted_location", by_trait(("beta", "omission_beta_null_ML"), ("p", "omission_p_score")))
    out = cut(own.join(left_out, ["lead_snp", "trait"]))
    agrees = F.abs(F.col("primary_p_score") - F.col("_p")) <= 1e-12 + 3e-6 * F.abs("_p")
    sound = reduce(lambda a, b: a & b, (F.coalesce(F.abs(c) < float("inf"), F.lit(False)) for c in ("primary_beta_null_ML", "primary_se_null_ML", "omission_beta_null_ML")))
    n, keys, same, fine = out.agg(F.count("*"), F.count_distinct("lead_snp", "trait", "omitted_location"), F.count_if(agrees), F.count_if(sound)).first()
    require(n == keys == candidates.count() * locations * len(traits), f"{n} rows of {keys} candidates, traits and locations")
    require(same == n, "score p-values differ from the candidates'")
    require(fine == n, "an effect isn't finite")
    alike = F.signum("primary_beta_null_ML") == F.signum("omission_beta_null_ML")
    return out.drop("_p").withColumn("direction_preserved", alike)
