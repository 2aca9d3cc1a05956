"""The last stage of an analysis: from trait scans, genotypes and genes to the tables that are published.

Every table is written once to the shared folder and read from there by those that follow, under a key of the inputs'
contents and the settings. A run that lost its driver goes on behind the last table it finished, and one with other
inputs or settings never meets this one's tables.

Edge cases: a scan that lacks or repeats a variant of its partner, or a variant without genotypes, is an error, and so is
a missing primary scan; null p-values are hits of nothing and lead nothing; extra columns aren't read; without leads at
the first threshold the smallest p-values lead, as ``clump`` says; without genes in reach the nearest one is named.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from locusframe.operators import annotate, genotype, ld, models, ranking, tables
from locusframe.operators.guards import join_one_to_one, require
from locusframe.sources.text_formats import fingerprint
from locusframe.sources.workbooks import write_workbook

TESTS = ("score", "lrt", "wald")
#: The p-values whose signals are clumped.
LEADING = ("ACAT", "SEV")
#: Second traits that the score test's table is made again with: their name beside candidates and in the profile.
OTHERS = {"SEV_COND": ("conditional", "conditional_severity"), "SEV_POS": ("positive_only", "positive_only_severity")}
#: Allele frequencies and targets of the table of detectable effects.
FREQUENCIES, TARGETS = (0.05, 0.10, 0.20, 0.30, 0.50), (0.80, 0.90)


@dataclass(frozen=True)
class Settings:
    """Thresholds of leads and their clumps, of candidates and of hits; lengths of the lists beside the full tables."""

    index_p: float = 1e-4
    secondary_p: float = 1e-3
    window_kb: int = 1000
    r2: float = 0.20
    fallback: int = 500
    candidates: int = 10
    flank_kb: int = 50
    fdr: float = 0.10
    sample_sizes: tuple[int, ...] = (100, 102)
    top_rows: int = 20_000
    top_classes: int = 5_000


def run_key(inputs: dict[str, DataFrame], settings: Settings) -> str:
    """Changes with any row or column of the inputs, whatever the rows' order, and with the settings."""
    seen = {name: [df.dtypes, *map(str, fingerprint(df).first())] for name, df in inputs.items()}
    return hashlib.sha256(json.dumps([seen, asdict(settings)]).encode()).hexdigest()[:16]


class Store:
    """Tables of one run by name; what is there whole is read, the rest is built."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def whole(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        reader, path = self.spark.read, f"{self.folder}/{name}"
        if not self.whole(name):
            df = build()
            df.write.mode("overwrite").parquet(path)
            reader = reader.schema(df.schema)
        return reader.parquet(path)


def classed_variants(score: DataFrame, genotypes: DataFrame) -> DataFrame:
    """The score test's rows with their equivalence classes."""
    own = join_one_to_one(score.select("variant_index", "CHR", "pos"), genotypes, "variant_index", "genotypes")
    return score.join(genotype.equivalence_classes(own).drop("CHR", "pos"), "variant_index")


def pooled_leads(leads: dict[str, DataFrame], score: DataFrame, most: int) -> DataFrame:
    """The first ``most`` leads of all methods by p_ACAT, p_SEV and place; a lead of two counts for the first by name."""
    named = [df.withColumn("candidate_source", F.lit(f"score_{m}")).drop("p") for m, df in leads.items()]
    rest = [c for c in named[0].columns if c != "lead_variant_index"]
    one = reduce(DataFrame.unionByName, named).groupBy("lead_variant_index").agg(F.min_by(F.struct(*rest), "candidate_source").alias("_of"))
    pool = one.select(F.col("lead_variant_index").alias("variant_index"), "_of.*").join(score.select("variant_index", "MAF", "p_ACAT", "p_SEV"), "variant_index")
    order = [F.col("p_ACAT").asc_nulls_last(), F.col("p_SEV").asc_nulls_last(), F.col("CHR"), F.col("pos"), F.col("variant_index")]
    return pool.orderBy(*order).limit(most).drop("p_ACAT", "p_SEV")


def _with_effects(candidates: DataFrame, table: DataFrame, traits: tuple[str, ...], suffix: str) -> DataFrame:
    own = [f"{c}_{t}" for t in traits for c in ("beta", "se", "ci_low", "ci_high") if f"{c}_{t}" in table.columns]
    return candidates.join(table.select("variant_index", *(F.col(c).alias(c + suffix) for c in own)), "variant_index", "left")


def supported_candidates(pool: DataFrame, pairs: dict[str, DataFrame], others: dict[str, DataFrame], variants: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """Candidates with the p- and q-values of all tests, effects, classes and their rank."""
    ids = variants.select("variant_index", F.col("global_class").alias("global_alias_class_index"), F.col("test_class").alias("test_class_index"), F.col("test_size").alias("test_class_size"))
    support = {t if t != "wald" else "wald_diagnostic": (pairs[t], list(tables.METHODS)) for t in TESTS}
    support |= {f"{OTHERS[t][0]}_score": (df, ["SEV", "ACAT", "SIMES"]) for t, df in others.items()}
    alias = classes.select(F.col("global_class").alias("global_alias_class_index"), F.col("global_id").alias("global_alias_class_id"), F.col("class_size").alias("global_alias_class_size"), "n_chromosomes", "alias_mappings")
    out = tables.candidate_support(pool.join(ids, "variant_index"), support, alias)
    out = _with_effects(out, pairs["score"], ("INC", "SEV"), "")
    for t, df in others.items():
        out = _with_effects(out, df, ("SEV",), f"_{OTHERS[t][0]}")
    out = out.withColumn("window_kb", F.lit(settings.window_kb)).withColumn("r2_threshold", F.lit(settings.r2))
    order = [F.col("p_ACAT_score").asc_nulls_last(), F.col("p_SEV_score").asc_nulls_last(), "CHR", "pos", "variant_index"]
    return out.withColumn("candidate_rank", F.row_number().over(W.orderBy(*order)))  # at most settings.candidates rows


class Run:
    """The stage's tables by name, each built when it, or one that reads it, is first asked for.

    ``scans``: context, trait, the variant's columns (tables.META), beta, se, p_score, p_lrt and p_wald, with rows of the
    context ``loco`` for the traits INC and SEV, and, if there are any, for SEV_COND and SEV_POS; ``genotypes``:
    variant_index and dosages of the samples scanned; ``genes``: CHR, start, end, gene.
    """

    def __init__(self, scans: DataFrame, genotypes: DataFrame, genes: DataFrame, folder: str, settings: Settings | None = None) -> None:
        self.settings, spark = settings or Settings(), scans.sparkSession
        s = self.settings
        loco = scans.filter(F.col("context") == "loco").select("trait", *tables.META, *(c for c in ("beta", "se", "l_remle") if c in scans.columns), *(f"p_{t}" for t in TESTS))
        genotypes, genes = genotypes.select("variant_index", "dosages"), genes.select("CHR", "start", "end", "gene")
        have = {r["trait"] for r in loco.filter(F.col("trait").isin("INC", "SEV", *OTHERS)).select("trait").distinct().collect()}
        for t in ("INC", "SEV"):
            require(t in have, f"no primary scan of {t}")
        self._store = Store(spark, f"{folder}/{run_key({'scans': loco, 'genotypes': genotypes, 'genes': genes}, s)}")
        # Read for many tables: written once, in as many parts as the session has tasks, whatever it was computed from.
        self._given = {"scans": lambda: loco.repartition("variant_index"), "genotypes": lambda: genotypes.repartition("variant_index")}
        self._read: dict[str, DataFrame] = {}
        self._others = {t: OTHERS[t][0] for t in OTHERS if t in have}

        def pair(second: str, test: str) -> Callable[[], DataFrame]:
            return lambda: tables.trait_pair_table(given("scans").filter("trait = 'INC'"), given("scans").filter(F.col("trait") == second), test)

        def classes(name: str) -> Callable[[], DataFrame]:
            return lambda: genotype.class_tables(self.table("variants"))[name]

        t, given = self.table, self._copy
        self._builds: dict[str, Callable[[], DataFrame]] = {
            **{f"all_{k}": pair("SEV", k) for k in TESTS},
            **{f"all_{name}": pair(k, "score") for k, name in self._others.items()},
            "profile": self._profile,
            "test_comparison": lambda: tables.compare_tests(self._pairs(), s.fdr),
            "concordance": lambda: tables.concordance(t("all_score"))[0],
            "concordance_tops": lambda: tables.concordance(t("all_score"))[1],
            "acat_simes": lambda: tables.method_comparison(t("all_score"), s.fdr),
            "variants": lambda: classed_variants(t("all_score"), given("genotypes")),
            "test_classes": classes("test_classes"),
            "global_classes": classes("global_classes"),
            "classes_summary": classes("summary"),
            **{f"unique_{m}": lambda m=m: genotype.collapse(t("variants"), m) for m in LEADING},
            **{f"leads_{m}": lambda m=m: self._leads(m, given("genotypes")) for m in LEADING},
            "pool": lambda: pooled_leads({m: t(f"leads_{m}") for m in LEADING}, t("all_score"), s.candidates),
            "candidates": lambda: supported_candidates(t("pool"), self._pairs(), {k: t(f"all_{name}") for k, name in self._others.items()}, t("variants"), t("global_classes"), s),
            "candidate_genes": lambda: annotate.nearby_genes(t("candidates").select("lead_snp", "CHR", "pos"), genes, s.flank_kb * 1000),
            "power": lambda: models.power_table(spark, s.sample_sizes, FREQUENCIES, {"bonferroni_rows": 0.05 / t("all_score").count(), "bonferroni_unique_tests": 0.05 / t("test_classes").count(), "suggestive": 1e-5}, TARGETS),
            **{f"qq_{m}": lambda m=m: ranking.qq_points(t("all_score"), f"p_{m}") for m in LEADING},
            **{f"top_{k}": lambda k=k: ranking.top_k(t(f"all_{k}"), "p_ACAT", s.top_rows) for k in TESTS},
            "top_test_classes": lambda: t("test_classes").orderBy(F.col("minimum_p_ACAT").asc_nulls_last(), "test_class").limit(s.top_rows),
            "largest_classes": lambda: t("global_classes").orderBy(F.desc("class_size"), "global_class").limit(s.top_classes),
            "summary": lambda: self._summary(given("genotypes")),
        }

    def table(self, name: str) -> DataFrame:
        if name not in self._read:
            if name in self._members:
                self.table(self._members[name])  # written with them
            self._read[name] = self._store.keep(name, self._builds.get(name, lambda: self._missing(name)))
        return self._read[name]

    def _copy(self, name: str) -> DataFrame:
        key = f"given_{name}"
        if key not in self._read:
            self._read[key] = self._store.keep(key, self._given[name])
        return self._read[key]

    @property
    def names(self) -> list[str]:
        return [*self._builds, *self._members]

    _members = {f"members_{m}": f"leads_{m}" for m in LEADING}

    def _missing(self, name: str) -> DataFrame:
        raise ValueError(f"no table {name}")

    def _pairs(self) -> dict[str, DataFrame]:
        return {k: self.table(f"all_{k}") for k in TESTS}

    def _profile(self) -> DataFrame:
        fdr = self.settings.fdr
        own = [tables.profile(df, k, fdr=fdr) for k, df in self._pairs().items()]
        return reduce(DataFrame.unionByName, own + [tables.profile(self.table(f"all_{name}"), "score", OTHERS[k][1], fdr) for k, name in self._others.items()])

    def _leads(self, m: str, genotypes: DataFrame) -> DataFrame:
        """The leads of a method; their members are written before them."""
        s, unique = self.settings, self.table(f"unique_{m}")
        found = unique.filter(F.col(f"p_{m}") <= s.index_p).isEmpty()
        criterion = f"{s.fallback} smallest p_{m}" if found else f"p_{m} <= {s.index_p:g}"
        leads, members = ld.clump(unique.join(genotypes, "variant_index"), f"p_{m}", s.index_p, s.secondary_p, s.window_kb * 1000, s.r2, s.fallback)
        self._store.keep(f"members_{m}", lambda: members)
        return leads.withColumn("candidate_criterion", F.lit(criterion))

    def _summary(self, genotypes: DataFrame) -> DataFrame:
        """(figure, value): sizes, hits by test and method, inflation and smallest p of the primary table."""
        rows = [("n_samples", genotypes.agg(F.max(F.size("dosages"))).first()[0])]
        rows += [("n_variants", self.table("all_score").count()), ("unique_tests", self.table("test_classes").count()), ("candidates", self.table("candidates").count())]
        for r in self.table("profile").filter("context = 'loco'").collect():  # a row for each test and method
            rows.append((f"{r['test']}_{r['method']}_hits", r["hits"]))
            if r["test"] == "score" and r["method"] == "ACAT":
                rows += [("score_ACAT_lambda_gc", r["lambda_gc"]), ("score_ACAT_minimum_p", r["minimum_p"])]
        return genotypes.sparkSession.createDataFrame([(k, None if x is None else float(x)) for k, x in rows], "figure string, value double")


def final_results(scans: DataFrame, genotypes: DataFrame, genes: DataFrame, folder: str, settings: Settings | None = None) -> dict[str, DataFrame]:
    """All tables of a run by name."""
    run = Run(scans, genotypes, genes, folder, settings)
    return {name: run.table(name) for name in run.names}


#: What a workbook shows: bounded lists, not the full tables.
SHEETS = ("profile", "test_comparison", "concordance", "concordance_tops", "acat_simes", "candidates", "candidate_genes", "power", "classes_summary", "top_test_classes", "largest_classes", "leads_ACAT", "leads_SEV", "summary")


def publish(results: dict[str, DataFrame], folder: str, workbook: str | None = None) -> None:
    """Every table as compressed CSV in a folder of its own, written by all tasks, and the short ones as a local workbook."""
    for name, df in results.items():
        df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(f"{folder}/{name}")
    if workbook:
        write_workbook(workbook, {name: results[name] for name in SHEETS})
