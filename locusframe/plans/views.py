"""Association-shaped views of the generic tables, in Spark and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Multipliers and moduli of the p-values of the three tests, for the first and the second trait.
TESTS = {"score": ((7919, 10007), (104729, 10009)), "lrt": ((7907, 10007), (104723, 10009)), "wald": ((7901, 10007), (104717, 10009))}


def _p(key: str, mul: int, mod: int) -> str:
    return f"CAST(({key} * {mul}) % {mod} + 1 AS DOUBLE) / CAST({mod + 1} AS DOUBLE)"


def scan_columns(div: str) -> list[tuple[str, str]]:
    k = "p_partkey"
    out = [
        ("variant_index", k),
        ("snp", f"concat('S', CAST({k} AS {'STRING' if div == 'div' else 'VARCHAR'}))"),
        ("CHR", f"CAST({k} % 10 + 1 AS INTEGER)"),
        ("pos", f"CAST(({k} {div} 10 + 1) * 1000 AS BIGINT)"),
        ("MAF", "CAST(0.05 AS DOUBLE) + CAST(p_size % 10 AS DOUBLE) * CAST(0.05 AS DOUBLE)"),
        ("missing_rate", "CAST(p_size % 7 AS DOUBLE) / CAST(50 AS DOUBLE)"),
        ("beta_INC", f"CAST(({k} * 31) % 201 - 100 AS DOUBLE) / CAST(100 AS DOUBLE)"),
        ("beta_SEV", f"CAST(({k} * 57) % 201 - 100 AS DOUBLE) / CAST(100 AS DOUBLE)"),
        ("se", f"CAST(10 + {k} % 17 AS DOUBLE) / CAST(100 AS DOUBLE)"),
    ]
    for test, (a, b) in TESTS.items():
        out += [(f"p_{test}_INC", _p(k, *a)), (f"p_{test}_SEV", _p(k, *b))]
    return out


SCAN_SQL = "scan AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in scan_columns("//")) + " FROM part)"


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*(f"{e} AS {c}" for c, e in scan_columns("div")))


def trait_scan(spark: SparkSession, sf_dir: str, trait: str, test: str = "score") -> DataFrame:
    return scan(spark, sf_dir).select("variant_index", "snp", "CHR", "pos", "MAF", "missing_rate", F.col(f"beta_{trait}").alias("beta"), "se", F.col(f"p_{test}_{trait}").alias(f"p_{test}"))


#: (vec_id, v, e, code): dosage codes from the components of vectors, some of them missing.
DOSAGE_SQL = """dosage AS (
  SELECT vec_id, v, CASE WHEN (vec_id * 31 + v) % 23 = 0 THEN -1 WHEN e < -0.06 THEN 0 WHEN e > 0.06 THEN 2 ELSE 1 END AS code
  FROM (SELECT vec_id, CAST(unnest(range(1, 65)) AS BIGINT) AS v, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings)
)"""


def dosage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("v", "e"))
    v, e = (F.col("v") + 1).cast("bigint"), F.col("e").cast("double")
    code = F.when((F.col("vec_id") * 31 + v) % 23 == 0, -1).when(e < -0.06, 0).when(e > 0.06, 2).otherwise(1)
    return d.select("vec_id", v.alias("v"), code.alias("code"))


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a component; chromosome and position from its number. An array holds the samples, whose number is fixed."""
    d = dosage(spark, sf_dir).groupBy("v").agg(F.sort_array(F.collect_list(F.struct("vec_id", "code"))).alias("a"))
    return d.select(F.col("v").alias("variant_index"), (F.col("v") % 10 + 1).cast("int").alias("CHR"), (F.expr("v div 10") * 1000 + 1000).alias("pos"), F.transform("a", lambda x: x["code"].cast("tinyint")).alias("dosages"))


#: A dosage for each hex digit of a hash: 64 samples, a sixteenth of them missing. Three variants in a row share it.
_DIGITS, _DOSAGES = "0123456789abcdef", "0000011111222229"
SCAN_VECTORS_SQL = f"scan_vectors AS (SELECT variant_index, CHR, translate(sha256(CAST(variant_index // 3 AS VARCHAR)), '{_DIGITS}', '{_DOSAGES}') AS codes FROM scan)"


def scan_vectors(scan: DataFrame) -> DataFrame:
    """variant_index and dosages of the scan's variants."""
    codes = F.translate(F.sha2(F.expr("variant_index div 3").cast("string"), 256), _DIGITS, _DOSAGES)
    code = lambda c: F.when(c == "9", -1).otherwise(c.cast("int")).cast("tinyint")
    return scan.select("variant_index", F.transform(F.split(codes, ""), code).alias("dosages"))


#: Plots: an order line as a plot of a supplier's line at the customer's region.
PLOTS_SQL = """plots AS (
  SELECT concat('ID', CAST(l_suppkey AS VARCHAR)) AS ID_std, r_name AS Location, concat(l_returnflag, l_linestatus) AS Stratum,
    CASE WHEN l_quantity <= 5 THEN 0.0::DOUBLE ELSE l_quantity END AS INC, l_discount AS SEV, l_linestatus, l_orderkey, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, c, n, r = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    places = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select("c_custkey", F.col("r_name").alias("Location"))
    d = li.join(o.select("o_orderkey", "o_custkey"), li["l_orderkey"] == F.col("o_orderkey")).join(places, F.col("o_custkey") == F.col("c_custkey"))
    inc = F.when(F.col("l_quantity") <= 5, F.lit(0.0)).otherwise(F.col("l_quantity"))
    return d.select(F.concat(F.lit("ID"), F.col("l_suppkey").cast("string")).alias("ID_std"), "Location", F.concat("l_returnflag", "l_linestatus").alias("Stratum"), inc.alias("INC"), F.col("l_discount").alias("SEV"), "l_linestatus", "l_orderkey", "l_linenumber")


#: Genes: suppliers as intervals.
GENES_SQL = """genes AS (
  SELECT CAST(s_suppkey % 10 + 1 AS INTEGER) AS CHR, (s_suppkey * 37) % 199 * 1000 + 200 AS gene_start, (s_suppkey * 37) % 199 * 1000 + 200 + (s_suppkey % 5) * 400 AS gene_end, s_name AS gene FROM supplier
)"""


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("s_suppkey") * 37) % 199 * 1000 + 200
    return table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 10 + 1).cast("int").alias("CHR"), start.alias("start"), (start + F.col("s_suppkey") % 5 * 400).alias("end"), F.col("s_name").alias("gene"))


LEADS_SQL = "leads AS (SELECT variant_index AS lead_variant_index, snp AS lead_snp, CHR, pos FROM scan WHERE p_score_INC < 0.02)"


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir).filter(F.col("p_score_INC") < 0.02).select(F.col("variant_index").alias("lead_variant_index"), F.col("snp").alias("lead_snp"), "CHR", "pos")


def norm_ppf_sql(p: str) -> str:
    """The normal quantile as SQL text, from the same coefficients."""
    from locusframe.functions.stats import _CENTRE, _MIDDLE, _TAIL

    def poly(c: tuple[float, ...], x: str) -> str:
        out = f"CAST('{c[-1]!r}' AS DOUBLE)"
        for k in reversed(c[:-1]):
            out = f"({out} * {x} + CAST('{k!r}' AS DOUBLE))"
        return out

    q, near = f"({p} - 0.5)", f"(0.180625 - ({p} - 0.5) * ({p} - 0.5))"
    r = f"sqrt(-ln(CASE WHEN {q} < 0 THEN {p} ELSE 1 - {p} END))"
    mid, far = f"({r} - 1.6)", f"({r} - 5.0)"
    tail = f"(CASE WHEN {r} <= 5 THEN {poly(_MIDDLE[0], mid)} / {poly(_MIDDLE[1], mid)} ELSE {poly(_TAIL[0], far)} / {poly(_TAIL[1], far)} END)"
    return f"(CASE WHEN {p} > 0 AND {p} < 1 THEN CASE WHEN abs({q}) <= 0.425 THEN {q} * {poly(_CENTRE[0], near)} / {poly(_CENTRE[1], near)} WHEN {q} < 0 THEN -{tail} ELSE {tail} END END)"
