"""A query for each operator over views of the generic tables, with its oracle where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from locusframe.functions import stats, text
from locusframe.operators import annotate, genotype, guards, inputs, kinship, ld, models, numbering, packed, phenotype, ranking, tables
from locusframe.plans import final
from locusframe.plans import views as v
from locusframe.sources import text_formats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *with_: str) -> Callable[[Query], Query]:
    """Registers a query; ``with_``: common table expressions that the SQL uses."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = ("WITH " + ", ".join(with_) + " " if with_ else "") + sql
        return f

    return add


def r8(c: Column | str) -> Column:
    return F.round(c, 8)


# -- scalar functions -------------------------------------------------------------------------------------------------

def _pick(values: list[str], key: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


#: Two alleles, or one or three of them, from the digits of a hash.
_ALLELES = "concat(translate(substr(h, 1, 1), '0123456789abcdef', '0101012.01013.01'), CASE WHEN substr(h, 2, 1) < '3' THEN '' WHEN substr(h, 2, 1) < '9' THEN '/' ELSE '|' END, CASE WHEN substr(h, 2, 1) < '3' THEN '' ELSE translate(substr(h, 3, 1), '0123456789abcdef', '101.01012.01010.') END, CASE WHEN substr(h, 4, 1) < '2' THEN concat('/', substr(h, 5, 2)) ELSE '' END)"


@query(
    f"SELECT token, count(*) AS n, CASE WHEN regexp_matches(token, '^[01][/|][01]$') THEN CAST(substr(token, 1, 1) AS INTEGER) + CAST(substr(token, 3, 1) AS INTEGER) ELSE -1 END AS code FROM (SELECT {_ALLELES} AS token FROM (SELECT md5(CAST(event_id AS VARCHAR)) AS h FROM events)) GROUP BY token"
)
def s4_genotype_token(spark: SparkSession, d: str) -> DataFrame:
    e = v.table(spark, d, "events").select(F.md5(F.col("event_id").cast("string")).alias("h")).select(F.expr(_ALLELES).alias("token"))
    return e.groupBy("token").agg(F.count("*").alias("n")).withColumn("code", text.genotype_code(F.col("token")).cast("int"))


#: FORMAT with or without GT at any place, and sample fields of one to four entries.
_FORMAT = "concat_ws(':', CASE WHEN substr(h, 1, 1) < '4' THEN 'DP' END, CASE WHEN substr(h, 2, 1) < 'b' THEN 'GT' END, CASE WHEN substr(h, 3, 1) < '8' THEN 'AD' END, CASE WHEN substr(h, 4, 1) < '3' THEN concat('GT', substr(h, 5, 1)) END)"
_FIELD = "concat_ws(':', concat(substr(h, 6, 1), '/', substr(h, 7, 1)), CASE WHEN substr(h, 8, 1) < 'c' THEN substr(h, 9, 2) END, CASE WHEN substr(h, 11, 1) < '8' THEN concat(substr(h, 12, 1), '|', substr(h, 13, 1)) END, CASE WHEN substr(h, 14, 1) < '2' THEN '' END)"


def _hashed(spark: SparkSession, d: str, table: str, key: str, **tokens: str) -> DataFrame:
    """Tokens, in SQL over h, the hash of a row's key, and their numbers of rows."""
    h = v.table(spark, d, table).select(F.md5(F.col(key).cast("string")).alias("h"))
    return h.select(*(F.expr(e).alias(name) for name, e in tokens.items())).groupBy(*tokens).agg(F.count("*").alias("n"))


def _hashed_sql(table: str, key: str, **tokens: str) -> str:
    return f"(SELECT {', '.join(f'{e} AS {name}' for name, e in tokens.items())}, count(*) AS n FROM (SELECT md5(CAST({key} AS VARCHAR)) AS h FROM {table}) GROUP BY ALL)"


@query(f"SELECT fmt, field, n, coalesce(string_split(field, ':')[greatest(coalesce(list_position(string_split(fmt, ':'), 'GT'), 0), 1)], '.') AS gt FROM {_hashed_sql('events', 'event_id', fmt=_FORMAT, field=_FIELD)}")
def s5_format_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _hashed(spark, d, "events", "event_id", fmt=_FORMAT, field=_FIELD).withColumn("gt", text.genotype_field(F.col("fmt"), F.col("field")))


#: Chromosome names: prefixes in several cases or none, leading zeros, one to three digits, blanks and letters after them.
_CHROM = (
    "concat(CASE WHEN substr(h, 7, 1) = '2' THEN '  ' ELSE '' END, CASE WHEN substr(h, 1, 1) < '4' THEN 'Chr' WHEN substr(h, 1, 1) < '7' THEN 'chr' WHEN substr(h, 1, 1) < '9' THEN 'CHR' WHEN substr(h, 1, 1) < 'a' THEN 'scaffold_' WHEN substr(h, 1, 1) < 'b' THEN 'cHr' ELSE '' END,"
    " CASE WHEN substr(h, 2, 1) < '5' THEN '0' WHEN substr(h, 2, 1) < '7' THEN '00' ELSE '' END, translate(substr(h, 3, 1), 'abcdef', '101201'), CASE WHEN substr(h, 4, 1) < '6' THEN translate(substr(h, 5, 2), 'abcdef', '012301') ELSE '' END, CASE WHEN substr(h, 8, 1) = '0' THEN 'X' WHEN substr(h, 8, 1) = '1' THEN ' ' ELSE '' END)"
)


@query(f"SELECT name, n, CASE WHEN k BETWEEN 1 AND 10 THEN k END AS chrom FROM (SELECT *, TRY_CAST(nullif(regexp_extract(trim(name), '^(?:[cC][hH][rR])?0*([0-9]+)$', 1), '') AS INTEGER) AS k FROM {_hashed_sql('events', 'event_id', name=_CHROM)})")
def s6_chromosome(spark: SparkSession, d: str) -> DataFrame:
    return _hashed(spark, d, "events", "event_id", name=_CHROM).withColumn("chrom", text.chromosome_number(F.col("name")))


@query(
    """SELECT CAST(s_suppkey % 10 + 1 AS INTEGER) AS CHR, s_suppkey * 10 AS "start", s_suppkey * 10 + 7 AS "end",
    CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 3 = 1 THEN concat('G', s_suppkey) ELSE '' END AS gene FROM supplier WHERE s_suppkey % 4 <> 0"""
)
def s12_gff_genes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    attr = F.when(k % 3 == 0, F.concat(F.lit("ID=gene:x;Name = "), "s_name")).when(k % 3 == 1, F.concat(F.lit("flag;Name=;ID=gene:G"), k.cast("string"))).otherwise("Note=a=b")
    kind = F.when(k % 4 == 0, "mRNA").when(k % 4 == 1, "Gene").otherwise("gene")
    line = F.concat_ws("\t", F.format_string("Chr%02d", k % 10 + 1), F.lit("src"), kind, (k * 10).cast("string"), (k * 10 + 7).cast("string"), F.lit("."), F.lit("+"), F.lit("."), attr)
    return text_formats.parse_genes(v.table(spark, d, "supplier").select(line.alias("value"))).drop("attributes")


#: Accession names in several spellings: letters, a separator, digits and sometimes a suffix.
_NAME = (
    "concat(CASE WHEN substr(h, 1, 1) < '3' THEN 'btx' WHEN substr(h, 1, 1) < '6' THEN 'BTx' WHEN substr(h, 1, 1) < '9' THEN 'SC' WHEN substr(h, 1, 1) < 'c' THEN 's c' ELSE concat('P I', substr(h, 9, 2)) END,"
    " CASE WHEN substr(h, 2, 1) < '8' THEN '' WHEN substr(h, 2, 1) < 'a' THEN ' ' WHEN substr(h, 2, 1) < 'c' THEN '-' WHEN substr(h, 2, 1) < 'd' THEN '  - ' ELSE '_' END,"
    " CASE WHEN substr(h, 3, 1) < '3' THEN '6' WHEN substr(h, 3, 1) < '6' THEN '623' WHEN substr(h, 3, 1) < '8' THEN '748' WHEN substr(h, 3, 1) < 'a' THEN '7485' WHEN substr(h, 3, 1) < 'c' THEN '748-5' ELSE substr(h, 4, 3) END, CASE WHEN substr(h, 7, 1) = '0' THEN ' ' WHEN substr(h, 7, 1) = '1' THEN concat('-', substr(h, 8, 1)) ELSE '' END)"
)


@query(
    f"""SELECT raw, n, CASE k WHEN 'BTX6' THEN 'BTX623' WHEN 'SC748' THEN 'SC748_5' WHEN 'SC7485' THEN 'SC748_5' ELSE k END AS id
    FROM (SELECT raw, n, upper(replace(regexp_replace(raw, '\\s+', '', 'g'), '-', '_')) AS k FROM {_hashed_sql('part', 'p_partkey', raw=_NAME)})"""
)
def p1_normalize_id(spark: SparkSession, d: str) -> DataFrame:
    return _hashed(spark, d, "part", "p_partkey", raw=_NAME).withColumn("id", text.normalize_id(F.col("raw")))


@query("SELECT url, regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, count(*) AS n FROM pages GROUP BY url")
def p2_slugify(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "pages").groupBy("url").agg(F.count("*").alias("n")).withColumn("slug", text.slugify(F.col("url")))


@query("SELECT r_name, upper(regexp_replace(regexp_replace(concat(r_name, ' / ', n_name), '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g')) AS label FROM nation JOIN region ON n_regionkey = r_regionkey")
def p3_location_label(spark: SparkSession, d: str) -> DataFrame:
    n, r = v.table(spark, d, "nation"), v.table(spark, d, "region")
    return n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select("r_name", phenotype.location_label(F.concat("r_name", F.lit(" / "), "n_name")).alias("label"))


#: Cells of a field book: words for a missing value, and numbers with signs, blanks, points, exponents or letters after them.
_CELL = (
    "CASE WHEN substr(h, 1, 1) < '3' THEN CASE WHEN substr(h, 2, 1) < '2' THEN '' WHEN substr(h, 2, 1) < '4' THEN ' . ' WHEN substr(h, 2, 1) < '6' THEN 'MISSING' WHEN substr(h, 2, 1) < '8' THEN 'missintg' WHEN substr(h, 2, 1) < 'a' THEN 'N/A' WHEN substr(h, 2, 1) < 'c' THEN 'nan' WHEN substr(h, 2, 1) < 'e' THEN 'inf' ELSE concat('na', substr(h, 3, 1)) END"
    " ELSE concat(CASE WHEN substr(h, 4, 1) < '2' THEN ' ' ELSE '' END, CASE WHEN substr(h, 4, 1) > 'd' THEN '-' WHEN substr(h, 4, 1) > 'b' THEN '+' ELSE '' END, CASE WHEN substr(h, 5, 1) < '2' THEN '' ELSE translate(substr(h, 6, 2), 'abcdef', '012345') END, CASE WHEN substr(h, 5, 1) > '9' THEN '' ELSE '.' END,"
    " CASE WHEN substr(h, 8, 1) < '3' THEN '' ELSE translate(substr(h, 9, 3), 'abcdef', '543210') END, CASE WHEN substr(h, 12, 1) < '2' THEN concat('e-', translate(substr(h, 13, 1), 'abcdef', '123456')) WHEN substr(h, 12, 1) < '3' THEN 'E+3' WHEN substr(h, 12, 1) < '4' THEN 'd' WHEN substr(h, 12, 1) < '5' THEN ' ' ELSE '' END) END"
)


@query(
    f"SELECT cell, n, CASE WHEN trim(cell) IN ('', '.', 'MISSING', 'missing', 'Missing', 'missintg', 'MISSINTG', 'NA', 'N/A') THEN NULL WHEN regexp_matches(trim(cell), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(trim(cell) AS DOUBLE) END AS number FROM {_hashed_sql('events', 'event_id', cell=_CELL)}"
)
def p4_numeric(spark: SparkSession, d: str) -> DataFrame:
    return _hashed(spark, d, "events", "event_id", cell=_CELL).withColumn("number", text.number_or_null(F.col("cell")))


_REP_SQL = "CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_linenumber AS BIGINT) END"


@query(
    f"SELECT stratum, count(*) AS n FROM (SELECT concat(Location, '_R', coalesce(CAST({_REP_SQL} AS VARCHAR), 'NA'), CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE concat('_B', CAST(l_orderkey % 3 AS VARCHAR)) END) AS stratum FROM plots) GROUP BY stratum",
    v.PLOTS_SQL,
)
def p5_stratum(spark: SparkSession, d: str) -> DataFrame:
    rep = F.when(F.col("l_linenumber") != 1, F.col("l_linenumber"))
    block = F.when(F.col("l_orderkey") % 3 != 0, F.col("l_orderkey") % 3)
    return v.plots(spark, d).groupBy(text.stratum(F.col("Location"), rep, block).alias("stratum")).agg(F.count("*").alias("n"))


@query(
    "SELECT Location, count(*) FILTER (INC > 0) AS present, count(*) FILTER (INC = 0 AND SEV = 0) AS zero_zero, count(*) FILTER (INC = 0 AND SEV > 0) AS zero_positive, count(*) FILTER (INC > 0 AND SEV = 0) AS positive_zero FROM plots GROUP BY Location",
    v.PLOTS_SQL,
)
def p6_disease_flags(spark: SparkSession, d: str) -> DataFrame:
    names = {"present": "DiseasePresent", "zero_zero": "INC_zero_SEV_zero", "zero_positive": "INC_zero_SEV_positive", "positive_zero": "INC_positive_SEV_zero"}
    return phenotype.disease_flags(v.plots(spark, d)).groupBy("Location").agg(*(F.count_if(F.col(c)).alias(k) for k, c in names.items()))


@query("SELECT l_returnflag, count(*) FILTER (abs(coalesce(l_quantity - l_extendedprice / 1000, 0)) > 1e-12 OR abs(coalesce(l_tax - l_discount, 0)) > 1e-12) AS corrected, round(sum(l_tax - l_discount), 6) AS total FROM lineitem GROUP BY l_returnflag")
def p7_corrections(spark: SparkSession, d: str) -> DataFrame:
    li = v.table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("INC"), (F.col("l_extendedprice") / 1000).alias("INC_raw_source"), F.col("l_tax").alias("SEV"), F.col("l_discount").alias("SEV_raw_source"))
    return phenotype.corrections(li).groupBy("l_returnflag").agg(F.count_if("CorrectionFlag").alias("corrected"), F.round(F.sum("SEV_correction"), 6).alias("total"))


@query("SELECT count(*) AS n, count(*) FILTER (a IS NULL AND b IS NULL OR coalesce(abs(a - b) <= 1e-8 + 1e-5 * abs(b), false)) AS alike FROM (SELECT nullif(l_tax, 0.08) AS a, nullif(l_discount, 0.08) AS b FROM lineitem)")
def p8_isclose(spark: SparkSession, d: str) -> DataFrame:
    li = v.table(spark, d, "lineitem").select(F.nullif("l_tax", F.lit(0.08)).alias("a"), F.nullif("l_discount", F.lit(0.08)).alias("b"))
    return li.agg(F.count("*").alias("n"), F.count_if(stats.close(F.col("a"), F.col("b"))).alias("alike"))


_CLIP = "CASE WHEN {0} < {1} THEN {1} WHEN {0} > {2} THEN {2} ELSE {0} END"


def _acat_sql(p: str, q: str) -> str:
    a, b = ("(" + _CLIP.format(x, "1e-15::DOUBLE", "(1 - 1e-15::DOUBLE)") + ")" for x in (p, q))
    inner = f"(0.5 - atan(0.5 * (tan((0.5 - {a}) * pi()) + tan((0.5 - {b}) * pi()))) / pi())"
    return _CLIP.format(inner, "1e-300::DOUBLE", "1.0::DOUBLE")


def _simes_sql(p: str, q: str) -> str:
    return f"greatest(least(2 * least({p}, {q}), greatest({p}, {q}), 1.0::DOUBLE), 1e-300::DOUBLE)"


@query("SELECT variant_index, round(-log10(p_score_INC), 8) AS x FROM scan", v.SCAN_SQL)
def p9_neglog10(spark: SparkSession, d: str) -> DataFrame:
    return v.scan(spark, d).select("variant_index", r8(stats.neglog10(F.col("p_score_INC"))).alias("x"))


@query(f"SELECT variant_index, round({_acat_sql('p_score_INC', 'p_score_SEV')}, 8) AS p FROM scan", v.SCAN_SQL)
def p10_acat_pair(spark: SparkSession, d: str) -> DataFrame:
    return v.scan(spark, d).select("variant_index", r8(stats.acat(F.col("p_score_INC"), F.col("p_score_SEV"))).alias("p"))


@query(f"SELECT variant_index, round({_simes_sql('p_score_INC', 'p_score_SEV')}, 8) AS p FROM scan", v.SCAN_SQL)
def p11_simes_pair(spark: SparkSession, d: str) -> DataFrame:
    return v.scan(spark, d).select("variant_index", r8(stats.simes(F.col("p_score_INC"), F.col("p_score_SEV"))).alias("p"))


@query("SELECT variant_index, round(beta_INC - 1.96 * se, 8) AS low, round(beta_INC + 1.96 * se, 8) AS high FROM scan", v.SCAN_SQL)
def p12_wald_interval(spark: SparkSession, d: str) -> DataFrame:
    low, high = stats.interval(F.col("beta_INC"), F.col("se"))
    return v.scan(spark, d).select("variant_index", r8(low).alias("low"), r8(high).alias("high"))


@query("SELECT CHR, count(*) AS n, count(*) FILTER (sign(beta_INC) = sign(beta_SEV)) AS alike FROM scan GROUP BY CHR", v.SCAN_SQL)
def p13_sign_agreement(spark: SparkSession, d: str) -> DataFrame:
    return v.scan(spark, d).groupBy("CHR").agg(F.count("*").alias("n"), F.count_if(stats.same_sign(F.col("beta_INC"), F.col("beta_SEV"))).alias("alike"))


@query("SELECT CHR, pos // 20000 AS bin, count(*) AS n FROM scan GROUP BY CHR, bin", v.SCAN_SQL)
def p14_bins(spark: SparkSession, d: str) -> DataFrame:
    return v.scan(spark, d).groupBy("CHR", F.expr("pos div 20000").alias("bin")).agg(F.count("*").alias("n"))


@query(
    "SELECT v AS variant_index, round(sum(CASE WHEN code < 0 THEN m ELSE code END), 6) AS total, round(m, 8) AS mean FROM (SELECT *, avg(CASE WHEN code >= 0 THEN CAST(code AS DOUBLE) END) OVER (PARTITION BY v) AS m FROM dosage) GROUP BY v, m",
    v.DOSAGE_SQL,
)
def p15_impute(spark: SparkSession, d: str) -> DataFrame:
    g = v.genotypes(spark, d).withColumn("x", genotype.imputed(F.col("dosages")))
    s = F.aggregate("x", F.lit(0.0), lambda a, b: a + b)
    return g.select("variant_index", F.round(s, 6).alias("total"), r8(s / F.size("x")).alias("mean"))


@query(
    "SELECT v AS variant_index, round(least(f, 1 - f), 8) AS maf, round(miss, 8) AS missing_rate FROM (SELECT v, sum(code) FILTER (code >= 0) / (2.0 * count(*) FILTER (code >= 0)) AS f, 1 - count(*) FILTER (code >= 0) / CAST(count(*) AS DOUBLE) AS miss FROM dosage GROUP BY v)",
    v.DOSAGE_SQL,
)
def p16_maf_missing(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("dosages")
    return v.genotypes(spark, d).select("variant_index", r8(genotype.maf(x)).alias("maf"), r8(genotype.missing_rate(x)).alias("missing_rate"))


@query(
    "SELECT v AS variant_index, CASE WHEN arg_min(code, vec_id) FILTER (code IN (0, 2)) = 2 THEN -1 ELSE 1 END AS orientation, string_agg(CAST(CASE WHEN first_code = 2 AND code >= 0 THEN 2 - code ELSE code END AS VARCHAR), ',' ORDER BY vec_id) AS canonical FROM (SELECT *, arg_min(code, vec_id) FILTER (code IN (0, 2)) OVER (PARTITION BY v) AS first_code FROM dosage) GROUP BY v",
    v.DOSAGE_SQL,
)
def p17_canonical(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("dosages")
    return v.genotypes(spark, d).select("variant_index", genotype.orientation(x).alias("orientation"), F.array_join(genotype.canonical(x).cast("array<string>"), ",").alias("canonical"))


@query("SELECT p_partkey, concat('/mnt/c/', replace(p_type, ' ', '/'), '/x') AS path FROM part")
def p18_posix_path(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("C:\\"), F.replace("p_type", F.lit(" "), F.lit("\\")), F.lit("\\x"))
    return v.table(spark, d, "part").select("p_partkey", text.posix_path(raw).alias("path"))


@query("SELECT p_partkey, concat('G', lpad(CAST(p_partkey + 1 AS VARCHAR), 9, '0')) AS id FROM part")
def p19_marker_id(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "part").select("p_partkey", text.marker_id(F.col("p_partkey")).alias("id"))


@query("SELECT s_suppkey, upper(sha256(s_name)) AS digest FROM supplier")
def k11_digest(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "supplier").select("s_suppkey", F.upper(F.sha2("s_name", 256)).alias("digest"))


@query(
    "SELECT variant_index, round(-log10((row_number() OVER (ORDER BY p, variant_index) - 0.5) / count(*) OVER ()), 8) AS expected, round(-log10(p), 8) AS observed FROM (SELECT variant_index, CASE WHEN variant_index % 50 = 0 THEN 1e-300::DOUBLE ELSE p_score_INC END AS p FROM scan)",
    v.SCAN_SQL,
)
def k9_qq_points(spark: SparkSession, d: str) -> DataFrame:
    """Every 50th p-value is 0."""
    s = v.scan(spark, d).select("variant_index", F.when(F.col("variant_index") % 50 == 0, 0.0).otherwise(F.col("p_score_INC")).alias("p"))
    q = ranking.qq_points(s, "p")
    return q.select("variant_index", r8("expected").alias("expected"), r8("observed").alias("observed"))


# -- ranks and windows ------------------------------------------------------------------------------------------------


def _bh_sql(p: str, source: str, key: str = "variant_index", q: str = "q") -> str:
    n = f"(SELECT count(*) FROM {source})"
    ranked = f"SELECT *, {p} * {n} / CAST(row_number() OVER (ORDER BY {p}, {key}) AS DOUBLE) AS raw FROM {source}"
    return f"SELECT * EXCLUDE (raw), least(min(raw) OVER (ORDER BY {p} DESC, {key} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0::DOUBLE) AS {q} FROM ({ranked})"


@query(f"SELECT variant_index, round(q, 8) AS q FROM ({_bh_sql('p_score_INC', 'scan')})", v.SCAN_SQL)
def w2_bh_fdr(spark: SparkSession, d: str) -> DataFrame:
    return ranking.bh_adjust(v.scan(spark, d), "p_score_INC", "q").select("variant_index", r8("q").alias("q"))


@query(f"SELECT variant_index, round(q, 8) AS q FROM ({_bh_sql('p_score_SEV', 'scan')})", v.SCAN_SQL)
def a7_bh_strict(spark: SparkSession, d: str) -> DataFrame:
    return ranking.bh_adjust(v.scan(spark, d), "p_score_SEV", "q", strict=True).select("variant_index", r8("q").alias("q"))


@query(
    f"SELECT c_custkey, round({v.norm_ppf_sql('u')}, 8) AS z FROM (SELECT c_custkey, CASE WHEN x IS NULL THEN NULL ELSE (rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE - 0.5::DOUBLE) / n END AS u FROM (SELECT c_custkey, x, count(x) OVER () AS n FROM (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE round(c_acctbal, -2) END AS x FROM customer)))"
)
def w1_rank_normal(spark: SparkSession, d: str) -> DataFrame:
    c = v.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 11 != 0, F.round("c_acctbal", -2)).alias("x"))
    return ranking.rank_normal(c, {"x": "z"}).select("c_custkey", r8("z").alias("z"))


@query(
    "SELECT variant_index, CHR, bin FROM (SELECT *, row_number() OVER (PARTITION BY CHR, bin ORDER BY missing_rate, MAF DESC, pos, variant_index) AS rn FROM (SELECT *, pos // 20000 AS bin FROM scan)) WHERE rn = 1",
    v.SCAN_SQL,
)
def w4_thinned_markers(spark: SparkSession, d: str) -> DataFrame:
    return ranking.thinned_markers(v.scan(spark, d), 20, 10**9).select("variant_index", "CHR", F.col("thin_bin").alias("bin"))


@query(
    "SELECT variant_index, CHR, bin FROM (SELECT *, row_number() OVER (ORDER BY CHR, pos, variant_index) - 1 AS r, count(*) OVER () AS n FROM (SELECT *, row_number() OVER (PARTITION BY CHR, bin ORDER BY missing_rate, MAF DESC, pos, variant_index) AS rn FROM (SELECT *, pos // 20000 AS bin FROM scan)) WHERE rn = 1) t WHERE n <= 7 OR r IN (SELECT CAST(floor(j * (t.n - 1) / 6.0) AS BIGINT) FROM (SELECT unnest(range(0, 7)) AS j))",
    v.SCAN_SQL,
)
def w4_evenly_thinned(spark: SparkSession, d: str) -> DataFrame:
    return ranking.thinned_markers(v.scan(spark, d), 20, 7).select("variant_index", "CHR", F.col("thin_bin").alias("bin"))


@query(
    f"SELECT row_number() OVER (ORDER BY p_score_INC, variant_index) AS lead_rank, variant_index AS lead_variant_index, snp AS lead_snp, CHR, pos FROM (SELECT *, row_number() OVER (PARTITION BY CHR, pos // 50000 ORDER BY p_score_INC, variant_index) AS rn FROM ({_bh_sql('p_score_INC', 'scan')}) WHERE q < 0.999) WHERE rn = 1",
    v.SCAN_SQL,
)
def w5_leads_by_bin(spark: SparkSession, d: str) -> DataFrame:
    s = ranking.bh_adjust(v.scan(spark, d), "p_score_INC", "q")
    return ranking.leads_by_bin(s, "p_score_INC", "q", 0.999, 50).select(F.col("lead_rank").cast("bigint").alias("lead_rank"), "lead_variant_index", "lead_snp", "CHR", "pos")


@query("SELECT row_number() OVER (ORDER BY missing_rate, MAF DESC, pos, variant_index) AS candidate_rank, variant_index FROM scan", v.SCAN_SQL)
def t1_stable_order(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("missing_rate").asc_nulls_last(), F.col("MAF").desc_nulls_last(), F.col("pos"), F.col("variant_index")]
    s = v.scan(spark, d).select("variant_index", "missing_rate", "MAF", "pos")
    return numbering.numbered(s, order, "_number").select((F.col("_number") + 1).alias("candidate_rank"), "variant_index")


@query("SELECT variant_index, p_score_INC AS p FROM scan ORDER BY p_score_INC, variant_index LIMIT 50", v.SCAN_SQL)
def t2_top_k(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_k(v.scan(spark, d), "p_score_INC", 50).select("variant_index", F.col("p_score_INC").alias("p"))


@query("SELECT lead_snp, p FROM (SELECT snp AS lead_snp, p_score_INC AS p, row_number() OVER (PARTITION BY CHR, pos // 50000 ORDER BY p_score_INC, p_score_SEV, pos, variant_index) AS rn, CHR, pos, p_score_SEV FROM scan) WHERE rn = 1 ORDER BY p, p_score_SEV, CHR, pos LIMIT 20", v.SCAN_SQL)
def t3_distinct_leads(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("CHR", F.expr("pos div 50000")).orderBy("p_score_INC", "p_score_SEV", "pos", "variant_index")
    s = v.scan(spark, d).withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return s.orderBy("p_score_INC", "p_score_SEV", "CHR", "pos").limit(20).select(F.col("snp").alias("lead_snp"), F.col("p_score_INC").alias("p"))


@query("SELECT variant_index, 'fallback top 25 by p_score_INC' AS criterion FROM scan ORDER BY p_score_INC, variant_index LIMIT 25", v.SCAN_SQL)
def t5_candidate_set(spark: SparkSession, d: str) -> DataFrame:
    found, rule = ranking.candidate_set(v.scan(spark, d), "p_score_INC", p_max=1e-9, fallback=25)
    return found.select("variant_index", F.lit(rule).alias("criterion"))


@query(
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT {f}::DOUBLE AS top_fraction, k, both_n AS overlap, round(both_n / (2.0 * k - both_n), 8) AS jaccard FROM (SELECT count(*) AS both_n, any_value(k) AS k FROM (SELECT variant_index, row_number() OVER (ORDER BY p_score_INC, variant_index) AS a, row_number() OVER (ORDER BY p_score_SEV, variant_index) AS b, CAST(greatest(1, round_even(count(*) OVER () * {f}::DOUBLE, 0)) AS BIGINT) AS k FROM scan) WHERE a <= k AND b <= k)" for f in (0.05, 0.1)) + ")",
    v.SCAN_SQL,
)
def a11_jaccard_top(spark: SparkSession, d: str) -> DataFrame:
    j = ranking.jaccard_top(v.scan(spark, d), "p_score_INC", "p_score_SEV", [0.05, 0.1])
    return j.select(F.col("top_fraction").cast("double").alias("top_fraction"), F.col("k").cast("bigint").alias("k"), "overlap", r8("jaccard").alias("jaccard"))


@query(
    "SELECT 'both' AS part, count(*) AS n FROM (SELECT variant_index FROM scan WHERE p_score_INC < 0.1 INTERSECT SELECT variant_index FROM scan WHERE p_score_SEV < 0.1) UNION ALL SELECT 'any', count(*) FROM (SELECT variant_index FROM scan WHERE p_score_INC < 0.1 UNION SELECT variant_index FROM scan WHERE p_score_SEV < 0.1) UNION ALL SELECT 'first', count(*) FROM (SELECT variant_index FROM scan WHERE p_score_INC < 0.1 EXCEPT SELECT variant_index FROM scan WHERE p_score_SEV < 0.1)",
    v.SCAN_SQL,
)
def j16_set_operations(spark: SparkSession, d: str) -> DataFrame:
    s = v.scan(spark, d)
    a, b = (s.filter(F.col(c) < 0.1).select("variant_index") for c in ("p_score_INC", "p_score_SEV"))
    parts = {"both": a.join(b, "variant_index", "left_semi"), "any": a.union(b).distinct(), "first": a.join(b, "variant_index", "left_anti")}
    out = [df.agg(F.lit(k).alias("part"), F.count("*").alias("n")) for k, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


# -- association tables -----------------------------------------------------------------------------------------------


def _methods_sql(test: str) -> str:
    """CTEs: the two-trait table of a test with combined p-values and all q-values."""
    base = f"t_{test}_0 AS (SELECT variant_index, snp, CHR, pos, MAF, missing_rate, beta_INC, beta_SEV, se, p_{test}_INC AS p_INC, p_{test}_SEV AS p_SEV, {_acat_sql(f'p_{test}_INC', f'p_{test}_SEV')} AS p_ACAT, {_simes_sql(f'p_{test}_INC', f'p_{test}_SEV')} AS p_SIMES FROM scan)"
    steps = [base]
    for k, m in enumerate(tables.METHODS):
        steps.append(f"t_{test}_{k + 1} AS ({_bh_sql(f'p_{m}', f't_{test}_{k}', q=f'q_{m}')})")
    return ", ".join(steps) + f", t_{test} AS (SELECT * FROM t_{test}_4)"


def pair(spark: SparkSession, d: str, test: str = "score") -> DataFrame:
    return tables.trait_pair_table(v.trait_scan(spark, d, "INC", test), v.trait_scan(spark, d, "SEV", test), test)


_PAIR_COLUMNS = [f"{k}_{m}" for k in ("p", "q") for m in tables.METHODS]


@query("SELECT variant_index, snp, CHR, pos, " + ", ".join(f"round({c}, 8) AS {c}" for c in _PAIR_COLUMNS) + ", round(beta_INC - 1.96 * se, 8) AS ci_low_INC, round(beta_SEV + 1.96 * se, 8) AS ci_high_SEV, 'score' AS test FROM t_score", v.SCAN_SQL, _methods_sql("score"))
def j2_test_table(spark: SparkSession, d: str) -> DataFrame:
    return pair(spark, d).select("variant_index", "snp", "CHR", "pos", *(r8(c).alias(c) for c in _PAIR_COLUMNS), r8("ci_low_INC").alias("ci_low_INC"), r8("ci_high_SEV").alias("ci_high_SEV"), "test")


@query(f"SELECT variant_index, round(p_score_INC, 8) AS p, round(q, 8) AS q_BH, round(beta_INC - 1.96 * se, 8) AS ci_low, 'INC' AS trait FROM ({_bh_sql('p_score_INC', 'scan')})", v.SCAN_SQL)
def m14_single_trait(spark: SparkSession, d: str) -> DataFrame:
    t = tables.single_trait_table(v.trait_scan(spark, d, "INC"), "score", "INC")
    return t.select("variant_index", r8("p").alias("p"), r8("q_BH").alias("q_BH"), r8("ci_low").alias("ci_low"), "trait")


@query("SELECT concat('G', lpad(CAST(variant_index + 1 AS VARCHAR), 9, '0')) AS gemma_id, variant_index, CHR, pos, round(p_score_INC, 8) AS p_score FROM scan", v.SCAN_SQL)
def j1_map_assoc(spark: SparkSession, d: str) -> DataFrame:
    s = v.scan(spark, d).withColumn("gemma_id", text.marker_id(F.col("variant_index")))
    got = text_formats.map_assoc(s.select(F.col("gemma_id").alias("rs"), F.col("p_score_INC").alias("p_score")), s.select("gemma_id", "variant_index", "CHR", "pos"))
    return got.select("gemma_id", "variant_index", "CHR", "pos", r8("p_score").alias("p_score"))


def _profile_sql() -> str:
    long = " UNION ALL ".join(f"SELECT '{m}' AS method, p_{m} AS p, q_{m} AS q FROM t_score" for m in tables.METHODS)
    z = v.norm_ppf_sql("(p / 2)")
    return f"SELECT method, 'score' AS test, count(p) AS n_variants, round(quantile_cont({z} * {z}, 0.5) / 0.4549364231195727::DOUBLE, 6) AS lambda_gc, round(min(p), 8) AS minimum_p, round(min(q), 8) AS minimum_q, count(*) FILTER (q < 0.9999) AS hits FROM ({long}) GROUP BY method"


@query(_profile_sql(), v.SCAN_SQL, _methods_sql("score"))
def a9_profile(spark: SparkSession, d: str) -> DataFrame:
    p = tables.profile(pair(spark, d), "score", fdr=0.9999)
    return p.select("method", "test", "n_variants", F.round("lambda_gc", 6).alias("lambda_gc"), r8("minimum_p").alias("minimum_p"), r8("minimum_q").alias("minimum_q"), "hits")


_Z = v.norm_ppf_sql("(p_score_SEV / 2)")


@query(f"SELECT round(quantile_cont({_Z} * {_Z}, 0.5) / 0.4549364231195727::DOUBLE, 6) AS lambda_gc FROM scan", v.SCAN_SQL)
def a8_lambda_gc(spark: SparkSession, d: str) -> DataFrame:
    return ranking.lambda_gc(v.scan(spark, d).withColumn("all", F.lit("")), "p_score_SEV", "all").select(F.round("lambda_gc", 6).alias("lambda_gc"))


def _rank_sql(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


_COMPARE_SQL = f"""SELECT 'ACAT' AS method, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(quantile_cont(dd, 0.5), 6) AS median_difference, round(quantile_cont(dd, 0.99), 6) AS p99_difference,
  round(max(dd), 6) AS max_difference, count(*) FILTER (ql < 0.10) AS left_hits, count(*) FILTER (ql < 0.10 AND qr < 0.10) AS common_hits
FROM (SELECT *, {_rank_sql('x')} AS rx, {_rank_sql('y')} AS ry, abs(x - y) AS dd FROM (SELECT -log10(a.p_ACAT) AS x, -log10(b.p_ACAT) AS y, a.q_ACAT AS ql, b.q_ACAT AS qr FROM t_score a JOIN t_lrt b USING (variant_index)))"""


@query(_COMPARE_SQL, v.SCAN_SQL, _methods_sql("score"), _methods_sql("lrt"))
def a10_compare_tests(spark: SparkSession, d: str) -> DataFrame:
    c = tables.compare_pair(pair(spark, d), pair(spark, d, "lrt"), "ACAT")
    return c.select("method", *(F.round(k, 6).alias(k) for k in ("pearson", "spearman", "median_difference", "p99_difference", "max_difference")), "left_hits", "common_hits")


_PAIRS = [("score", "lrt"), ("score", "wald"), ("lrt", "wald")]
_BY = "PARTITION BY left_test, right_test, method"


def _by_rank(c: str) -> str:
    return f"rank() OVER ({_BY} ORDER BY {c}) + (count(*) OVER ({_BY}, {c}) - 1) / 2.0"


_ALL_COMPARED_SQL = f"""SELECT left_test, right_test, method, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(quantile_cont(dd, 0.5), 6) AS median_difference, round(quantile_cont(dd, 0.99), 6) AS p99_difference, round(max(dd), 6) AS max_difference,
  count(*) FILTER (ql < 0.10) AS left_hits, count(*) FILTER (qr < 0.10) AS right_hits, count(*) FILTER (ql < 0.10 AND qr < 0.10) AS common_hits,
  {", ".join(f"round(count(*) FILTER (ra <= k{i} AND rb <= k{i}) / (2.0 * any_value(k{i}) - count(*) FILTER (ra <= k{i} AND rb <= k{i})), 8) AS {name}" for i, name in enumerate(tables.TOPS))}
FROM (SELECT *, {_by_rank("x")} AS rx, {_by_rank("y")} AS ry, abs(x - y) AS dd, row_number() OVER ({_BY} ORDER BY pl, variant_index) AS ra, row_number() OVER ({_BY} ORDER BY pr, variant_index) AS rb,
  {", ".join(f"CAST(greatest(1, round_even(count(*) OVER ({_BY}) * {f}::DOUBLE, 0)) AS BIGINT) AS k{i}" for i, f in enumerate(tables.TOPS.values()))}
  FROM (SELECT *, -log10(pl) AS x, -log10(pr) AS y FROM ({" UNION ALL ".join(f"SELECT '{a}' AS left_test, '{b}' AS right_test, '{m}' AS method, a.variant_index, a.p_{m} AS pl, a.q_{m} AS ql, b.p_{m} AS pr, b.q_{m} AS qr FROM t_{a} a JOIN t_{b} b USING (variant_index)" for a, b in _PAIRS for m in tables.METHODS)})))
GROUP BY left_test, right_test, method"""


@query(_ALL_COMPARED_SQL, v.SCAN_SQL, _methods_sql("score"), _methods_sql("lrt"), _methods_sql("wald"))
def a10_all_comparisons(spark: SparkSession, d: str) -> DataFrame:
    c = tables.compare_tests({t: pair(spark, d, t) for t in ("score", "lrt", "wald")})
    return c.select("left_test", "right_test", "method", *(F.round(k, 6).alias(k) for k in ("pearson", "spearman", "median_difference", "p99_difference", "max_difference")), "left_hits", "right_hits", "common_hits", *(r8(k).alias(k) for k in tables.TOPS))


#: Two-sided p of a correlation by Simpson's rule over the density of t, in 4,000 steps.
_T_SQL = """SELECT metric, round(coefficient, 6) AS coefficient, round(1 - 2 * t / 12000 * (SELECT sum((CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt((n - 2) * pi()) * power(1 + t * t * i * i / 16000000.0 / (n - 2), -(n - 1) / 2.0)) FROM (SELECT unnest(range(0, 4001)) AS i)), 6) AS p_value, n AS n_snps
FROM (SELECT *, abs(coefficient) * sqrt((n - 2) / (1 - coefficient * coefficient)) AS t FROM ({}))"""
_CONCORDANCE_SQL = _T_SQL.format(f"""SELECT 'Pearson' AS metric, corr(x, y) AS coefficient, count(*) AS n FROM (SELECT -log10(p_score_INC) AS x, -log10(p_score_SEV) AS y FROM scan)
UNION ALL SELECT 'Spearman', corr(rx, ry), count(*) FROM (SELECT {_rank_sql('p_score_INC')} AS rx, {_rank_sql('p_score_SEV')} AS ry FROM scan)""")


@query(_CONCORDANCE_SQL, v.SCAN_SQL)
def a12_concordance(spark: SparkSession, d: str) -> DataFrame:
    c, _ = tables.concordance(v.scan(spark, d), "p_score_INC", "p_score_SEV")
    return c.select("metric", F.round("coefficient", 6).alias("coefficient"), F.round("p_value", 6).alias("p_value"), "n_snps")


def _tops_sql(a: str, b: str, source: str, fractions: tuple[float, ...]) -> str:
    """top_fraction, k, overlap and n of the top lists by two columns."""
    return " UNION ALL ".join(f"SELECT {f}::DOUBLE AS top_fraction, any_value(k) AS k, count(*) FILTER (ra <= k AND rb <= k) AS overlap, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY {a}, variant_index) AS ra, row_number() OVER (ORDER BY {b}, variant_index) AS rb, CAST(greatest(1, round_even(count(*) OVER () * {f}::DOUBLE, 0)) AS BIGINT) AS k FROM {source})" for f in fractions)


_HYPER = "exp(lgamma(k + 1) - lgamma(x + 1) - lgamma(k - x + 1) + lgamma(n - k + 1) - lgamma(k - x + 1) - lgamma(n - 2 * k + x + 1) - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1))"


@query(
    f"SELECT top_fraction, k AS top_n_each, overlap, round(overlap / (2.0 * k - overlap), 8) AS jaccard, round(1.0::DOUBLE * k * k / n, 8) AS expected_overlap, round(overlap / (1.0::DOUBLE * k * k / n), 8) AS fold_enrichment, round(CASE WHEN k = overlap THEN 'inf'::DOUBLE ELSE 1.0::DOUBLE * overlap * (n - 2 * k + overlap) / ((k - overlap) * (k - overlap)) END, 8) AS odds_ratio,"
    f" round((SELECT sum({_HYPER}) FROM (SELECT unnest(range(t.overlap, t.k + 1)) AS x)), 8) AS fisher_p FROM ({_tops_sql('p_score_INC', 'p_score_SEV', 'scan', (0.01, 0.05, 0.1))}) t",
    v.SCAN_SQL,
)
def a12_concordance_tops(spark: SparkSession, d: str) -> DataFrame:
    t = tables.concordance(v.scan(spark, d), "p_score_INC", "p_score_SEV")[1]
    return t.select("top_fraction", F.col("top_n_each").cast("bigint").alias("top_n_each"), "overlap", *(r8(c).alias(c) for c in ("jaccard", "expected_overlap", "fold_enrichment", "odds_ratio", "fisher_p")))


_METHOD_SQL = f"""SELECT 'rank correlation' AS comparison, round(corr(rx, ry), 6) AS value, NULL::DOUBLE AS jaccard FROM (SELECT {_rank_sql('p_ACAT')} AS rx, {_rank_sql('p_SIMES')} AS ry FROM t_score)
UNION ALL SELECT 'hits ACAT', CAST(count(*) FILTER (q_ACAT < 0.9) AS DOUBLE), NULL FROM t_score UNION ALL SELECT 'hits SIMES', CAST(count(*) FILTER (q_SIMES < 0.9) AS DOUBLE), NULL FROM t_score
UNION ALL SELECT concat('top ', CAST(CAST(round(top_fraction * 100) AS INTEGER) AS VARCHAR), '%'), CAST(overlap AS DOUBLE), round(overlap / (2.0 * k - overlap), 8) FROM ({_tops_sql('p_ACAT', 'p_SIMES', 't_score', (0.01, 0.05, 0.1))})"""


@query(_METHOD_SQL, v.SCAN_SQL, _methods_sql("score"))
def a13_method_comparison(spark: SparkSession, d: str) -> DataFrame:
    return tables.method_comparison(pair(spark, d), 0.9).select("comparison", F.round("value", 6).alias("value"), r8("jaccard").alias("jaccard"))


@query(
    " UNION ALL ".join(f"SELECT 'p_{m}' AS metric, 'lrt' AS comparison, round(corr(ra, rb), 6) AS rho, round(min(a), 8) AS full_min_p, round(min(b), 8) AS other_min_p, count(*) AS n FROM (SELECT *, {_rank_sql('a')} AS ra, {_rank_sql('b')} AS rb FROM (SELECT x.p_{m} AS a, y.p_{m} AS b FROM t_score x JOIN t_lrt y USING (variant_index)))" for m in tables.METHODS),
    v.SCAN_SQL, _methods_sql("score"), _methods_sql("lrt"),
)
def a14_compare_scans(spark: SparkSession, d: str) -> DataFrame:
    c = tables.compare_scans(pair(spark, d), pair(spark, d, "lrt"), "lrt")
    return c.select("metric", "comparison", F.round("rho", 6).alias("rho"), r8("full_min_p").alias("full_min_p"), r8("other_min_p").alias("other_min_p"), "n")


@query("SELECT a.variant_index, a.CHR, round(b.p_score_SEV - a.p_score_INC, 8) AS difference FROM scan a JOIN scan b ON a.variant_index = b.variant_index", v.SCAN_SQL)
def j3_scan_comparison(spark: SparkSession, d: str) -> DataFrame:
    s = v.scan(spark, d)
    both = guards.join_one_to_one(s.select("variant_index", "CHR", F.col("p_score_INC").alias("a")), s.select("variant_index", F.col("p_score_SEV").alias("b")), "variant_index", "scans")
    return both.select("variant_index", "CHR", r8(F.col("b") - F.col("a")).alias("difference"))


@query("SELECT CASE WHEN l.b IS NULL THEN 'none' ELSE 'found' END AS state, count(*) AS n FROM (SELECT a.variant_index, b.variant_index AS b FROM scan a LEFT JOIN (SELECT * FROM scan WHERE p_score_SEV < 0.3) b ON a.variant_index = b.variant_index) l GROUP BY 1", v.SCAN_SQL)
def j4_left_join(spark: SparkSession, d: str) -> DataFrame:
    s = v.scan(spark, d)
    j = s.select("variant_index").join(s.filter("p_score_SEV < 0.3").select("variant_index", F.lit(1).alias("b")), "variant_index", "left")
    return j.groupBy(F.when(F.col("b").isNull(), "none").otherwise("found").alias("state")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS sample_index, concat('ID', CAST(s_suppkey AS VARCHAR)) AS ID_std, round(s_acctbal, 4) AS value FROM supplier")
def j5_ordered_lookup(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("ID"), F.col("s_suppkey").cast("string"))
    s = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample_index"), name.alias("ID_std"), F.round("s_acctbal", 4).alias("value"))
    return phenotype.in_order(s.select("ID_std", "value"), s.select("sample_index", "ID_std")).select("sample_index", "ID_std", "value")


@query("SELECT l_orderkey, l_quantity AS INC, round(l_tax - l_discount, 8) AS SEV_correction, abs(l_tax - l_discount) > 1e-12 AS CorrectionFlag FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS k FROM lineitem)")
def j6_align_by_position(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(spark, d, F.col("l_quantity")).select("l_orderkey", "INC", r8("SEV_correction").alias("SEV_correction"), "CorrectionFlag")


def _aligned(spark: SparkSession, d: str, inc: Column) -> DataFrame:
    """Order lines as a raw and a corrected field book, aligned; all columns settle ties, so that both number rows alike."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    li = numbering.numbered(v.table(spark, d, "lineitem").select(*order), [F.col(c) for c in order], "row").withColumn("id", F.concat(F.lit("C"), F.col("l_partkey").cast("string")))
    rep, block = F.when(F.col("l_linenumber") != 1, F.col("l_linenumber")), F.when(F.col("l_orderkey") % 3 != 0, F.col("l_orderkey") % 3)
    raw = li.select("row", "l_orderkey", rep.alias("Rep"), block.alias("Block"), inc.alias("INC_raw_source"), F.col("l_discount").alias("SEV_raw_source"), F.col("l_returnflag").alias("Location"), F.col("id").alias("Cultivar_raw"))
    fixed = li.select("row", inc.alias("INC"), F.col("l_tax").alias("SEV"), F.col("l_returnflag").alias("Location"), F.col("id").alias("Cultivar"), F.col("id").alias("ID_std"))
    return phenotype.align_by_position(raw, fixed, ["row"])


_FLAGS = ["CorrectionFlag", "DiseasePresent", "INC_zero_SEV_zero", "INC_zero_SEV_positive", "INC_positive_SEV_zero"]


@query(
    f"SELECT l_orderkey, concat(l_returnflag, '_R', coalesce(CAST({_REP_SQL} AS VARCHAR), 'NA'), CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE concat('_B', CAST(l_orderkey % 3 AS VARCHAR)) END) AS Stratum, abs(l_tax - l_discount) > 1e-12 AS CorrectionFlag,"
    " l_quantity > 5 AS DiseasePresent, l_quantity <= 5 AND l_tax = 0 AS INC_zero_SEV_zero, l_quantity <= 5 AND l_tax > 0 AS INC_zero_SEV_positive, l_quantity > 5 AND l_tax = 0 AS INC_positive_SEV_zero FROM lineitem"
)
def m17_canonical_plots(spark: SparkSession, d: str) -> DataFrame:
    """The canonical plots of two aligned books: strata, corrections, zero patterns."""
    inc = F.when(F.col("l_quantity") <= 5, F.lit(0.0)).otherwise(F.col("l_quantity"))
    return phenotype.canonical_plots(_aligned(spark, d, inc)).select("l_orderkey", "Stratum", *_FLAGS)


@query(
    "SELECT Location, Stratum, count(*) AS n, 0 AS corrected, count(*) FILTER (INC > 0) AS present, (SELECT count(*) FROM plots) AS numbers, 1.0::DOUBLE AS first_plot, (SELECT CAST(count(*) AS DOUBLE) FROM plots) AS last_plot FROM (SELECT Location, concat(Location, '_RNA') AS Stratum, INC FROM plots) GROUP BY Location, Stratum",
    v.PLOTS_SQL,
)
def m17_without_sources(spark: SparkSession, d: str) -> DataFrame:
    """The canonical plots where no field book is at hand: plots are numbered, nothing is corrected."""
    p = guards.cut(phenotype.without_sources(v.plots(spark, d).drop("Stratum").withColumn("Cultivar", F.col("ID_std"))).select("Location", "Stratum", "Plot", "CorrectionFlag", "DiseasePresent"))
    numbers = p.agg(F.countDistinct("Plot").alias("numbers"), F.min("Plot").alias("first_plot"), F.max("Plot").alias("last_plot"))  # one row
    return p.groupBy("Location", "Stratum").agg(F.count("*").alias("n"), F.count_if("CorrectionFlag").alias("corrected"), F.count_if("DiseasePresent").alias("present")).join(F.broadcast(numbers))


# -- range joins ------------------------------------------------------------------------------------------------------

_GAP = "CASE WHEN l.pos < g.gene_start THEN g.gene_start - l.pos WHEN l.pos > g.gene_end THEN l.pos - g.gene_end ELSE 0 END"
_NEAR_SQL = f"""SELECT lead_snp, CHR, lead_pos, gene, gene_start, gene_end, distance_bp, distance_bp <= 5000 AS within_flank FROM (
  SELECT *, row_number() OVER (PARTITION BY lead_snp ORDER BY distance_bp, gene_start, gene) AS rn FROM (
    SELECT l.lead_snp, l.CHR, l.pos AS lead_pos, g.gene, g.gene_start, g.gene_end, CAST({_GAP} AS BIGINT) AS distance_bp FROM leads l JOIN genes g ON l.CHR = g.CHR))
WHERE distance_bp <= 5000 OR rn = 1"""


@query(_NEAR_SQL, v.SCAN_SQL, v.LEADS_SQL, v.GENES_SQL)
def j7_nearby_genes(spark: SparkSession, d: str) -> DataFrame:
    return annotate.nearby_genes(v.leads(spark, d), v.genes(spark, d), 5000)


@query(
    "SELECT lead_snp, CHR, pos, round(a, 8) AS min_p_INC_window, round(b, 8) AS min_p_SEV_window, a < 0.01 AS INC_support, b < 0.01 AS SEV_support, a < 0.01 AND b < 0.01 AS both_support FROM (SELECT l.lead_snp, l.CHR, l.pos, min(s.p_score_INC) AS a, min(s.p_score_SEV) AS b FROM leads l JOIN scan s ON l.CHR = s.CHR AND s.pos BETWEEN l.pos - 20000 AND l.pos + 20000 GROUP BY ALL)",
    v.SCAN_SQL, v.LEADS_SQL,
)
def j8_window_support(spark: SparkSession, d: str) -> DataFrame:
    s = v.scan(spark, d).withColumnsRenamed({"p_score_INC": "p_INC", "p_score_SEV": "p_SEV"})
    w = annotate.window_support(v.leads(spark, d), s, 20_000, 0.01)
    return w.withColumn("min_p_INC_window", r8("min_p_INC_window")).withColumn("min_p_SEV_window", r8("min_p_SEV_window"))


def _omitted(s: DataFrame) -> DataFrame:
    cols = ["variant_index", "CHR", "pos", "beta_INC", "beta_SEV"]
    a, b = (s.select(*cols, F.lit(t).alias("location"), *(F.col(f"p_{t}_{m}").alias(f"p_{m}") for m in ("INC", "SEV"))) for t in ("lrt", "wald"))
    out = a.unionByName(b).withColumn("p_ACAT", stats.acat(F.col("p_INC"), F.col("p_SEV")))
    return out.withColumn("beta_INC", F.when(F.col("location") == "wald", -F.col("beta_INC")).otherwise(F.col("beta_INC")))


_OMITTED_SQL = "omitted AS (SELECT *, " + _acat_sql("p_INC", "p_SEV") + " AS p_ACAT FROM (" + " UNION ALL ".join(f"SELECT variant_index, CHR, pos, {'-' if t == 'wald' else ''}beta_INC AS beta_INC, beta_SEV, '{t}' AS location, p_{t}_INC AS p_INC, p_{t}_SEV AS p_SEV FROM scan" for t in ("lrt", "wald")) + "))"


def _full(s: DataFrame) -> DataFrame:
    return s.withColumnsRenamed({"p_score_INC": "p_INC", "p_score_SEV": "p_SEV"}).withColumn("p_ACAT", stats.acat(F.col("p_INC"), F.col("p_SEV")))


@query(
    f"""SELECT l.lead_snp, o.location, round({_acat_sql('f.p_score_INC', 'f.p_score_SEV')}, 8) AS full_p_ACAT, round(o.p_ACAT, 8) AS loo_exact_p_ACAT,
    round((SELECT min(w.p_SEV) FROM omitted w WHERE w.location = o.location AND w.CHR = l.CHR AND w.pos BETWEEN l.pos - 20000 AND l.pos + 20000), 8) AS loo_min_p_SEV_window,
    sign(o.beta_INC) = sign(f.beta_INC) AS beta_INC_direction_same, sign(o.beta_SEV) = sign(f.beta_SEV) AS beta_SEV_direction_same
    FROM leads l JOIN scan f ON f.variant_index = l.lead_variant_index JOIN omitted o ON o.variant_index = l.lead_variant_index""",
    v.SCAN_SQL, v.LEADS_SQL, _OMITTED_SQL,
)
def j9_omission_stability(spark: SparkSession, d: str) -> DataFrame:
    s = v.scan(spark, d)
    o = annotate.omission_stability(v.leads(spark, d), _full(s), _omitted(s), 20_000)
    return o.select("lead_snp", "location", *(r8(c).alias(c) for c in ("full_p_ACAT", "loo_exact_p_ACAT", "loo_min_p_SEV_window")), "beta_INC_direction_same", "beta_SEV_direction_same")


@query(
    "SELECT l.variant_index, l.lead_rank, o.location, round(f.p_score_INC, 8) AS full_p_INC, round(o.p_SEV, 8) AS loo_p_SEV FROM (SELECT lead_variant_index AS variant_index, row_number() OVER (ORDER BY lead_variant_index) AS lead_rank FROM leads) l JOIN scan f USING (variant_index) JOIN omitted o USING (variant_index)",
    v.SCAN_SQL, v.LEADS_SQL, _OMITTED_SQL,
)
def j10_omission_support(spark: SparkSession, d: str) -> DataFrame:
    s = v.scan(spark, d)
    c = v.leads(spark, d).select(F.col("lead_variant_index").alias("variant_index"), F.row_number().over(W.orderBy("lead_variant_index")).cast("bigint").alias("lead_rank"))
    return annotate.omission_support(c, _full(s), _omitted(s)).select("variant_index", "lead_rank", "location", r8("full_p_INC").alias("full_p_INC"), r8("loo_p_SEV").alias("loo_p_SEV"))


@query("SELECT l.lead_snp, round(s.beta_INC, 8) AS beta_INC, round(s.beta_SEV + 1.96 * s.se, 8) AS ci_high_SEV, round(s.p_score_SEV, 8) AS p_SEV, 100 AS n_INC FROM leads l LEFT JOIN scan s ON s.variant_index = l.lead_variant_index", v.SCAN_SQL, v.LEADS_SQL)
def j11_trait_effects(spark: SparkSession, d: str) -> DataFrame:
    scans = {t: v.trait_scan(spark, d, t).withColumnRenamed("p_score", "p").withColumn("n", F.lit(100)) for t in ("INC", "SEV")}
    return annotate.with_effects(v.leads(spark, d), scans).select("lead_snp", r8("beta_INC").alias("beta_INC"), r8("ci_high_SEV").alias("ci_high_SEV"), r8("p_SEV").alias("p_SEV"), "n_INC")


@query(
    "SELECT l.lead_variant_index AS variant_index, l.lead_snp, round(a.p_ACAT, 8) AS p_ACAT_score, round(b.q_SEV, 8) AS q_SEV_lrt, row_number() OVER (ORDER BY a.p_ACAT, a.p_SEV, l.CHR, l.pos) AS candidate_rank FROM leads l LEFT JOIN t_score a ON a.variant_index = l.lead_variant_index LEFT JOIN t_lrt b ON b.variant_index = l.lead_variant_index",
    v.SCAN_SQL, v.LEADS_SQL, _methods_sql("score"), _methods_sql("lrt"),
)
def j13_candidate_support(spark: SparkSession, d: str) -> DataFrame:
    leads = v.leads(spark, d).withColumnRenamed("lead_variant_index", "variant_index")
    c = tables.candidate_support(leads, {"score": (pair(spark, d), list(tables.METHODS)), "lrt": (pair(spark, d, "lrt"), ["SEV"])})
    rank = F.row_number().over(W.orderBy(F.col("p_ACAT_score").asc_nulls_last(), F.col("p_SEV_score").asc_nulls_last(), "CHR", "pos"))
    return c.select("variant_index", "lead_snp", r8("p_ACAT_score").alias("p_ACAT_score"), r8("q_SEV_lrt").alias("q_SEV_lrt"), rank.cast("bigint").alias("candidate_rank"))


_ALIAS_SQL = "SELECT DISTINCT variant_index % 7 AS c, count(*) OVER (PARTITION BY variant_index % 7) AS k FROM scan"


@query(
    "SELECT l.lead_variant_index AS variant_index, round(t.p_ACAT, 8) AS p_ACAT, round(t.beta_INC - 1.96 * t.se, 8) AS ci_low_INC, round(s.p_lrt_SEV, 8) AS p_SEV_lrt, a.k AS global_alias_count,"
    f" row_number() OVER (ORDER BY t.p_ACAT, t.p_SEV, l.CHR, l.pos, l.lead_variant_index) AS candidate_rank FROM leads l JOIN t_score t ON t.variant_index = l.lead_variant_index JOIN scan s ON s.variant_index = l.lead_variant_index JOIN ({_ALIAS_SQL}) a ON a.c = l.lead_variant_index % 7",
    v.SCAN_SQL, v.LEADS_SQL, _methods_sql("score"),
)
def j12_enrich_candidates(spark: SparkSession, d: str) -> DataFrame:
    key = (F.col("variant_index") % 7).alias("global_alias_class_index")
    scan = v.scan(spark, d).select(key)
    classes = scan.groupBy("global_alias_class_index").agg(F.count("*").alias("class_size")).selectExpr("*", "'c' AS global_alias_class_id", "1 AS n_chromosomes", "'' AS alias_mappings")
    leads = v.leads(spark, d).withColumnRenamed("lead_variant_index", "variant_index")
    lrt = v.trait_scan(spark, d, "SEV", "lrt").select("variant_index", F.col("p_lrt").alias("p_SEV"))
    c = tables.enrich_candidates(leads, pair(spark, d).select("*", key), {"lrt": lrt}, classes)
    return c.select("variant_index", r8("p_ACAT").alias("p_ACAT"), r8("ci_low_INC").alias("ci_low_INC"), r8("p_SEV_lrt").alias("p_SEV_lrt"), "global_alias_count", F.col("candidate_rank").cast("bigint").alias("candidate_rank"))


@query("SELECT lead_snp, CHR, pos, lead_variant_index AS variant_index FROM leads", v.SCAN_SQL, v.LEADS_SQL)
def j14_candidate_mapping(spark: SparkSession, d: str) -> DataFrame:
    return tables.map_candidates(v.leads(spark, d).drop("lead_variant_index"), v.scan(spark, d)).select("lead_snp", "CHR", "pos", "variant_index")


# -- genotypes --------------------------------------------------------------------------------------------------------

_R2_SQL = """SELECT a.chr AS CHR, a.v AS a, b.v AS b, round(regr_r2(CAST(b.x AS DOUBLE), CAST(a.x AS DOUBLE)), 6) AS r2
FROM (SELECT *, CAST(v % 10 + 1 AS INTEGER) AS chr, (v // 10) * 1000 + 1000 AS pos FROM imputed) a JOIN (SELECT *, CAST(v % 10 + 1 AS INTEGER) AS chr, (v // 10) * 1000 + 1000 AS pos FROM imputed) b
ON a.vec_id = b.vec_id AND a.chr = b.chr AND a.v < b.v AND abs(a.pos - b.pos) <= 3000 GROUP BY ALL"""
_IMPUTED_SQL = "imputed AS (SELECT vec_id, v, CASE WHEN code < 0 THEN avg(CASE WHEN code >= 0 THEN CAST(code AS DOUBLE) END) OVER (PARTITION BY v) ELSE code END AS x FROM dosage)"


@query(_R2_SQL, v.DOSAGE_SQL, _IMPUTED_SQL)
def l1_ld_r2_band(spark: SparkSession, d: str) -> DataFrame:
    return genotype.r2_pairs(v.genotypes(spark, d), 3000).select("CHR", "a", "b", F.round("r2", 6).alias("r2"))


@query("SELECT v AS variant_index, round(sum(z * z), 4) AS squares FROM (SELECT v, (x - m) / sqrt(2 * (m / 2) * (1 - m / 2)) AS z FROM (SELECT v, x, avg(x) OVER (PARTITION BY v) AS m FROM imputed)) GROUP BY v", v.DOSAGE_SQL, _IMPUTED_SQL)
def m1_standardized(spark: SparkSession, d: str) -> DataFrame:
    return genotype.standardized_squares(v.genotypes(spark, d)).select("variant_index", F.round("squares", 4).alias("squares"))


#: Vectors of all samples; most classes hold one variant. Shared and complemented classes are tested on small tables.
_VECTORS_SQL = """vectors AS (SELECT v, string_agg(CAST(CASE WHEN first_code = 2 AND code >= 0 THEN 2 - code ELSE code END AS VARCHAR), ',' ORDER BY vec_id) AS canonical
  FROM (SELECT *, arg_min(code, vec_id) FILTER (code IN (0, 2)) OVER (PARTITION BY v) AS first_code FROM dosage) GROUP BY v)"""


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return v.genotypes(spark, d).withColumn("pos", F.col("variant_index") * 100)


@query("SELECT v AS variant_index, count(*) OVER (PARTITION BY canonical) AS global_size, count(*) OVER (PARTITION BY canonical, v % 10) AS test_size FROM vectors", v.DOSAGE_SQL, _VECTORS_SQL)
def a15_equivalence(spark: SparkSession, d: str) -> DataFrame:
    return genotype.equivalence_classes(_vectors(spark, d)).select("variant_index", "global_size", "test_size")


_CLASS_P = "CAST((v * 7919) % 101 + 1 AS DOUBLE) / CAST(102 AS DOUBLE)"


def _classed(spark: SparkSession, d: str) -> DataFrame:
    c = genotype.equivalence_classes(_vectors(spark, d))
    p = ((F.col("variant_index") * 7919) % 101 + 1).cast("double") / 102
    return c.withColumn("snp", F.concat(F.lit("S"), F.col("variant_index").cast("string"))).withColumns({f"p_{m}": p for m in tables.METHODS})


@query(f"SELECT arg_min(v, p) AS representative, count(*) AS n FROM (SELECT v, canonical, {_CLASS_P} AS p FROM vectors) GROUP BY canonical", v.DOSAGE_SQL, _VECTORS_SQL)
def a16_representatives(spark: SparkSession, d: str) -> DataFrame:
    c = _classed(spark, d)
    sizes = c.groupBy("global_class").agg(F.count("*").alias("n"))
    return genotype.representatives(c, "global_class", "p_ACAT").join(sizes, "global_class").select("representative", "n")


@query(
    f"SELECT count(*) AS class_size, arg_min(v, p) AS representative, count(DISTINCT v % 10) AS n_chromosomes, min(v * 100) AS minimum_position, max(v * 100) AS maximum_position, string_agg(concat('S', CAST(v AS VARCHAR), '@chr', CAST(v % 10 + 1 AS VARCHAR), ':', CAST(v * 100 AS VARCHAR)), '; ' ORDER BY v) AS alias_mappings FROM (SELECT v, canonical, {_CLASS_P} AS p FROM vectors) GROUP BY canonical",
    v.DOSAGE_SQL, _VECTORS_SQL,
)
def a17_global_classes(spark: SparkSession, d: str) -> DataFrame:
    return genotype.class_tables(_classed(spark, d))["global_classes"].drop("global_class", "global_id")


@query(f"SELECT CAST(v % 10 + 1 AS INTEGER) AS CHR, count(*) AS class_size, round(min({_CLASS_P}), 8) AS minimum_p_ACAT, round(max({_CLASS_P}) - min({_CLASS_P}), 8) AS spread_ACAT FROM vectors GROUP BY canonical, v % 10", v.DOSAGE_SQL, _VECTORS_SQL)
def a18_class_spread(spark: SparkSession, d: str) -> DataFrame:
    return genotype.class_tables(_classed(spark, d))["test_classes"].select("CHR", "class_size", r8("minimum_p_ACAT").alias("minimum_p_ACAT"), r8("spread_ACAT").alias("spread_ACAT"))


@query(f"SELECT v AS variant_index FROM (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY p, v) AS g FROM (SELECT *, row_number() OVER (PARTITION BY canonical, v % 10 ORDER BY p, v) AS t FROM (SELECT v, canonical, {_CLASS_P} AS p FROM vectors)) WHERE t = 1) WHERE g = 1", v.DOSAGE_SQL, _VECTORS_SQL)
def w3_collapse(spark: SparkSession, d: str) -> DataFrame:
    return genotype.collapse(_classed(spark, d), "ACAT").select("variant_index")


@query()
def l2_ld_prune(spark: SparkSession, d: str) -> DataFrame:
    return ld.prune(v.genotypes(spark, d), 3000, 0.02)


def _clumps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g = v.genotypes(spark, d)
    p = ((F.col("variant_index") * 7919) % 101 + 1).cast("double") / 102
    g = g.withColumn("snp", F.concat(F.lit("S"), F.col("variant_index").cast("string"))).withColumn("p_ACAT", p)
    return ld.clump(g, "p_ACAT", 0.2, 0.8, 3000, 0.002, 50)


@query()
def l4_ld_clump(spark: SparkSession, d: str) -> DataFrame:
    return _clumps(spark, d)[0]


@query()
def l4_clump_members(spark: SparkSession, d: str) -> DataFrame:
    return _clumps(spark, d)[1]


# -- phenotypes -------------------------------------------------------------------------------------------------------


@query("SELECT ID_std, round(avg(INC), 6) AS INC_SIMPLE_RAW, round(avg(SEV), 8) AS SEV_SIMPLE_RAW, count(*) AS N_PLOTS_TOTAL, count(DISTINCT Location) AS N_LOCATIONS FROM plots GROUP BY ID_std", v.PLOTS_SQL)
def a1_simple_means(spark: SparkSession, d: str) -> DataFrame:
    return phenotype.simple_means(v.plots(spark, d)).withColumn("INC_SIMPLE_RAW", F.round("INC_SIMPLE_RAW", 6)).withColumn("SEV_SIMPLE_RAW", r8("SEV_SIMPLE_RAW"))


#: The names in the table of regions.
_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query(
    "SELECT ID_std, " + ", ".join(f"round(avg(INC) FILTER (Location = '{r}'), 6) AS INC_SITE_{r.replace(' ', '_')}, round(avg(SEV) FILTER (Location = '{r}'), 8) AS SEV_SITE_{r.replace(' ', '_')}, nullif(count(*) FILTER (Location = '{r}'), 0) AS N_SITE_{r.replace(' ', '_')}" for r in _REGIONS) + " FROM plots GROUP BY ID_std",
    v.PLOTS_SQL,
)
def a2_location_traits(spark: SparkSession, d: str) -> DataFrame:
    t = phenotype.location_traits(v.plots(spark, d), _REGIONS)
    digits = {"INC": 6, "SEV": 8}
    return t.select(*(F.round(c, digits[c[:3]]).alias(c) if c[:3] in digits else F.col(c) for c in t.columns))


@query("SELECT count(*) AS rows, count(DISTINCT ID_std) AS ids, count(DISTINCT Location) AS locations, count(DISTINCT Stratum) AS strata, count(*) FILTER (INC = 0 AND SEV = 0) AS zero_zero, len(list(DISTINCT SEV)) AS severities FROM plots", v.PLOTS_SQL)
def a3_plot_report(spark: SparkSession, d: str) -> DataFrame:
    r = phenotype.plot_report(phenotype.disease_flags(v.plots(spark, d)))
    return r.select("rows", "ids", "locations", "strata", F.col("INC_zero_SEV_zero").alias("zero_zero"), F.size("severities").cast("bigint").alias("severities"))


_LSM_SQL = """, base AS (SELECT ID_std, CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s, INC AS y FROM plots),
m AS (SELECT ID_std, count(*) AS n, avg(s) AS sx, avg(y) AS my FROM base GROUP BY ID_std),
c AS (SELECT sum((b.s - m.sx) * (b.y - m.my)) AS sxy, sum((b.s - m.sx) * (b.s - m.sx)) AS sxx, sum((b.y - m.my) * (b.y - m.my)) AS syy, count(*) AS total FROM base b JOIN m USING (ID_std)),
v AS (SELECT sxy / sxx AS b, sxx, (syy - sxy * sxy / sxx) / (total - (SELECT count(*) FROM m) - 1) AS s2 FROM c)
SELECT ID_std, round(my - b * (sx - 0.5), 6) AS INC_ADJ_RAW, round(sqrt(s2 * (1.0 / n + (sx - 0.5) * (sx - 0.5) / sxx)), 6) AS INC_ADJ_RAW_LSM_SE, n AS INC_ADJ_RAW_N_PLOTS FROM m, v"""


@query("", v.PLOTS_SQL)
def a4_adjusted_means(spark: SparkSession, d: str) -> DataFrame:
    p = v.plots(spark, d).withColumn("Stratum", F.col("l_linestatus"))
    a = phenotype.adjusted_means(p, "INC")
    return a.select("ID_std", F.round("INC_ADJ_RAW", 6).alias("INC_ADJ_RAW"), F.round("INC_ADJ_RAW_LSM_SE", 6).alias("INC_ADJ_RAW_LSM_SE"), "INC_ADJ_RAW_N_PLOTS")


ORACLE_SQL["a4_adjusted_means"] = "WITH " + v.PLOTS_SQL + _LSM_SQL


@query()
def a5_accession_traits(spark: SparkSession, d: str) -> DataFrame:
    return phenotype.accession_traits(v.plots(spark, d))


@query()
def a5_omission_traits(spark: SparkSession, d: str) -> DataFrame:
    """Traits without one region at a time."""
    return phenotype.omission_traits(v.plots(spark, d), _REGIONS)


@query("SELECT trait, count(*) AS n, count(*) FILTER (alike) AS same FROM (SELECT 'INC' AS trait, sign(beta_INC) = sign(beta_SEV) AS alike FROM scan UNION ALL SELECT 'SEV', sign(beta_SEV) = sign(se) FROM scan) GROUP BY trait", v.SCAN_SQL)
def a20_direction_summary(spark: SparkSession, d: str) -> DataFrame:
    s = v.scan(spark, d)
    rows = F.array(F.struct(F.lit("INC").alias("trait"), stats.same_sign(F.col("beta_INC"), F.col("beta_SEV")).alias("alike")), F.struct(F.lit("SEV").alias("trait"), stats.same_sign(F.col("beta_SEV"), F.col("se")).alias("alike")))
    return s.select(F.inline(rows)).groupBy("trait").agg(F.count("*").alias("n"), F.count_if("alike").alias("same"))


@query(
    "SELECT s.ID_std, coalesce(t.k, 0) AS N_LOCATIONS, coalesce(t.k, 0) >= 5 AS PRIMARY_ELIGIBLE FROM (SELECT concat('ID', CAST(s_suppkey * 2 AS VARCHAR)) AS ID_std FROM supplier) s LEFT JOIN (SELECT ID_std, count(DISTINCT Location) AS k FROM plots GROUP BY ID_std) t USING (ID_std)",
    v.PLOTS_SQL,
)
def m16_population(spark: SparkSession, d: str) -> DataFrame:
    ids = v.table(spark, d, "supplier").select(F.concat(F.lit("ID"), (F.col("s_suppkey") * 2).cast("string")).alias("ID_std"))
    return phenotype.population(phenotype.simple_means(v.plots(spark, d)), ids, 5).select("ID_std", "N_LOCATIONS", "PRIMARY_ELIGIBLE")


@query(
    "SELECT metric, CASE WHEN mode = 'log10' THEN CASE WHEN abs(log10(actual) - log10(expected)) <= tolerance THEN 'PASS' ELSE 'FAIL' END WHEN mode = 'exact' THEN CASE WHEN actual = expected THEN 'PASS' ELSE 'FAIL' END WHEN abs(actual - expected) <= tolerance THEN 'PASS' WHEN mode = 'diagnostic' THEN 'WARN' ELSE 'FAIL' END AS status FROM (SELECT n_name AS metric, CAST(n_nationkey + 1 AS DOUBLE) AS expected, CAST(n_nationkey % 5 + 1 AS DOUBLE) AS actual, ['exact', 'absolute', 'log10', 'diagnostic'][n_nationkey % 4 + 1] AS mode, 0.5::DOUBLE AS tolerance FROM nation)"
)
def m15_reference_check(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    n = v.table(spark, d, "nation").select(F.col("n_name").alias("metric"), (k + 1).cast("double").alias("expected"), (k % 5 + 1).cast("double").alias("actual"), _pick(["exact", "absolute", "log10", "diagnostic"], "n_nationkey").alias("mode"), F.lit(0.5).alias("tolerance"))
    return tables.check_reference(n).select("metric", "status")


# -- models -----------------------------------------------------------------------------------------------------------

_OLS_SQL = """SELECT l_partkey, round(b, 6) AS beta, round(sqrt(greatest(syy - b * sxy, 0) / (n - 2) / sxx), 6) AS se FROM (
  SELECT l_partkey, count(*) AS n, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_sxy(l_extendedprice, l_quantity) AS sxy, regr_syy(l_extendedprice, l_quantity) AS syy, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem GROUP BY l_partkey)
WHERE n >= 5 AND sxx > 0"""


@query(_OLS_SQL)
def m6_ols_groups(spark: SparkSession, d: str) -> DataFrame:
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    g = v.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), F.regr_syy(y, x).alias("syy"))
    b = F.col("sxy") / F.col("sxx")
    return g.filter("n >= 5 AND sxx > 0").select("l_partkey", F.round(b, 6).alias("beta"), F.round(F.sqrt(F.greatest(F.col("syy") - b * F.col("sxy"), F.lit(0.0)) / (F.col("n") - 2) / F.col("sxx")), 6).alias("se"))


def _panel(spark: SparkSession, d: str) -> tuple[DataFrame, np.ndarray]:
    """All samples of the table, checkpointed, as scans and components pass over them several times, and a trait as long."""
    g = guards.cut(v.genotypes(spark, d))
    n = g.agg(F.max(F.size("dosages"))).first()[0] or 0
    return g, np.sin(np.arange(n) * 1.7) + np.cos(np.arange(n) * 0.3)


@query()
def m6_ols_scan(spark: SparkSession, d: str) -> DataFrame:
    g, y = _panel(spark, d)
    return models.ols_scan(g, {"A": y, "B": y**2}, kinship.principal_components(packed.packed(g.select("dosages")), 5), [0, 1, 3])


@query()
def m4_mixed_scan_loco(spark: SparkSession, d: str) -> DataFrame:
    g, y = _panel(spark, d)
    return models.mixed_scan(g, {"A": y})


@query()
def m3_kinship(spark: SparkSession, d: str) -> DataFrame:
    return kinship.kinship_tiles(_panel(spark, d)[0])


@query()
def m10_power_table(spark: SparkSession, d: str) -> DataFrame:
    """Detectable effects of the scan's variants, by allele frequency and number of called samples out of 102."""
    s = v.scan(spark, d)
    called = F.round((1 - F.col("missing_rate")) * 102).cast("int")
    return models.variant_power(s.select(called.alias("n_samples"), F.col("MAF").alias("maf")), {"bonferroni": None, "suggestive": 1e-5}, [0.8, 0.9])


@query()
def m7_ols_summary(spark: SparkSession, d: str) -> DataFrame:
    return ranking.scan_summary(m6_ols_scan(spark, d), ["trait", "n_pcs"], "p")


@query()
def m9_pc_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Spaces of the components of all markers and of every second one."""
    g = _panel(spark, d)[0]
    some = g.filter("variant_index % 2 = 0").select("variant_index")
    return spark.createDataFrame(models.pc_geometry(kinship.principal_components(packed.packed(g.select("dosages")), 5), models.structure_components(g, some))[1])


def _candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Score tests of every ninth variant with the panel's traits, and without each of three places."""
    g, y = _panel(spark, d)
    traits = {"INC": y, "SEV": y**2}
    omitted = {place: {t: x + 0.1 * np.cos(np.arange(len(x)) * (k + 2)) for t, x in traits.items()} for k, place in enumerate(_REGIONS[:3])}
    candidates = g.filter("variant_index % 9 = 1").select("variant_index", F.concat(F.lit("S"), F.col("variant_index").cast("string")).alias("lead_snp"))
    return models.rescan_candidates(g, candidates, traits, omitted)


@query()
def m12_candidate_effects(spark: SparkSession, d: str) -> DataFrame:
    primary, rest = _candidates(spark, d)
    p = primary.groupBy("variant_index").agg(*(F.max(F.when(F.col("trait") == t, F.col("p_score"))).alias(f"p_{t}_score") for t in ("INC", "SEV")))
    return tables.candidate_score_effects(primary, rest.select("variant_index", "lead_snp").distinct().join(p, "variant_index"), rest, 3)


@query(
    "SELECT 'genotypes' AS input, count(DISTINCT v) AS n FROM dosage UNION ALL SELECT 'metadata', count(DISTINCT v) FROM dosage UNION ALL SELECT 'markers', count(DISTINCT v) FILTER (v <= 40) FROM dosage UNION ALL SELECT 'ids', count(*) FILTER (vec_id % 4 > 0) FROM embeddings UNION ALL SELECT 'traits', count(*) FILTER (vec_id % 4 > 0) FROM embeddings",
    v.DOSAGE_SQL,
)
def m13_primary_inputs(spark: SparkSession, d: str) -> DataFrame:
    """The panel as a project's inputs, three of four samples eligible; the published tables are the same ones."""
    g, y = _panel(spark, d)
    g = g.withColumn("variant_index", F.col("variant_index") - 1)
    ids = numbering.numbered(v.table(spark, d, "embeddings").select("vec_id"), [F.col("vec_id")], "sample_index")
    samples = ids.select(F.col("sample_index").cast("int").alias("sample_index"), F.concat(F.lit("ID"), F.col("vec_id").cast("string")).alias("ID_std"), (F.col("vec_id") % 4 > 0).alias("PRIMARY_ELIGIBLE"))
    traits = samples.select("ID_std", F.sin("sample_index").alias("INC"), F.cos("sample_index").alias("SEV"))
    meta = g.select("variant_index", F.concat(F.lit("S"), F.col("variant_index").cast("string")).alias("snp"), "CHR", "pos")
    markers = meta.filter("variant_index < 40")
    chosen = samples.filter("PRIMARY_ELIGIBLE").orderBy("sample_index").select("sample_index", "ID_std").toArrow()
    pc = models.structure_components(g, markers.select("variant_index"), chosen.column("sample_index").to_numpy())
    pcs = spark.createDataFrame(pa.table({"ID_std": chosen.column("ID_std"), **{c: pc[:, k] for k, c in enumerate(inputs.PCS)}}))
    given = inputs.Inputs(samples, traits, pcs, meta, markers, g.select("variant_index", "dosages"))
    found = inputs.primary_inputs(given, given, (len(chosen), g.count(), len(y)), ("INC", "SEV"))
    out = [df.agg(F.lit(k).alias("input"), F.count("*").alias("n")) for k, df in found.items()]
    return reduce(DataFrame.unionByName, out)


@query()
def m11_reproduce_power(spark: SparkSession, d: str) -> DataFrame:
    return models.reproduce_power(m10_power_table(spark, d))


# -- the composed last stage ------------------------------------------------------------------------------------------

#: Thresholds that give clumps on the p-values and vectors of the views.
_FINAL = final.Settings(index_p=0.02, secondary_p=0.1, window_kb=20, r2=0.1, candidates=50, flank_kb=5, fdr=0.9999, sample_sizes=(64,))


def _final(spark: SparkSession, d: str) -> final.Run:
    s = v.scan(spark, d)
    traits = F.array(*(F.struct(F.lit(t).alias("trait"), F.col(f"beta_{t}").alias("beta"), *(F.col(f"p_{k}_{t}").alias(f"p_{k}") for k in final.TESTS)) for t in ("INC", "SEV")))
    scans = s.select(F.lit("loco").alias("context"), *tables.META, "se", F.inline(traits))
    return final.Run(scans, v.scan_vectors(s), v.genes(spark, d), f"{guards.shared_folder(spark)}/{uuid.uuid4().hex}", _FINAL)


def _final_sql() -> str:
    rows = ["SELECT 'n_samples' AS figure, 64.0::DOUBLE AS value", "SELECT 'n_variants', CAST(count(*) AS DOUBLE) FROM scan", "SELECT 'unique_tests', CAST(count(DISTINCT (CHR, codes)) AS DOUBLE) FROM scan_vectors"]
    rows += [f"SELECT '{t}_{m}_hits', CAST(count(*) FILTER (q_{m} < {_FINAL.fdr}) AS DOUBLE) FROM t_{t}" for t in final.TESTS for m in tables.METHODS]
    z = v.norm_ppf_sql("(p_ACAT / 2)")
    rows += [f"SELECT 'score_ACAT_lambda_gc', round(quantile_cont({z} * {z}, 0.5) / 0.4549364231195727::DOUBLE, 6) FROM t_score", "SELECT 'score_ACAT_minimum_p', round(min(p_ACAT), 6) FROM t_score"]
    return " UNION ALL ".join(rows)


@query()
def o_final_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of a whole run: clumped leads of both methods with all tests, effects, classes and ranks."""
    return _final(spark, d).table("candidates")


@query(_final_sql(), v.SCAN_SQL, v.SCAN_VECTORS_SQL, *map(_methods_sql, final.TESTS))
def o_final_summary(spark: SparkSession, d: str) -> DataFrame:
    """Figures of a whole run; how many candidates there are is left to the tests, as SQL can't clump."""
    return _final(spark, d).table("summary").filter("figure <> 'candidates'").withColumn("value", F.round("value", 6))
