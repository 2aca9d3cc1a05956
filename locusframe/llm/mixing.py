"""Mixing sources to target weights.

Tokens are summed per source, each source's target is a weighted share of the budget, capped at a multiple of
what the source has, and each document is repeated ``floor(rate)`` times plus one Bernoulli copy, drawn from a
hash of its id, with the fraction of the rate as probability.

Edge cases: a null text has size 0; a null source is a source of its own and comes last; an empty table gives an
empty result; rows that repeat a doc_id share one draw, so a rerun and a repeated row always agree; rows with a
null doc_id share the draw of the empty id. Extra columns are carried along unread.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import lcm

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import keep, table, unused, words

WEIGHTS = (5, 2, 1)
SEED = "mix-1"
#: Sources whose rates are broadcast; beyond, rates are joined by source and one of SALTS shares of its documents.
FEW, SALTS = 50_000, 64


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """Targets of sources. ``sizes``: (source, source_size), one row a source.

    Weights repeat in the order of the source names. The budget is ``share`` (a fraction) of all sizes. Excess over
    ``cap`` times a source's size is shared among the others by weight until none is above: as sources are capped in the
    order of size / weight, one pass of running sums finds the level. Both windows hold one row per source.
    """
    num, den = share
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    unit = lcm(*weights)
    s = sizes.withColumn("w", F.element_at(F.lit(list(weights)), (F.pmod(F.row_number().over(by_name) - 1, len(weights)) + 1).cast("int")).cast("long"))
    by_room = W.orderBy((F.col("source_size") * F.lit(unit) / F.col("w")), F.col("source").asc_nulls_last())
    whole = by_room.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = (
        s.withColumn("below", F.coalesce(F.sum("source_size").over(by_room.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(by_room.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(whole))
    )
    level = (F.lit(num) * F.col("total") - F.lit(den * cap) * F.col("below")).cast("double") / (F.lit(den) * F.col("w_left")).cast("double")
    s = s.withColumn("level", level).withColumn("full", F.col("level") * F.col("w") > (F.lit(cap) * F.col("source_size")).cast("double"))
    s = s.withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(whole))
    target = F.when(F.col("full"), (F.lit(cap) * F.col("source_size")).cast("double")).otherwise(F.col("level") * F.col("w"))
    return s.select("source", "source_size", target.alias("target"))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the seed and the id."""
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mixing_plan(docs: DataFrame, size: Column, **options: object) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with size, source_size, target and copies, and the names that these columns have got beside the table's own."""
    name = {c: unused(docs, f"__{c}") for c in ("size", "source_size", "target", "copies", "source", "salt")}
    totals = docs.select("source", size.cast("long").alias("n")).groupBy("source").agg(F.sum("n").alias("source_size"))
    rates = keep(source_targets(totals, **options).select(F.col("source").alias(name["source"]), F.col("source_size").alias(name["source_size"]), F.col("target").alias(name["target"])), "rates")
    sized, same = docs.withColumn(name["size"], size.cast("long")), F.col("source").eqNullSafe(F.col(name["source"]))
    if rates.limit(FEW + 1).count() <= FEW:
        joined = sized.join(F.broadcast(rates), same)
    else:
        salted = rates.withColumn(name["salt"], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        share = F.pmod(F.xxhash64("doc_id", "text" if "text" in docs.columns else "doc_id"), F.lit(SALTS))
        joined = sized.join(salted, same & (share == F.col(name["salt"]))).drop(name["salt"])
    rate = F.when(F.col(name["source_size"]) > 0, F.col(name["target"]) / F.col(name["source_size"])).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (draw(F.col("doc_id")) < rate - F.floor(rate)).cast("long")
    return joined.withColumn(name["copies"], copies).drop(name["source"]), name


def mix(docs: DataFrame, size: Column | None = None, **options: object) -> DataFrame:
    """The mixed documents: the columns of ``docs``, each row as often as the mix takes it."""
    size = F.size(words(F.col("text"))) if size is None else size
    plan, name = mixing_plan(docs, size, **options)
    return plan.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.col(name["copies"]).cast("int"))).alias(unused(docs, "__copy"))).select(*docs.columns)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = keep(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("words")), "mix-sizes")
    plan, name = mixing_plan(sized, F.col("words"))
    return plan.select("doc_id", *(F.col(name[c]).alias(c) for c in ("size", "source_size", "target")), (F.col(name["size"]) * F.col(name["copies"])).alias("taken"))


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CAST([5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS BIGINT) AS w FROM totals
), running AS (
  SELECT *,
    coalesce(sum(source_size) OVER (ORDER BY source_size * 10 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(w) OVER (ORDER BY source_size * 10 / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left,
    sum(source_size) OVER () AS total
  FROM weighted
), levels AS (SELECT *, CAST(3 * total - 4 * below AS DOUBLE) / CAST(2 * w_left AS DOUBLE) AS level FROM running),
fulls AS (SELECT *, level * w > CAST(2 * source_size AS DOUBLE) AS is_full FROM levels),
targets AS (
  SELECT source, source_size,
    CASE WHEN is_full THEN CAST(2 * source_size AS DOUBLE) ELSE (max(CASE WHEN NOT is_full THEN level END) OVER ()) * w END AS target
  FROM fulls
), rated AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
    CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM rated
"""
