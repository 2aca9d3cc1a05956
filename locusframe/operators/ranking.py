"""Ranks, step-up adjustment, quantile statistics and top lists."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from locusframe.functions.stats import CHI2_1_MEDIAN, TINY, chi2_1_isf, clip, neglog10, norm_ppf
from locusframe.operators.guards import cut
from locusframe.operators.numbering import numbered

#: Ranges of a value, by quantiles, that a global order is dealt to; each is a task's share of a window.
RANGES = 64


def ranged(counts: DataFrame, p: str, group: str) -> DataFrame:
    """Adds _range, the number of quantiles of ``p`` in its group that a value is above: at most RANGES ranges a group.

    The quantiles are approximate, and come out otherwise when they're told again, as their parts meet in another order;
    so they are checkpointed, or the rows dealt by one reading would meet the sums of ranges of another.
    """
    cuts = cut(counts.groupBy(group).agg(F.percentile_approx(p, [k / RANGES for k in range(1, RANGES)], 10_000).alias("_cuts")))
    dealt = counts.join(F.broadcast(cuts), group)  # one row a group
    return dealt.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(p)))).drop("_cuts")


def running_counts(counts: DataFrame, p: str, group: str) -> DataFrame:
    """(group, p, k) with _range, _upto (the rows of the group up to and with p) and _n (all of the group).

    Windows stay within ranges; sums of whole ranges, at most RANGES rows a group, are added to them.
    """
    dealt = ranged(counts, p, group)
    order = W.partitionBy(group).orderBy("_range")
    sums = dealt.groupBy(group, "_range").agg(F.sum("k").alias("_own"))
    before = sums.select(group, "_range", (F.sum("_own").over(order) - F.col("_own")).alias("_before"), F.sum("_own").over(W.partitionBy(group)).alias("_n"))
    up = W.partitionBy(group, "_range").orderBy(p).rowsBetween(W.unboundedPreceding, 0)
    return dealt.withColumn("_upto", F.sum("k").over(up)).join(F.broadcast(before), [group, "_range"]).withColumn("_upto", F.col("_upto") + F.col("_before")).drop("_before")


def selected(rows: DataFrame, value: str, group: str, at: Callable[[Column], Column] | DataFrame) -> DataFrame:
    """(group, _at, value, _below, _n) of the values at stated places of each group's order, counted from 0.

    ``at`` makes an array of places from the group's number of rows, or is a table (group, _at); _below is the number of
    smaller values. Rows are counted by range; only the ranges that hold a place are then sorted. ``rows`` is read three
    times: checkpoint it.
    """
    dealt = ranged(rows.filter(F.col(value).isNotNull()), value, group)
    order = W.partitionBy(group).orderBy("_range")
    sums = dealt.groupBy(group, "_range").agg(F.count("*").alias("_own"))
    sums = sums.select(group, "_range", "_own", (F.sum("_own").over(order) - F.col("_own")).alias("_before"), F.sum("_own").over(W.partitionBy(group)).alias("_n"))
    placed = sums.join(at, group) if isinstance(at, DataFrame) else sums.withColumn("_at", F.explode(F.array_distinct(at(F.col("_n")))))
    want = placed.filter((F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_own")))
    inside = dealt.join(want.select(group, "_range").distinct(), [group, "_range"]).groupBy(group, "_range", value).agg(F.count("*").alias("_k"))
    upto = F.sum("_k").over(W.partitionBy(group, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    found = inside.withColumn("_upto", upto).join(want, [group, "_range"])
    below = F.col("_before") + F.col("_upto") - F.col("_k")
    return found.filter((below <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_upto"))).select(group, "_at", value, below.alias("_below"), "_n")


def quantiles(rows: DataFrame, value: str, group: str, shares: Sequence[float]) -> DataFrame:
    """(group, q0, q1, ...): exact quantiles, linear between the two values around a place. Nulls don't count."""
    place = lambda q: F.lit(float(q)) * (F.col("_n") - 1)
    found = selected(rows, value, group, lambda n: F.flatten(F.array(*(F.array(F.floor(F.lit(float(q)) * (n - 1)), F.ceil(F.lit(float(q)) * (n - 1))) for q in shares))))
    value_at = lambda c: F.max(F.when(F.col("_at") == c, F.col(value)))
    n = found.groupBy(group, "_n")
    both = n.agg(*(value_at(f(place(q))).alias(f"_{side}{i}") for i, q in enumerate(shares) for side, f in (("low", F.floor), ("high", F.ceil))))
    return both.select(group, *((F.col(f"_low{i}") + (place(q) - F.floor(place(q))) * (F.col(f"_high{i}") - F.col(f"_low{i}"))).alias(f"q{i}") for i, q in enumerate(shares)))


def bh_adjust(df: DataFrame, p: str, q: str, strict: bool = False) -> DataFrame:
    """Adds Benjamini-Hochberg q-values of ``p`` over all rows. ``strict``: values outside [0, 1] are an error."""
    if strict:
        bad = df.filter(F.col(p).isNull() | F.isnan(p) | ~F.col(p).between(0, 1)).limit(1).collect()
        if bad:
            raise ValueError(f"p-values outside [0, 1]: {bad}")
    return bh_columns(df, {p: q})


def _safe(p: str) -> Column:
    return F.when(F.abs(p) < float("inf"), clip(F.col(p), 0.0, 1.0)).otherwise(F.lit(1.0))


def bh_columns(df: DataFrame, names: dict[str, str], key: str | None = None) -> DataFrame:
    """Adds q-values of several columns: one pass over (column, p) pairs.

    Values that aren't finite count as 1 and all are clipped to [0, 1]; ties get the same value. With a unique ``key`` the
    q-values come back by one join on it, else by one join on p for each column.
    """
    pairs = F.inline(F.array(*(F.struct(F.lit(q).alias("_name"), _safe(p).alias("_p")) for p, q in names.items())))
    if key is None:
        q = _step_up(df.select(pairs))
        out = df
        for p, name in names.items():
            out = out.withColumn("_p", _safe(p)).join(q.filter(F.col("_name") == name).select("_p", F.col("_q").alias(name)), "_p").drop("_p")
        return out
    long = df.select(key, pairs)
    found = long.join(_step_up(long), ["_name", "_p"]).groupBy(key).agg(*(F.max(F.when(F.col("_name") == q, F.col("_q"))).alias(q) for q in names.values()))
    return df.join(found, key)


def _step_up(values: DataFrame) -> DataFrame:
    """(_name, _p, _q) of the distinct values of each name."""
    counts = running_counts(values.groupBy("_name", "_p").agg(F.count("*").alias("k")), "_p", "_name")
    raw = counts.withColumn("_raw", F.col("_p") * F.col("_n").cast("double") / F.col("_upto"))
    lowest = raw.groupBy("_name", "_range").agg(F.min("_raw").alias("_low"))
    later = lowest.select("_name", "_range", F.min("_low").over(W.partitionBy("_name").orderBy("_range").rowsBetween(1, W.unboundedFollowing)).alias("_later"))
    # From the largest down: a frame that ends with the partition would be added up anew for every row.
    down = W.partitionBy("_name", "_range").orderBy(F.desc("_p")).rowsBetween(W.unboundedPreceding, 0)
    q = F.least(F.min("_raw").over(down), "_later", F.lit(1.0))  # nulls are skipped
    return raw.join(F.broadcast(later), ["_name", "_range"]).select("_name", "_p", q.alias("_q"))


def rank_normal(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Adds the inverse-normal transform of the average ranks of several columns, each from the same input.

    Nulls stay null and don't count. Ranks are running sums over distinct values, within ranges of them.
    """
    value = lambda c: F.when(F.isnan(c), None).otherwise(F.col(c)).cast("double")
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("_name"), value(c).alias("_v")) for c in names)))).dropna()
    ranks = running_counts(long.groupBy("_name", "_v").agg(F.count("*").alias("k")), "_v", "_name")
    ranks = ranks.withColumn("_rank", F.col("_upto") - (F.col("k") - 1) / 2)
    out = df
    for c, name in names.items():
        own = ranks.filter(F.col("_name") == c).select("_v", norm_ppf(clip((F.col("_rank") - 0.5) / F.col("_n"), 1e-12, 1 - 1e-12)).alias(name))
        out = out.withColumn("_v", value(c)).join(own, "_v", "left").drop("_v")
    return out


def lambda_gc(rows: DataFrame, p: str, group: str) -> DataFrame:
    """(group, lambda_gc): median chi-square over its expectation, of p-values in (0, 1].

    Chi-square falls as p rises, so the two p-values in the middle tell it; no other is transformed.
    """
    valid = cut(rows.filter((F.col(p) > 0) & (F.col(p) <= 1)).select(group, F.col(p).alias("_v")))
    middle = selected(valid, "_v", group, lambda n: F.array(F.floor((n - 1) / 2), F.ceil((n - 1) / 2)))
    chi = cut(middle.select(group, "_v")).select(group, chi2_1_isf(F.col("_v")).alias("_chi"))
    return chi.groupBy(group).agg((F.avg("_chi") / CHI2_1_MEDIAN).alias("lambda_gc"))


def scan_summary(scan: DataFrame, keys: list[str], p: str, fdr: float = 0.10) -> DataFrame:
    """By group of ``keys``: n, lambda_gc, minimum_p and fdr_significant, the rows with a q-value below ``fdr``.

    p-values are clipped to [1e-300, 1], and 1 where they aren't finite; groups are few, their rows many.
    """
    d = cut(scan.select(*keys, F.to_json(F.struct(*keys)).alias("_name"), clip(_safe(p), TINY, 1.0).alias("_p")))
    found = d.join(_step_up(d).filter(F.col("_q") < fdr), ["_name", "_p"]).groupBy("_name").agg(F.count("*").alias("_hits"))
    whole = d.groupBy("_name", *keys).agg(F.count("*").alias("n"), F.min("_p").alias("minimum_p"))
    return whole.join(lambda_gc(d, "_p", "_name"), "_name", "left").join(found, "_name", "left").withColumn("fdr_significant", F.coalesce("_hits", F.lit(0))).drop("_name", "_hits")


def top_k(df: DataFrame, p: str, k: int, key: str = "variant_index") -> DataFrame:
    """The k rows of smallest p, ties by key; nulls last. A take of the ordered rows, not a sort of all."""
    return df.orderBy(F.col(p).asc_nulls_last(), F.col(key)).limit(k)


def share_count(n: int, fraction: float) -> int:
    """k of a top fraction: rounded half to even, one at least."""
    return max(1, round(n * fraction))


def _share_counts(n: Column, fractions: Sequence[float]) -> list[Column]:
    """share_count of a column."""
    return [F.greatest(F.lit(1), F.rint(n * F.lit(float(f))).cast("long")) for f in fractions]


def top_limits(rows: DataFrame, group: str, p: str, fractions: Sequence[float], key: str) -> DataFrame:
    """(group, k0, edge0, last0, k1, ...), a row a group: a row is in the top share i if its p is below edge i, or equal
    to it and its key at most last i. Nulls count as infinite.

    The value at the share's end is selected, and where it ties, the key at the place that is left for the tied.
    """
    rows = cut(rows.select(group, _or_infinite(p).alias("_v"), F.col(key).alias("_key")))
    ends = cut(selected(rows, "_v", group, lambda n: F.array(*(k - 1 for k in _share_counts(n, fractions)))).withColumn("_tie", F.concat_ws(":", group, "_at")))
    tied = rows.join(ends.select(group, "_v", "_tie"), [group, "_v"]).select("_tie", "_key")
    last = selected(cut(tied), "_key", "_tie", ends.select("_tie", (F.col("_at") - F.col("_below")).alias("_at"))).select("_tie", F.col("_key").alias("_last"))
    found = ends.join(last, "_tie").groupBy(group, "_n")
    ks = _share_counts(F.col("_n"), fractions)
    out = found.agg(*(F.max(F.when(F.col("_at") == k - 1, F.col(c))).alias(f"{name}{i}") for i, k in enumerate(ks) for c, name in (("_v", "edge"), ("_last", "last"))))
    return out.select(group, *(k.alias(f"k{i}") for i, k in enumerate(ks)), *(f"{name}{i}" for i in range(len(fractions)) for name in ("edge", "last")))


def _or_infinite(p: str) -> Column:
    return F.coalesce(F.col(p).cast("double"), F.lit(float("inf")))


def jaccard_by(df: DataFrame, group: str, a: str, b: str, fractions: Sequence[float], key: str = "variant_index") -> DataFrame:
    """Of each group's top lists by two columns: group, top_fraction, k, overlap, jaccard. ``key`` is a number that
    doesn't repeat within a group; groups are few. Whether a row is in a list follows from the list's limits alone."""
    out = df
    for side, c in (("a", a), ("b", b)):
        limits = top_limits(df, group, c, fractions, key)
        out = out.join(F.broadcast(limits.select(group, *(F.col(x).alias(f"_{side}_{x}") for x in limits.columns if x != group))), group)
    inside = lambda side, c, i: (_or_infinite(c) < F.col(f"_{side}_edge{i}")) | ((_or_infinite(c) == F.col(f"_{side}_edge{i}")) & (F.col(key) <= F.col(f"_{side}_last{i}")))
    counts = out.groupBy(group).agg(*(F.first(f"_a_k{i}").alias(f"k{i}") for i in range(len(fractions))), *(F.count_if(inside("a", a, i) & inside("b", b, i)).alias(f"n{i}") for i in range(len(fractions))))
    rows = F.array(*(F.struct(F.lit(float(f)).alias("top_fraction"), F.col(f"k{i}").cast("int").alias("k"), F.col(f"n{i}").alias("overlap")) for i, f in enumerate(fractions)))
    return counts.select(group, F.inline(rows)).withColumn("jaccard", F.col("overlap") / (2 * F.col("k") - F.col("overlap")))


def jaccard_top(df: DataFrame, a: str, b: str, fractions: Sequence[float], key: str = "variant_index") -> DataFrame:
    """Of the top lists of all rows by two columns: top_fraction, k, overlap, jaccard."""
    return jaccard_by(df.select(F.lit("").alias("_g"), key, a, b), "_g", a, b, fractions, key).drop("_g")


def qq_points(df: DataFrame, p: str, key: str = "variant_index") -> DataFrame:
    """Expected and observed -log10 p in order, for a plot. Ties are ordered by key.

    p-values are clipped to [1e-300, 1], so those of 0 keep their place; what is null or not a number is left out.
    """
    d = df.filter(F.col(p).isNotNull() & ~F.isnan(p)).select(key, clip(F.col(p), TINY, 1.0).alias("_p"))
    ordered = numbered(d, [F.col("_p"), F.col(key)], "_i")
    n = ordered.count()
    return ordered.select(key, (-F.log10((F.col("_i") + 0.5) / F.lit(float(max(n, 1))))).alias("expected"), neglog10(F.col("_p")).alias("observed"))


def candidate_set(df: DataFrame, p: str, q: str | None = None, fdr: float | None = None, p_max: float | None = None, fallback: int | None = None, key: str = "variant_index") -> tuple[DataFrame, str]:
    """Rows with q < fdr, or else p <= p_max; where there are none, the ``fallback`` rows of smallest p. And which it was."""
    found, rule = df.limit(0), "none"
    if q is not None and fdr is not None:
        found, rule = df.filter(F.col(q) < fdr), f"{q} < {fdr}"
    elif p_max is not None:
        found, rule = df.filter(F.col(p) <= p_max), f"{p} <= {p_max}"
    if fallback and found.isEmpty():
        return top_k(df, p, fallback, key), f"fallback top {fallback} by {p}"
    return found, rule


def leads_by_bin(df: DataFrame, p: str, q: str, fdr: float, bin_kb: int) -> DataFrame:
    """The row of smallest p of each bin among those with q < fdr, numbered by p."""
    d = df.filter(F.col(q) < fdr).withColumn("_bin", F.expr(f"pos div {bin_kb * 1000}"))
    best = d.groupBy("CHR", "_bin").agg(F.min_by(F.struct("variant_index", "snp", "pos", p, q), F.struct(p, "variant_index")).alias("_x")).select("CHR", "_x.*")
    out = numbered(best, [F.col(p), F.col("variant_index")], "_number")
    return out.select((F.col("_number") + 1).alias("lead_rank"), F.col("variant_index").alias("lead_variant_index"), F.col("snp").alias("lead_snp"), "CHR", "pos", p, q)


def thinned_markers(df: DataFrame, bin_kb: int, most: int) -> DataFrame:
    """One marker a bin, the most complete one, then that of the largest MAF, then the first; evenly thinned to ``most``."""
    d = df.withColumn("thin_bin", F.expr(f"pos div {bin_kb * 1000}"))
    best = W.partitionBy("CHR", "thin_bin").orderBy(F.col("missing_rate").asc_nulls_last(), F.coalesce("MAF", F.lit(0.0)).desc(), "pos", "variant_index")
    d = d.withColumn("_rn", F.row_number().over(best)).filter("_rn = 1").drop("_rn")
    n = d.count()
    if n <= most:
        return d
    # Row r (from 0) is taken if some j < most has floor(j * (n - 1) / (most - 1)) = r.
    step = F.lit(n - 1) / F.lit(max(most - 1, 1))
    return numbered(d, [F.col("CHR"), F.col("pos"), F.col("variant_index")], "_r").filter(F.floor(F.ceil(F.col("_r") / step) * step) == F.col("_r")).drop("_r")
