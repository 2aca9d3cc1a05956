"""Field-plot phenotypes: canonical table, adjusted means, trait tables, populations."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions.stats import close
from locusframe.functions.text import normalize_id, slugify, stratum
from locusframe.operators.guards import cut, require, summed
from locusframe.operators.numbering import numbered
from locusframe.operators.ranking import rank_normal

#: Strata that a model may have; columns of a design that is solved as a whole.
STRATA, WHOLE = 2_000, 3_000
#: Models that are fitted at a time.
MODELS = 5


def disease_flags(plots: DataFrame) -> DataFrame:
    """Adds DiseasePresent and the three zero patterns; a comparison with null is false."""
    i, s = F.col("INC"), F.col("SEV")
    flags = {"DiseasePresent": i > 0, "INC_zero_SEV_zero": (i == 0) & (s == 0), "INC_zero_SEV_positive": (i == 0) & (s > 0), "INC_positive_SEV_zero": (i > 0) & (s == 0)}
    return plots.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})


def corrections(plots: DataFrame) -> DataFrame:
    """Adds INC_correction, SEV_correction and CorrectionFlag from values and their sources."""
    d = plots.withColumn("INC_correction", F.col("INC") - F.col("INC_raw_source")).withColumn("SEV_correction", F.col("SEV") - F.col("SEV_raw_source"))
    changed = lambda c: F.abs(F.coalesce(c, F.lit(0.0))) > 1e-12
    return d.withColumn("CorrectionFlag", changed("INC_correction") | changed("SEV_correction"))


def align_by_position(raw: DataFrame, corrected: DataFrame, order: Sequence[str], ids_alike: float = 0.99) -> DataFrame:
    """Joins the rows of two sources that share no key by their order, after rows without both values are dropped.

    ``order`` names the columns that give the order in both. Locations and incidences must agree in every row, ids in
    99 % of them; else it stops.
    """
    by = [F.col(c) for c in order]
    a = numbered(raw.dropna(subset=["INC_raw_source", "SEV_raw_source"]), by, "_at").drop(*order)
    b = numbered(corrected.dropna(subset=["INC", "SEV"]), by, "_at").select("_at", F.col("Location").alias("_location"), "Cultivar", "ID_std", "INC", "SEV")
    both = a.join(b, "_at", "full")
    checks = both.agg(
        F.count_if(F.col("INC_raw_source").isNull() | F.col("INC").isNull()).alias("lone"),
        F.count_if(F.col("Location") != F.col("_location")).alias("place"),
        F.count_if(~close(F.col("INC_raw_source"), F.col("INC"))).alias("value"),
        F.avg((normalize_id(F.col("Cultivar_raw")) == F.col("ID_std")).cast("double")).alias("ids"),
    ).first()
    require(checks["lone"] == 0, f"{checks['lone']} rows without a partner")
    require(checks["place"] == 0 and checks["value"] == 0, f"rows that differ: {checks['place']} in location, {checks['value']} in incidence")
    require(checks["ids"] is None or checks["ids"] >= ids_alike, f"ids agree in {checks['ids']} of the rows")
    return corrections(both.drop("_location", "_at"))


def canonical_plots(aligned: DataFrame) -> DataFrame:
    return disease_flags(aligned.withColumn("Stratum", stratum(F.col("Location"), F.col("Rep"), F.col("Block"))))


def without_sources(corrected: DataFrame) -> DataFrame:
    """Canonical plots where the field books are missing: plots numbered in order, nothing corrected."""
    d = corrected.withColumn("Cultivar_raw", F.col("Cultivar")).withColumn("INC_raw_source", F.col("INC")).withColumn("SEV_raw_source", F.col("SEV"))
    d = d.withColumn("Rep", F.lit(None).cast("bigint")).withColumn("Block", F.lit(None).cast("bigint")).withColumn("Plants", F.lit(None).cast("double"))
    d = numbered(cut(d.withColumn("_row", F.monotonically_increasing_id())), [F.col("_row")], "_number")
    return canonical_plots(corrections(d.withColumn("Plot", (F.col("_number") + 1).cast("double")).drop("_row", "_number")))


def plot_report(plots: DataFrame) -> DataFrame:
    return plots.agg(
        F.count("*").alias("rows"), F.countDistinct("ID_std").alias("ids"), F.countDistinct("Location").alias("locations"), F.countDistinct("Stratum").alias("strata"),
        *(F.count_if(F.col(c)).alias(c) for c in ("INC_zero_SEV_zero", "INC_zero_SEV_positive", "INC_positive_SEV_zero")), F.sort_array(F.collect_set("SEV")).alias("severities"),
    )


@dataclass(frozen=True)
class Cells:
    """Plots summed by id, stratum, other columns and which of the values a plot has: n, and of each value its mean and
    plain sum and number, of each two of them the products of deviations from the cell's means (c0_0, c0_1, ...)."""

    rows: DataFrame
    names: tuple[str, ...]


def cells_of(plots: DataFrame, names: Sequence[str], by: Sequence[Column | str] = ()) -> Cells:
    """Checkpointed, so that the plots are read once, however many models are fitted of them. NaN counts as missing, but
    for the plain sums."""
    x = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in names]
    d = plots.select(F.col("ID_std").cast("string").alias("ID_std"), F.col("Stratum").cast("string").alias("Stratum"), *by, *(F.col(c).alias(f"v{i}") for i, c in enumerate(names)), *(v.alias(f"x{i}") for i, v in enumerate(x)))
    d = d.withColumns({f"has{i}": F.col(f"x{i}").isNotNull() for i in range(len(names))})
    keys = [c for c in d.columns if c not in {f"{k}{i}" for k in "vx" for i in range(len(names))}]
    products = {f"c{i}_{j}": F.covar_pop(f"x{i}", f"x{j}") * F.count("*") for i in range(len(names)) for j in range(i, len(names))}
    values = [f(f"{of}{i}").alias(f"{k}{i}") for i in range(len(names)) for k, of, f in (("m", "x", F.avg), ("sum", "v", F.sum), ("count", "v", F.count))]
    return Cells(cut(d.groupBy(*keys).agg(F.count("*").alias("n"), *values, *(c.alias(k) for k, c in products.items()))), tuple(names))


def adjusted_means(plots: DataFrame, value: str, covariates: Sequence[str] = (), prefix: str | None = None) -> DataFrame:
    """Least-squares means of ids of plots, see fitted_means."""
    return fitted_means(cells_of(plots, [value, *covariates]), value, covariates, prefix)


def fitted_means(cells: Cells, value: str, covariates: Sequence[str] = (), prefix: str | None = None, where: Column | None = None) -> DataFrame:
    """Least-squares means of ids: value ~ id + stratum + covariates, every stratum with equal weight.

    Ids are absorbed: what is solved is their Schur complement, of the size of strata and covariates, and an id's mean and
    error follow from its own sums. Ids, however many, stay in Spark; their sums are added up by task. Where ids and
    strata fall apart into groups that share no stratum, the means aren't estimable one by one, and the minimum-norm
    solution of all dummies is taken, for a design of at most WHOLE columns. Covariates are centred on the rows used.
    ``where``: the cells whose plots are used, if not all that have the values.
    """
    prefix = prefix or value
    names = [value, *covariates]
    own = [cells.names.index(c) for c in names]
    complete = reduce(lambda a, b: a & b, (F.col(f"has{i}") for i in own), F.col("ID_std").isNotNull() & F.col("Stratum").isNotNull())
    used = cells.rows.filter(complete if where is None else complete & where)
    xs = [f"x{i}" for i in range(len(names))]
    n, n_ids, *totals = used.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_distinct("ID_std"), *(F.sum(F.col("n") * F.col(f"m{i}")) for i in own)).first()
    centre = [t / n if n else 0.0 for t in totals]
    strata = sorted(r["Stratum"] for r in used.select("Stratum").distinct().limit(STRATA + 1).collect())
    require(len(strata) <= STRATA, f"{value}: more than {STRATA} strata")
    require(n_ids >= 10 and n > n_ids + len(strata), f"{value}: {n_ids} ids, {len(strata)} strata and {n} rows don't suffice")
    off = [F.col(f"m{i}") - F.lit(m) for i, m in zip(own, centre, strict=True)]
    pairs = [(a, b) for k, a in enumerate(xs) for b in xs[k:]]
    within = {(a, b): F.col("c{}_{}".format(*sorted((own[int(a[1:])], own[int(b[1:])])))) for a, b in pairs}
    used = used.select("ID_std", "Stratum", "n", *((F.col("n") * d).alias(x) for x, d in zip(xs, off, strict=True)), *((within[a, b] + F.col("n") * off[int(a[1:])] * off[int(b[1:])]).alias(f"{a}_{b}") for a, b in pairs))
    by_stratum = {r["Stratum"]: r for r in used.groupBy("Stratum").agg(F.sum("n").alias("n"), *(F.sum(x).alias(x) for x in xs), *(F.sum(f"{a}_{b}").alias(f"{a}_{b}") for a, b in pairs)).collect()}
    product = {p: sum(r[f"{a}_{b}"] for r in by_stratum.values()) for a, b in pairs for p in ((a, b), (b, a))}
    # The nuisance columns: strata but the first, then covariates.
    k, c = len(strata) - 1, len(covariates)
    inner, toward = np.zeros((k + c, k + c)), np.zeros(k + c)
    for j, name in enumerate(strata[1:]):
        row = by_stratum[name]
        inner[j, j], toward[j] = row["n"], row["x0"]
        inner[j, k:] = inner[k:, j] = [row[x] for x in xs[1:]]
    for j, a in enumerate(xs[1:]):
        toward[k + j] = product[a, "x0"]
        inner[k + j, k:] = [product[a, b] for b in xs[1:]]
    summed_up = used.groupBy("ID_std", "Stratum").agg(F.sum("n").alias("n"), *(F.sum(x).alias(x) for x in xs))
    by_id = cut(summed_up.groupBy("ID_std").agg(F.collect_list("Stratum").alias("strata"), F.collect_list("n").alias("counts"), F.sum("n").alias("n"), *(F.sum(x).alias(x) for x in xs)))
    at = {name: j - 1 for j, name in enumerate(strata)}

    def means(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, mean of the value and means of the nuisance columns of each id."""
        rows, size = batch.num_rows, batch.column("n").to_numpy().astype(float)
        out = np.zeros((rows, k + 1 + c))
        lists, counts = batch.column("strata"), batch.column("counts").flatten().to_numpy()
        where = np.array([at[x] for x in lists.flatten().to_pylist()], int)  # the first stratum is -1, the column that goes
        out[np.repeat(np.arange(rows), np.diff(lists.offsets.to_numpy())), np.where(where < 0, k, where)] = counts
        for j, x in enumerate(xs[1:]):
            out[:, k + 1 + j] = batch.column(x).to_numpy()
        return size, batch.column("x0").to_numpy() / size, np.delete(out, k, axis=1) / size[:, None]

    def absorbed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + c + 1, k + c + 1))
        for batch in batches:
            size, y, b = means(batch)
            z = np.column_stack((b, y)) * np.sqrt(size)[:, None]
            total += z.T @ z
        for row in range(len(total)):
            yield pa.record_batch([pa.array([row], pa.int32()), pa.array([total[row].tobytes()], pa.binary()), pa.array([0.0])], ["row", "sums", "trace"])

    schema = "row int, sums binary, trace double"
    lost = by_id.mapInArrow(absorbed, schema).groupBy("row").applyInArrow(summed(["row"]), schema).collect()
    own = np.vstack([np.frombuffer(r["sums"]) for r in sorted(lost, key=lambda r: r["row"])])
    schur, right = inner - own[:-1, :-1], toward - own[:-1, -1]
    values, vectors = np.linalg.eigh(schur) if k + c else (np.zeros(0), np.zeros((0, 0)))
    if k + c and values[0] <= 1e-10 * max(float(np.diag(inner).max()), 1e-300):
        require(n_ids + len(strata) + c <= WHOLE, f"{value}: ids and strata fall apart, and {n_ids} ids are too many for one matrix")
        return _whole_design(summed_up, names, centre[0], product, prefix)
    inverse = (vectors / values) @ vectors.T
    gamma = inverse @ right
    df = max(n - n_ids - k - c, 1)
    sigma2 = max(product["x0", "x0"] - own[-1, -1] - right @ gamma, 0.0) / df
    even = np.concatenate((np.full(k, 1 / (k + 1)), np.zeros(c)))
    rank, middle = n_ids + k + c, centre[0]

    def estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, y, b = means(batch)
            off = b - even
            error = np.sqrt(np.maximum(sigma2 * (1 / size + ((off @ inverse) * off).sum(axis=1)), 0))
            columns = [batch.column("ID_std"), pa.array(middle + y - off @ gamma), pa.array(error), batch.column("n"), *(pa.array(np.full(len(size), x, np.int64)) for x in (rank, df))]
            yield pa.record_batch(columns, ["ID_std", "estimate", "se", "n", "rank", "df"])

    found = by_id.mapInArrow(estimates, "ID_std string, estimate double, se double, n long, rank long, df long")
    return found.toDF("ID_std", *_means_columns(prefix))


def _means_columns(prefix: str) -> list[str]:
    return [f"{prefix}_ADJ_RAW", f"{prefix}_ADJ_RAW_LSM_SE", f"{prefix}_ADJ_RAW_N_PLOTS", f"{prefix}_RANK", f"{prefix}_DF"]


def _whole_design(cells: DataFrame, names: Sequence[str], centre: float, product: dict[tuple[str, str], float], prefix: str) -> DataFrame:
    """The minimum-norm solution of a small design of all dummies, from sums by id and stratum of centred values.

    Centring the value moves the intercept, so the minimum norm is that of the value as it is.
    """
    rows = cells.toPandas()
    ids, strata = sorted(rows["ID_std"].unique()), sorted(rows["Stratum"].unique())
    c, n = len(names) - 1, int(rows["n"].sum())
    width = len(ids) + len(strata) - 1 + c
    id_at, stratum_at = ({v: j for j, v in enumerate(x)} for x in (ids, strata))
    xtx, xty = np.zeros((width, width)), np.zeros(width)
    xs = [f"x{i}" for i in range(1, c + 1)]
    for r in rows.to_dict("records"):
        i, s = id_at[r["ID_std"]], stratum_at[r["Stratum"]]
        fixed = [0] + ([i] if i else []) + ([len(ids) - 1 + s] if s else [])
        xtx[np.ix_(fixed, fixed)] += r["n"]
        xty[fixed] += r["x0"] + r["n"] * centre
        for j, x in enumerate(xs):
            xtx[fixed, width - c + j] += r[x]
            xtx[width - c + j, fixed] += r[x]
    for j, x in enumerate(xs):
        xty[width - c + j] = product[x, "x0"]
        xtx[width - c + j, width - c :] = [product[x, z] for z in xs]
    inverse = np.linalg.pinv(xtx, rcond=1e-12, hermitian=True)
    rank = int(np.linalg.matrix_rank(xtx, tol=1e-10 * np.abs(xtx).max(), hermitian=True))
    beta, df = inverse @ xty, max(n - rank, 1)
    sigma2 = max(product["x0", "x0"] + n * centre**2 - xty @ beta, 0.0) / df
    contrast = np.zeros((len(ids), width))
    contrast[:, 0] = 1
    contrast[np.arange(1, len(ids)), np.arange(1, len(ids))] = 1
    contrast[:, len(ids) : len(ids) + len(strata) - 1] = 1 / len(strata)
    se = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", contrast, inverse, contrast) * sigma2, 0))
    count = rows.groupby("ID_std")["n"].sum()
    out = [(v, float(e), float(s), int(count[v]), rank, df) for v, e, s in zip(ids, contrast @ beta, se, strict=True)]
    kinds = ("double", "double", "long", "long", "long")
    return cells.sparkSession.createDataFrame(out, "ID_std string, " + ", ".join(f"{c} {t}" for c, t in zip(_means_columns(prefix), kinds, strict=True)))


def simple_means(plots: DataFrame) -> DataFrame:
    return plots.groupBy("ID_std").agg(F.avg("INC").alias("INC_SIMPLE_RAW"), F.avg("SEV").alias("SEV_SIMPLE_RAW"), F.count("*").alias("N_PLOTS_TOTAL"), F.countDistinct("Location").alias("N_LOCATIONS"))


def accession_traits(plots: DataFrame) -> DataFrame:
    """Adjusted INC, SEV, SEV of diseased plots and SEV given INC, simple means, and the inverse-normal form of each."""
    cells = cells_of(plots, ("INC", "SEV"), ["Location", F.coalesce(F.col("INC") > 0, F.lit(False)).alias("positive")])
    mean = lambda i: F.try_divide(F.sum(f"sum{i}"), F.sum(f"count{i}"))
    out = cells.rows.groupBy("ID_std").agg(mean(0).alias("INC_SIMPLE_RAW"), mean(1).alias("SEV_SIMPLE_RAW"), F.sum("n").alias("N_PLOTS_TOTAL"), F.countDistinct("Location").alias("N_LOCATIONS"))
    models = {"INC": ("INC", (), None), "SEV": ("SEV", (), None), "SEV_POS": ("SEV", (), F.col("positive")), "SEV_COND": ("SEV", ("INC",), None)}
    # The models are independent, and each waits for several small jobs.
    with ThreadPoolExecutor(len(models)) as pool:
        fitted = list(pool.map(lambda m: fitted_means(cells, m[1][0], m[1][1], m[0], m[1][2]).drop(f"{m[0]}_RANK", f"{m[0]}_DF"), models.items()))
    for own in fitted:
        out = out.join(own, "ID_std", "left")
    raw = ("INC_ADJ_RAW", "SEV_ADJ_RAW", "SEV_POS_ADJ_RAW", "SEV_COND_ADJ_RAW", "INC_SIMPLE_RAW", "SEV_SIMPLE_RAW")
    return rank_normal(cut(out), {c: c.replace("_RAW", "_INT") for c in raw})


def omission_traits(plots: DataFrame, locations: Sequence[str]) -> DataFrame:
    """Adjusted INC, SEV and conditional SEV without one location at a time, inverse-normal.

    The plots are read once, into cells; the models are independent and fitted MODELS at a time, and their means meet in
    one pivot with known names.
    """
    cells = cells_of(plots, ("INC", "SEV"), ["Location"])
    values = {"INC": ("INC", ()), "SEV": ("SEV", ()), "SEV_COND": ("SEV", ("INC",))}
    wanted = [(place, name) for place in locations for name in values]
    column = lambda m: f"{m[1]}_LOO_{slug(m[0])}"

    def fit(m: tuple[str, str]) -> DataFrame:
        own = fitted_means(cells, *values[m[1]], "X", F.col("Location") != m[0])
        return own.select("ID_std", F.lit("_" + column(m)).alias("_model"), F.col("X_ADJ_RAW").alias("_mean"))

    with ThreadPoolExecutor(MODELS) as pool:
        means = reduce(DataFrame.unionByName, pool.map(fit, wanted))
    wide = means.groupBy("ID_std").pivot("_model", ["_" + column(m) for m in wanted]).agg(F.max("_mean"))
    out = cut(cells.rows.select("ID_std").distinct().join(wide, "ID_std", "left"))
    return rank_normal(out, {"_" + column(m): column(m) for m in wanted}).drop(*("_" + column(m) for m in wanted))


def slug(place: str) -> str:
    return re.sub(r"[^A-Za-z0-9]+", "_", place).strip("_").upper()


def location_traits(plots: DataFrame, locations: Sequence[str]) -> DataFrame:
    """Means and numbers of plots of each id by location, wide; the locations are known, so the pivot needs no scan."""
    wide = plots.groupBy("ID_std").pivot("Location", list(locations)).agg(F.avg("INC").alias("INC"), F.avg("SEV").alias("SEV"), F.count(F.lit(1)).alias("N"))
    return wide.toDF("ID_std", *(f"{v}_SITE_{slug(p)}" for p in locations for v in ("INC", "SEV", "N")))


def population(traits: DataFrame, ids: DataFrame, at_least: int) -> DataFrame:
    """Of the genotyped ids: numbers of locations and plots, eligibility and why not."""
    d = ids.select("ID_std").join(traits.select("ID_std", "N_LOCATIONS", "N_PLOTS_TOTAL"), "ID_std", "left").fillna(0, ["N_LOCATIONS", "N_PLOTS_TOTAL"])
    ok = F.col("N_LOCATIONS") >= at_least
    why = F.when(ok, "").when(F.col("N_LOCATIONS") == 0, "no phenotype").otherwise(F.format_string("%d of %d locations", F.col("N_LOCATIONS").cast("int"), F.lit(at_least)))
    return d.withColumn("PRIMARY_ELIGIBLE", ok).withColumn("EXCLUSION_REASON", why)


def in_order(table: DataFrame, ids: DataFrame, key: str = "ID_std") -> DataFrame:
    """Rows of ``table`` in the order of (sample_index, key) rows; stops where one is missing."""
    d = ids.join(table, key, "left").withColumn("_found", F.lit(True))
    lost = ids.join(table.select(key), key, "left_anti").limit(1).collect()
    require(not lost, f"no row for {lost}")
    return d.drop("_found").orderBy("sample_index")


def location_label(place):  # noqa: ANN001, ANN201
    return F.upper(slugify(place))
