"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors are projected on leading principal axes, which only shortens distances, and laid on a grid as wide as the
join's radius. They are sorted by label and grid cells, cut into blocks, and blocks whose cells touch and whose boxes
are within the radius are joined: two sequence intervals are halved again and again, pairs of intervals with boxes
farther apart than the radius are skipped, short ones are compared by one matrix product in double precision. Each
pair of blocks gives a count of links for each vector and one link of it to the smallest vector that it reaches there,
never the pairs themselves.

Equal vectors of a label are one class with a number of its own, joined once and counted with its size; vec_ids only
name the results. The axes are fitted to a bounded sample; any
axes give the same result, good ones skip more.

Edge cases: vectors that are null, zero or hold null or non-finite components, and null labels, link with nothing;
vectors of different lengths link with nothing; rows that repeat a vec_id count as vectors of their own; a vector with a null vec_id
links like any other, names no component (null where no other vec_id is in it) and isn't kept; an empty table gives an
empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, rows_a_batch, table
from .components import components

COSINE = 0.93
#: Vectors that the axes are fitted to, at most about so many.
SAMPLE = 10_000
#: Leading axes: of the grid that orders, of the cells by which blocks meet, of the boxes.
GRID, MEET, BOX = 4, 3, 8
BLOCK, LEAF = 1024, 128
#: Coordinates of a cell, that lie within some tens of 0, as one number.
STRIDES = np.array([1 << 20 * k for k in range(MEET)], np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, by their largest component first, whose square may be beyond the range of doubles."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=np.finfo(np.float64).smallest_subnormal)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_axes(sample: np.ndarray) -> np.ndarray:
    """Axes as columns, those of the largest variance first."""
    if len(sample) < 2:
        return np.eye(sample.shape[1])
    u = unit(sample)
    u = u - u.mean(axis=0)
    return np.linalg.eigh(u.T @ u)[1][:, ::-1]


def axes_of(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Axes by length of vector, from a sample that a hash chooses."""
    n = vectors.count()
    draw = F.pmod(F.xxhash64("embedding"), F.lit(1 << 30)) / float(1 << 30)
    rows = vectors.filter(draw < min(1.0, SAMPLE / max(n, 1))).select("embedding").limit(2 * SAMPLE).collect()
    by_size: dict[int, list[list[float]]] = {}
    for (e,) in rows:
        by_size.setdefault(len(e), []).append(e)
    return {k: fit_axes(np.array(v, np.float64)) for k, v in by_size.items()}


def join_blocks(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, radius: float, cosine: float) -> np.ndarray:
    """Which vectors of two sequences are linked."""
    linked = np.zeros((len(a), len(b)), bool)
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        gap = np.maximum(0, np.maximum(pa_[i:j].min(axis=0) - pb[k:m].max(axis=0), pb[k:m].min(axis=0) - pa_[i:j].max(axis=0)))
        if gap @ gap > radius * radius:
            continue
        if max(j - i, m - k) <= LEAF:
            linked[i:j, k:m] = a[i:j] @ b[k:m].T >= cosine
        elif j - i >= m - k:
            todo += [(i, (i + j) // 2, k, m), ((i + j) // 2, j, k, m)]
        else:
            todo += [(i, j, k, (k + m) // 2), (i, j, (k + m) // 2, m)]
    return linked


def reached(linked: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each vector reaches by links between two sequences."""
    most = np.iinfo(np.int64).max
    la, lb = ids_a.copy(), ids_b.copy()
    while True:
        na = np.minimum(la, np.where(linked, lb, most).min(axis=1, initial=most))
        nb = np.minimum(lb, np.where(linked, na[:, None], most).min(axis=0, initial=most))
        if (na == la).all() and (nb == lb).all():
            return la, lb
        la, lb = na, nb


def _matrix(data: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(n, -1)


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of each (vec_id, embedding, label) row."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    radius = float(np.sqrt(2 - 2 * cosine)) + 1e-9
    # Floats stay floats, which is half the data; other numbers are taken as doubles.
    held_as, kind_of = ("float", np.float32) if dict(vectors.dtypes)["embedding"] == "array<float>" else ("double", np.float64)
    v = vectors.select("vec_id", F.col("embedding").cast(f"array<{held_as}>").alias("embedding"), "label")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0)
    classes = scratch.keep(v.filter(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight")).withColumn("rep", F.monotonically_increasing_id()), "vectors")
    axes = spark.sparkContext.broadcast(axes_of(classes))

    def project(x: np.ndarray) -> np.ndarray:
        own = axes.value.get(x.shape[1])
        return unit(x) @ (np.eye(x.shape[1]) if own is None else own)[:, :BOX]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = batch.column("embedding")
            sizes = np.diff(e.offsets.to_numpy())
            flat = e.flatten().to_numpy()
            at = np.concatenate(([0], np.cumsum(sizes)))
            out = np.zeros((len(batch), GRID), np.int32)
            for k in np.unique(sizes):
                own = np.flatnonzero(sizes == k)
                c = np.floor(project(flat[at[own][:, None] + np.arange(k)]) / radius).astype(np.int32)[:, :GRID]
                out[own, : c.shape[1]] = c
            yield pa.record_batch([*(batch.column(c) for c in ("label", "embedding", "rep", "weight")), pa.array(sizes, pa.int32()), *(pa.array(out[:, k]) for k in range(GRID))], ["label", "embedding", "rep", "weight", "size", *(f"c{k}" for k in range(GRID))])

    types = dict(classes.dtypes)
    grid = ", ".join(f"c{k} int" for k in range(GRID))
    order = ["label", "size", *(f"c{k}" for k in range(GRID)), "rep"]
    laid = classes.mapInArrow(cells, f"label {types['label']}, embedding array<{held_as}>, rep {types['rep']}, weight long, size int, {grid}")
    # The ids in the order let a crowded cell be cut anywhere.
    laid = laid.repartitionByRange(*order).sortWithinPartitions(*order)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, kind = TaskContext.get().partitionId(), 0, None
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal made
            x = np.array([h[2] for h in held], kind_of)
            p = project(x)
            at = np.floor(np.pad(p, ((0, 0), (0, max(0, MEET - p.shape[1]))))[:, :MEET] / radius).astype(np.int64)
            code = np.unique(at @ STRIDES).tolist()
            row = [[v] for v in ((part << 32) + made, held[0][0], held[0][1], p.min(axis=0).tolist(), p.max(axis=0).tolist(), code, [h[3] for h in held], [h[4] for h in held], x.tobytes())]
            made += 1
            held.clear()
            return pa.record_batch([pa.array(row[0], pa.int64()), pa.array(row[1], kind), pa.array(row[2], pa.int32()), pa.array(row[3], pa.list_(pa.float64())), pa.array(row[4], pa.list_(pa.float64())), pa.array(row[5], pa.list_(pa.int64())), pa.array(row[6], pa.list_(pa.int64())), pa.array(row[7], pa.list_(pa.int64())), pa.array(row[8], pa.binary())], ["block", "label", "size", "lo", "hi", "cells", "ids", "weights", "data"])

        for batch in batches:
            kind = batch.schema.field("label").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("label", "size", "embedding", "rep", "weight")), strict=True):
                if held and (len(held) == BLOCK or held[0][:2] != row[:2]):
                    yield flush()
                held.append(row)
        if held:
            yield flush()

    table_of_blocks = scratch.keep(laid.mapInArrow(blocks, f"block long, label {types['label']}, size int, lo array<double>, hi array<double>, cells array<long>, ids array<long>, weights array<long>, data binary"), "blocks")
    box = table_of_blocks.select("block", "label", "size", "lo", "hi", "cells")
    side = lambda k: [F.col(c).alias(f"{c}_{k}") for c in ("block", "lo", "hi")]
    around = F.array(*(F.lit(int(np.dot(step, STRIDES))) for step in product((-1, 0, 1), repeat=MEET)))
    near = F.array_distinct(F.flatten(F.transform("cells", lambda c: F.transform(around, lambda d: c + d))))
    left = box.select("label", "size", *side("a"), F.explode("cells").alias("cell"))
    right = box.select("label", "size", *side("b"), F.explode(near).alias("cell"))
    gap = lambda x, y: F.zip_with(x, y, lambda p, q: F.greatest(F.lit(0.0), p - q))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)
    pairs = left.join(right, ["label", "size", "cell"]).filter(F.col("block_a") <= F.col("block_b"))
    pairs = pairs.filter(total(gap("lo_a", "hi_b")) + total(gap("lo_b", "hi_a")) <= radius * radius).select("block_a", "block_b").distinct()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                ia, ib, wa, wb = (np.array(row[c].as_py(), np.int64) for c in ("ids_a", "ids_b", "weights_a", "weights_b"))
                xa, xb = _matrix(row["data_a"].as_py(), len(ia), kind_of), _matrix(row["data_b"].as_py(), len(ib), kind_of)
                linked = join_blocks(unit(xa), unit(xb), project(xa), project(xb), radius, cosine)
                same = row["block_a"].as_py() == row["block_b"].as_py()
                if same:
                    np.fill_diagonal(linked, False)
                la, lb = reached(linked, ia, ib)
                ids, n, to = (ia, linked @ wb, la) if same else (np.concatenate((ia, ib)), np.concatenate((linked @ wb, wa @ linked)), np.concatenate((la, lb)))
                some = n > 0
                yield pa.record_batch([pa.array(ids[some]), pa.array(n[some]), pa.array(to[some])], ["rep", "n", "to"])

    data = lambda k: table_of_blocks.select(*(F.col(c).alias(f"{c}_{k}") for c in ("block", "ids", "weights", "data")))
    joined = pairs.join(data("a"), "block_a").join(data("b"), "block_b")
    with rows_a_batch(spark, 32):  # a row holds up to a megabyte
        found = scratch.keep(joined.mapInArrow(compare, "rep long, n long, to long"), "links")
    n_links = found.groupBy(F.col("rep").alias("c_rep")).agg(F.sum("n").alias("n"))
    labels = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")), scratch)
    scratch.drop("blocks")
    whole = v.withColumn("usable", usable).join(classes.withColumnRenamed("label", "k_label").withColumnRenamed("embedding", "k_embedding"), F.col("usable") & (F.col("label") == F.col("k_label")) & (F.col("embedding") == F.col("k_embedding")), "left")
    # The smallest vec_id of each component of classes; a class without links is its own.
    own = F.coalesce("component", "rep")
    ids = classes.join(labels, F.col("rep") == F.col("node"), "left").groupBy(own.alias("c_root")).agg(F.min("least").alias("c_least"))
    whole = whole.join(n_links, F.col("rep") == F.col("c_rep"), "left").join(labels, F.col("rep") == F.col("node"), "left").withColumn("root", own)
    whole = whole.join(ids, F.col("root") == F.col("c_root"), "left")
    component = F.when(F.col("rep").isNull(), F.col("vec_id")).otherwise(F.col("c_least"))
    return whole.select(
        "vec_id",
        (F.coalesce("weight", F.lit(1)) - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def op5_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
