"""Checks of cardinality and keys that stop a run instead of giving a wrong result."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def require_columns(df: DataFrame, names: set[str], what: str) -> None:
    missing = sorted(names - set(df.columns))
    require(not missing, f"{what}: missing columns {missing}")


def require_unique(df: DataFrame, key: str, what: str) -> None:
    """No null key and none twice; stops at the first found."""
    bad = df.groupBy(key).count().filter((F.col("count") > 1) | F.col(key).isNull()).limit(1).collect()
    require(not bad, f"{what}: {key} is null or repeats: {bad}")


def join_one_to_one(left: DataFrame, right: DataFrame, key: str, what: str) -> DataFrame:
    """Inner join in which every row of the left finds exactly one of the right. One job checks both sides."""
    sides = left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    counts = sides.groupBy(key).agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"))
    bad = counts.filter(F.col(key).isNull() | (F.col("n_left") > 1) | (F.col("n_right") > 1) | (F.col("n_right") < F.col("n_left"))).limit(1).collect()
    if bad:
        require(bad[0][key] is not None and max(bad[0]["n_left"], bad[0]["n_right"]) < 2, f"{what}: {key} is null or repeats: {bad}")
        require(False, f"{what}: no partner for {bad}")
    return left.join(right, key)


def expect(df: DataFrame, n: int, what: str) -> DataFrame:
    got = df.count()
    require(got == n, f"{what}: {got} rows instead of {n}")
    return df


def shared_folder(session: SparkSession) -> str:
    """The one of spark.checkpoint.dir; only a local session without it takes a temporary one."""
    folder = session.conf.get("spark.checkpoint.dir", None)
    require(bool(folder) or session.sparkContext.master.startswith("local"), "spark.checkpoint.dir must name a shared folder")
    return folder or f"file://{tempfile.mkdtemp(prefix='spark-')}"


def cut(df: DataFrame) -> DataFrame:
    """The rows, checkpointed: for one that several statistics read, so that its plan isn't repeated in theirs."""
    session = df.sparkSession
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(shared_folder(session))
    return df.checkpoint()


def summed(keys: list[str]) -> Callable[[pa.Table], pa.Table]:
    """For applyInArrow: adds the arrays ``sums``, doubles in bytes, and ``trace`` of a group, whose rows are as many as tasks."""

    def run(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in table.column("sums").to_pylist())
        named = {k: table.column(k)[:1] for k in keys}
        return pa.table(named | {"sums": pa.array([total.tobytes()], pa.binary()), "trace": pa.array([sum(table.column("trace").to_pylist())], pa.float64())})

    return run
