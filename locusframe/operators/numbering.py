"""Numbers along one global order of several columns, without gathering the rows in one task."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .guards import cut


def numbered(df: DataFrame, order: list[Column], name: str, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """Adds ``name``, 0 to n - 1 in the order of the columns, which should tell all rows apart.

    Rows are dealt to ranges of the whole order and sorted within them; ``keep`` writes them, so that a lost executor
    can't deal them anew. A count for each range, one row a partition, then gives each its offset.
    """
    at = "_place"
    while at.lower() in {c.lower() for c in (*df.columns, name)}:
        at = f"_{at}"
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = keep(dealt.withColumn(at, F.monotonically_increasing_id()))  # the partition's number, then 33 bits within it
    part = F.shiftright(at, 33).cast("int")
    sizes = {r["part"]: r["count"] for r in rows.groupBy(part.alias("part")).count().collect()}
    before = list(accumulate((sizes.get(k, 0) for k in range(max(sizes, default=0) + 1)), initial=0))
    return rows.withColumn(name, F.get(F.lit(before), part) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at)
