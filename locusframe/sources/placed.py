"""One file of rows in order, written by all tasks at their own places."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators.guards import require


def write_rows(ordered: DataFrame, value: str, path: str, head: bytes = b"") -> int:
    """Writes the bytes of a column, row after row; returns the number of rows.

    ``ordered`` must keep its rows and their order when it's read twice, as the result of ``numbered`` does, whose
    partitions follow each other. Tasks first tell how many bytes they hold and then write them at their place in a file
    of a name of its own, in a folder that all executors share; a task that runs again writes the same. When all have
    reported, the file takes its name, in one step. The driver sees a row a task.
    """
    data = ordered.select(F.col(value).cast("binary").alias("value"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = total = 0
        for batch in batches:
            rows, total = rows + len(batch), total + sum(map(len, batch.column(0).to_pylist()))
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total]), pa.array([rows])], ["part", "bytes", "rows"])

    found = sorted(tuple(r) for r in data.mapInArrow(sizes, "part int, bytes long, rows long").collect())
    starts = dict(zip((r[0] for r in found), accumulate((r[1] for r in found), initial=len(head)), strict=False))
    total, temporary = sum(r[1] for r in found), os.path.abspath(f"{path}.{uuid.uuid4().hex}")
    with open(temporary, "wb") as f:
        f.write(head)
        f.truncate(len(head) + total)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at = starts.get(part, 0)
        own = os.open(temporary, os.O_WRONLY)
        try:
            for batch in batches:
                chunk = memoryview(b"".join(batch.column(0).to_pylist()))
                while chunk:
                    n = os.pwrite(own, chunk, at)
                    chunk, at = chunk[n:], at + n
            os.fsync(own)
        finally:
            os.close(own)
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([at - starts.get(part, 0)])], ["part", "bytes"])

    done = {r["part"]: r["bytes"] for r in data.mapInArrow(write, "part int, bytes long").collect()}
    require(done == {r[0]: r[1] for r in found}, f"{path}: tasks wrote other bytes than they had told")
    os.replace(temporary, path)
    return sum(r[2] for r in found)
