"""Lines of block-compressed files (gzip members that tell their size), read by many tasks.

A task has a range of bytes. It finds the first block that begins there, inflates the blocks that begin in its range, drops
what precedes its first line end and goes on to the end of the last line that it began, as readers of split text do.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from typing import BinaryIO

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession

#: How a block begins (gzip with an extra field), and the largest block.
MAGIC, LARGEST = b"\x1f\x8b\x08\x04", 1 << 16
_CHROMOSOME = re.compile(rb"\s*(?:chr)?0*([0-9]+)\s*", re.IGNORECASE)


def block_size(head: bytes) -> int | None:
    """The whole size of the block whose bytes begin with ``head``; None if that's no block or too short to tell."""
    if len(head) < 12 or not head.startswith(MAGIC):
        return None
    extra, at = struct.unpack_from("<H", head, 10)[0], 12
    while at + 6 <= min(12 + extra, len(head)):
        name, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if name == b"BC" and size == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


def opened(path: str) -> tuple[FileSystem, str]:
    """``path`` is a URI that pyarrow knows, or a path of a folder that all executors share."""
    return FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def is_blocked(path: str) -> bool:
    """Whether a file named like a compressed one consists of blocks."""
    if not path.lower().endswith((".gz", ".bgz", ".bgzf")) or any(c in path for c in "*?[{"):
        return False
    files, name = opened(path)
    if not files.get_file_info(name).is_file:
        return False
    with files.open_input_file(name) as f:
        return block_size(f.read(LARGEST)) is not None


def first_block(f: BinaryIO, start: int, size: int) -> int | None:
    """Where the first block at or after ``start`` begins: its magic must be followed by another block or the end."""
    f.seek(start)
    held = f.read(2 * LARGEST + 32)
    at = held.find(MAGIC)
    while at >= 0:
        n = block_size(held[at:])
        if n is not None:
            after = start + at + n
            if after == size:
                return start + at
            f.seek(after)
            if block_size(f.read(LARGEST)) is not None:
                return start + at
        at = held.find(MAGIC, at + 1)
    return None


def inflated(f: BinaryIO, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Blocks from the one at ``at`` on, with where they begin."""
    while at < size:
        f.seek(at)
        raw = f.read(LARGEST)
        n = block_size(raw)
        if n is None or len(raw) < n:
            raise ValueError(f"no whole block at byte {at}")
        yield at, zlib.decompress(raw[12 + struct.unpack_from("<H", raw, 10)[0] : n - 8], wbits=-15)
        at += n


def lines_of(f: BinaryIO, start: int, end: int, size: int) -> Iterator[bytes]:
    """The lines that begin after the first line end of the range (of the file's first range: all), one beyond it at most."""
    at = 0 if start == 0 else first_block(f, start, size)
    if at is None or at >= end:
        return
    rest, skipping = b"", start > 0
    for place, data in inflated(f, at, size):
        if place >= end and skipping:
            return
        rest += data
        if skipping:
            cut = rest.find(b"\n")
            if cut < 0:
                rest = b""
                continue
            rest, skipping = rest[cut + 1 :], False
        if place >= end:
            cut = rest.find(b"\n")
            if cut >= 0:
                yield rest[:cut]
                return
            continue
        *whole, rest = rest.split(b"\n")
        yield from whole
    if rest and not skipping:
        yield rest


def chosen(line: bytes, columns: Sequence[int] | None, region: tuple[int, int, int] | None) -> bytes | None:
    """A record with its first nine fields and the chosen sample columns alone; None outside the region. Comments stay."""
    if line.startswith(b"#") or (columns is None and region is None):
        return line
    fields = line.split(b"\t")
    if region is not None:
        name = _CHROMOSOME.fullmatch(fields[0])
        if not name or int(name[1]) != region[0] or len(fields) < 2 or not fields[1].isdigit() or not region[1] <= int(fields[1]) <= region[2]:
            return None
    if columns is None or len(fields) < 10:
        return line
    return b"\t".join([*fields[:9], *(fields[9 + c] if 9 + c < len(fields) else b"." for c in columns)])


def block_lines(spark: SparkSession, path: str, columns: Sequence[int] | None = None, region: tuple[int, int, int] | None = None, task_bytes: int = 16 << 20) -> DataFrame:
    """value and line, a number that grows in the file's order. ``region``: chromosome, first and last position.

    Tasks drop sample columns and records outside the region before anything leaves them.
    """
    files, name = opened(path)
    size = files.get_file_info(name).size or 0
    keep = None if columns is None else list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = opened(path)
        with own.open_input_file(at) as f:
            for batch in batches:
                for start in batch.column("id").to_pylist():
                    values, numbers, held = [], [], 0
                    for k, line in enumerate(lines_of(f, start, start + task_bytes, size)):
                        value = chosen(line.removesuffix(b"\r"), keep, region)
                        if value is not None:
                            values.append(value)
                            numbers.append((start // task_bytes << 33) + k)
                            held += len(value)
                        if held > 4 << 20:
                            yield pa.record_batch([pa.array(values, pa.binary()).cast(pa.string()), pa.array(numbers, pa.int64())], ["value", "line"])
                            values, numbers, held = [], [], 0
                    yield pa.record_batch([pa.array(values, pa.binary()).cast(pa.string()), pa.array(numbers, pa.int64())], ["value", "line"])

    return spark.range(0, size, task_bytes, numPartitions=max(1, -(-size // task_bytes))).mapInArrow(run, "value string, line long")
