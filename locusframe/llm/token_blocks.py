"""Token ids in patched frame-of-reference blocks.

A segment packs a run of ids in blocks of 128: the block's minimum is subtracted, the rest is packed at the width
of the block's 90th percentile, and what doesn't fit leaves its high bits in an exception list. The header holds
each block's minimum, width, number of exceptions and start, so that any range of ids is read without the rest.

Layout of a segment (little-endian): ``PFR1``, n, blocks, exceptions as uint32; minima (uint32), starts (uint32),
widths (uint8), exception counts (uint8) per block; exception positions (uint8) and high parts (uint32); packed bits.

A file set is a Parquet folder of such segments, written by Spark's committer, hence whole after lost executors and
in any store: (shard, segment, first, doc_ids, lengths, payload). Shards are ranges of doc_id in ascending order.

Edge cases: a null text is empty and holds the end id only; null doc_ids come first; rows that repeat a doc_id are
ordered by text; an empty table gives no segment; a segment ends with a document, so one very long document makes
one large segment; extra columns are left out.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bpe import forget, pieces_of, slices, unseen, vocabulary_path
from .common import shared_dir, table

BLOCK = 128
PERCENTILE = 0.9
#: Ids in a segment, from which on it ends with the document.
SEGMENT = 1 << 18
END = 0


def _bits(values: np.ndarray) -> np.ndarray:
    """Widths in bits."""
    return np.where(values == 0, 0, np.floor(np.log2(np.maximum(values, 1).astype(np.float64))).astype(np.int64) + 1)


def pack(ids: np.ndarray) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return b"PFR1" + np.zeros(3, "<u4").tobytes()
    full = np.full(blocks * BLOCK, ids[-1], np.uint32)  # the last block is filled up with its last id
    full[:n] = ids
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1)
    rest = full - low[:, None]
    rank = int(np.ceil(PERCENTILE * BLOCK)) - 1
    width = _bits(np.partition(rest, rank, axis=1)[:, rank])
    starts = np.concatenate(([0], np.cumsum(width * (BLOCK // 8))))
    over = (rest >> width.astype(np.uint32)[:, None]) > 0
    block_of, position = np.nonzero(over)
    high = (rest >> width.astype(np.uint32)[:, None])[over]
    out = np.zeros(starts[-1], np.uint8)
    for w in np.unique(width):
        if w:
            at = np.flatnonzero(width == w)
            kind = "<u2" if w <= 16 else "<u4"
            bits = np.unpackbits(rest[at].astype(kind).view(np.uint8).reshape(len(at) * BLOCK, -1), axis=1, count=int(w), bitorder="little")
            out[starts[at][:, None] + np.arange(w * BLOCK // 8)] = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little")
    head = np.array([n, blocks, len(high)], "<u4").tobytes()
    parts = (low.astype("<u4"), starts[:-1].astype("<u4"), width.astype(np.uint8), np.bincount(block_of, minlength=blocks).astype(np.uint8), position.astype(np.uint8), high.astype("<u4"), out)
    return b"PFR1" + head + b"".join(x.tobytes() for x in parts)


def unpack(data: bytes, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """The ids from lo up to hi; only the blocks that hold them are unpacked."""
    if data[:4] != b"PFR1":
        raise ValueError("not a segment")
    n, blocks, patches = (int(x) for x in np.frombuffer(data, "<u4", 3, 4))
    at = 16

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(data, kind, count, at)
        at += x.nbytes
        return x

    low, starts, width, counts = take("<u4", blocks), take("<u4", blocks), take("u1", blocks), take("u1", blocks)
    position, high = take("u1", patches), take("<u4", patches)
    packed = np.frombuffer(data, np.uint8, -1, at) if at < len(data) else np.zeros(0, np.uint8)
    hi = n if hi is None else min(hi, n)
    if lo >= hi:
        return np.zeros(0, np.uint32)
    a, b = lo // BLOCK, -(-hi // BLOCK)
    out = np.zeros((b - a, BLOCK), np.uint32)
    for w in np.unique(width[a:b]):
        if w:
            own = np.flatnonzero(width[a:b] == w)
            got = packed[starts[a:b][own].astype(np.int64)[:, None] + np.arange(int(w) * BLOCK // 8)]
            bits = np.unpackbits(got, axis=1, bitorder="little").reshape(-1, int(w))
            size = 16 if w <= 16 else 32
            wide = np.zeros((len(bits), size), np.uint8)
            wide[:, : int(w)] = bits
            out[own] = np.packbits(wide, axis=1, bitorder="little").view(f"<u{size // 8}").reshape(len(own), BLOCK)
    ends = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    own = slice(ends[a], ends[b])
    rows = np.repeat(np.arange(b - a), counts[a:b])
    out[rows, position[own]] |= high[own] << width[a:b][rows].astype(np.uint32)
    return (out + low[a:b, None]).reshape(-1)[lo - a * BLOCK : hi - a * BLOCK]


@lru_cache(maxsize=2)
def _library(path: str):  # noqa: ANN202
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    special = [t.content for t in own.get_added_tokens_decoder().values()]
    return own, re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None


_KNOWN: dict[str, dict[str, bytes]] = {}


#: Pieces that the library gets as one text.
RUN = 256


def encode_pieces(pieces: list[str], library) -> Iterator[tuple[str, bytes]]:  # noqa: ANN001
    """Each piece with its ids as bytes.

    Pieces that begin with a blank before something else are cut again at that blank when they stand in a row, so the
    library gets them as texts of many pieces, whose ids it tells apart by word.
    """
    blank: list[str] = []
    rest: list[str] = []
    for p in pieces:
        (blank if p[:1] == " " and len(p) > 1 and not p[1].isspace() else rest).append(p)
    runs = [blank[i : i + RUN] for i in range(0, len(blank), RUN)]
    for run, got in zip(runs, library.encode_batch(["".join(r) for r in runs], add_special_tokens=False), strict=True):
        ids = np.array(got.ids, "<u4")
        at = [*np.flatnonzero(np.diff(np.array(got.word_ids), prepend=-1)).tolist(), len(ids)]
        data = ids.tobytes()
        for piece, a, b in zip(run, at[:-1], at[1:], strict=True):
            yield piece, data[4 * a : 4 * b]
    for piece, got in zip(rest, library.encode_batch_fast(rest, add_special_tokens=False), strict=True):
        yield piece, np.array(got.ids, "<u4").tobytes()


def encode_ids(texts: list[str | None], path: str) -> list[np.ndarray]:
    """Ids of each text by the tokenizers library, which sees each distinct piece once while a worker remembers it."""
    library, cut = _library(path)
    known = _KNOWN.setdefault(path, {})
    batch = pieces_of(texts, cut)
    fresh = unseen(batch, known)
    known.update(encode_pieces(list(fresh), library))
    of = known.__getitem__
    out = [np.frombuffer(b"".join(map(of, pieces)), "<u4") for pieces in batch]
    forget(fresh, known)
    return out


_FIELDS = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])


def _segments(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    shard, segment, first = TaskContext.get().partitionId(), 0, 0
    docs: list[int | None] = []
    held: list[np.ndarray] = []
    total = 0

    def flush() -> pa.RecordBatch:
        nonlocal segment, first, docs, held, total
        row = pa.record_batch([[shard], [segment], [first], [docs], [[len(x) for x in held]], [pack(np.concatenate(held))]], schema=_FIELDS)
        segment, first, docs, held, total = segment + 1, first + total, [], [], 0
        return row

    for batch in batches:
        for part in slices(batch.column("text")):
            rows = batch.slice(part.start, part.stop - part.start)
            for doc, ids in zip(rows.column("doc_id").to_pylist(), encode_ids(rows.column("text").to_pylist(), path), strict=True):
                docs.append(doc)
                held.append(np.append(ids, np.uint32(END)))
                total += len(ids) + 1
                if total >= SEGMENT:
                    yield flush()
    if docs:
        yield flush()


def write_token_files(docs: DataFrame, out: str, path: str | None = None) -> None:
    """Encode all documents and write their ids, in ascending order of doc_id, to the folder ``out``."""
    path = vocabulary_path(path)
    # No number of partitions: adaptive execution may join neighbouring ranges, which keeps the order.
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    ordered.mapInArrow(lambda batches: _segments(batches, path), "shard int, segment int, first long, doc_ids array<long>, lengths array<long>, payload binary").write.parquet(out)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids before the document in all files), n_tokens and ids_crc32, read from the files."""
    segments = spark.read.parquet(folder)
    sizes = segments.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    # One row a shard: their number is the number of writing tasks, not of documents.
    before = sizes.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                doc, lengths, data = (batch.column(c)[row] for c in ("doc_ids", "lengths", "payload"))
                n = np.array(lengths.as_py(), np.int64)
                ids = unpack(data.as_py()).astype("<u4")
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[b - k : b].tobytes()) for b, k in zip(ends, n, strict=True)]
                yield pa.record_batch([doc.values, pa.array(ends - n + batch.column("first")[row].as_py() + batch.column("before")[row].as_py(), pa.int64()), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.join(F.broadcast(before), "shard").select("first", "before", "doc_ids", "lengths", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder)
