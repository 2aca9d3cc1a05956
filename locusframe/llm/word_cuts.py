"""Words of whole texts as arrays: what the operators on word windows share inside their tasks.

Only ASCII bytes separate words, and in UTF-8 no byte of another character is below 0x80, so words are cut in bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are looked at together; a longer text is one piece.
SLICE = 2 << 20
WORD, BLANK, BREAK = 0, 1, 2
_M1, _M2, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)


def byte_kinds(blanks: bytes, breaks: bytes = b"") -> np.ndarray:
    """WORD, BLANK or BREAK for each byte; breaks end a piece of text, too."""
    kinds = np.zeros(256, np.uint8)
    kinds[list(blanks)] = BLANK
    kinds[list(breaks)] = BREAK
    return kinds


#: ``[^\x20\x09-\x0D]+``, ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing, and ``[^\x20\x09]+`` in pieces.
PLAIN = byte_kinds(b" \t\n\v\f\r")
LETTERS = byte_kinds(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
PIECES = byte_kinds(b" \t", b".,;:!?\n\v\f\r")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


@dataclass
class Cut:
    """Words in order: their number in ``vocabulary``, their text (row) and their piece, numbered across texts."""

    ids: np.ndarray
    row: np.ndarray
    piece: np.ndarray
    vocabulary: pa.Array

    def firsts(self, rows: int) -> np.ndarray:
        """The number of the first word of each row, and at the end that of all words."""
        return np.searchsorted(self.row, np.arange(rows + 1))


def cut(texts: pa.Array, kinds: np.ndarray, fold: bool) -> Cut:
    """The words of texts, nulls being empty; ``fold``: A-Z are lower-cased first."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[off[0] : off[-1]] if held is not None and len(held) else np.zeros(0, np.uint8)
    off = off - off[0]
    if fold:
        data = _FOLD[data]
    kind = kinds[data]
    edge = np.zeros(len(data) + 1, bool)  # where a text begins or ends
    edge[off] = True
    word = kind == WORD
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    end[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    kept = np.ascontiguousarray(data[word])
    wide = len(kept) >= 1 << 31
    offsets = np.zeros(len(starts) + 1, np.int64 if wide else np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    coded = pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
    row = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(starts, off)))
    piece = row + np.cumsum(kind == BREAK)[starts] if (kinds == BREAK).any() and len(starts) else row
    return Cut(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), row, piece, coded.dictionary)


def spelled(vocabulary: pa.Array) -> list[bytes]:
    """The words as bytes; slices of the buffer, as to_pylist takes four times as long."""
    held = vocabulary.buffers()
    off = np.frombuffer(held[1], np.int32 if vocabulary.type == pa.binary() else np.int64)[vocabulary.offset : vocabulary.offset + len(vocabulary) + 1].tolist()
    data = held[2].to_pybytes() if held[2] is not None else b""
    return [data[a:b] for a, b in zip(off, off[1:], strict=False)]


def parts(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch, each of at most ``limit`` bytes of text or one row."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > limit:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(n)
    if at < len(sizes):
        yield batch.slice(at)


def over_parts(run: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` on each part of each batch, for mapInArrow."""

    def all_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                yield from run(part)

    return all_parts


def digests(vocabulary: pa.Array) -> np.ndarray:
    """Two 64-bit halves of a digest of each word: (2, words)."""
    raw = b"".join(map(xxhash.xxh3_128_digest, spelled(vocabulary)))
    return np.frombuffer(raw, np.uint64).reshape(-1, 2).T.copy()


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The digest of two neighbours from theirs; each half of a digest goes its own way."""
    x = left * _M1 + (right ^ (right >> _SHIFT)) * _M2
    x = (x ^ (x >> _SHIFT)) * _M1
    return x ^ (x >> np.uint64(32))


def window_digests(base: np.ndarray, length: int) -> np.ndarray:
    """Digests of all windows of ``length`` words by doubling: a window of 2n is the pair of its halves.

    ``base`` is (halves, words); the result has ``length`` - 1 fewer windows, some of which cross texts.
    """
    have, size, done = base, 1, None
    n, used = base.shape[1] - length + 1, 0
    if n <= 0:
        return base[:, :0]
    while True:
        if length & size:  # this power of two is a part of the length
            part = have[:, used : used + n]
            done = part if done is None else pair(done, part)
            used += size
        if used == length:
            return done
        have = pair(have[:, :-size], have[:, size:])
        size *= 2
