"""Substring dedup: passages of at least ``window`` words that stand earlier in the corpus, found by doubling.

Level one takes windows of half the length. Of those, a window of full length is represented by its anchor, the half
window within it with the smallest digest: equal windows have equal anchors, so a window whose anchor occurs once alone
can't repeat and is dropped. What survives is extended to twice the length, where the repeats of a removal are told from
the rest; longer repeats are unions of those. ``repeat_lengths`` doubles on from there, until no candidate survives.

Each level deals digests with the first place they occur at, summed up by task, so that no passage, however frequent, is
one task's work; a place is one number, of the document in order of doc_id and the word. The first places go back to
their documents, one row each, and the documents tell what repeats from what doesn't.

Digests of whole windows have 128 bits (of words: xxh3). Edge cases: a null or empty text has no words and keeps the
empty string; texts shorter than a window lose nothing; null doc_ids come last; rows that repeat a doc_id are documents
of their own, ordered by a hash of the text, so of equal rows one stays whole; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators.numbering import numbered

from .common import Scratch, table
from .word_cuts import PLAIN, cut, digests, over_parts, pair, window_digests

WINDOW = 20


class Windows:
    """The words of some texts, and the windows of ``length`` words that lie within one text."""

    def __init__(self, part: pa.RecordBatch, length: int) -> None:
        self.texts, self.rows, self.length = part.column("text"), part.num_rows, length
        self.words = cut(self.texts, PLAIN, fold=False)
        self.base = digests(self.words.vocabulary)[:, self.words.ids]
        self.first = self.words.firsts(self.rows)
        self.half = window_digests(self.base, (length + 1) // 2)
        row, n = self.words.row, max(len(self.words.ids) - length + 1, 0)
        #: Where windows begin.
        self.at = np.flatnonzero(row[:n] == row[length - 1 :]) if n else np.zeros(0, np.int64)

    def anchors(self) -> np.ndarray:
        """Of each window, where its half window of smallest digest begins; the first of equal ones."""
        best, where = self.half[0][self.at], self.at.copy()
        for j in range(1, self.length - (self.length + 1) // 2 + 1):
            value = self.half[0][self.at + j]
            less = value < best
            best = np.where(less, value, best)
            where[less] = self.at[less] + j
        return where

    def digest(self, at: np.ndarray) -> np.ndarray:
        """Digests of the windows that begin at these words: the pair of both halves, which overlap if the length is odd."""
        return pair(self.half[:, at], self.half[:, at + self.length // 2])

    def marked(self, lists: pa.Array) -> np.ndarray:
        """The words that a list of numbers of words in each row names."""
        out = np.zeros(len(self.words.ids) + 1, bool)
        many = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        out[lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(self.first[:-1], many)] = True
        return out[:-1]

    def places(self, number: pa.Array, at: np.ndarray, bits: int) -> np.ndarray:
        """Document and word as one number."""
        row = self.words.row[at]
        return (number.to_numpy()[row] << bits) | (at - self.first[row])

    def removed(self, at: np.ndarray) -> np.ndarray:
        """The words that windows beginning at ``at`` cover."""
        n = len(self.words.ids)
        edges = np.zeros(n + 1, np.int64)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + self.length, -1)
        return np.cumsum(edges)[:n] > 0


def _candidates(w: Windows, part: pa.RecordBatch) -> np.ndarray:
    """The windows whose anchor occurs elsewhere, too."""
    return w.at[~w.marked(part.column("lone"))[w.anchors()]]


def _returned(first: DataFrame, bits: int, name: str) -> DataFrame:
    """Places as one list of words for each document."""
    place = first.select(F.shiftright("place", bits).alias("_to"), F.col("place").bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("_word"))
    return place.groupBy("_to").agg(F.collect_list("_word").alias(name))


def _joined(docs: DataFrame, lists: DataFrame, how: str = "left") -> DataFrame:
    return docs.join(lists, docs["number"] == lists["_to"], how).drop("_to")


def placed_documents(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(number, doc_id, text), numbered in order of doc_id, and the bits that hold a word's number."""
    d = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.xxhash64("text").alias("tie"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("size")]
    d = numbered(d, order, "number", lambda x: scratch.keep(x, "texts"))
    size = d.agg(F.max("size").alias("size"), F.count("*").alias("n")).first()
    bits = ((size["size"] or 0) // 2 + 1).bit_length()  # every other byte begins a word at most
    if bits + size["n"].bit_length() > 63:
        raise ValueError("documents and words of the longest one need more than 63 bits")
    return d.select("number", "doc_id", "text"), bits


def _first_places(docs: DataFrame, window: int, bits: int, candidates: Callable[[Windows, pa.RecordBatch], np.ndarray]) -> DataFrame:
    """(a, b, place, n): how often each candidate window occurs, and where first."""

    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        w = Windows(part, window)
        at = candidates(w, part)
        a, b = w.digest(at)
        yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(w.places(part.column("number"), at, bits))], ["a", "b", "place"])

    found = docs.mapInArrow(over_parts(run), "a long, b long, place long")
    return found.groupBy("a", "b").agg(F.min("place").alias("place"), F.count("*").alias("n"))


def with_lone(d: DataFrame, bits: int, scratch: Scratch, window: int) -> DataFrame:
    """Adds ``lone`` to the documents: where those anchors begin that occur once alone."""

    def halves(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        w = Windows(part, window)
        at = np.unique(w.anchors())
        yield pa.record_batch([pa.array(w.half[0][at].view(np.int64)), pa.array(w.places(part.column("number"), at, bits))], ["a", "place"])

    # Equal half windows of other words (64 bits) only let more candidates survive.
    once = d.select("number", "text").mapInArrow(over_parts(halves), "a long, place long").groupBy("a").agg(F.min("place").alias("place"), F.count("*").alias("n"))
    return _joined(d, scratch.keep(_returned(once.filter("n = 1"), bits, "lone"), "lone"))


def marked_documents(docs: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """(number, doc_id, text, lone, firsts): lone anchors and first windows of each document, as numbers of words."""
    d, bits = placed_documents(docs, scratch)
    marked = with_lone(d, bits, scratch, window)
    first = _first_places(marked.select("number", "text", "lone"), window, bits, _candidates)
    return _joined(marked, scratch.keep(_returned(first, bits, "firsts"), "firsts"))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): each text without the words of windows that occur earlier."""
    scratch = Scratch(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        w = Windows(part, window)
        at = _candidates(w, part)
        gone = w.removed(at[~w.marked(part.column("firsts"))[at]])
        n_gone = np.bincount(w.words.row[gone], minlength=w.rows)
        kept = []
        for i, text in enumerate(w.texts.to_pylist()):
            words = (text or "").encode().split()
            kept.append(b" ".join(compress(words, ~gone[w.first[i] : w.first[i + 1]]) if n_gone[i] else words))
        columns = [part.column("doc_id"), pa.array(np.diff(w.first)), pa.array(n_gone), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.record_batch(columns, ["doc_id", "n_words", "n_removed", "kept_text"])

    return marked_documents(docs, scratch, window).mapInArrow(over_parts(run), f"doc_id {kind}, n_words long, n_removed long, kept_text string")


def repeat_lengths(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, length, first_word, last_word): runs of words in windows of ``length`` words that occur more than once.

    Lengths are the window, then twice the last one, as long as a window repeats; numbers of words count from 0.
    """
    scratch = Scratch(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    d, bits = placed_documents(docs, scratch)

    def extended(w: Windows, part: pa.RecordBatch) -> np.ndarray:
        if "lone" in part.schema.names:
            return _candidates(w, part)
        before = w.marked(part.column("repeats"))
        return w.at[before[w.at] & before[w.at + w.length // 2]]

    def runs(length: int) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            w = Windows(part, length)
            at = extended(w, part)
            at = at[~w.marked(part.column("single"))[at]]
            row = w.words.row[at]
            lists = np.split((at - w.first[row]).astype(np.int32), np.searchsorted(row, np.arange(1, w.rows)))
            yield pa.record_batch([part.column("number"), part.column("doc_id"), pa.array(lists, pa.list_(pa.int32()))], ["number", "doc_id", "repeats"])

        return run

    found, state, length, last = [], with_lone(d, bits, scratch, window), window, "lone"
    while True:
        first = _first_places(state.select("number", "text", last), length, bits, extended)
        single = scratch.keep(_returned(first.filter("n = 1"), bits, "single"), f"single{length}")
        repeats = _joined(state, single).mapInArrow(over_parts(runs(length)), f"number long, doc_id {kind}, repeats array<int>").filter(F.size("repeats") > 0)
        repeats = scratch.keep(repeats, f"repeats{length}")
        if repeats.isEmpty():
            break
        # A run goes on as long as the next window begins at or before the word after its end.
        starts = F.filter("repeats", lambda x, k: (k == 0) | (F.get(F.col("repeats"), k - 1) + length < x))
        ends = F.filter("repeats", lambda x, k: F.coalesce(x + length < F.get(F.col("repeats"), k + 1), F.lit(True)))
        runs_of = F.arrays_zip(starts.alias("first_word"), F.transform(ends, lambda x: x + length - 1).alias("last_word"))
        found.append(repeats.select("doc_id", F.lit(length).alias("length"), F.inline(runs_of).alias("first_word", "last_word")))
        state, last = d.join(repeats.select(F.col("number").alias("_to"), "repeats"), d["number"] == F.col("_to")).drop("_to"), "repeats"
        length *= 2
    out = repeats.select("doc_id", F.lit(0).alias("length"), F.lit(0).alias("first_word"), F.lit(0).alias("last_word"))
    for x in found:
        out = out.unionByName(x)
    return out


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP13_SQL = rf"""
WITH cut AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM cut WHERE len(w) >= {WINDOW})),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
places AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM cut),
marked AS (
  SELECT p.doc_id, p.i, word, max(CASE WHEN l.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone
  FROM places p LEFT JOIN later l ON p.doc_id = l.doc_id AND p.i = l.i
), kept AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS t FROM marked GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM cut LEFT JOIN kept USING (doc_id)
"""
