"""Importance resampling towards a target: hashed word n-grams of documents and of a target text collection.

Tasks number the words of a slice of texts and sort the slice's word-id suffixes, cut off at the longest order; common
prefixes of neighbours (LCP) mark the runs of equal n-grams. Each run is hashed once and its bucket scattered to all of
its occurrences. One pass counts buckets, a second adds the buckets' gains up by document; the rest is a draw by score.

Edge cases: a null or empty text has no feature and weight 0; words never cross texts; rows that repeat a doc_id share a
draw, are scored by their own text, and ties go to the smaller doc_id, null last, then to fewer features; empty tables
give no row, or gains of an empty side; extra columns are left out. A slice is 4 MB of text or one longer text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators.numbering import numbered

from .common import Scratch, table
from .word_cuts import LETTERS, cut, over_parts, parts, spelled

#: Lengths of the n-grams, buckets of their hash, documents drawn of 100, words of a document that can be drawn.
ORDERS, BUCKETS, PERCENT, LEAST = (1, 1), 10_000, 10, 20
SEED = "2024"


def runs(ids: np.ndarray, row: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``longest`` words, and how many words each shares with the one before.

    Words of the next text count as none, so that a suffix ends with its text.
    """
    n = len(ids)
    ahead = []
    for j in range(longest):
        x = np.full(n, -1, np.int64)
        if n > j:
            x[: n - j] = np.where(row[j:] == row[: n - j], ids[j:], -1)
        ahead.append(x)
    order = np.lexsort(ahead[::-1])
    common, same = np.zeros(n, np.int64), np.ones(max(n - 1, 0), bool)
    for x in ahead:
        s = x[order]
        same &= (s[1:] == s[:-1]) & (s[1:] >= 0)
        common[1:] += same
    return order, common


def features(part: pa.RecordBatch, orders: tuple[int, int], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket and the row of each n-gram's occurrence, and the number of words of each row."""
    words = cut(part.column("text"), LETTERS, fold=True)
    names = spelled(words.vocabulary)
    order, common = runs(words.ids, words.row, orders[1])
    found, rows = [], []
    for n in range(orders[0], orders[1] + 1):
        last = order + (n - 1)
        inside = last < len(order)
        inside[inside] = words.row[last[inside]] == words.row[order[inside]]
        at, opens = order[inside], common[inside] < n
        # Those that share n words stand together, so a suffix that is too short never parts a run.
        heads = at[opens]
        if n == 1:
            hashed = [zlib.crc32(names[i]) % buckets for i in words.ids[heads]]
        else:
            hashed = [zlib.crc32(b" ".join([names[i] for i in words.ids[p : p + n]])) % buckets for p in heads.tolist()]
        found.append(np.array(hashed, np.int64)[np.cumsum(opens) - 1])
        rows.append(words.row[at])
    return np.concatenate(found), np.concatenate(rows), np.bincount(words.row, minlength=part.num_rows)


def bucket_counts(docs: DataFrame, orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts; a task adds up its own, at most ``buckets`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in parts(batch):
                total += np.bincount(features(part, orders, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares in the target and in the documents, floored."""
    size, n_own, n_target = len(own), float(own.sum() + len(own)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log(float(t + 1) * n_own / (float(s + 1) * n_target))) for s, t in zip(own.tolist(), target.tolist(), strict=True)], np.int64).reshape(size)


def weighed(docs: DataFrame, gain: np.ndarray, orders: tuple[int, int] = ORDERS) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the gains of a document's features."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bucket, row, n_words = features(part, orders, len(gain))
        n = np.bincount(row, minlength=part.num_rows)
        total = np.zeros(part.num_rows, np.int64)
        np.add.at(total, row, gain[bucket])
        columns = [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n, total // np.maximum(n, 1)))]
        yield pa.record_batch(columns, ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(over_parts(run), f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of a hash of the seed and the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(docs: DataFrame, target: DataFrame, orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS, percent: int = PERCENT, least: int = LEAST, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; rank is null where it isn't drawn.

    Of the documents with ``least`` words or more, ``percent`` of 100 are drawn, rounded down: those of highest score.
    """
    scratch = Scratch(docs.sparkSession)
    gain = gains(bucket_counts(docs, orders, buckets), bucket_counts(target, orders, buckets))
    # Written first: finding the ranges of the order reads its rows twice.
    scored = scratch.keep(weighed(docs, gain, orders), "weighed").withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    # Short documents come after all others and so take no number that counts.
    order = [F.col("n_words") < least, F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    found = numbered(scored, order, "_number", lambda df: scratch.keep(df, "scored"))
    drawn = percent * found.filter(F.col("n_words") >= least).count() // 100
    return found.withColumn("rank", F.when(F.col("_number") < drawn, F.col("_number") + 1)).drop("_number")


def resampled(docs: DataFrame, target: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs``, all columns, that the draw takes; doc_id must not repeat."""
    drawn = ranked(docs, target, **options).filter(F.col("rank").isNotNull()).select(F.col("doc_id").alias("_drawn"))
    return docs.join(drawn, F.col("doc_id").eqNullSafe(F.col("_drawn")), "left_semi")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 byte by byte, over distinct words only; its table follows from the polynomial.
OP11_SQL = rf"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END)) AS steps
), cut AS (
  SELECT 'd' AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), places AS (SELECT side, doc_id, unnest(w) AS word FROM cut),
vocabulary AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM places)),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))),
    lambda c, b: xor(c // 256, steps[CAST(xor(c, b) % 256 AS INTEGER) + 1])), 4294967295::BIGINT) % {BUCKETS} AS bucket
  FROM vocabulary, crc
), totals AS (SELECT count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM places),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(count(*) FILTER (side = 'b') + 1 AS DOUBLE) * CAST(max(totals.s) + {BUCKETS} AS DOUBLE)
    / (CAST(count(*) FILTER (side = 'd') + 1 AS DOUBLE) * CAST(max(totals.t) + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain
  FROM places JOIN hashed USING (word), totals GROUP BY bucket
), weighed AS (
  SELECT doc_id, CAST(count(*) AS BIGINT) AS n_features, CAST(sum(gain) AS BIGINT) AS total FROM places JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight,
    CAST('0x' || substr(sha256('{SEED}:' || CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h
  FROM documents d LEFT JOIN weighed ON d.doc_id = weighed.doc_id
), summed AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((CAST(h AS DOUBLE) + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM scored),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM summed WHERE n_features >= {LEAST})
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS BIGINT) AS rank FROM summed LEFT JOIN drawn USING (doc_id)
"""
