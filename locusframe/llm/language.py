"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of a bounded, hash-chosen sample of the labelled rows; the matrix of log-probabilities
(languages x buckets, so of a size known beforehand) is broadcast, and batches of documents are scored as sparse
count matrices in numpy.

Edge cases: a null text, or one without a letter, is ``und`` with score 0, and so is every text if there is nothing
to learn from; texts of any length are counted whole, in pieces; equal scores go to the first language in order; a
null doc_id counts as not held out; rows that repeat are judged alike; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .bpe import slices
from .common import table

#: Buckets of the hash, lengths of the n-grams, the smoothing of counts.
BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
ALPHA = 0.5
#: About so many documents are sampled for each language, fewer where there are fewer.
SAMPLE = 2_000
#: Languages that are scored together, entries of the product that are held at a time, and languages that a broadcast
#: matrix, 64 KB each, has room for: more are an error, none is left out.
TOGETHER, ENTRIES, ROOM = 64, 1 << 21, 8_000
#: Code points looked at together.
PIECE = 1 << 20
_A, _B = np.uint32(2654435761), np.uint32(2246822519)


def buckets(text: str) -> np.ndarray:
    """The bucket of each n-gram of one piece of text."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out, h = [], np.zeros(len(x), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(x) < n:
            break
        h = (h[: len(x) - n + 1] + x[n - 1 :]) * _A  # the next letter joins each n-gram
        if n in ORDERS:
            out.append(((h ^ (h >> np.uint32(15))) * _B + np.uint32(n)) >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def counts(text: str) -> np.ndarray:
    """Counts by bucket of a whole text; pieces overlap by an n-gram less one."""
    text = text.lower()
    if len(text) <= PIECE:
        return np.bincount(buckets(text), minlength=BUCKETS)
    total = np.zeros(BUCKETS, np.int64)
    back = max(ORDERS) - 1
    for at in range(0, len(text), PIECE):
        total += np.bincount(buckets(text[max(0, at - back) : at + PIECE]), minlength=BUCKETS)
        if at:  # what lies in the overlap alone was counted before
            total -= np.bincount(buckets(text[at - back : at]), minlength=BUCKETS)
    return total


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model:
    """Languages in order, and log-probabilities by bucket and language."""

    def __init__(self, names: list[str], by_name: np.ndarray) -> None:
        self.names = names
        smooth = by_name + ALPHA
        self.logs = np.ascontiguousarray(np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32)) if names else np.zeros((BUCKETS, 0), np.float32)

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its share of the posterior, with languages alike beforehand."""
        names, shares = ["und"] * len(texts), [0.0] * len(texts)
        use = [i for i, t in enumerate(texts) if self.names and has_letter(t)]
        if not use:
            return names, shares
        where, values = [], []
        for i in use:
            c = counts(texts[i])
            at = np.flatnonzero(c)
            where.append(at)
            values.append(c[at])
        for row, i in enumerate(use):
            best, share = self._likeliest(where[row], values[row].astype(np.float32))
            names[i], shares[i] = self.names[best], share
        return names, shares

    def _likeliest(self, where: np.ndarray, values: np.ndarray) -> tuple[int, float]:
        """The first label of the largest log-probability and its share, by blocks of labels and runs of entries."""
        logs = np.zeros(len(self.names))
        for k in range(0, len(logs), TOGETHER):
            block = self.logs[:, k : k + TOGETHER]
            step = max(1, ENTRIES // block.shape[1])
            for at in range(0, len(where), step):
                logs[k : k + TOGETHER] += (block[where[at : at + step]] * values[at : at + step, None]).sum(axis=0, dtype=np.float64)
        best = int(logs.argmax())
        return best, float(1 / np.exp(logs - logs[best]).sum())


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit to (doc_id, text, lang) rows with a lang that isn't null; at most about ``sample`` of each language.

    The draw hashes the row and its place, so that rows that share an id or a text don't share it.
    """
    spark = labelled.sparkSession
    rows = labelled.filter(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(ROOM + 1).collect()}
    if len(sizes) > ROOM:
        raise ValueError(f"more than {ROOM} languages don't fit the matrix that is broadcast")
    if not sizes:
        return Model([], np.zeros((0, BUCKETS)))
    shares = spark.createDataFrame([(k, min(1.0, sample / n)) for k, n in sizes.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.withColumn("draw", draw).join(F.broadcast(shares), "lang").filter(F.col("draw") < F.col("share")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if has_letter(text):
                    total[lang] = total.get(lang, 0) + counts(text)
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["lang", "bucket", "n"])

    # Languages x buckets rows at most, whatever the size of the corpus.
    found = chosen.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(found["lang"].unique())
    by_name = np.zeros((len(names), BUCKETS))
    np.add.at(by_name, (np.searchsorted(np.array(names, object), found["lang"].to_numpy(object)), found["bucket"].to_numpy(np.int64)), found["n"].to_numpy(np.float64))
    return Model(names, by_name)


def predict(docs: DataFrame, model: Model, pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """The columns of ``docs`` with the language and its score, in place of columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema if f.name not in (pred, score)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.select([f.name for f in fields])
            for part in slices(batch.column("text")):
                rows = batch.slice(part.start, part.stop - part.start)
                names, scores = shared.value.score(rows.column("text").to_pylist())
                yield rows.append_column(pred, pa.array(names, pa.string())).append_column(score, pa.array(scores, pa.float64()))

    return docs.mapInArrow(run, StructType([*fields, StructField(pred, StringType()), StructField(score, DoubleType())]))


def learned(docs: DataFrame) -> Model:
    return train(docs.filter(~held_out(F.col("doc_id"))))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), learned(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
