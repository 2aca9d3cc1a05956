"""Phrase collocations from vertical positional lists.

A task holds, for each slice of texts, the list of places of each word. A phrase's list comes from merging the places of
the frequent phrase one word shorter with the postings of the adjacent word, and the list's length is its frequency in
the slice; sums over all slices are exact frequencies. Only frequent phrases are extended: each level's are written, and
their digests mark bits of a map of fixed size that all tasks get. A digest that another phrase has marked only makes a
task count a phrase in vain, as what isn't frequent is dropped after the sums.

Frequencies, cuts and containment are joins and sums on phrases. The rows kept are numbered along ranges of one order of
all languages, so that one language's phrases are never one task's.

Edge cases: a null or empty text has no words, a null language is ``und``; phrases cross neither pieces nor texts; rows
that repeat count again; extra columns aren't read; empty tables and languages without a frequent phrase give no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators.numbering import numbered

from .common import Scratch, rows_a_batch, table
from .word_cuts import PIECES, Cut, cut, digests, over_parts, pair

LONGEST, LEAST, TOP = 4, 30, 2000
#: A candidate goes if a longer phrase around it has this many of 100 of its occurrences.
INSIDE = 80
#: The map of frequent phrases: 2^26 bits, 8 MB.
BITS = 26
#: Languages whose totals are broadcast; rows of a batch of texts.
FEW, ROWS = 10_000, 1_000


def _langs(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct languages, each row's number among them and its digest."""
    coded = column.fill_null("und").cast(pa.binary()).dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return coded.dictionary.cast(pa.string()), number, digests(coded.dictionary)[0][number]


def _marked(digest: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = digest >> np.uint64(64 - BITS)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


class Postings:
    """Lists of places of the phrases of one length: ``at`` in order of place, ``phrase`` the list each belongs to."""

    def __init__(self, at: np.ndarray, key: np.ndarray, digest: np.ndarray) -> None:
        self.at = at
        _, heads, self.phrase = np.unique(key, return_index=True, return_inverse=True)
        #: A place and the digest of each list.
        self.head, self.digest = at[heads], digest[heads]

    def frequent(self, bits: np.ndarray) -> Postings:
        """The lists whose phrase the map has."""
        keep = _marked(self.digest, bits)[self.phrase]
        out = object.__new__(Postings)
        out.at, out.phrase, out.head, out.digest = self.at[keep], self.phrase[keep], self.head, self.digest
        return out

    def extended(self, words: Postings, piece: np.ndarray, word_digest: np.ndarray, length: int) -> Postings:
        """Phrases of one word more, ``length`` in all: those whose tail is a frequent phrase, too."""
        after = self.at + (length - 1)
        # Merge the places with those of the tails and with those of the words that follow.
        tail, met = np.searchsorted(self.at, self.at + 1), np.searchsorted(words.at, after)
        ok = (tail < len(self.at)) & (met < len(words.at))
        ok[ok] = (self.at[tail[ok]] == self.at[ok] + 1) & (words.at[met[ok]] == after[ok])
        ok[ok] = piece[self.at[ok]] == piece[after[ok]]
        at, word = self.at[ok], words.phrase[met[ok]]
        key = self.phrase[ok] * (len(words.head) + 1) + word
        return Postings(at, key, pair(self.digest[self.phrase[ok]], word_digest[after[ok]]))


def _phrases(words: Cut, head: np.ndarray, length: int) -> pa.Array:
    """The phrases that begin at these words, their words joined by a space."""
    columns = [words.vocabulary.take(pa.array(words.ids[head + k])) for k in range(length)]
    return (columns[0] if length == 1 else pc.binary_join_element_wise(*columns, pa.scalar(b" ", words.vocabulary.type))).cast(pa.string())


def level_counts(docs: DataFrame, length: int, maps: list[np.ndarray]) -> DataFrame:
    """(lang, phrase, f) of phrases of ``length`` words whose parts the ``maps`` of shorter phrases have."""
    shared = docs.sparkSession.sparkContext.broadcast(maps)

    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words = cut(part.column("text"), PIECES, fold=True)
        names, lang, lang_digest = _langs(part.column("lang"))
        word_digest = digests(words.vocabulary)[0][words.ids]
        lists = Postings(np.arange(len(words.ids)), lang[words.row] * (len(words.vocabulary) + 1) + words.ids, pair(lang_digest[words.row], word_digest))
        if length > 1:
            lists = postings = lists.frequent(shared.value[0])
            for n in range(2, length + 1):
                lists = lists.extended(postings, words.piece, word_digest, n)
                if n < length:
                    lists = lists.frequent(shared.value[n - 1])
        f = np.bincount(lists.phrase, minlength=len(lists.head))
        yield pa.record_batch([names.take(pa.array(lang[words.row[lists.head]])), _phrases(words, lists.head, length), pa.array(f)], ["lang", "phrase", "f"])

    found = docs.select("text", "lang").mapInArrow(over_parts(run), "lang string, phrase string, f long")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def frequent_map(phrases: DataFrame) -> np.ndarray:
    """The map's bits of (lang, phrase) rows; tasks send the words of the map that they touch, 2^20 at most in all."""

    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words = cut(part.column("text"), PIECES, fold=False)
        first = words.firsts(part.num_rows)
        many, digest = np.diff(first), pair(_langs(part.column("lang"))[2], digests(words.vocabulary)[0][words.ids[first[:-1]]])
        word_digest = digests(words.vocabulary)[0][words.ids]
        for k in range(1, int(many.max(initial=0))):
            on = many > k
            digest[on] = pair(digest[on], word_digest[first[:-1][on] + k])
        at = digest >> np.uint64(64 - BITS)
        slot = (at >> np.uint64(6)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        heads = np.flatnonzero(np.diff(slot[order], prepend=-1))
        bits = np.bitwise_or.reduceat(np.uint64(1) << (at[order] & np.uint64(63)), heads)
        yield pa.record_batch([pa.array(slot[order][heads]), pa.array(bits.view(np.int64))], ["slot", "bits"])

    found = phrases.select(F.col("phrase").alias("text"), "lang").mapInArrow(over_parts(run), "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _part(first: Column, size: Column) -> Column:
    """Some words of the phrase, joined; numbers from 1."""
    return F.array_join(F.slice("words", first, size), " ")


def _wide(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def lowest_cuts(long: DataFrame, known: DataFrame) -> DataFrame:
    """(lang, phrase, a, score, k, l, r): the cut of lowest score, the first of equal ones; parts get their frequency by a join."""
    k = F.col("k")
    sides = F.inline(F.array(F.struct(F.lit(True).alias("left"), _part(F.lit(1), k).alias("part")), F.struct(F.lit(False).alias("left"), _part(k + 1, F.col("size") - k).alias("part"))))
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select("lang", "phrase", F.col("f").alias("a"), "k", sides)
    found = cuts.join(known.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    by_cut = found.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    # Decimals: a product may pass 64 bits.
    by_cut = by_cut.withColumn("scaled", _wide("a") * F.lit(2_000_000).cast("decimal(7,0)")).withColumn("sum", _wide("l") + _wide("r")).withColumn("score", F.expr("scaled div sum"))
    return by_cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low")).select("lang", "phrase", "a", "low.*")


def most_around(long: DataFrame) -> DataFrame:
    """(lang, phrase, most): how often the most frequent longer phrase around a phrase of two words or more occurs."""
    sizes = F.sequence(F.lit(2), F.col("size") - 1)
    inner = long.filter(F.col("size") > 2).withColumn("_m", F.explode(sizes)).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("_m") + 1)))
    return inner.select("lang", _part(F.col("_i"), F.col("_m")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words.

    a is the phrase's frequency, l and r those of the two parts of its lowest-scoring cut, n the words of the language,
    score 2,000,000 a / (l + r), floored. Phrases of fewer than ``least`` occurrences are no candidates, nor those that
    a longer candidate contains with ``inside`` of 100 of their occurrences.
    """
    scratch = Scratch(docs.sparkSession)
    with rows_a_batch(docs.sparkSession, ROWS):
        words = scratch.keep(level_counts(docs, 1, []), "words")
        totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
        levels, maps = [words.filter(F.col("f") >= least)], []
        for n in range(2, longest + 1):
            maps.append(frequent_map(levels[-1]))
            levels.append(scratch.keep(level_counts(docs, n, maps).filter(F.col("f") >= least), f"level{n}"))
    known = reduce(DataFrame.unionByName, levels)
    long = reduce(DataFrame.unionByName, levels[1:]).withColumn("words", F.split("phrase", " ", -1)).withColumn("size", F.size("words"))
    scored, around = lowest_cuts(long, known), most_around(long)
    kept = scored.join(around, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (_wide("most") * 100 < _wide("a") * inside))
    # One order of all languages; a language's first number makes its ranks.
    order = [F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    found = numbered(kept, order, "_number", lambda df: scratch.keep(df, "ranked"))
    of_lang = found.groupBy("lang").agg(F.min("_number").alias("_first")).join(totals, "lang")
    few = of_lang.limit(FEW + 1).count() <= FEW  # else by a join that can split a language
    ranked = found.join(F.broadcast(of_lang) if few else of_lang, "lang").withColumn("rank", F.col("_number") - F.col("_first") + 1)
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents)
), places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces WHERE len(w) > 0),
grams AS (SELECT lang, w[i:i + m - 1] AS p, m FROM places, (SELECT unnest(range(1, {LONGEST + 1})) AS m) WHERE i + m - 1 <= len(w)),
counts AS (SELECT lang, p, m, count(*) AS f FROM grams GROUP BY lang, p, m HAVING count(*) >= {LEAST}),
totals AS (SELECT lang, CAST(count(*) AS BIGINT) AS n FROM places GROUP BY lang),
cuts AS (SELECT lang, p, m, f AS a, k FROM (SELECT *, unnest(range(1, m)) AS k FROM counts WHERE m > 1)),
scored AS (
  SELECT c.lang, c.p, c.m, a, x.f AS l, y.f AS r, k, CAST((CAST(a AS HUGEINT) * 2000000) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM cuts c JOIN counts x ON c.lang = x.lang AND x.p = c.p[1:k] JOIN counts y ON c.lang = y.lang AND y.p = c.p[k + 1:]
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
subs AS (SELECT lang, p[i:i + s - 1] AS p, f FROM counts, (SELECT unnest(range(1, {LONGEST})) AS i), (SELECT unnest(range(2, {LONGEST})) AS s) WHERE s < m AND i + s - 1 <= m),
around AS (SELECT lang, p, max(f) AS most FROM subs GROUP BY lang, p),
kept AS (SELECT q.lang, array_to_string(q.p, ' ') AS phrase, a, l, r, score FROM lowest q LEFT JOIN around USING (lang, p) WHERE most IS NULL OR 100 * CAST(most AS HUGEINT) < {INSIDE} * CAST(a AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
