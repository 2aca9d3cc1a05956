"""N-gram Jaccard join by partitioning the universe of shingles.

Sets are grouped into bands of sizes. A band's scheme hashes the universe into segments; two sets of Jaccard
similarity ``T`` per cent or more differ in at most ``H = (100 - T) (|r| + |s|) / (100 + T)`` shingles, so among
segments whose allotments sum to more than H, one of allotment 1 is equal in both sets, or one of allotment 2 differs
by one shingle at most. The latter are found by one-deletion neighbourhoods. How many segments get 2 is chosen by the
cost of a band: rows in the index against the risk that small segments agree by chance. In a second, measured step
each set drops its fullest buckets, as many as it has segments more than it needs. The smaller set of a pair
probes; a set is indexed in its own band, and in the band below where a smaller partner may stand.

Equal sets are one class. The index is made of texts in one pass, straight into the shuffle that brings buckets
together, and only buckets of several classes are written. Within a batch one set speaks for all that share its
segment: the others are marked as meeting it and are dealt out by themselves, so that a segment that very many sets
share is no hot key. A group of similar sets would meet in each bucket of its segments, so links are not sought pair
by pair: each set is compared with two pivots of its buckets, components are formed, and buckets within one component
are done, as no further link changes the result. A pivot may be an odd one of its group, which few others link with, so
each large group of buckets then draws sets at random, which its other sets are compared with, until the pairs left are
about as few as the rows. Groups of few sets, most of which met by chance, have no part in that. What is left, pairs of
different components in one bucket, is compared in full. Statistics of buckets are partial aggregates that are written
and joined back, which Spark splits where they are skewed. Parities of hashed shingles reject most pairs exactly (their difference bounds the sets' difference from
below), short ones as a condition of the join itself, so that rejected pairs are never rows; the rest is verified on
the whole sets, which are read from the texts then; a bitmap of fixed size over their documents keeps most other texts
out of that shuffle.

Shingles are compared by 64-bit hashes, sets by a 128-bit digest of these; that two of a pair's shingles agree by
chance has a probability of about the product of the sets' sizes / 2^64.

Edge cases: null and empty texts link with nothing; a text of fewer words than a shingle is one shingle; texts of any
length are processed whole; rows that repeat a doc_id are sets of their own, each with the smallest doc_id that it
reaches by links, in whatever order rows come; a null doc_id gets a null component and links with nothing; an empty
table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from math import exp, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bpe import slices
from .common import Scratch, rows_a_batch, table, unused
from .components import components

SHINGLE, T = 3, 90
#: Cost of a segment that sets agree in by chance, against a row of the index.
RISK = 10_000.0
#: Rows of a bucket beyond which it's grouped with others.
CROWDED = 8
#: Pivots that each set is compared with before the rest.
PIVOTS = 2
#: Sets of a group of buckets up to which it's compared in full at once; of larger ones, sets drawn in a round and rounds at most.
FEW, DRAWN, ROUNDS = 32, 16, 8
#: Places of the bitmap of documents whose texts are read again (2 MB), and of one row of it.
PLACES, ROW_PLACES = 1 << 24, 1 << 15
#: Digests that a task remembers, so that equal sets enter the index once a task.
SEEN = 500_000
#: Words of the short parities.
BRIEF = 8
_M1, _M2, _P1, _P2, _P3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: By byte: A-Z lowered, white space, a number to hash with.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _P1)


def word_hashes(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that stand side by side in ``raw``, and by text the number of words before it.

    A word's hash is the sum of numbers of its bytes times odd numbers of their places, mixed with its length.
    """
    low = _LOWER[raw]
    at = np.flatnonzero(~_BLANK[low])
    fresh = np.diff(at, prepend=-2) > 1
    inner = np.searchsorted(at, cuts[:-1])  # a text's first letter begins a word
    fresh[inner[inner < len(at)]] = True
    starts = np.flatnonzero(fresh)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(cuts), np.int64)
    sizes = np.diff(starts, append=len(at))
    place = np.arange(len(at)) - np.repeat(starts, sizes)
    odd = _mix(np.arange(1, sizes.max() + 1, dtype=np.uint64) * _P2) | np.uint64(1)
    sums = np.add.reduceat(_BYTE[low[at]] * odd[place], starts)
    return _mix(sums + sizes.astype(np.uint64) * _P3), np.searchsorted(at[starts], cuts)


def _pieces(raw: np.ndarray, most: int = 1 << 21) -> Iterator[np.ndarray]:
    """A text in pieces that end before white space."""
    at = 0
    while len(raw) - at > most:
        blank = np.flatnonzero(_BLANK[raw[at + 1 : at + most]])
        end = at + most
        if len(blank):
            end = at + 1 + int(blank[-1])
        else:  # a word of more than a piece
            while end < len(raw) and not _BLANK[raw[end]]:
                end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text of an array."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    if len(texts) == 1 and len(raw) > 1 << 22:
        w = np.concatenate([word_hashes(x, np.array([0, len(x)]))[0] for x in _pieces(raw)])
        cuts = np.array([0, len(w)])
    else:
        w, cuts = word_hashes(raw, ends)
    joined = np.zeros(max(0, len(w) - size + 1), np.uint64)
    for k in range(size):
        joined = _mix((joined + _P1) ^ w[k : k + len(joined)] * (_P2 if k % 2 else _P3))
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a >= size:
            h = np.sort(joined[a : b - size + 1])
            out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
        else:  # the whole text is one shingle, or it has no word
            h = np.zeros(min(1, b - a), np.uint64)
            for k in range(b - a):
                h = _mix((h + _P1) ^ w[a + k : a + k + 1] * (_P2 if k % 2 else _P3))
            out.append(h + np.uint64(1))
    return out


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.string()), size)[0]


def differ(n: int, t: int = T) -> int:
    """How many shingles a set of n and a partner may differ in at most."""
    return (100 - t) * (n + n * 100 // t) // (100 + t)


@lru_cache
def edges(t: int = T) -> tuple[int, ...]:
    """First sizes of the bands, each at least 1.25 times the one before, so that partners are one band apart at most."""
    out = [next(n for n in range(1, 1000) if differ(n, t))]
    while out[-1] < 1 << 40:
        out.append(-(-out[-1] * 5 // 4))
    return tuple(out)


@lru_cache
def scheme(band: int, t: int = T) -> tuple[int, int, int]:
    """Of a band: segments with neighbourhoods, spare segments, all segments; the cheapest by rows and risk.

    Sets agree by chance in segments in which both hold nothing. A set may drop as many buckets as it has spare segments,
    so the risk is that it has more empty ones (a bound of the Poisson tail), or neighbourhoods of one shingle.
    """
    low, top = edges(t)[band], edges(t)[band + 1] - 1
    most = differ(top, t) + 1

    def cost(two: int, spare: int) -> float:
        one = max(0, most - 2 * two)
        n = two + one + spare
        filled = low / n
        empty, more = (one + spare) * exp(-filled), spare + 1
        excess = exp(more - empty - more * log(more / empty)) if one and empty < more else float(one > 0)
        return one + spare + two * (1 + filled) + RISK * (excess + two * exp(-filled) * (1 + filled))

    halves = {*range(min((most + 1) // 2, 24) + 1), (most + 1) // 2}
    spares = sorted({0, *(k for e in range(96) if (k := round(2 ** (e / 4))) <= most)})
    two, spare = min(((d, k) for d in halves for k in (spares if most > 2 * d else [0])), key=lambda x: (cost(*x), x))
    return two, spare, two + max(0, most - 2 * two) + spare


def signatures(h: np.ndarray, band: int, upto: int | None, t: int = T) -> tuple[np.ndarray, np.ndarray]:
    """Of a set in a band's scheme: hashes of the neighbourhoods of its first segments, and of its other segments up to a number."""
    two, _, n = scheme(band, t)
    segment = ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    cuts = np.searchsorted(segment, np.arange(n + 1, dtype=np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)))
    whole = sums[cuts[1:]] - sums[cuts[:-1]]
    salt = (np.arange(n, dtype=np.uint64) + np.uint64(1 + (band << 24))) * _P1
    near = [np.concatenate((whole[j : j + 1], whole[j] - h[cuts[j] : cuts[j + 1]])) + salt[j] for j in range(two)]
    end = n if upto is None else min(n, upto)
    return _mix(np.concatenate(near)) if near else np.zeros(0, np.uint64), _mix(whole[two:end] + salt[two:end])


def parities(h: np.ndarray) -> bytes:
    """Parities of the counts of hashes by their low bits, about four bits a shingle."""
    bits = 1 << min(13, max(8, (4 * len(h) - 1).bit_length()))
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def brief(h: np.ndarray) -> np.ndarray:
    """Parities in BRIEF 64-bit words, for conditions of joins."""
    bits = np.bincount((h & np.uint64(64 * BRIEF - 1)).astype(np.int64), minlength=64 * BRIEF).astype(np.uint8) & 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference; the longer parities are folded to the shorter's length."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)))


def digest(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def described(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, row (a hash of the text), n, digest and parities of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                rows = batch.slice(part.start, part.stop - part.start)
                hs = shingle_sets(rows.column("text"), shingle)
                made = [pa.array([len(h) for h in hs], pa.int64()), pa.array([digest(h) for h in hs], pa.binary()), pa.array([parities(h) if len(h) else b"" for h in hs], pa.binary()), _lists([brief(h) for h in hs])]
                yield pa.record_batch([rows.column("doc_id"), rows.column("row"), *made], ["doc_id", "row", "n", "digest", "sketch", "brief"])

    return with_row(docs).select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row binary, n long, digest binary, sketch binary, brief array<long>")


def with_row(docs: DataFrame) -> DataFrame:
    """Tells rows of one doc_id apart by their text."""
    return docs.withColumn("row", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))))


#: Marks of an entry of the index: of the set's own band, met by others of its batch; above them, for segments that may
#: be spared, how many of the set's may.
OWN, MET, SPARE = 1, 2, 2


def entries(docs: DataFrame, shingle: int = SHINGLE, t: int = T) -> DataFrame:
    """The index: sig, name (of the set, from its digest), n, marks, and apart, which is not 0 for sets that met another of their batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch.column("text")):
                sigs, names, sizes, marks, counts = [], [], [], [], []
                for h in shingle_sets(batch.column("text").slice(part.start, part.stop - part.start), shingle):
                    n = len(h)
                    band = bisect_right(edges(t), n) - 1
                    if band < 0 or (own := digest(h)) in seen:
                        continue
                    seen.add(own)
                    d, spare, _ = scheme(band, t)
                    two, one = signatures(h, band, d + max(0, differ(n, t) + 1 - 2 * d) + spare, t)
                    below = np.concatenate(signatures(h, band - 1, None, t)) if band and n * t <= (edges(t)[band] - 1) * 100 else one[:0]
                    sigs += [two, one, below]
                    marks.append(np.repeat(np.array([OWN, OWN | spare << SPARE, 0], np.int32), [len(two), len(one), len(below)]))
                    names.append(int.from_bytes(own[:8], "big", signed=True))
                    sizes.append(n)
                    counts.append(len(marks[-1]))
                if sigs:
                    sig, mark = np.concatenate(sigs).view(np.int64), np.concatenate(marks)
                    name = np.repeat(np.array(names, np.int64), counts)
                    _, first, group, times = np.unique(sig, return_index=True, return_inverse=True, return_counts=True)
                    mark |= np.where(times[group] > 1, MET, 0).astype(np.int32)
                    apart = np.where(first[group] == np.arange(len(sig)), 0, name | 1)
                    yield pa.record_batch([pa.array(sig), pa.array(name), pa.array(np.repeat(np.array(sizes, np.int64), counts)), pa.array(mark), pa.array(apart)], ["sig", "name", "n", "marks", "apart"])
                if len(seen) > SEEN:
                    seen.clear()

    return docs.filter(F.col("doc_id").isNotNull()).select("text").mapInArrow(run, "sig long, name long, n long, marks int, apart long")


def sets(wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc and hashes of (doc, digest, text) rows, of those texts that have the digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                rows = batch.slice(part.start, part.stop - part.start)
                hs = shingle_sets(rows.column("text"), shingle)
                own = [digest(h) == d for h, d in zip(hs, rows.column("digest").to_pylist(), strict=True)]
                yield pa.record_batch([rows.column("doc").filter(pa.array(own, pa.bool_())), _lists([h for h, o in zip(hs, own, strict=True) if o])], ["doc", "hashes"])

    return wanted.select("doc", "digest", "text").mapInArrow(run, "doc long, hashes array<long>")


def perhaps(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id stands in wanted (as of_id), and few others: those that share a place of the bitmap."""
    hashed = lambda x: F.pmod(F.xxhash64(x), F.lit(PLACES))
    stretch, place = (hashed("of_id") / ROW_PLACES).cast("long"), hashed("of_id") % ROW_PLACES
    bits = wanted.groupBy(stretch.alias("of_stretch")).agg(F.bitmap_construct_agg(place).alias("bits"))
    at = hashed("doc_id") % ROW_PLACES
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = docs.join(F.broadcast(bits), (hashed("doc_id") / ROW_PLACES).cast("long") == F.col("of_stretch"))
    return met.filter(F.getbit(byte, (at % 8).cast("int")) == 1).select(*docs.columns)


def shared_buckets(index: DataFrame) -> DataFrame:
    """(sig, name, n, own, spare) of the buckets of the index that hold several sets."""
    bucket = W.partitionBy("sig", "apart")
    met = F.max(F.col("marks").bitwiseAND(MET)).over(bucket) > 0
    several = index.withColumn("lo", F.min("name").over(bucket)).withColumn("hi", F.max("name").over(bucket)).withColumn("met", met).filter("met or lo < hi")
    return several.select("sig", "name", "n", (F.col("marks").bitwiseAND(OWN) > 0).alias("own"), F.shiftright("marks", SPARE).alias("spare")).distinct()


def probing(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(sig, doc, n, probes): each set probes in its own band, but for the fullest buckets that it can spare."""
    sizes = scratch.keep(rows.groupBy(F.col("sig").alias("of_sig")).agg(F.count("*").alias("cost")), "sizes")
    rows = rows.join(sizes, F.col("sig") == F.col("of_sig"))
    full = F.row_number().over(W.partitionBy("doc").orderBy(F.when(F.col("spare") > 0, F.col("cost")).desc_nulls_last(), "sig"))
    return rows.withColumn("probes", F.col("own") & (full > F.col("spare"))).select("sig", "doc", "n", "probes")


def _alike(a: Column, b: Column, t: int = T) -> Column:
    return 100 * F.least(a, b) >= t * F.greatest(a, b)


def mixed(rows: DataFrame, labels: DataFrame | None, scratch: Scratch, step: str) -> DataFrame:
    """Buckets that hold several components and a probing set, with each row's component as comp."""
    rows = rows.select("sig", "doc", "n", "probes")
    if labels is None:
        rows = rows.withColumn("comp", F.col("doc"))
    else:
        rows = rows.join(labels, rows["doc"] == labels["node"], "left").withColumn("comp", F.coalesce("component", "doc")).drop("node", "component")
    several = rows.groupBy(F.col("sig").alias("of_sig")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("probes").alias("any")).filter("lo < hi and any")
    return rows.join(scratch.keep(several.select("of_sig"), f"several-{step}"), F.col("sig") == F.col("of_sig")).drop("of_sig")


def pivots(rows: DataFrame, seed: int, scratch: Scratch, t: int = T) -> DataFrame:
    """One pair (a, b) for each set: the pivot that it meets in most buckets, if of another component."""
    order = F.struct((F.col("doc") if seed == 0 else F.xxhash64(F.lit(seed), "doc")).alias("key"), "doc", "n", "comp")
    first = scratch.keep(rows.groupBy(F.col("sig").alias("of_sig")).agg(F.min(order).alias("p")), f"pivots-{seed}")
    met = rows.join(first, F.col("sig") == F.col("of_sig")).filter((F.col("p.comp") != F.col("comp")) & _alike(F.col("n"), F.col("p.n"), t))
    met = met.groupBy("doc", F.col("p.doc").alias("pivot")).agg(F.count("*").alias("times"))
    best = met.groupBy("doc").agg(F.max_by("pivot", F.struct("times", -F.col("pivot"))).alias("b"))
    return best.select(F.least("doc", "b").alias("a"), F.greatest("doc", "b").alias("b"))


def grouped(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, doc, n, comp, probes, size, other): the rows of mixed buckets, each set once a group of buckets.

    Sets that are alike meet in very many buckets. Crowded buckets are one group if they have the same pivot, so that a
    pair meets in few groups; a group holds the pairs of all of its buckets. size: its sets; other: not of its largest component.
    """
    order = F.struct(F.xxhash64("doc").alias("key"), "doc")
    of_sig = scratch.keep(rows.groupBy(F.col("sig").alias("of_sig")).agg(F.count("*").alias("k"), F.min(order)["doc"].alias("pivot")), "of-sig")
    key = F.when(F.col("k") > CROWDED, F.col("pivot")).otherwise(F.col("sig"))
    rows = rows.join(of_sig, F.col("sig") == F.col("of_sig")).groupBy(key.alias("key"), "doc").agg(F.min("n").alias("n"), F.min("comp").alias("comp"), F.max("probes").alias("probes"))
    return told(scratch.keep(rows, "grouped"), scratch, "first")


def told(rows: DataFrame, scratch: Scratch, step: str) -> DataFrame:
    """Adds size and other to (key, doc, comp, ...); groups of one component go."""
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("k"))
    main = sizes.groupBy(F.col("key").alias("of_key")).agg(F.max(F.struct("k", "comp"))["comp"].alias("main"), F.sum("k").alias("size"), F.count("*").alias("comps")).filter("comps > 1")
    main = scratch.keep(main.select("of_key", "main", "size"), f"main-{step}")
    return rows.join(main, F.col("key") == F.col("of_key")).withColumn("other", F.col("comp") != F.col("main")).drop("of_key", "main")


def relabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of groups with new components; those of a group's largest one are still of one component, so other holds."""
    return rows.drop("comp").join(labels, F.col("doc") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "doc")).drop("node", "component")


def _meet(x: Callable[[str], Column], y: Callable[[str], Column], t: int = T) -> Column:
    """Of two rows of a group, by their columns: different components, of which the smaller set probes, that short parities don't reject."""
    apart = reduce(lambda a, b: a + b, (F.bit_count(F.get(x("brief"), F.lit(k)).bitwiseXOR(F.get(y("brief"), F.lit(k)))) for k in range(BRIEF)))
    probed = (x("probes") & (x("n") <= y("n"))) | (y("probes") & (y("n") <= x("n")))
    return (x("comp") != y("comp")) & _alike(x("n"), y("n"), t) & probed & ((100 + t) * apart <= (100 - t) * (x("n") + y("n")))


def drawn(rows: DataFrame, step: int, scratch: Scratch, t: int = T) -> DataFrame:
    """Pairs (a, b) of a set and one that its group drew at random, and for how many pairs of the group each stands (weight)."""
    sets_drawn = F.array(*(F.min_by(F.struct("doc", "n", "comp", "probes", "brief"), F.xxhash64(F.lit(step * DRAWN + k), "doc")) for k in range(DRAWN)))
    of_key = scratch.keep(rows.groupBy(F.col("key").alias("of_key")).agg(F.count("*").alias("k"), F.array_distinct(sets_drawn).alias("drawn")), f"of-key-{step}")
    near = F.filter("drawn", lambda x: _meet(x.getField, F.col, t))
    met = rows.join(of_key, F.col("key") == F.col("of_key")).select("doc", (F.col("k") / (2 * F.size("drawn"))).alias("weight"), F.explode(F.transform(near, lambda x: x["doc"])).alias("with"))
    return met.select(F.least("doc", "with").alias("a"), F.greatest("doc", "with").alias("b"), "weight")


def remaining(rows: DataFrame, t: int = T) -> DataFrame:
    """Pairs of different components in a group of which the smaller set probes, but for those that parities reject."""
    x = rows.filter("other").select(*(F.col(c).alias(f"x_{c}") for c in ("key", "doc", "n", "probes", "comp", "brief")))
    once = ~F.col("other") | (F.col("x_doc") < F.col("doc"))
    meets = x.join(rows, (F.col("x_key") == F.col("key")) & once & _meet(lambda c: F.col(f"x_{c}"), F.col, t))
    return meets.select(F.least("doc", "x_doc").alias("a"), F.greatest("doc", "x_doc").alias("b")).distinct()


def rejected_not(pairs: DataFrame, classes: DataFrame, t: int = T) -> DataFrame:
    """Pairs that the parities don't reject."""
    one, other = (classes.select(F.col("doc").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}")) for k in ("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, sa, sb = (batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "s_a", "s_b"))
            ok = [(100 + t) * least_difference(sa[i], sb[i]) <= (100 - t) * (na[i] + nb[i]) for i in range(len(a))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    joined = pairs.join(one, "a").join(other, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    return joined.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, own: DataFrame, t: int = T) -> DataFrame:
    """Pairs whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for i in range(len(batch)):
                x, y = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("x", "y"))
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(100 * both >= t * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one, other = own.select(F.col("doc").alias("a"), F.col("hashes").alias("x")), own.select(F.col("doc").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def classified(docs: DataFrame, scratch: Scratch, shingle: int = SHINGLE, t: int = T) -> tuple[DataFrame, DataFrame]:
    """Two tables: doc_id, row, n and digest of each row, and of each digest its component's number (node) and smallest doc_id (first).

    Classes of equal sets are numbered; a class's rows in the index have its name, half of the digest. Classes that
    share a name and a size would get each other's buckets too, which the verification of pairs settles.
    """
    spark = docs.sparkSession
    rows = scratch.keep(described(docs, shingle), "described")
    some = rows.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    of_digest = some.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "sketch", "brief")).alias("least"))
    name = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    classes = scratch.keep(of_digest.select(F.monotonically_increasing_id().alias("doc"), "digest", name.alias("name"), "least.*"), "classes")

    found = scratch.keep(shared_buckets(entries(docs, shingle, t)), "index")
    numbered = classes.select("doc", F.col("name").alias("of_name"), F.col("n").alias("of_n"))
    found = found.join(numbered, (F.col("name") == F.col("of_name")) & (F.col("n") == F.col("of_n"))).select("sig", "doc", "n", "own", "spare")
    probes = scratch.keep(probing(found, scratch), "probes")
    buckets = scratch.keep(mixed(probes, None, scratch, "first"), "buckets")
    scratch.drop("index", "sizes", "probes", "several-first")

    def links_of(pairs: DataFrame, step: str) -> DataFrame:
        """Those of the pairs, which are distinct, that are links."""
        pairs = scratch.keep(rejected_not(pairs, classes, t), f"pairs-{step}")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct().join(classes.select("doc", "digest", F.col("doc_id").alias("of_id")), "doc")
        wanted = scratch.keep(wanted, f"wanted-{step}")
        own = scratch.keep(sets(perhaps(docs.select("doc_id", "text"), wanted).join(wanted, F.col("doc_id") == F.col("of_id")), shingle), f"sets-{step}")
        with rows_a_batch(spark, 256):  # a row holds two sets
            links = scratch.keep(verified(pairs, own, t), f"links-{step}")
        scratch.drop(f"pairs-{step}", f"wanted-{step}", f"sets-{step}")
        return links

    links = links_of(reduce(DataFrame.unionByName, (pivots(buckets, k, scratch, t) for k in range(PIVOTS))).distinct(), "pivots")
    labels = components(links, scratch)
    rows_left = scratch.keep(mixed(buckets, labels, scratch, "rest"), "left")
    scratch.drop("buckets", "several-rest", *(f"pivots-{k}" for k in range(PIVOTS)))
    groups = scratch.keep(grouped(rows_left, scratch).join(classes.select("doc", "brief"), "doc"), "mixed")
    scratch.drop("left", "of-sig", "grouped", "main-first")
    linked = lambda more: components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), scratch)
    few, large = groups.filter(F.col("size") <= FEW), groups.filter(F.col("size") > FEW)
    rows_in_all, rows_in_large = groups.agg(F.count("*"), F.count_if(F.col("size") > FEW)).first()
    for k in range(ROUNDS if rows_in_large else 0):
        pairs = scratch.keep(drawn(large, k, scratch, t), f"drawn-{k}")
        if (pairs.agg(F.sum("weight")).first()[0] or 0) <= rows_in_all:
            break
        more = links_of(pairs.select("a", "b").distinct(), f"drawn-{k}")
        if more.isEmpty():
            break
        labels = linked(more)
        few = relabelled(groups.filter(F.col("size") <= FEW), labels)
        again = scratch.keep(relabelled(large.drop("size", "other"), labels), f"relabelled-{k}")
        large = scratch.keep(told(again, scratch, str(k)), f"mixed-{k}")
        scratch.drop(f"drawn-{k}", f"links-drawn-{k}", f"of-key-{k}", f"relabelled-{k}", f"main-{k}", f"mixed-{k - 1}")
    rest = links_of(remaining(few.unionByName(large), t), "rest")
    scratch.drop("mixed", *(f"{x}-{k}" for k in range(ROUNDS) for x in ("mixed", "drawn", "of-key")))
    if not rest.isEmpty():
        labels = linked(rest)

    member = labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())
    group = classes.select("digest", "doc", "doc_id").join(member, F.col("doc") == F.col("node"), "left").select("digest", F.coalesce("component", "doc").alias("node"), "doc_id")
    group = scratch.keep(group, "groups")
    first = group.groupBy(F.col("node").alias("of_node")).agg(F.min("doc_id").alias("first"))
    named = scratch.keep(group.join(first, F.col("node") == F.col("of_node")).select("digest", "node", "first"), "named")
    scratch.drop("classes", "groups", "links-pivots", "links-rest")
    return rows.select("doc_id", "row", "n", "digest"), named


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, t: int = T) -> DataFrame:
    """doc_id, n_shingles, component_id, one row for each row of ``docs``."""
    rows, named = classified(docs, Scratch(docs.sparkSession), shingle, t)
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    component = F.when(linked, F.col("first")).otherwise(F.col("doc_id"))
    return rows.join(named, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def first_of_group(docs: DataFrame, shingle: int = SHINGLE, t: int = T) -> DataFrame:
    """One document of each group, the row with its smallest doc_id (of several, that with the smallest hash of the text).

    Texts without words are groups of their own; of rows that repeat doc_id and text one stays; all without a doc_id stay.
    """
    scratch = Scratch(docs.sparkSession)
    rows, named = classified(docs, scratch, shingle, t)
    rows = rows.filter(F.col("doc_id").isNotNull())
    grouped = rows.filter("n > 0").join(named, "digest").groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("k")).select("k.*")
    alone = rows.filter("n = 0").select("doc_id", "row").distinct()
    chosen = scratch.keep(grouped.unionByName(alone).select(F.col("doc_id").alias("of_id"), F.col("row").alias("of_row")), "chosen")
    key = unused(docs, "row")
    own = docs.filter(F.col("doc_id").isNotNull()).withColumn(key, F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))))
    own = own.join(chosen, (own["doc_id"] == chosen["of_id"]) & (own[key] == chosen["of_row"]), "left_semi").dropDuplicates(["doc_id", key]).drop(key)
    return own.unionByName(docs.filter(F.col("doc_id").isNull()))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
