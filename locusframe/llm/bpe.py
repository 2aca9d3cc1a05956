"""Byte-level BPE by prefix-sharing trie traversal.

A text is cut into pieces by the pre-tokenizer's pattern. The distinct pieces of a batch that were not seen before
are inserted into a trie, here as their sorted list: a depth-first traversal of a trie meets words in sorted order,
and the state of a shared prefix stays on the stack. A state is the last token of a prefix's encoding. BPE has the
property that a sequence of tokens is an encoding if and only if each pair of neighbours is, so the last token of a
prefix is the one token that ends there and pairs with the last token of the prefix before it; shared prefixes are
encoded once. Encodings are read off by walking back along last tokens.

Edge cases: a null text is empty and has no token; an empty table gives an empty result; texts of any length are
processed whole; rows that repeat are encoded alike; extra columns are left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The pattern by which byte-level BPE of this family cuts texts; white space as in Unicode's property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ˁ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\t-\\r \x85\xa0"
_ANY = regex.compile(PATTERN)
#: The same for texts of Latin letters only, in the standard library's engine, which is four times as fast.
_LATIN = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile("[ɐ-\U0010ffff]")
#: Pieces whose encoding a worker remembers; beyond, it starts anew. Longer pieces than LONG are forgotten with their
#: batch, so that the number bounds the bytes.
CACHE, LONG = 600_000, 64
#: Pairs of tokens that a worker remembers.
PAIRS = 2_000_000


def vocabulary_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself where printable, else from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def split_text(text: str) -> list[str]:
    return (_ANY if not text.isascii() and _BEYOND.search(text) else _LATIN).findall(text)


class TrieEncoder:
    """Encodes batches of distinct words; remembers the pairs of tokens that it has tried."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        self.size = {i: len(b) for b, i in self.ids.items()}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in special.items()}
        self.text_of = {str(i): b for i, b in self.bytes.items()}  # decoding starts from decimal ids
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            left, right = (bytes(letters[c] for c in x) for x in (a, b))
            self.ranks[self.ids[left], self.ids[right]] = rank, self.ids[left + right]
        #: A token that no merges make never ends a prefix.
        self.made = {b: i for b, i in self.ids.items() if self.merge(b) == [i]}
        self.longest = max(map(len, self.made))
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pairs: dict[int, bool] = {}

    def merge(self, text: bytes) -> list[int]:
        """Plain BPE, merge by merge; only for pairs of tokens, which are short."""
        out = [self.ids[text[i : i + 1]] for i in range(len(text))]
        while len(out) > 1:
            best = min(((self.ranks[p], i) for i, p in enumerate(zip(out, out[1:], strict=False)) if p in self.ranks), default=None)
            if best is None:
                break
            (_, joined), i = best
            out[i : i + 2] = [joined]
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether two tokens stay as they are side by side; remembered in ``pairs``."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        known = self.pairs[a << 32 | b] = (a, b) not in self.ranks and self.merge(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Each distinct word with its ids, in sorted order."""
        last: list[int] = []  # by length of the prefix: its last token
        made, pairs, longest, size = self.made.get, self.pairs.get, self.longest, self.size
        before = b""
        for word in sorted(words):
            del last[len(commonprefix((before, word))) :]
            for end in range(len(last) + 1, len(word) + 1):
                for start in range(end - longest if end > longest else 0, end):  # longest token first
                    token = made(word[start:end])
                    if token is not None:
                        if start:
                            a = last[start - 1]
                            known = pairs(a << 32 | token)
                            if not (self.compatible(a, token) if known is None else known):
                                continue
                        last.append(token)
                        break
            out, end = [], len(word)
            while end:
                out.append(last[end - 1])
                end -= size[last[end - 1]]
            yield word, out[::-1]
            before = word


@lru_cache(maxsize=2)
def trie_encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


def pieces_of(texts: list[str | None], cut: re.Pattern[str] | None) -> list[list[str]]:
    """The pieces of each text; the strings of special tokens are pieces of their own."""
    out = []
    for text in texts:
        if cut is None or not cut.search(text or ""):
            out.append(split_text(text or ""))
        else:
            out.append([p for k, part in enumerate(cut.split(text)) for p in ([part] if k % 2 else split_text(part))])
    return out


def unseen(batch: list[list[str]], known: dict) -> set[str]:
    """Pieces without an entry in ``known``, which starts anew when it is full."""
    fresh = set().union(*batch).difference(known)  # walks the batch; a difference from known.keys() walks all that is known
    if len(known) + len(fresh) > CACHE:
        known.clear()
        fresh = set().union(*batch)
    return fresh


def forget(fresh: set[str], known: dict) -> None:
    for s in fresh:
        if len(s) > LONG:
            del known[s]


def _encoded(texts: list[str | None], path: str, known: dict[str, str]) -> Iterator[tuple[int, str, str]]:
    """Number of ids, ids as decimal text, decoded text."""
    coder = trie_encoder(path)
    batch = pieces_of(texts, coder.cut)
    fresh = unseen(batch, known)
    for s in fresh & coder.special.keys():
        known[s] = str(coder.special[s])
    names = {p.encode(): p for p in fresh - coder.special.keys()}
    for word, ids in coder.encode_words(names):
        known[names[word]] = ",".join(map(str, ids))
    of, text_of = known.__getitem__, coder.text_of.__getitem__
    for pieces in batch:
        ids = ",".join(map(of, pieces))
        each = ids.split(",") if ids else []
        yield len(each), ids, b"".join(map(text_of, each)).decode("utf-8", "replace")
    forget(fresh, known)


_KNOWN: dict[str, dict[str, str]] = {}


def slices(column: pa.Array, most: int = 1 << 21) -> Iterator[slice]:
    """Runs of rows with about ``most`` bytes of text each, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(pc.binary_length(column).to_pylist()):
        if i > start and total + (n or 0) > most:
            yield slice(start, i)
            start, total = i, 0
        total += n or 0
    if len(column) > start:
        yield slice(start, len(column))


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by commas) and decoded text of each document."""
    path = vocabulary_path(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _KNOWN.setdefault(path, {})
        for batch in batches:
            for part in slices(batch.column("text")):
                rows = batch.slice(part.start, part.stop - part.start)
                got = list(_encoded(rows.column("text").to_pylist(), path, known))
                yield pa.record_batch([rows.column("doc_id"), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.string()), pa.array([x[2] for x in got], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
