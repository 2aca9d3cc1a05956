"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def smallest_linked(nodes, linked):
    """node -> smallest node of its component; linked(a, b) of all pairs."""
    nodes, root = sorted(nodes), {}
    for n in nodes:
        root[n] = n

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def chats(rows):
    """rows: (conv_id, turn, role, text) -> conv_id: (n, turns digest, loss length, loss digest)."""
    first = lambda x: (x is not None, x)  # noqa: E731  nulls first
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((first(turn), first(role), first(text), role or "", text or ""))
    out = {}
    for conv, turns in by_conv.items():
        turns.sort(key=lambda t: t[:3])
        whole = "".join(f"{t[3]}\n{t[4]}\n" for t in turns)
        loss = "".join(t[4] for t in turns if t[3] == "assistant")
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def licenses(text):
    """n_words, n_base, first_word, last_word, base_labels."""
    words = LICENSE_WORD.findall((text or "").translate(LOWER))
    at, labels = [], set()
    for label, phrase in PHRASES.items():
        parts = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        at += here
        labels |= {label} if here else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def shingles(text, size=3):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def jaccard_components(docs, size=3, t=90):
    """docs: {doc_id: text} -> {doc_id: (n_shingles, component_id)}."""
    sets = {d: shingles(x, size) for d, x in docs.items()}

    def linked(a, b):
        x, y = sets[a], sets[b]
        return bool(x and y) and 100 * len(x & y) >= t * len(x | y)

    roots = smallest_linked(sets, linked)
    return {d: (len(sets[d]), roots[d]) for d in sets}


def cosine_components(rows, least=0.93):
    """rows: (vec_id, vector, label) -> {vec_id: (n_links, component_id, kept)}."""
    unit = {}
    for i, x, label in rows:
        ok = label is not None and x is not None and all(v is not None and np.isfinite(v) for v in x) and any(x)
        if ok:
            v = np.array(x, np.float32).astype(np.float64)
            unit[i] = (label, v / np.linalg.norm(v))

    def linked(a, b):
        if a not in unit or b not in unit or unit[a][0] != unit[b][0] or len(unit[a][1]) != len(unit[b][1]):
            return False
        return float(unit[a][1] @ unit[b][1]) >= least

    ids = [r[0] for r in rows]
    roots = smallest_linked(ids, linked)
    return {i: (sum(linked(i, j) for j in ids if j != i), roots[i], roots[i] == i) for i in ids}


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def url_rule(url):
    """host, path, rule, verdict of the rule."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.translate(LOWER)
    best = (None, None)
    for kind, rule in URL_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(rule) > len(best[0] or ""):
            best = (rule, kind)
    return host, path, *best


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    repeated = {k for i, w in enumerate(windows) if times[w] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated), n < 20 or 100 * len(repeated) > 30 * n


def mix_targets(sizes, weights=(5, 2, 1)):
    """sizes: {source: size} -> {source: exact target}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, budget, target = set(order), Fraction(3, 2) * sum(sizes.values()), {}
    while left:
        total = sum(weight[s] for s in left)
        over = {s for s in left if budget * weight[s] / total > 2 * sizes[s]}
        for s in over or left:
            target[s] = Fraction(2 * sizes[s]) if over else budget * weight[s] / total
        budget -= sum(target[s] for s in over)
        left -= over or left
    return target
