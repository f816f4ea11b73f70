"""Brute-force versions of the operators, in plain Python."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

WHITE = " \t\n\x0b\x0c\r"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def low(text):
    return (text or "").translate(LOWER)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def line_dedup(docs):
    """{doc_id: (n_lines, n_dropped, kept text)} of (doc_id, text) with distinct ids."""
    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            holders[low(line.strip(WHITE))].add(doc)
    out = {}
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            key = low(line.strip(WHITE))
            if len(key) < 10 or min(holders[key]) == doc:
                kept.append(line)
        out[doc] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def shingles(text, size):
    words = WORDS.findall(low(text))
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def near_duplicates(docs, size, parts=(80, 100)):
    """{doc_id: (n_shingles, component_id)} of (doc_id, text) with distinct ids."""
    sets = {doc: shingles(text, size) for doc, text in docs}
    parent = {doc: doc for doc in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for doc, own in sets.items():
        for shingle in own:
            holders[shingle].append(doc)
    for a, b in {tuple(sorted(p)) for docs_ in holders.values() for p in itertools.combinations(docs_, 2)}:
        shared = len(sets[a] & sets[b])
        if parts[1] * shared >= parts[0] * (len(sets[a]) + len(sets[b]) - shared):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {doc: (len(own), root(doc)) for doc, own in sets.items()}


def contamination(docs, items, window=10):
    """{doc_id: (n_words, hit word numbers, items)}."""
    windows = defaultdict(set)
    for item, text in items:
        words = ITEM_WORDS.findall(low(text))
        for i in range(max(1, len(words) - window + 1) if words else 0):
            windows[tuple(words[i : i + window])].add(item)
    out = {}
    for doc, text in docs:
        words, hit, found = ITEM_WORDS.findall(low(text)), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                got = windows.get(tuple(words[i : i + size]))
                if got:
                    hit.update(range(i, i + size))
                    found |= got
        out[doc] = (len(words), hit, found)
    return out
