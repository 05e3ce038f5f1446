"""Plain versions that the operators are held against."""

import re
import zlib
from collections import Counter, defaultdict


def held(key, parts):
    return key is not None and zlib.crc32(str(key).encode()) % parts == 2


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def jaccard_components(docs, percent=80):
    """(key, text) rows with distinct keys: key -> (set size, least key reachable)."""
    sets = {k: shingles(t) for k, t in docs}
    up = {k: k for k in sets}

    def find(a):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    holders = defaultdict(list)
    for k in sorted(sets):
        common = Counter(o for s in sets[k] for o in holders[s])
        for o, n in common.items():
            if 100 * n >= percent * (len(sets[k]) + len(sets[o]) - n):
                a, b = find(k), find(o)
                up[max(a, b)] = min(a, b)
        for s in sets[k]:
            holders[s].append(k)
    return {k: (len(sets[k]), find(k)) for k in sets}


def suffix_spans(docs, length=50):
    """(key, bytes) rows, null keys last: for each row its removed bytes as a mask."""
    big = float("inf")
    first = {}
    for k, b in sorted(docs, key=lambda d: big if d[0] is None else d[0]):
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], big if k is None else k)
    out = []
    for k, b in docs:
        mask, end = bytearray(len(b)), 0
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (big if k is None else k):
                for j in range(max(i, end), i + length):
                    mask[j] = 1
                end = i + length
        out.append(mask)
    return out


def runs(mask):
    return sum(1 for j in range(len(mask)) if mask[j] and (j == 0 or not mask[j - 1]))
