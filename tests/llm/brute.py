"""Plain versions of the operators, for comparison."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def lower(text):
    return (text or "").translate(LOWER)


def shingles(text, k=5):
    w = SPACED.findall(lower(text))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def jaccard_components(rows):
    """rows: (id, text); the (id, size, component) of each, by comparing all pairs."""
    sets = [(i, shingles(x)) for i, x in rows]
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)].append(i)
    return [(i, len(s), min(least[find(a)], default=None) if s else i) for a, (i, s) in enumerate(sets)]


def substring(rows, window=20):
    """rows: (id, text) of different ids; {id: (words, removed, kept text)}."""
    seen, out = set(), {}
    for i, x in sorted(rows):
        w, gone = SPACED.findall(x or ""), set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone.update(range(k, k + window))
            seen.add(key)
        out[i] = (len(w), len(gone), " ".join(y for k, y in enumerate(w) if k not in gone))
    return out


def contamination(docs, items, window=13):
    """{id: (words, hit words, items)}."""
    patterns = defaultdict(lambda: defaultdict(set))
    for i, x in items:
        w = ALNUM.findall(lower(x))
        m = min(window, len(w))
        for k in range(len(w) - m + 1) if m else ():
            patterns[m][tuple(w[k : k + m])].add(i)
    out = []
    for i, x in docs:
        w, hit, found = ALNUM.findall(lower(x)), set(), set()
        for m, those in patterns.items():
            for k in range(len(w) - m + 1):
                if own := those.get(tuple(w[k : k + m])):
                    found |= own
                    hit.update(range(k, k + m))
        out.append((i, len(w), len(hit), sorted(str(f) for f in found if f is not None)))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
