"""Plain Python versions of the operators, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Groups:
    def __init__(self, nodes):
        self.parent = {n: n for n in nodes}

    def find(self, n):
        while self.parent[n] != n:
            n = self.parent[n]
        return n

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def shingles(text):
    words = [w.translate(LOWER) for w in WORD.findall(text or "")]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def ngram_groups(docs):
    sets = {k: shingles(t) for k, t in docs if k is not None}
    groups = Groups(sets)
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                groups.join(a, b)
    return {k: (len(sets[k]), groups.find(k)) for k in keys}


def repeats(docs, window=50):
    first = {}
    for k, t in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        words = WORD.findall(t or "")
        for i in range(len(words) - window + 1):
            first.setdefault(tuple(words[i:i + window]), k)
    out = {}
    for k, t in docs:
        words = WORD.findall(t or "")
        gone = set()
        for i in range(len(words) - window + 1):
            if k is not None and first[tuple(words[i:i + window])] < k:
                gone |= set(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[k] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    triples = list(zip(words, words[1:], words[2:]))
    seen, covered = Counter(triples), set()
    for i, t in enumerate(triples):
        if seen[t] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [s for s in text.split("\n") if WORD.search(s)]
    return len(words), sum(map(len, words)), sum(text.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def removed_lines(docs, percent, least):
    lines = [(k, i, set(WORD.findall(s))) for k, t in docs if k is not None for i, s in enumerate((t or "").split("\n"))]
    lines = sorted((x for x in lines if len(x[2]) >= least), key=lambda x: x[:2])
    out = defaultdict(set)
    for j, (k, i, s) in enumerate(lines):
        if any((k, i) != (a, b) and 100 * len(s & q) >= percent * len(s | q) for a, b, q in lines[:j]):
            out[k].add(i)
    return {k: sorted(v) for k, v in out.items()}


def vector_groups(rows, least=0.98):
    def sound(v, label):
        return v is not None and label is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    units = [(k, label, np.array(v, float) / np.linalg.norm(np.array(v, float)) if sound(v, label) else None) for k, v, label in rows]
    groups, links = Groups({k for k, _, _ in units}), Counter()
    for i, (a, la, x) in enumerate(units):
        for b, lb, y in units[:i]:
            if x is not None and y is not None and la == lb and len(x) == len(y) and x @ y >= least:
                links[a] += 1
                links[b] += 1
                groups.join(a, b)
    return {k: (links[k], groups.find(k), groups.find(k) == k) for k, _, _ in units}
