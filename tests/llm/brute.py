"""Plain versions of the operators, for small inputs."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

A_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_LOWER))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_LOWER))


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def factors(n, k=5):
    out = {}
    tail = (k + 1) * n.get(k + 1, 0) / n[1] if n.get(1) else 1.0
    for r in range(1, k + 1):
        good = (r + 1) * n.get(r + 1, 0) / (r * n[r]) if n.get(r) else -1.0
        d = (good - tail) / (1 - tail) if tail < 1 else -1.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class Katz:
    """The model of ``katz`` with a head that holds every word or the given ones, and given hot contexts."""

    def __init__(self, docs, hot_share=2000, head=None):
        texts = [[*blank_words(t), "\n"] for _, t in docs]
        self.uni = Counter(w for t in texts for w in t)
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.docs = len(texts)
        self.bi = Counter()
        self.after = defaultdict(set)
        for t in texts:
            for u, w in zip(["\t", *t], t, strict=False):
                self.bi[u, w] += 1
                self.after[u].add(w)
        d = factors(Counter(self.uni.values()))
        self.head = set(self.uni) if head is None else head
        self.p = {w: d.get(self.uni[w], 1.0) * self.uni[w] / (self.n + 1) for w in self.head}
        self.rest = (1 - sum(self.p.values())) / (self.v - len(self.head) + 1)
        self.d = factors(Counter(self.bi.values()))
        self.hot = {w for w in self.head if self.uni[w] * hot_share >= self.n} | {"\t"}

    def unigram(self, w):
        return self.p.get(w, self.rest)

    def context(self, u):
        c = self.docs if u == "\t" else self.uni[u] if u != "\n" else 0
        few = any(self.bi[u, w] <= 5 for w in self.after[u])
        return c, c + (1 if u in self.hot or not few else 0)

    def given(self, u, w):
        c = self.bi[u, w]
        return self.d.get(c, 1.0) * c / self.context(u)[1]

    def probability(self, u, w):
        if self.bi.get((u, w)):
            return self.given(u, w)
        if u not in self.after:
            return self.unigram(w)
        left = 1 - sum(self.given(u, x) for x in self.after[u])
        return left / (1 - sum(self.unigram(x) for x in self.after[u])) * self.unigram(w)

    def score(self, text):
        t = [*blank_words(text), "\n"]
        return sum(math.log10(self.probability(u, w)) for u, w in zip(["\t", *t], t, strict=False))


def components(prints, bits=4):
    """Smallest id reachable for each (id, fingerprint)."""
    ids = [i for i, _ in prints]
    fp = np.array([p for _, p in prints], dtype=np.int64).view(np.uint64)
    label = list(ids)
    while True:
        new = [min(np.array(label)[np.bitwise_count(fp ^ f) <= bits]) for f in fp]
        new = [min(a, b) for a, b in zip(new, label, strict=True)]
        if new == label:
            return dict(zip(ids, label, strict=True))
        label = new
