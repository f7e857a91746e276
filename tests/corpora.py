"""Deterministic corpora and a plain BM25 to compare with."""

import math
import re

MASK = (1 << 64) - 1


class Lcg:
    def __init__(self, seed):
        self.s = seed

    def below(self, n):
        self.s = (self.s * 6364136223846793005 + 1442695040888963407) & MASK
        return (self.s >> 33) % n


def random_docs(n, vocab, seed, prefix="doc", title=False):
    """Ids, titles and bodies of 5 to 64 words; low word numbers are frequent."""
    r, out = Lcg(seed), []
    word = lambda: f"w{min(r.below(vocab), r.below(vocab))}"
    for k in range(n):
        size = 5 + r.below(60)
        body = " ".join(word() for _ in range(size))
        out.append((f"{prefix}-{k}", f"title {word()}" if title else "", body))
    return out


def topic_docs(n, seed=3):
    """Two topics in turn, under paths."""
    r, out = Lcg(seed), []
    for k in range(n):
        body = " ".join(f"t{k % 2}w{min(r.below(80), r.below(80))}" for _ in range(10 + r.below(40)))
        out.append((f"/home/user/topic{k % 2}/file{k:05}.txt", f"doc {k}", body))
    return out


HAND = [
    ("d0", "", "cheap pizza pizza montreal"),
    ("d1", "", "expensive pizza toronto"),
    ("d2", "", "cheap tacos montreal montreal"),
    ("d3", "", "pizza pizza pizza"),
    ("d4", "", "montreal weather report"),
    ("d5", "", "cheap cheap cheap flights"),
]


def toks(text):
    return [t.lower() for t in re.findall(r"[^\W_]+", text)]


def naive(docs, query, k, weight=1, dead=(), stats_over_all=True):
    """(score, id) of the k best live documents: df over all, N and lengths over the live."""
    tf, length = {}, {}
    for d, title, body in docs:
        counts = {}
        for t in toks(title):
            counts[t] = counts.get(t, 0) + weight
        for t in toks(body):
            counts[t] = counts.get(t, 0) + 1
        tf[d], length[d] = counts, len(toks(title)) + len(toks(body))
    live = [d for d, *_ in docs if d not in dead]
    n, avg = len(live), sum(length[d] for d in live) / max(1, len(live)) or 1.0
    scores = {}
    for t in dict.fromkeys(toks(query)):
        df = sum(t in tf[d] for d in (tf if stats_over_all else live))
        idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
        for d in live:
            if f := tf[d].get(t):
                scores[d] = scores.get(d, 0) + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length[d] / avg))
    order = {d: k for k, (d, *_) in enumerate(docs)}
    return sorted(((round(s, 6), d) for d, s in scores.items()), key=lambda x: (-x[0], order[x[1]]))[:k]
