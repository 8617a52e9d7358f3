"""Plain Python versions of the operators' results."""

import collections
import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def alnum(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))


def substrings(rows, n=20):
    """rows: (id, text) by id; id -> n_words, n_removed, digest."""
    first, out = {}, {}
    for i, t in rows:
        w = spaced(t)
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            k = tuple(w[s : s + n])
            if k in first and first[k] < (i, s):
                gone[s : s + n] = [True] * n
            first.setdefault(k, (i, s))
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def contamination(rows, items, n=10):
    index = collections.defaultdict(set)
    for i, t in items:
        w = alnum(t)
        for s in range(max(1, len(w) - n + 1) if w and i is not None else 0):
            index[tuple(w[s : s + n])].add(i)
    out = {}
    for i, t in rows:
        w, found = alnum(t), set()
        hit = [0] * len(w)
        for size in {len(k) for k in index}:
            for s in range(len(w) - size + 1):
                k = tuple(w[s : s + size])
                if k in index:
                    found |= index[k]
                    hit[s : s + size] = [1] * size
        out[i] = (len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest())
    return out


def shingles(t, n=5):
    w = alnum(t)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def near(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    par = list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    inv = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for x in s for j in inv[x]).items():
            if n / (len(s) + len(sets[j]) - n) >= threshold - 1e-12:
                a, b = find(i), find(j)
                par[max(a, b)] = min(a, b)
        for x in s:
            inv[x].append(i)
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}
