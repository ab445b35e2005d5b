"""Plain versions of the operators' results, for small tables."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def shingles(text, size):
    w = WORD.findall(lower_ascii(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset({tuple(w)})


def smallest_reachable(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard_components(docs, size, percent):
    """doc_id: (set size, component) of {doc_id: text}."""
    sets = {i: shingles(t, size) for i, t in docs.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = defaultdict(int)
    for held in holders.values():
        for k, a in enumerate(held):
            for b in held[k + 1 :]:
                shared[a, b] += 1
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    root = smallest_reachable(docs, links)
    return {i: (len(sets[i]), root[i]) for i in docs}


def without_repeats(docs, window):
    """doc_id: (n_bytes, n_removed, n_spans, sha256 of the rest) of {doc_id: text}."""
    first = {}
    datas = {i: (t or "").encode() for i, t in docs.items()}
    for i in sorted(datas):
        d = datas[i]
        for k in range(len(d) - window + 1):
            first.setdefault(d[k : k + window], i)
    out = {}
    for i, d in datas.items():
        gone = bytearray(len(d))
        for k in range(len(d) - window + 1):
            if first[d[k : k + window]] < i:
                gone[k : k + window] = b"\1" * window
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        spans = len([1 for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1])])
        out[i] = (len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
