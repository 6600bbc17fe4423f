"""Plain versions of the operators, for small tables."""

import collections
import hashlib

import numpy as np


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def substring(rows, width=13):
    """{row index: (n_words, n_removed, sha)}; rows are (doc_id, text)."""
    least = {}
    words = [(t or "").encode().split() for _, t in rows]
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            if d is not None:
                least[k] = min(least.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if d is not None and least[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((d, len(w), sum(gone), sha(b" ".join(kept))))
    return out


def suffix(rows, width=200):
    raw = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(r[i : i + width] for r in raw for i in range(len(r) - width + 1))
    out = []
    for (d, _), r in zip(rows, raw, strict=True):
        gone = np.zeros(len(r) + 1, dtype=bool)
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(r) else 0
        out.append((d, len(r), int(gone.sum()), spans, sha(bytes(b for b, g in zip(r, gone, strict=False) if not g))))
    return out


def components(n, links):
    """Smallest reachable index of each of n nodes."""
    near = collections.defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = [None] * n
    for i in range(n):
        if out[i] is None:
            out[i], stack = i, [i]
            while stack:
                for k in near[stack.pop()]:
                    if out[k] is None:
                        out[k] = i
                        stack.append(k)
    return out


def ordered(rows):
    return sorted((tuple("~" if v is None else str(v) for v in r) for r in rows))


def subsequence_kernel(a, b, decay, span):
    """Common subsequences of three or four characters of two marked words, by trying all places: decay
    to the number of gaps on either side; they span ``span`` places at most, the first letter given."""
    import itertools

    def weights(w):
        out = collections.Counter()
        for n in (3, 4):
            for at in itertools.combinations(range(len(w)), n):
                if at[-1] - at[0] < span:
                    out["".join(w[i] for i in at)] += decay ** (at[-1] - at[0] + 1 - n)
        return out

    x, y = weights(a), weights(b)
    return sum(v * y[k] for k, v in x.items())


def thue_morse(n, a, b):
    """A word and its complement have equal polynomial hashes modulo 2**64."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)
