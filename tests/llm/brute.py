"""Plain single-machine versions of the operators."""

import hashlib

import numpy as np
import xxhash


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def repeats(docs, length=100):
    """docs: (order key, bytes) in order -> removed mask per document."""
    seen, out = set(), []
    for _, b in docs:
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if (s := b[i : i + length]) in seen:
                cover[i] += 1
                cover[i + length] -= 1
            else:
                seen.add(s)
        out.append(np.cumsum(cover)[: len(b)] > 0)
    return out


def without(b: bytes, mask) -> str:
    """The characters that are not removed as a whole."""
    out, at = [], 0
    for c in b.decode():
        n = len(c.encode())
        if not all(mask[at : at + n]):
            out.append(c)
        at += n
    return "".join(out)


def simhash(text, words=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(n, pairs):
    at = list(range(n))

    def find(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
