"""Plain versions of the operators, to hold them against."""

import collections
import hashlib
import re

import numpy as np
import xxhash

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def substring_dedup(rows, window=50):
    first = {}
    for i, t in rows:
        words = (t or "").encode().split()
        for k in range(len(words) - window + 1 if i is not None else 0):
            key = tuple(words[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - window + 1 if i is not None else 0):
            if first[tuple(words[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(words), sum(gone), sha(b" ".join(w for w, g in zip(words, gone, strict=True) if not g))))
    return out


def groups(n, linked):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in linked:
        a, b = top(i), top(j)
        root[max(a, b)] = min(a, b)
    out = collections.defaultdict(list)
    for i in range(n):
        out[top(i)].append(i)
    return [out[top(i)] for i in range(n)]


def simhash(rows):
    prints = []
    for _, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    return [(r[0], f"{p:016x}", min((rows[k][0] for k in g if rows[k][0] is not None), default=None)) for r, p, g in zip(rows, prints, groups(len(rows), linked), strict=True)]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) < 256 for x in m[0].split("."))]
    out += [("card", m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, (a, b) in out)


def cosines(vectors):
    x = np.array(vectors, np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T
