"""Plain versions of the operators' results for small inputs."""
import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

UPPER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def low(text):
    return (text or "").encode().translate(UPPER)


def covered(texts, length):
    """Per text a mask of the bytes in strings of ``length`` bytes that start elsewhere too."""
    count = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        m = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                m[i:i + length] = True
        out.append(m)
    return out


def dedup_row(t, m):
    kept = bytes(b for b, x in zip(t, m) if not x)
    spans = sum(1 for i, x in enumerate(m) if x and (i == 0 or not m[i - 1]))
    return len(t), int(m.sum()), spans, hashlib.sha256(kept).hexdigest()


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", low(text))
    if not w:
        return 0
    sh = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, link):
    """Component label (least index) of n items under ``link(i, j)``."""
    lab = list(range(n))

    def root(x):
        while lab[x] != x:
            x = lab[x]
        return x
    for i in range(n):
        for j in range(i):
            if link(i, j):
                a, b = root(i), root(j)
                lab[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def contamination(texts, items, width=13):
    """Per text (words, hit words, sorted ids of items with occurring windows)."""
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        for a in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[a:a + width])].add(str(i))
    out = []
    for t in texts:
        w, hit, ids = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                found = windows.get(tuple(w[a:a + n]))
                if found:
                    ids |= found
                    hit.update(range(a, a + n))
        out.append((len(w), len(hit), sorted(ids)))
    return out


def ppm_score(train, text, order):
    """log10 probability of the text by method C with symbol exclusion, from plain dictionaries."""
    counts = defaultdict(Counter)

    def steps(t):
        s = [b + 1 for b in t] + [0]
        pad = [0] + s
        for i in range(len(s)):
            full = tuple(pad[max(0, i + 1 - order):i + 1]) if order else ()
            yield (0,) * (order - len(full)) + full, s[i]
    for t in train:
        for ctx, x in steps(t):
            for k in range(order + 1):
                counts[ctx[order - k:]][x] += 1
    total = 0.0
    for ctx, x in steps(text):
        rest, gone, p = 1.0, set(), None
        for k in range(order, -1, -1):
            c = counts.get(ctx[order - k:])
            own = {a: n for a, n in (c or {}).items() if a not in gone}
            if not own:
                continue
            n, kinds = sum(own.values()), len(own)
            if x in own:
                p = rest * own[x] / (n + kinds)
                break
            rest *= kinds / (n + kinds)
            gone |= set(own)
        total += math.log10(p if p is not None else rest / (257 - len(gone)))
    return total


def lookup(names, size, prefs):
    """The filled table by plain turns; ``prefs(name)`` gives offset and skip."""
    owner, nxt = [None] * size, [0] * len(names)
    order = [prefs(x) for x in names]
    for turn in range(size):
        i = turn % len(names)
        o, k = order[i]
        while owner[(o + nxt[i] * k) % size] is not None:
            nxt[i] += 1
        owner[(o + nxt[i] * k) % size] = names[i]
    return owner
