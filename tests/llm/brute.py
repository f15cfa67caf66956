"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD, ALNUM = re.compile(rb"[^\x20\x09-\x0D]+"), re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def repeats(texts, length=200):
    """(bytes, removed, spans, sha256 of the rest) of each text."""
    raw, seen = [(t or "").encode() for t in texts], Counter()
    for r in raw:
        seen.update(r[i : i + length] for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((len(r), sum(gone), sum(gone[i] and not (i and gone[i - 1]) for i in range(len(r))), hashlib.sha256(bytes(b for b, x in zip(r, gone) if not x)).hexdigest()))
    return out


def shingles(text, size=5):
    w = WORD.findall((text or "").encode().translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def components(docs, percent=85):
    """{id: (set size, smallest id reachable)} of (id, text) pairs with distinct ids."""
    sets, parent = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by, both = defaultdict(list), Counter()
    for i in sorted(sets):
        for g in sets[i]:
            by[g].append(i)
    for ids in by.values():
        both.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def contamination(docs, items, window=10):
    """{id: (words, hit words, sorted item ids)}."""
    found = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").encode().translate(LOWER))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            found[tuple(w[i : i + n])].add(str(item))
    sizes = {len(k) for k in found}
    out = {}
    for i, text in docs:
        w = ALNUM.findall((text or "").encode().translate(LOWER))
        hit, ids = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in found:
                    hit.update(range(a, a + n))
                    ids |= found[k]
        out[i] = (len(w), len(hit), sorted(ids))
    return out


def toxic_logit(raw, table, bias):
    """The largest mean of two neighbouring words' mean gram values."""
    import numpy as np

    from tessella.llm import bytesops as B
    from tessella.llm import toxicity as T

    words = []
    for w in WORD.findall(raw.translate(LOWER)):
        w = b" " + w + b" "
        grams = [w[i : i + n] for n in T.GRAMS for i in range(len(w) - n + 1)]
        at = [int(B.span_hash(B.prefix(np.frombuffer(g, np.uint8)), np.array([0]), np.array([len(g)]))[0]) >> (64 - T.BUCKET_BITS) for g in grams]
        words.append(sum(float(table[k]) for k in at) / max(1, len(at)))
    if not words:
        return bias
    return max((a + b) / 2 for a, b in zip(words, words[1:] or words)) + bias


def crf_score(unary, size, model):
    """A document's score from its lines' unary scores, by forward and backward sums of logs."""
    import math

    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    t = model["trans"].tolist()
    forward = [[0.0, unary[0]]]
    for u in unary[1:]:
        f = forward[-1]
        forward.append([add(f[0] + t[0][0], f[1] + t[1][0]), add(f[0] + t[0][1], f[1] + t[1][1]) + u])
    back = [[0.0, 0.0]]
    for u in unary[:0:-1]:
        b = back[-1]
        back.append([add(t[0][0] + b[0], t[0][1] + u + b[1]), add(t[1][0] + b[0], t[1][1] + u + b[1])])
    back.reverse()
    good = [1 / (1 + math.exp(min(700, (f[0] + b[0]) - (f[1] + b[1])))) for f, b in zip(forward, back)]
    q = sum(g * (n + 1) for g, n in zip(good, size)) / sum(n + 1 for n in size)
    z = model["a"] * math.log((q + 1e-3) / (1 - q + 1e-3)) + model["b"]
    return 1 / (1 + math.exp(-max(-50, min(50, z))))
