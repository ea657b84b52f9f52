"""Plain single-process versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict


def near_groups(docs, size, numerator=80, denominator=100):
    """doc -> (number of shingles, smallest id in reach), by comparing all pairs."""
    sets = {}
    for doc, text in docs:
        words = (text or "").encode().lower().split()
        runs = range(max(1, len(words) - size + 1)) if words else ()
        sets[doc] = frozenset(tuple(words[i : i + size]) for i in runs)
    parent = {doc: doc for doc in sets}

    def root(doc):
        while parent[doc] != doc:
            doc = parent[doc]
        return doc

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and denominator * common >= numerator * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {doc: (len(sets[doc]), root(doc)) for doc in ids}


def within_edits(a, b, most):
    if abs(len(a) - len(b)) > most:
        return False
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b or not most:
        return max(len(a), len(b)) <= most
    return any(within_edits(x, y, most - 1) for x, y in ((a[1:], b[1:]), (a[1:], b), (a, b[1:])))


def kept_lines(docs):
    """doc -> (lines, equal ones gone, near ones gone, text left), for sorted docs."""
    allowed = lambda n: min(2, n // 16)
    first, order, near, by_length = {}, [], set(), defaultdict(list)
    for doc, text in docs:
        for i, line in enumerate((text or "").split("\n")):
            if line.strip() and line not in first:
                first[line] = (doc, i)
                order.append(line)
    for line in order:
        n = len(line)
        for m in range(n - 2, n + 3):
            tau = min(allowed(n), allowed(m))
            if tau and any(within_edits(line, other, tau) for other in by_length[m]):
                near.add(line)
                break
        by_length[n].append(line)
    out = {}
    for doc, text in docs:
        lines, left, equal, close = (text or "").split("\n"), [], 0, 0
        for i, line in enumerate(lines):
            if line.strip() and first[line] != (doc, i):
                equal += 1
            elif line in near:
                close += 1
            else:
                left.append(line)
        out[doc] = (len(lines) if text else 0, equal, close, "\n".join(left))
    return out


def kneser_ney(rows, rare):
    """Ratios of a text's words by two bigram models of (text, label) rows, without any bound."""
    cut = lambda text: text.encode().lower().split()
    words, pairs = (defaultdict(lambda: [0, 0]) for _ in range(2))
    for text, label in rows:
        own = cut(text)
        for table, keys in ((words, own), (pairs, zip(own, own[1:]))):
            for key in set(keys):
                table[key][1 - label] += 1
    known = {w: n for w, n in words.items() if sum(n) >= rare}
    inside, kinds, continued = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), defaultdict(int)
    for (a, b), n in pairs.items():
        continued[b] += 1
        for c in range(2):
            inside[a][c] += n[c]
            kinds[a][c] += n[c] > 0
    lowest = sum(continued[w] for w in known) + len(known) + 1

    def discount(table, c):
        ones, twos = (sum(n[c] == k for n in table.values()) for k in (1, 2))
        return ones / (ones + 2 * twos) if ones and twos else 0.75

    def own(w, c):
        d, total = discounts[0][c], max(sum(n[c] for n in known.values()), 1)
        types = sum(n[c] > 0 for n in known.values())
        return max(known[w][c] - d, 0) / total + max(d * types / total, 1e-3) * (continued[w] + 1) / lowest

    def left(w, c):
        return max(discounts[1][c] * kinds[w][c] / inside[w][c], 1e-3) if inside[w][c] else 1.0

    def pair(a, b, c):
        return max(pairs[a, b][c] - discounts[1][c], 0) / max(inside[a][c], 1) + left(a, c) * own(b, c)

    discounts = [[discount(table, c) for c in range(2)] for table in (words, pairs)]
    ratio = lambda f, *at: math.log(f(*at, 0)) - math.log(f(*at, 1))
    alone = {w: ratio(own, w) for w in known}

    def ratios(text):
        found, before = [], None
        for w in cut(text):
            if w not in known:
                found.append(0.0)
            elif before not in known:
                found.append(alone[w])
            elif sum(pairs.get((before, w), (0, 0))) >= rare:
                found.append(ratio(pair, before, w))
            else:
                found.append(alone[w] + ratio(left, before))
            before = w
        return found

    return ratios


def best(vectors, k, every, scale=64):
    import math

    whole = {}
    for key, vector in vectors:
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            whole[key] = [math.floor(scale * float(x)) for x in vector]
    out = []
    for query in whole:
        if query % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(whole[query], whole[c])), c) for c in whole if c != query)
            out += [(query, rank, c, -s) for rank, (s, c) in enumerate(scores[:k], 1)]
    return sorted(out)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def crc(data):
    return zlib.crc32(data)
