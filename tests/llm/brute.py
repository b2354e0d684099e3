"""Brute-force versions of the contracts, over pandas tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


def op1(docs):
    own = {i: words(t) for i, t in zip(docs.doc_id, docs.text)}
    first = {}
    for i, w in own.items():
        for s in range(len(w) - 12):
            k = tuple(w[s : s + 13])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, w in own.items():
        gone = set()
        for s in range(len(w) - 12):
            if first[tuple(w[s : s + 13])] < i:
                gone.update(range(s, s + 13))
        out[i] = len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()
    return out


def op3(docs, threshold=0.8):
    bags = {}
    for i, t in zip(docs.doc_id, docs.text):
        if w := words(t):
            bags[i] = Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))
    root = {i: i for i in docs.doc_id}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i in sorted(bags):
        near = Counter()
        for k, n in bags[i].items():
            for j in holders[k]:
                near[j] += min(n, bags[j][k])
            holders[k].append(i)
        for j, n in near.items():
            if n >= threshold * (bags[i].total() + bags[j].total() - n) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def op6_base(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    spots = defaultdict(list)
    for s in range(len(w) - 7):
        spots[tuple(w[s : s + 8])].append(s)
    inside = {p for at in spots.values() if len(at) > 1 for s in at for p in range(s, s + 8)}
    symbols = len(re.findall(r"[#*$%&|<>]", t or ""))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(inside)


def op9(docs, items):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOWER))
    windows = defaultdict(set)
    for i, t in zip(items.item_id, items.text):
        w = split(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s : s + n])].add(str(i))
    out = {}
    for i, t in zip(docs.doc_id, docs.text):
        w, hit, names = split(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if found := windows.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    names |= found
        out[i] = len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return out


def held_out(doc_id, parts, rest):
    return zlib.crc32(str(doc_id).encode()) % parts == rest
