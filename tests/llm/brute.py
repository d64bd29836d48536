"""Plain Python versions of what the text operators compute, for small tables."""

import collections
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, size=5):
    w = words(text)
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def components(docs):
    """{doc_id: (number of shingles, least id reachable)} of (id, text) pairs."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = collections.defaultdict(list)
    for i, (doc, _) in enumerate(docs):
        least[find(i)].append(doc)
    return {doc: (len(sets[i]), min(least[find(i)])) for i, (doc, _) in enumerate(docs)}


def repeats(docs, span=200, keep_first=False):
    """{doc_id: (bytes, removed, runs, left)}."""
    data = {d: (t or "").encode() for d, t in docs}
    count = collections.Counter(t[i:i + span] for t in data.values()
                                for i in range(len(t) - span + 1))
    seen, out = set(), {}
    for d in sorted(data):
        t, mark = data[d], bytearray(len(data[d]))
        for i in range(len(t) - span + 1):
            s = t[i:i + span]
            if count[s] > 1 and (s in seen or not keep_first):
                mark[i:i + span] = b"\1" * span
            seen.add(s)
        runs = sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1]))
        out[d] = (len(t), sum(mark), runs, bytes(b for b, m in zip(t, mark) if not m))
    return out


def leaks(docs, items):
    """{(doc_id, item_id): best similarity of an item-sized window}, 3/4 at least."""
    def bag(w):
        return collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))

    out = {}
    for item, text in items:
        want = words(text)
        if len(want) < 5:
            continue
        own = bag(want)
        for doc, body in docs:
            w, best = words(body), 0
            for i in range(max(1, len(w) - len(want) + 1)):
                there = bag(w[i:i + len(want)])
                top = sum((there | own).values())
                best = max(best, sum((there & own).values()) / top)
            if best >= 0.75:
                out[doc, item] = best
    return out


def pieces(ids, capacity):
    import numpy as np

    ids = np.array([*ids, 1], "<u4")
    return [(i // capacity, i, len(ids[i:i + capacity]), zlib.crc32(ids[i:i + capacity].tobytes()))
            for i in range(0, len(ids), capacity)]
