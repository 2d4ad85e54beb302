"""Plain versions of the operators for small tables."""

import hashlib
import re

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def contamination(docs, items, window=10):
    windows = {}
    for item, text in items:
        if item is None or text is None:
            continue
        w = ALNUM.findall(fold(text))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = ALNUM.findall(fold(text))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= ids
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return out


def shingles(text, size):
    w = BLANK.findall(fold(text))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def similar(docs, size, threshold):
    """Set size and component by document, from all pairs that share a shingle."""
    sets = [shingles(t, size) for _, t in docs]
    by, parent = {}, list(range(len(docs)))

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k, s in enumerate(sets):
        counts = {}
        for x in s:
            for j in by.setdefault(x, []):
                counts[j] = counts.get(j, 0) + 1
            by[x].append(k)
        for j, shared in counts.items():
            if 1000 * shared >= round(1000 * threshold) * (len(s) + len(sets[j]) - shared):
                parent[find(k)] = find(j)
    least = {}
    for k, (doc, _) in enumerate(docs):
        least[find(k)] = min(least.get(find(k), doc), doc, key=lambda x: (x is None, x))
    return {doc: (len(sets[k]), least[find(k)]) for k, (doc, _) in enumerate(docs)}
