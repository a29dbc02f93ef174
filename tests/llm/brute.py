"""Plain Python results to hold the operators against."""
from __future__ import annotations

import hashlib
import re

SPACE_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def lower(text):
    return (text or "").translate(UPPER)


def shingle_set(text, k):
    words = SPACE_WORD.findall(lower(text).encode())
    if not words:
        return frozenset()
    k = min(k, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def near_groups(rows, k, percent):
    """{position: (n, component)} of (doc_id, text) rows by comparing all pairs that share anything."""
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    seen = set()
    for held in holders.values():
        for a in range(len(held)):
            for b in range(a):
                pair = (held[b], held[a])
                if pair in seen:
                    continue
                seen.add(pair)
                both = len(sets[pair[0]] & sets[pair[1]])
                if 100 * both >= percent * (len(sets[pair[0]]) + len(sets[pair[1]]) - both):
                    parent[root(pair[0])] = root(pair[1])
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [(doc_id, len(sets[i]), least.get(root(i))) for i, (doc_id, _) in enumerate(rows)]


def contaminated(rows, items, window):
    windows = {}
    for item_id, text in items:
        words = ALNUM_WORD.findall(lower(text))
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            windows.setdefault(tuple(words[i : i + m]), set()).add(item_id)
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in rows:
        words = ALNUM_WORD.findall(lower(text))
        hit, found = set(), set()
        for m in sizes:
            for i in range(len(words) - m + 1):
                ids = windows.get(tuple(words[i : i + m]))
                if ids is not None:
                    hit.update(range(i, i + m))
                    found |= {str(x) for x in ids if x is not None}
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(found), digest, bool(hit)))
    return out


def repeated_bytes(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by listing every string of ``length`` bytes."""
    texts = [(t or "").encode() for _, t in rows]
    count = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            key = hashlib.md5(t[i : i + length]).digest()
            count[key] = count.get(key, 0) + 1
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        last = -1
        for i in range(len(t) - length + 1):
            if count[hashlib.md5(t[i : i + length]).digest()] > 1:
                start = max(i, last)
                gone[start : i + length] = b"\1" * (i + length - start)
                last = i + length
        kept = bytes(x for x, g in zip(t, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
