"""Brute-force versions of the corpus operators, for lists of (doc_id, text)."""

import hashlib
import re

SPACE = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def key_of(doc):
    return -(1 << 63) if doc is None else doc


def lines(docs, least=20, docs_least=3):
    holders, top = {}, {}
    keyed = []
    for row, (d, t) in enumerate(docs):
        parts = (t or "").split("\n")
        ks = [p.strip(SPACE).translate(LOW) for p in parts]
        keyed.append((d, parts, ks))
        for k in {k for k in ks if len(k) >= least}:
            holders.setdefault(k, set()).add((d, row) if d is None else d)
            top[k] = max(top.get(k, key_of(d)), key_of(d))
    out = []
    for d, parts, ks in keyed:
        kept = [p for p, k in zip(parts, ks, strict=True) if not (len(holders.get(k, ())) >= docs_least and key_of(d) < top[k])]
        out.append((d, len(parts), len(parts) - len(kept), sha("\n".join(kept))))
    return out


def byte_spans(docs, w=50):
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - w + 1):
            g = b[i : i + w]
            first[g] = min(first.get(g, key_of(d)), key_of(d))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - w + 1):
            if first[b[i : i + w]] < key_of(d):
                gone[i : i + w] = b"\1" * w
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def word_windows(docs, w=20):
    texts = [(d, re.findall(rf"[^{SPACE}]+", t or "")) for d, t in docs]
    first = {}
    for d, ws in texts:
        for i in range(len(ws) - w + 1):
            g = tuple(ws[i : i + w])
            first[g] = min(first.get(g, key_of(d)), key_of(d))
    out = []
    for d, ws in texts:
        gone, seen = [False] * len(ws), set()
        for i in range(len(ws) - w + 1):
            g = tuple(ws[i : i + w])
            if first[g] < key_of(d) or g in seen:
                gone[i : i + w] = [True] * w
            seen.add(g)
        out.append((d, len(ws), sum(gone), sha(" ".join(x for x, g in zip(ws, gone, strict=True) if not g))))
    return out


def near(docs, percent=75):
    sets = {}
    sizes = []
    for d, t in docs:
        ws = re.findall(rf"[^{SPACE}]+", (t or "").translate(LOW))
        s = frozenset(zip(ws, ws[1:], strict=False)) if len(ws) > 1 else frozenset([tuple(ws)] if ws else [])
        sizes.append((d, len(s)))
        if d is not None and s:
            sets.setdefault(d, set()).add(s)
    comp = {d: d for d, _ in docs if d is not None}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return [(d, n, None if d is None else find(d), d is None or find(d) == d) for d, n in sizes]


def leaks(docs, items, w=10):
    def words(t):
        return re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").translate(LOW))

    windows = {}
    for item, t in items:
        ws = words(t)
        n = min(w, len(ws))
        for i in range(len(ws) - n + 1) if ws else ():
            windows.setdefault(tuple(ws[i : i + n]), set()).add(item)
    sizes = {len(g) for g in windows}
    out = []
    for d, t in docs:
        ws = words(t)
        hit, found = [False] * len(ws), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                g = tuple(ws[i : i + n])
                if g in windows:
                    hit[i : i + n] = [True] * n
                    found |= windows[g]
        names = sorted(str(x) for x in found if x is not None)
        out.append((d, len(ws), sum(hit), len(names), sha(",".join(names)), any(hit)))
    return out
