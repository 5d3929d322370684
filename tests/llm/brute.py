"""Plain Python versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def base_spans(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans)


def base_row(doc_id, text):
    spans = base_spans(text)
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
    return (doc_id, *(sum(k == n for _, k, _ in spans) for n in range(3)), sha(joined))


def index_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(docs, items):
    windows = defaultdict(set)
    for item_id, text in items:
        w = index_words(text)
        for i in range(max(len(w) - 13, 0) + 1 if w else 0):
            windows[tuple(w[i : i + 13])].add(item_id)
    sizes = {len(k) for k in windows}
    for doc_id, text in docs:
        w, hit, found = index_words(text), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if ids := windows.get(tuple(w[i : i + m])):
                    hit.update(range(i, i + m))
                    found |= ids
        ids = sorted(str(x) for x in found if x is not None)
        yield doc_id, len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit) and 20 * len(hit) >= len(w)


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, cap=3):
    """Reshare the excess again and again, as the contract words it."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in full]
        left = total - sum(cap * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return {s: share.get(s, cap * sizes[s]) for s in order}
        full |= over


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def components(rows):
    """rows: (doc_id, text). doc_id -> (set size, smallest reachable id), by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for n, (i, _) in enumerate(sets):
        least[root(n)] = min(i, least.get(root(n), i))
    return sorted((i, len(s), least[root(n)]) for n, (i, s) in enumerate(sets))


def one_of_each(rows):
    """rows: (doc_id, text). One row per class, of the smallest id (null last); rows without words all stay."""
    links = components([(n, t) for n, (_, t) in enumerate(rows)])
    best, kept = {}, []
    for n, size, root in links:
        row = rows[n]
        if not size:
            kept.append(row)
        elif root not in best or (row[0] is None, row[0] or 0) < (best[root][0] is None, best[root][0] or 0):
            best[root] = row
    return kept + list(best.values())


def links(rows):
    """rows: (doc_id, text). doc_id, number of other sets to which its set links, by comparing all pairs."""
    sets = [(i, frozenset(shingles(t))) for i, t in rows]
    distinct = {x for _, x in sets if x}
    return sorted((i, sum(y != x and 100 * len(x & y) >= 75 * len(x | y) for y in distinct) if x else 0) for i, x in sets)


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
