"""Plain reference versions of the operators, for small inputs."""

import hashlib
import re
from itertools import combinations


def dedup(texts, length=100):
    """Per text (in order): n_bytes, n_removed, n_spans, kept_sha256."""
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            if w in seen:
                gone[i:i + length] = b"\x01" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


_UP = {c: c + 32 for c in range(65, 91)}


def shingles(text, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_UP))
    return {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def groups(rows):
    """rows: (doc_id, text); per row: doc_id, n_shingles, component_id."""
    sets = [shingles(t) for _, t in rows]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    near = set()
    for ids in where.values():
        if len(ids) > 1:
            near.update(combinations(ids, 2))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, j in near:
        if find(i) != find(j):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[a if rows[a][0] > rows[b][0] else b] = b if rows[a][0] > rows[b][0] else a
    return [(d, len(s), rows[find(i)][0]) for i, ((d, _), s) in enumerate(zip(rows, sets))]
