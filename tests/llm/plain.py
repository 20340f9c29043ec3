"""Plain single-process versions of the training-data operators."""

from __future__ import annotations

import hashlib
import re
import zlib

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def simhash(text) -> int:
    words = WORD.findall(lower(text).encode())
    if not words:
        return 0
    parts = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_classes(rows, radius=2):
    """(doc_id, fingerprint, component) by comparing every pair."""
    prints = [(i, simhash(t)) for i, t in rows]
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p
    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                root[find(b)] = find(a)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return sorted(((i, f"{p:016x}", least.get(find(p))) for i, p in prints), key=str)


def exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and first, hashlib.sha256(t.encode()).hexdigest()))
            if i == keep:
                first = False
    return sorted(out, key=str)


def crc(text) -> int:
    return zlib.crc32((text or "").encode())


def edited(rows):
    """(doc_id, n_chars, edited text) for rows with distinct ids."""
    order = sorted(rows, key=lambda r: -r[0])
    out = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        out.append((i, len(t), t[:len(t) - m] + nxt[:m]))
    return sorted(out)


def words(text) -> int:
    return len(WORD.findall((text or "").encode()))
