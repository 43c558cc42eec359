"""Plain re-statements of what the operators must return, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def contamination(docs, items, window=13):
    """docs: [(doc_id, text)], items: [(item_id, text)]."""
    where: dict[tuple, set] = {}
    for item, text in items:
        ws = WORD.findall(lower(text))
        n = min(window, len(ws))
        for i in range(len(ws) - n + 1 if n else 0):
            where.setdefault(tuple(ws[i:i + n]), set()).add("" if item is None else str(item))
    sizes = {len(k) for k in where}
    out = []
    for doc, text in docs:
        ws = WORD.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                key = tuple(ws[i:i + n])
                if key in where:
                    hit.update(range(i, i + n))
                    found |= where[key]
        out.append((doc, len(ws), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(ws)))
    return out


def license_base(docs):
    phrases = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
    out = []
    for doc, text in docs:
        ws = WORD.findall(lower(text))
        places = [(i, label) for p, label in phrases for i in range(len(ws)) if ws[i:i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        out.append((doc, len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    return out


def word_window_dedup(docs, width=20):
    """docs: [(doc_id, text)]; equal doc_ids are one document's repeated rows."""
    key = lambda d: (d is not None, d)
    least: dict[tuple, tuple] = {}
    for doc, text in docs:
        ws = SPACE_WORD.findall(text or "")
        for i in range(len(ws) - width + 1):
            k = tuple(ws[i:i + width])
            least[k] = min(least.get(k, (key(doc), i)), (key(doc), i))
    out = []
    for doc, text in docs:
        ws = SPACE_WORD.findall(text or "")
        gone = set()
        for i in range(len(ws) - width + 1):
            if least[tuple(ws[i:i + width])] < (key(doc), i):
                gone.update(range(i, i + width))
        out.append((doc, len(ws), len(gone), sha(" ".join(w for i, w in enumerate(ws) if i not in gone))))
    return out


def byte_dedup(docs, width=400):
    count: dict[bytes, int] = {}
    for _, text in docs:
        raw = (text or "").encode()
        for i in range(len(raw) - width + 1):
            count[raw[i:i + width]] = count.get(raw[i:i + width], 0) + 1
    out = []
    for doc, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw) + 1)
        for i in range(len(raw) - width + 1):
            if count[raw[i:i + width]] > 1:
                gone[i:i + width] = b"\1" * width
        spans = sum(1 for i in range(len(raw)) if gone[i] and not (i and gone[i - 1]))
        out.append((doc, len(raw), sum(gone), spans, sha(bytes(b for i, b in enumerate(raw) if not gone[i]))))
    return out


def shingle_sets(docs, n=5):
    out = []
    for doc, text in docs:
        ws = SPACE_WORD.findall(lower(text))
        out.append((doc, {tuple(ws[i:i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()))
    return out


def components(docs):
    """[(doc_id, n_shingles, component_id)] for unique doc_ids."""
    sets = shingle_sets(docs)
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    at: dict[tuple, list] = {}
    for d, s in sets:
        for t in s:
            at.setdefault(t, []).append(d)
    by = dict(sets)
    pairs = {(a, b) for ds in at.values() for a in ds for b in ds if a < b} if len(docs) < 5000 else None
    for a, b in pairs:
        if 100 * len(by[a] & by[b]) >= 75 * len(by[a] | by[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [(d, len(s), find(d)) for d, s in sets]


def crc(text: str | None) -> int:
    return zlib.crc32((text or "").encode())
