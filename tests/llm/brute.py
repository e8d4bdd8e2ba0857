"""Plain Python versions of the contracts, row by row."""

from __future__ import annotations

import hashlib
import re
import zlib

import xxhash


def lower_ascii(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PII = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def contamination(docs, items):
    windows = {}
    for item, t in items:
        w = WORDS.findall(lower_ascii(t))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if item is None else str(item))
    out = []
    for d, t in docs:
        w, hit, found = WORDS.findall(lower_ascii(t)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= x
        out.append((d, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def fingerprint(t):
    w = SPACED.findall(lower_ascii(t))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode("utf-8"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, bits=4):
    """fps: (id, fingerprint) -> {id: least id reachable}"""
    root = {d: d for d, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, f) in enumerate(fps):
        for b, g in fps[:i]:
            if (f ^ g).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in fps}


def base_spans(t):
    out = []
    for i, (kind, p) in enumerate(PII):
        for m in re.finditer(p, t or ""):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(int(c) * (1 + j % 2), 10)) for j, c in enumerate(reversed(digits)))
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and total % 10 == 0) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), i, m.end()))
    return [(PII[i][0], a, z) for a, i, z in sorted(out)]


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def near(a, b):
    """Edit distance at most 1, by the definition."""
    if a == b:
        return True
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def line_dedup(docs, least=20):
    """docs in order -> kept texts"""
    seen, out = [], []
    for _, t in docs:
        if t is None:
            out.append(None)
            continue
        kept = []
        for line in t.split("\n"):
            if line.encode().strip():
                drop = any(line == s or (len(line) >= least and len(s) >= least and near(line, s)) for s in seen)
                seen.append(line)
                if drop:
                    continue
            kept.append(line)
        out.append("\n".join(kept))
    return out


def quality_counts(t):
    w = SPACED.findall(t or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    inside = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(inside)


def sha256(s):
    return hashlib.sha256(s.encode()).hexdigest()
