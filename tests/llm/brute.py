"""Plain, slow versions of the operators' results."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(rows):
    """[(doc_id, text)] to {(doc_id, fingerprint, component)} rows, in order."""
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return [(d, f"{f:016x}", ids.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))]


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    hit = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def lines(rows, similarity=0.8):
    """[(doc_id, text)] to the removed line numbers of each row."""
    order = sorted((i for i in range(len(rows))), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, hash_of(rows[i][1])))
    found, out, done = [], {}, {}
    for i in order:
        key = (rows[i][0], rows[i][1])
        if key in done:
            out[i] = done[key]
            continue
        gone = []
        for n, line in enumerate((rows[i][1] or "").split("\n") if rows[i][1] is not None else []):
            s = set(WORD.findall(line.translate(LOWER)))
            if not s:
                continue
            if any(len(s & o) >= similarity * len(s | o) - 1e-9 for o in found):
                gone.append(n)
            found.append(s)
        out[i] = done[key] = gone
    return [out[i] for i in range(len(rows))]


def hash_of(text):
    h = xxhash.xxh64_intdigest((text or "").encode(), 42) if text is not None else 42
    return h - (1 << 64) if h >> 63 else h


def hits(text, items):
    """n_words, n_hit and the sorted items of a text; items: [(item_id, text)]."""
    words = BENCH_WORD.findall((text or "").translate(LOWER))
    hit, names = set(), set()
    for name, t in items:
        w = BENCH_WORD.findall((t or "").translate(LOWER))
        if not w:
            continue
        n = min(13, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in grams:
                hit.update(range(i, i + n))
                names.add(str(name))
    return len(words), len(hit), sorted(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def importance(counts, pages):
    """Of a style path whose texts are on so many pages each, of so many that hold it."""
    return 1 - sum(c * math.log(c) for c in counts) / (sum(counts) * math.log(pages)) if pages > 1 else 1.0
