"""What the contracts say, in plain Python over all rows; rows are (doc_id, text)."""

import hashlib
import math
import re
import zlib
from collections import Counter

from xxhash import xxh64_intdigest

SPACE = r"[^\x20\x09-\x0D]+"
BIG = 1 << 63


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")


def order(doc_id):
    return BIG if doc_id is None else doc_id


def quality(text):
    text = text or ""
    words = re.findall(SPACE, text)
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {i + k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), n < 10 or 100 * len(again) > 20 * n)


def contamination(rows, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for item, text in items:
        words = cut(text)
        m = min(13, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            windows.setdefault(tuple(words[i : i + m]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in rows:
        words, hit, found = cut(text), set(), set()
        for m in lengths:
            for i in range(len(words) - m + 1):
                if got := windows.get(tuple(words[i : i + m])):
                    found |= got
                    hit |= set(range(i, i + m))
        out.append((doc, len(words), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit) and 20 * len(hit) >= len(words)))
    return out


def base_scores(rows):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    cut = lambda t: re.findall(SPACE, lower(t)) + [None]
    count = Counter(w for d, t in rows if not held(d) for w in cut(t))
    n, v = sum(count.values()), len(count)
    return [(d, held(d), len(cut(t)), sum(count[w] > 0 for w in cut(t)), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in cut(t))) for d, t in rows]


def _first(parts_of):
    first = {}
    for doc, parts in parts_of:
        for p in parts:
            first[p] = min(first.get(p, BIG), order(doc))
    return first


def removed_bytes(rows, size=50):
    texts = [(d, (t or "").encode()) for d, t in rows]
    first = _first((d, (b[i : i + size] for i in range(len(b) - size + 1))) for d, b in texts)
    out = []
    for d, b in texts:
        lost = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < order(d):
                lost[i : i + size] = b"\1" * size
        spans = sum(1 for i in range(len(b)) if lost[i] and not (i and lost[i - 1]))
        out.append((d, len(b), sum(lost), spans, sha(bytes(c for c, x in zip(b, lost, strict=True) if not x))))
    return out


def removed_words(rows, size=50):
    texts = [(d, re.findall(SPACE, t or "")) for d, t in rows]
    first = _first((d, (tuple(w[i : i + size]) for i in range(len(w) - size + 1))) for d, w in texts)
    out = []
    for d, w in texts:
        lost = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < order(d):
                lost |= set(range(i, i + size))
        out.append((d, len(w), len(lost), sha(" ".join(x for i, x in enumerate(w) if i not in lost).encode())))
    return out


def simhash(text):
    words = re.findall(SPACE, lower(text))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_groups(rows):
    prints = [simhash(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), BIG), order(d))
    return [(d, f"{prints[i]:016x}", None if low[root(i)] == BIG else low[root(i)]) for i, (d, _) in enumerate(rows)]


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return lower(m[1]), m[2]


def rule(url, rules):
    host, path = host_path(url)
    fits = [r for r, _ in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)
