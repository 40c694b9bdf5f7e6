"""Plain versions of the corpus operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


def secrets(text):
    text = text or ""
    found = {
        "assign": [m for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8],
        "access": [m for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16],
        "hex": [m for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32],
    }
    order = list(found)
    spans = sorted((m.start(), order.index(k), m.end()) for k in found for m in found[k])
    written = ",".join(f"{order[k]}:{a}:{b}" for a, k, b in spans)
    return (*[len(found[k]) for k in order], hashlib.sha256(written.encode()).hexdigest()), {f"{order[k]}:{a}:{b}" for a, k, b in spans}


def fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def shingles(text, size=5):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} or ({" ".join(words)} if words else set())


def wide_fingerprint(text):
    """256 bits of the five-word shingles' SimHash, each word of 64 by its own mix of the shingle's digest."""
    full, out = (1 << 64) - 1, 0
    own = {xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text)}
    for k in range(4):
        counts = [0] * 64
        for h in own:
            x = h + k * 0x9E3779B97F4A7C15 & full
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
            x = (x ^ x >> 27) * 0x94D049BB133111EB & full
            x ^= x >> 31
            for b in range(64):
                counts[b] += x >> b & 1
        out |= sum(1 << b for b in range(64) if 2 * counts[b] > len(own)) << 64 * k
    return out


def linked(fps, bits=4):
    """The least index reachable from each of `fps`."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def contamination(docs, items, size=10):
    """{doc_id: (n_words, n_hit, n_items, sha256)} of lists of (id, text)."""
    windows = defaultdict(set)
    for key, text in items:
        words = tokens(text)
        for w in [words[i : i + size] for i in range(len(words) - size + 1)] if len(words) >= size else [words] if words else []:
            windows[tuple(w)].add(str(key))
    lengths = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        words, hit, found = tokens(text), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if (w := tuple(words[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[w]
        out[doc] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out
