"""Plain versions of the operators, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def lower_az(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def quality_measures(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    times = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    covered = set()
    for k, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(k, k + 8))
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def shingles(text):
    words = WORD.findall(lower_az(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def components(docs):
    """{doc_id: (set size, smallest reachable doc_id)} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 0.79 < len(x) / len(y) < 1.26:
                both = len(x & y)
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    ra, rb = sorted((root(a), root(b)))
                    parent[rb] = ra
    return {i: (len(sets[i]), root(i)) for i in ids}


def removed_bytes(docs, size=100):
    """{doc_id: (bytes, removed, spans, digest of the rest)} by looking up every stretch."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - size + 1):
            part = data[k : k + size]
            if part in seen:
                gone[k : k + size] = b"\1" * size
            seen.add(part)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[i] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept))
    return out
