"""Plain restatements of the queries' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

UPPER = {c: c + 32 for c in range(65, 91)}


def low(text):
    return (text or "").translate(UPPER)


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def near_duplicates(rows, k=4):
    """rows: (doc_id, text) with distinct ids -> {doc_id: (n_shingles, component)}."""
    sets = {}
    for i, text in rows:
        w = spaced(low(text))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(len(w) - k, 0) + 1)} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    having = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            having[x].append(i)
    for i, s in sets.items():
        both = Counter(j for x in s for j in having[x] if j < i)
        for j, n in both.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def base_quality(text):
    text = text or ""
    w = spaced(text)
    lines = [x for x in text.split("\n") if spaced(x)]
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {i + j for places in at.values() if len(places) > 1 for i in places for j in range(8)}
    n = len(w)
    return (
        n,
        sum(map(len, w)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
        n < 20 or 100 * len(covered) > 30 * n,
    )


def licenses(text):
    w = alnum(text)
    places = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def secrets(text):
    text = text or ""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = ["assign", "access", "hex"]
    n = Counter(x[0] for x in spans)
    listed = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], kinds.index(x[0]))))
    return n["assign"], n["access"], n["hex"], sha(listed)


def contaminated(docs, items, window=10):
    grams = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        w = alnum(text)
        size = min(len(w), window)
        for i in range(len(w) - size + 1 if w else 0):
            grams[size][tuple(w[i : i + size])].add(item)
    out = []
    for i, text in docs:
        w = alnum(text)
        hit, found = set(), set()
        for size, known in grams.items():
            for j in range(len(w) - size + 1):
                who = known.get(tuple(w[j : j + size]))
                if who is not None:
                    hit.update(range(j, j + size))
                    found |= {str(x) for x in who if x is not None}
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def dedup_lines(rows, min_sites=3, min_words=5):
    """rows: (doc_id, text, source) with distinct ids -> {doc_id: (text, n_lines, n_removed)}."""
    sites, first = defaultdict(set), {}
    for i, text, source in sorted(rows, key=lambda r: r[0]):
        for at, line in enumerate(text.split("\n") if text is not None else []):
            line = line.strip(" \t\r\x0b\x0c")
            if len(re.split(r"[\x20\x09-\x0D]+", line)) >= min_words:
                if source is not None:
                    sites[line].add(source)
                first.setdefault(line, (i, at))
    out = {}
    for i, text, source in rows:
        if text is None:
            out[i] = (None, 0, 0)
            continue
        lines = text.split("\n")
        keep = [
            x
            for at, x in enumerate(lines)
            if len(sites.get(x.strip(" \t\r\x0b\x0c"), ())) < min_sites or first[x.strip(" \t\r\x0b\x0c")] == (i, at)
        ]
        out[i] = ("\n".join(keep), len(lines), len(lines) - len(keep))
    return out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
