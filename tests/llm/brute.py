"""Plain versions of the operators, one row after the other, to hold the Spark results against."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(rows):
    prints = {i: simhash(t) for i, t in rows}
    ids = sorted(prints)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3]
    root = components(pairs, ids)
    return {i: (f"{prints[i]:016x}", root[i]) for i in ids}


def exact(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    first, size = {}, Counter(norm.values())
    for i in sorted(norm):
        first.setdefault(norm[i], i)
    return {i: (first[n], size[n], first[n] == i, hashlib.sha256(n.encode()).hexdigest()) for i, n in norm.items()}


def licenses(rows, phrases):
    out = {}
    for i, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        at = [(k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        places = [k for k, _ in at]
        out[i] = (len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at})))
    return out


def rule_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, marked = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            marked |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 10 or 100 * len(marked) > 20 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(marked), failed


def substring(rows, span=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        words = WORD.findall(t or "")
        gone = set()
        for k in range(len(words) - span + 1):
            window = tuple(words[k : k + span])
            if window in seen:
                gone |= set(range(k, k + span))
            seen.add(window)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out[i] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def quality_statistics(text):
    """The twelve statistics, counted byte by byte."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    count = lambda marks: sum(raw.count(bytes([m])) for m in marks)
    upper, lower = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)
    letters, n, size = upper + lower + sum(b >= 128 for b in raw), max(1, len(words)), len(raw)
    lines = [x.strip(b" \t\n\v\f\r") for x in raw.split(b"\n")]
    lines = [x for x in lines if x]
    again = rule_counts(text or "")[4]
    return [
        math.log(1 + len(words)), math.log(1 + size / n), (upper / (letters + 10)) ** 0.5, (count(b"#*$%&|<>=+~^_\\{}[]@") / (size + 10)) ** 0.5,
        (count(b"!?") / (size + 10)) ** 0.5, (count(b"0123456789") / (size + 10)) ** 0.5, (count(b".,;:'\"()-") / (size + 10)) ** 0.5, len(set(words)) / n**0.9,
        (sum(a == b for a, b in zip(words, words[1:])) / (n + 10)) ** 0.5, (again / (n + 10)) ** 0.5,
        ((len(lines) - len(set(lines))) / (len(lines) + 5)) ** 0.5, math.log(1 + n / max(1, len(lines))),
    ]


def quality_scores(train, texts, shrink, temper, floor):
    """A regularised quadratic discriminant by its definition: explicit inverses and determinants."""
    x, y = np.array([quality_statistics(t) for t, _ in train]), np.array([c for _, c in train])
    scale = np.sqrt(np.maximum(x.var(axis=0), floor))
    out = []
    for t in texts:
        log = []
        for c in (0, 1):
            own = x[y == c] / scale
            cov = (1 - shrink) * np.cov(own.T, bias=True) + shrink * np.eye(len(scale))
            d = np.array(quality_statistics(t)) / scale - own.mean(axis=0)
            log.append(-0.5 * (d @ np.linalg.inv(cov) @ d + np.linalg.slogdet(cov)[1]))
        prior = math.log((sum(y == 1) + 1) / (sum(y == 0) + 1))
        out.append(1 / (1 + math.exp(-max(-60, min(60, temper * (log[1] - log[0]) + prior)))))
    return out


def languages(train, texts, letter):
    """Hyperdimensional profiles letter by letter; `letter` gives a code point's vector."""

    def bundle(text):
        if not any(c.isalpha() for c in text or ""):
            return None
        runs = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        total = 0
        for a, b, c in zip(runs, runs[1:], runs[2:]):
            total = total + np.roll(letter(ord(a)), 2).astype(float) * np.roll(letter(ord(b)), 1) * letter(ord(c))
        return total / np.linalg.norm(total)

    names = sorted({lang for _, lang in train})
    sums = [sum(v for t, x in train if x == lang and (v := bundle(t)) is not None) for lang in names]
    unit = np.array([s / np.linalg.norm(s) for s in sums])
    centred = unit - unit.mean(axis=0)
    centred /= np.linalg.norm(centred, axis=1, keepdims=True)
    out = []
    for t in texts:
        v = bundle(t)
        near = None if v is None else centred @ v
        out.append(("und", 0.0) if v is None else (names[int(near.argmax())], (1 + near.max()) / 2))
    return out
