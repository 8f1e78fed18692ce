"""Slow, plain versions of the operators, written apart from them."""

import hashlib
import re
from collections import Counter, defaultdict

SPACES = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return SPACES.findall(text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def windows(docs, size=35):
    split = [words(t) for _, t in docs]
    seen = Counter(tuple(w[i:i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for (d, _), w in zip(docs, split, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i:i + size])] > 1:
                gone |= set(range(i, i + size))
        out.append((d, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return ordered(out)


def substrings(docs, size=400):
    data = [(t or "").encode() for _, t in docs]
    seen = Counter(b[i:i + size] for b in data for i in range(len(b) - size + 1))
    out = []
    for (d, _), b in zip(docs, data, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i:i + size]] > 1:
                gone[i:i + size] = b"\1" * size
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return ordered(out)


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near(docs):
    """Rows by position; ids may repeat or be null."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    for k, s in enumerate(sets):
        common = Counter(j for x in s for j in holders[x] if j < k)
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                root[find(k)] = find(j)
    least = {}
    for k, (d, _) in enumerate(docs):
        if d is not None and sets[k]:
            least[find(k)] = min(d, least.get(find(k), d))
    out = []
    for k, (d, _) in enumerate(docs):
        c = least.get(find(k)) if sets[k] else d
        out.append((d, len(sets[k]), c, d == c))
    return ordered(out)


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def contaminated(docs, items, size=13):
    patterns = defaultdict(set)
    for i, t in items:
        w = plain_words(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            patterns[tuple(w[k:k + n])].add("" if i is None else str(i))
    lengths = {len(p) for p in patterns}
    out = []
    for d, t in docs:
        w = plain_words(t)
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                names = patterns.get(tuple(w[k:k + n]))
                if names:
                    hit |= set(range(k, k + n))
                    found |= names
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return ordered(out)


def base_counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i:i + 8])].append(i)
    rep = {k for p in at.values() if len(p) > 1 for i in p for k in range(i, i + 8)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(rep)


def normal(line):
    return re.sub("[ \t\n\x0b\f\r]+", " ", line).strip(" ").lower()


def quality(docs, max_docs=20):
    """docs: (id, text, host)."""
    holders = defaultdict(set)
    for _, t, h in docs:
        for x in (t or "").split("\n"):
            if words(x):
                holders[h, normal(x)].add(t)
    out = []
    for d, t, h in docs:
        n, chars, symbols, dup, rep = base_counts(t)
        often = [x for x in (t or "").split("\n") if len(holders[h, normal(x)]) > max_docs]
        left = n - sum(len(words(x)) for x in often)
        failed = n < 20 or 100 * rep > 30 * n
        out.append((d, n, chars, symbols, dup, rep, failed, not failed and left >= 20 and 2 * left >= n))
    return ordered(out)


def shares(sizes, weights=(3, 1, 2), percent=150, most=2):
    """Targets by sharing the excess again until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    done = {}
    while True:
        rest = percent / 100 * sum(sizes.values()) - sum(done.values())
        free = [s for s in names if s not in done]
        total = sum(weight[s] for s in free)
        now = {s: rest * weight[s] / total for s in free}
        over = [s for s in free if now[s] > most * sizes[s]]
        if not over:
            return done | now
        done |= {s: float(most * sizes[s]) for s in over}


def patience(a, b, at=0, bt=0):
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    q = 0
    while q < min(len(a), len(b)) - p and a[-1 - q] == b[-1 - q]:
        q += 1
    out = [(at + k, bt + k) for k in range(p)] + [(at + len(a) - 1 - k, bt + len(b) - 1 - k) for k in range(q)]
    a, b, at, bt = a[p:len(a) - q], b[p:len(b) - q], at + p, bt + p
    points = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
    if not points:
        return out
    best, back = [1] * len(points), [-1] * len(points)
    for k in range(len(points)):
        for j in range(k):
            if points[j][1] < points[k][1] and best[j] + 1 > best[k]:
                best[k], back[k] = best[j] + 1, j
    k = max(range(len(points)), key=best.__getitem__)
    run = []
    while k >= 0:
        run.append(points[k])
        k = back[k]
    i0 = j0 = 0
    for i, j in run[::-1]:
        out += patience(a[i0:i], b[j0:j], at + i0, bt + j0) + [(at + i, bt + j)]
        i0, j0 = i + 1, j + 1
    return out + patience(a[i0:], b[j0:], at + i0, bt + j0)


def aligned(docs, min_words=20):
    """docs with distinct ids, in order."""
    lines = {d: [normal(x) for x in t.split("\n")] if t is not None else [] for d, t in docs}
    first = {}
    for d, _ in docs:
        for x in lines[d]:
            if x:
                first.setdefault(x, d)
    out = []
    for d, t in docs:
        partners = {first[x] for x in lines[d] if x} - {d}
        cut = set()
        for e in partners:
            blocks = []
            for pair in sorted(patience(lines[d], lines[e])):
                if blocks and blocks[-1][-1] == (pair[0] - 1, pair[1] - 1):
                    blocks[-1].append(pair)
                else:
                    blocks.append([pair])
            for b in blocks:
                if sum(len(words(lines[d][i])) for i, _ in b) >= min_words:
                    cut |= {i for i, _ in b}
        kept = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in cut)
        out.append((d, len(lines[d]), len(partners), len(cut), sha(kept)))
    return ordered(out)
