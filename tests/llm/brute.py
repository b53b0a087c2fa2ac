"""Plain restatements of what the operators return, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall((text or "").translate(LOW))


def tokens(text, lower=False):
    return TOKEN.findall((text or "").translate(LOW) if lower else text or "")


def rem(doc_id, m):
    return zlib.crc32(str(doc_id).encode()) % m


def decontaminated(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - size + 1, 1)):
            if w:
                windows[tuple(w[i : i + size])].add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k]
        found = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return out


def fingerprint(text):
    w = tokens(text, lower=True)
    said = [" ".join(w)] if 0 < len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in said]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def linked(docs):
    prints = [(d, fingerprint(t)) for d, t in docs]
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, f"{p:016x}", least.get(find(i))) for i, (d, p) in enumerate(prints)]


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """By the words of the task: stop at the cap, share the excess again by weight, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    t = {s: share * sum(sizes.values()) * w[s] / sum(w.values()) for s in names}
    stopped = set()
    while over := [s for s in names if t[s] > most * sizes[s] + 1e-9]:
        excess = sum(t[s] - most * sizes[s] for s in over)
        stopped |= set(over)
        t |= {s: most * sizes[s] for s in over}
        free = [s for s in names if s not in stopped]
        for s in free:
            t[s] += excess * w[s] / sum(w[x] for x in free)
    return t


def near_copies(docs):
    """The least id of each group of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets, of = [], defaultdict(list)
    for i, (_, text) in enumerate(docs):
        w = tokens(text, lower=True)
        sets.append({" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
        for s in sets[-1] or {None}:
            of[s].append(i)
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, mine in enumerate(sets):
        shared = Counter(j for s in mine or {None} for j in of[s] if j < i)
        for j, n in shared.items():
            n = n if mine else 0
            if not mine or n >= 0.8 * (len(mine) + len(sets[j]) - n) - 1e-9:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return least.values()
