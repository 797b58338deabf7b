"""Plain versions of operators, one row at a time, that share no code with them."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import xxhash

MASK = (1 << 64) - 1


def spark_hash(*values):
    """xxhash64 as the engine defines it: chained over the values from seed 42; ints in 4 bytes as ``("int", x)``."""
    h = 42
    for v in values:
        if v is None:
            continue
        if isinstance(v, tuple):
            data = (v[1] & 0xFFFFFFFF).to_bytes(4, "little")
        elif isinstance(v, int):
            data = (v & MASK).to_bytes(8, "little")
        else:
            data = v if isinstance(v, bytes) else v.encode()
        h = xxhash.xxh64_intdigest(data, seed=h)
    return h - (1 << 64) if h >> 63 else h


def ranks(items, hash_of, tie_of, buckets):
    """Place of each item by range of its hash (as unsigned), hash (as signed) and tie."""
    width = (1 << 62) // buckets + 1
    order = sorted(items, key=lambda x: (((hash_of(x) & MASK) >> 2) // width, hash_of(x), tie_of(x)))
    return {tie_of(x): i for i, x in enumerate(order)}


def moves(wishes, sizes, capacity):
    """Granted moves: swaps first, then the shards with the most room take from the fullest while there is room."""
    n, size = len(sizes), list(sizes)
    out = [[min(wishes[a][b], wishes[b][a]) * (a != b) for b in range(n)] for a in range(n)]
    while True:
        before = [row[:] for row in out]
        for b in sorted(range(n), key=lambda s: (size[s], s)):
            for a in sorted(set(range(n)) - {b}, key=lambda s: (-size[s], s)):
                more = max(0, min(wishes[a][b] - out[a][b], math.floor(capacity) - size[b]))
                out[a][b], size[a], size[b] = out[a][b] + more, size[a] - more, size[b] + more
        if out == before:
            return out


def shards(texts, n, rounds=8, bucket_rows=4096, dealt=False):
    """(shard, slot) of rows 0, 1, ... by balanced label propagation; equal texts are linked."""
    hubs = [None if t is None else hashlib.md5(t.encode()).digest() for t in texts]
    sizes = Counter(h for h in hubs if h is not None)
    linked = [sizes[h] if h is not None else 1 for h in hubs]
    rows = range(len(texts))
    at = [r % n if dealt else spark_hash(("int", 1), r) % n for r in rows]
    capacity = max(1, len(texts) // n)
    big = [linked[r] > max(2, capacity // 64) for r in rows]

    def chance(*values):
        return ((spark_hash(*values) & MASK) >> 11) / (1 << 53)

    for turn in range(rounds):
        votes, full_of = defaultdict(Counter), Counter()
        for r in rows:
            if linked[r] > 1:
                votes[hubs[r]][at[r]] += 1
                full_of[at[r]] += 1
        fill = [full_of[s] for s in range(n)]
        full = [x >= capacity for x in fill]
        wish = list(at)
        for r in rows:
            if linked[r] > 1:
                ranked = sorted(range(n), key=lambda s: (votes[hubs[r]][s], spark_hash(("int", s), hubs[r]), s), reverse=True)
                free = [s for s in ranked if not full[s]]
                first = ranked[0]
                wish[r] = at[r] if at[r] == first else (free[0] if free else at[r]) if full[first] else first
        asked = Counter((big[r], at[r], wish[r]) for r in rows if wish[r] != at[r])
        share, moved = {}, False
        for kind in (False, True):
            granted = moves([[asked[kind, a, b] for b in range(n)] for a in range(n)], fill, capacity)
            for a in range(n):
                for b in range(n):
                    share[kind, a, b] = granted[a][b] / asked[kind, a, b] if asked[kind, a, b] else 0.0
                    moved |= granted[a][b] > 0
            fill = [fill[s] - sum(granted[s]) + sum(g[s] for g in granted) for s in range(n)]
        if not moved:
            break
        at = [wish[r] if wish[r] != at[r] and chance(("int", turn), r if big[r] else hubs[r]) < share[big[r], at[r], wish[r]] else at[r] for r in rows]
    # Even out: unlinked rows go first, then small groups, then rows of large ones.
    count = [at.count(s) for s in range(n)]
    fullest = sorted(range(n), key=lambda s: (-count[s], s))
    goal = [len(texts) // n + (fullest.index(s) < len(texts) % n) for s in range(n)]

    def order(r):
        tier, key = (0, r) if linked[r] == 1 else (1, hubs[r]) if linked[r] <= bucket_rows // 4 else (2, r)
        return tier << 61 | (spark_hash(key) & MASK) >> 3

    going = []
    for s in range(n):
        place = ranks([r for r in rows if at[r] == s], order, lambda r: r, 4 * max(1, math.ceil(max(count) / bucket_rows)))
        going += sorted((r for r in place if place[r] < max(0, count[s] - goal[s])), key=place.get)
    room = [s for s in range(n) for _ in range(max(0, goal[s] - count[s]))]
    for r, s in zip(going, room, strict=True):
        at[r] = s
    slots = {}
    total = len(texts)
    buckets = max(1, math.ceil(total / n / bucket_rows))
    for s in range(n):
        mine = [r for r in rows if at[r] == s]
        if dealt:
            slots |= {r: i for i, r in enumerate(sorted(mine))}
        else:
            slots |= ranks(mine, lambda r: spark_hash(("int", 7), r), lambda r: r, buckets)
    return [(at[r], slots[r]) for r in rows]


def mixture(rows, block=32, bucket_rows=4096):
    """Position of each (id, source), ids distinct: exact earliest-deadline-first over blocks; weights are rows ** 0.5."""
    sources = defaultdict(list)
    for i, s in rows:
        sources[s].append(i)
    size = {s: len(x) for s, x in sources.items()}
    buckets = max(1, math.ceil(max(size.values()) / bucket_rows))
    place = {s: ranks(x, lambda i: spark_hash(("int", 6), i), lambda i: i, buckets) for s, x in sources.items()}
    left, done, start, at = {s: -(-n // block) for s, n in size.items()}, Counter(), {}, 0
    while left:
        total = sum(size[s] ** 0.5 for s in left)
        w = {s: Fraction(size[s] ** 0.5) / Fraction(total) for s in left}
        ran, t = Counter(), 0
        while all(left.values()):
            due = [(math.ceil((ran[s] + 1) / w[s]), str(s), s) for s in left if math.floor(ran[s] / w[s]) <= t]
            s = min(due, key=lambda x: x[:2])[2]
            start[s, done[s]] = at
            at += min(block, size[s] - done[s] * block)
            done[s], ran[s], left[s], t = done[s] + 1, ran[s] + 1, left[s] - 1, t + 1
        left = {s: n for s, n in left.items() if n}
    return {i: start[s, place[s][i] // block] + place[s][i] % block for i, s in rows}


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def components(rows, k=5, percent=80):
    """Least id that each (id, text) reaches over links of similar shingle sets."""
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def contaminated(text, items, similarity=0.8):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())

    def runs(w):
        return Counter([tuple(w)] if len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])

    doc = words(text)
    for item in items:
        v = words(item)
        for s in range(max(1, len(doc) - len(v) + 1) if v and doc else 0):
            a, b = runs(doc[s : s + len(v)]), runs(v)
            if sum((a & b).values()) >= similarity * sum((a | b).values()):
                return True
    return False


def crc(text):
    return zlib.crc32((text or "").encode())
