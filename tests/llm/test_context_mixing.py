import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from millrace.llm import context_mixing as cm

SCHEMA = "doc_id long, text string, block int, slab int, train int"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\n"]


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


def corpus(n=200, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(120)]
    rows = [(i, rng.choice([" ", "\n "]).join(rng.choice(words).capitalize() for _ in range(rng.randint(0, 80)))) for i in range(n)]
    rows += [(None, "Ab cd"), (1000, None), (1001, ""), (1002, " \t"), (5, rows[5][1]), (1003, "x" * 50_000), (1004, "q\x00z")]
    return [(i, t, 1, 1, 1) for i, t in rows]


def test_base_and_counts_against_brute_force(spark):
    rows = corpus()
    got = cm.lm_scores(spark.createDataFrame(rows, SCHEMA), block_bytes=3000, slab_bytes=20_000).collect()
    c = Counter(w for i, t, *_ in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = []
    for i, t, *_ in rows:
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
        want.append((i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(base, 6)))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == sorted(want, key=str)
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)
    prose = [r for r in got if r.held_out and r.n_tokens > 20]
    assert np.mean([r.bits_per_byte for r in prose]) < 2.6


def test_scores_do_not_depend_on_blocks_or_held_out_texts(spark, monkeypatch):
    rows = corpus(60)
    few = {"slab_bytes": 8000}
    one = cm.lm_scores(spark.createDataFrame(rows, SCHEMA), **few).collect()
    two = cm.lm_scores(spark.createDataFrame(rows, SCHEMA).repartition(3), block_bytes=2000, **few).collect()
    for a, b in zip(sorted(one, key=str), sorted(two, key=str), strict=True):
        assert a.doc_id == b.doc_id and abs(a.score - b.score) < 1e-6 * abs(a.score)
    # Held-out texts grow tenfold: neither the cuts between slabs nor what they learn may change.
    other = [(i, "zzz yyy xxx " * 300 if held(i) else t, *x) for i, t, *x in rows]
    seen = []
    cuts = cm.slab_cuts
    monkeypatch.setattr(cm, "slab_cuts", lambda *a: seen.append(cuts(*a)) or seen[-1])
    three = {r.doc_id: r.score for r in cm.lm_scores(spark.createDataFrame(other, SCHEMA), **few).collect() if not r.held_out}
    assert len(seen[0]) >= 4
    assert all(abs(three[r.doc_id] - r.score) < 1e-9 for r in one if not r.held_out)


def digits(before):
    """The digits of the six bytes before one (nearest first), as the keys hold them."""
    past = [*reversed(before[-6:])] + [0] * (6 - len(before[-6:]))
    return (past[0], past[1], past[2], past[3], int(cm._SEVEN[past[4]]), int(cm._SEVEN[past[5]]))


def brute_model(rows, cuts):
    """Scores by dictionaries of counts and one bit at a time; the slab of a key is part of its longer contexts."""

    def key(d, symbol):
        top = ((d[0] << 8 | d[1]) * cm._ODD) & 0xFFFF
        return top << 38 | d[2] << 30 | d[3] << 22 | d[4] << 15 | d[5] << 8 | symbol

    def slab(d):
        return sum(key(d, 0) >= c for c in cuts)

    def stream(text):
        return (" ".join(tokens(text)[:-1]) + "\n").encode()

    counts, seen = Counter(), Counter()
    for i, t, *_ in rows:
        if not held(i):
            text = stream(t)
            for at, symbol in enumerate(text):
                d = digits(text[:at])
                counts[d, symbol] += 1
                for order in range(cm.ORDERS):
                    for bits in range(9):
                        seen[order, d[:order], slab(d) if order > 1 else 0, bits, symbol >> (8 - bits)] += 1

    def bit(d, symbol, b, own):
        odds, longest, weight = [], 0, max(seen[0, (), 0, b, symbol >> (8 - b)] - own, 0)
        for order in range(cm.ORDERS):
            where = (order, d[:order], slab(d) if order > 1 else 0)
            node, child = max(seen[(*where, b, symbol >> (8 - b))] - own, 0), max(seen[(*where, b + 1, symbol >> (7 - b))] - own, 0)
            odds.append(math.log((child + cm.DELTA) / (node - child + cm.DELTA)) if node else 0.0)
            if node:
                longest, weight = order, node
        return odds, (b * cm.ORDERS + longest) * 3 + (weight > 2) + (weight > 20)

    def squash(x):
        return 1 / (1 + math.exp(-min(30, max(-30, x))))

    all_weights, table, mass = np.zeros((cm.GATES, cm.ORDERS)), np.zeros((8, cm.BINS)), 0
    for s in range(len(cuts) + 1):
        mine = [(d, x, n) for (d, x), n in counts.items() if slab(d) == s]
        order = np.argsort(cm.ta.mix(np.array([key(d, x) for d, x, _ in mine], np.uint64)), kind="stable")
        weights = cm.first_weights()
        for epoch in range(cm.EPOCHS):
            for a in range(0, len(mine), cm.BATCH):
                pull, heavy = np.zeros_like(weights), np.zeros(cm.GATES)
                for p in order[a : a + cm.BATCH]:
                    d, x, n = mine[p]
                    for b in range(8):
                        odds, gate = bit(d, x, b, 1)
                        logit = float(np.dot(odds, weights[gate]))
                        heavy[gate] += math.log1p(n)
                        pull[gate] += (1 - squash(logit)) * math.log1p(n) * np.array(odds)
                        if epoch == cm.EPOCHS - 1:
                            table[b, min(cm.BINS - 1, max(0, round(logit * 2) + cm.BINS // 2))] += n
                weights += (cm.RATE * np.sqrt(np.maximum(heavy, 1)) / np.maximum(heavy, 1))[:, None] * pull
        total = sum(n for _, _, n in mine)
        all_weights, mass = all_weights + weights * total, mass + total
    all_weights /= mass
    out = {}
    for text in {stream(t) for _, t, *_ in rows}:
        score = 0.0
        for at, x in enumerate(text):
            d = digits(text[:at])
            for b in range(8):
                odds, gate = bit(d, x, b, 0)
                logit = float(np.dot(odds, all_weights[gate]))
                place = min(cm.BINS - 1, max(0, logit * 2 + cm.BINS // 2))
                low = min(int(place), cm.BINS - 2)
                near = [(table[b, i] + 20 * squash((i - cm.BINS // 2) / 2)) / (table[b, i] + table[b, cm.BINS - 1 - i] + 20) for i in (low, low + 1)]
                second = near[0] * (1 - place + low) + near[1] * (place - low)
                score += math.log10(min(1 - 1e-7, max(1e-7, (squash(logit) + second) / 2)))
        out[text] = score
    return {(i, t): out[stream(t)] for i, t, *_ in rows}


def test_scores_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5))) for _ in range(25)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 14))), 1, 1, 1) for i in range(60)]
    rows += [(None, "ab ba", 1, 1, 1), (70, None, 1, 1, 1), (71, "  ", 1, 1, 1), (3, rows[3][1], 1, 1, 1), (72, "Q\x00 ~", 1, 1, 1)]
    seen, cuts = [], cm.slab_cuts
    monkeypatch.setattr(cm, "slab_cuts", lambda *a: seen.append(cuts(*a)) or seen[-1])
    monkeypatch.setattr(cm, "BATCH", 512)
    got = cm.lm_scores(spark.createDataFrame(rows, SCHEMA), block_bytes=700, slab_bytes=700).collect()
    assert len(seen[0]) >= 2
    brute = brute_model(rows, [int(c) for c in seen[0]])
    want = sorted(((i, brute[i, t]) for i, t, *_ in rows), key=str)
    for (i, score), r in zip(want, sorted(((r.doc_id, r.score) for r in got), key=str), strict=True):
        # Log probabilities of bytes are kept in half precision.
        assert i == r[0] and abs(score - r[1]) < 2e-3 * abs(score), (i, score, r[1])


def test_copies_of_one_row_are_spread_and_scored_alike(spark):
    rows = corpus(30) + [(None, "one row of many", 1, 1, 1)] * 200 + [(1, "and another one", 1, 1, 1)] * 200
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    one, two = (sorted(cm.lm_scores(df, block_bytes=b).collect(), key=str) for b in (10**8, 1500))
    assert len(one) == len(rows) and [(a.doc_id, a.n_tokens, a.n_known, a.train_tokens) for a in one] == [(b.doc_id, b.n_tokens, b.n_known, b.train_tokens) for b in two]
    assert all(abs(a.score - b.score) < 1e-6 * abs(a.score) for a, b in zip(one, two, strict=True))


def test_no_rows_and_no_training_rows(spark):
    assert cm.lm_scores(spark.createDataFrame([], SCHEMA)).count() == 0
    row = cm.lm_scores(spark.createDataFrame([(None, "ab", 1, 1, 1)], SCHEMA)).first()
    assert row.n_known == 0 and row.train_tokens == 0 and abs(row.bits_per_byte - 8) < 1e-3


def test_probabilities_of_all_next_bytes_sum_to_one():
    stream, offsets, _, _ = cm.tokens_stream(pa.array([t for _, t, *_ in corpus(40)]))
    keys, counts = cm._counted(cm.context_keys(stream, offsets), np.ones(len(stream), bool))
    pairs = np.bincount(cm.nearest(keys) << 8 | (keys & np.uint64(255)).astype(np.int64), counts, 1 << 16).astype(float)
    weights, table = cm.learn(cm.Evidence(keys, counts, pairs), counts, cm.first_weights())
    context = keys[len(keys) // 2] >> np.uint64(8) << np.uint64(8)
    every = np.union1d(keys, context | np.arange(256, dtype=np.uint64))
    full = np.zeros(len(every), np.int64)
    full[np.searchsorted(every, keys)] = counts
    scores = cm.log10_probability(cm.Evidence(every, full, pairs), len(every), weights, table)
    picked = np.searchsorted(every, context | np.arange(256, dtype=np.uint64))
    assert abs((10.0 ** scores[picked].astype(float)).sum() - 1) < 1e-3


def test_stream_is_words_spaces_and_end():
    texts = ["  Ab\tcD\n", "", None, "x", "é É "]
    stream, offsets, _, first = cm.tokens_stream(pa.array(texts))
    got = [stream[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:], strict=False)]
    assert got == ["ab cd\n", "\n", "\n", "x\n", "é É\n"] and np.diff(first).tolist() == [2, 0, 0, 1, 2]


def test_keys_pack_and_contexts():
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert (cm._unpack_sorted(cm._pack_sorted(keys)) == keys).all() and len(cm._unpack_sorted(cm._pack_sorted(keys[:0]))) == 0
    stream, offsets = np.frombuffer(b"abcdefgh\nxy\n", np.uint8), np.array([0, 9, 12])
    made = cm.context_keys(stream, offsets)
    assert cm.nearest(made).tolist() == [0, *b"abcdefgh", 0, *b"xy"]
    assert made[7] & np.uint64(0xFF) == ord("h") and made[7] >> np.uint64(30) & np.uint64(0xFF) == ord("e")
    assert made[7] >> np.uint64(8) & np.uint64(0x7F) == cm._SEVEN[ord("b")] and (made < np.uint64(1 << 54)).all()
