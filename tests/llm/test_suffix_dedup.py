import hashlib
import random

import numpy as np
import pytest

from millrace.llm.suffix_dedup import Extensions, cut_texts, merge_sort, remove_repeats, sliding_argmin, stretches, window_classes

SCHEMA = "doc_id long, text string, anchor int, uses string, start long"


def brute(rows):
    """Rows with their result; equal (id, text) rows count once. Assumes no two texts of one id."""
    docs = sorted({(i is None, i or 0, (t or "").encode()) for i, t, *_ in rows})
    seen, out = set(), {}
    for none, i, text in docs:
        covered = bytearray(len(text))
        for p in range(len(text) - 99):
            w = text[p : p + 100]
            if w in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(c and not (p and covered[p - 1]) for p, c in enumerate(covered))
        kept = bytes(b for b, c in zip(text, covered, strict=True) if not c)
        out[None if none else i] = (len(text), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return sorted(((i, *out[i]) for i, *_ in rows), key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(150)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passages = [prose(rng.randint(18, 60)) for _ in range(6)]
    rows = []
    for i in range(150):
        parts = [prose(rng.randint(0, 40)) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, 3), rng.choice(passages))
        rows.append((rng.randint(0, 10**9) * 200 + i, " ".join(parts)))
    rows += [(7, rows[3][1]), (8, rows[3][1]), (9, "a" * 3000), (11, "b" + "a" * 200), (12, "ab" * 400), (13, None), (14, ""), (15, "x" * 99), (16, "y" * 100), (17, "y" * 100), (None, rows[5][1] + "tail"), (7, rows[3][1])]
    return [(i, t, 1, "", 1) for i, t in rows]


@pytest.mark.parametrize("hot", [4096, 3])
def test_against_brute_force(spark, hot):
    rows = corpus(hot)
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(6), hot_stretches=hot, bucket_stretches=50).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute(rows)


def test_many_copies_of_a_row_and_a_long_text(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3_000_000))
    rows = [(None, "z" * 50 + "".join(rng.choice("abc") for _ in range(300)), 1, "", 1)] * 400 + [(4, long[1_000_000:1_000_400], 1, "", 1), (3, long, 1, "", 1)]
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    assert len(got) == 402 and {(r.n_removed, r.n_spans) for r in got if r.doc_id is None} == {(0, 0)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in got if r.doc_id} == {3: (3_000_000, 0, 0), 4: (400, 400, 1)}


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_merge_sort_is_a_suffix_sort():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1400] = data[:400]
    starts = rng.permutation(len(data) - 99)
    segment = rng.integers(0, 3, len(starts))
    order = merge_sort(Extensions(data), starts, segment)
    text = data.tobytes()
    keys = [(segment[i], text[starts[i] : starts[i] + 100]) for i in order]
    assert keys == sorted(keys)
    classes = window_classes(data, starts, segment)
    assert len(set(classes.tolist())) == len(set(keys))


def test_collision_falls_back_to_bytes(monkeypatch):
    def clash(self, i, j):
        raise ArithmeticError

    monkeypatch.setattr(Extensions, "compare", clash)
    data = np.frombuffer(b"ab" * 200, np.uint8)
    classes = window_classes(data, np.arange(301), np.zeros(301, np.int64))
    assert len(set(classes.tolist())) == 2


def test_sliding_argmin():
    values = np.random.default_rng(2).integers(0, 1 << 60, 500).astype(np.uint64)
    for width in (1, 2, 77, 500):
        assert sliding_argmin(values, width).tolist() == [values[i : i + width].min() for i in range(500 - width + 1)]


def test_stretches_cover_every_window_once():
    texts = [b"a" * 250, b"", b"z" * 99, bytes(range(65, 91)) * 20]
    offsets = np.cumsum([0, *map(len, texts)])
    doc, start, run, gap, _ = stretches(np.frombuffer(b"".join(texts), np.uint8), offsets)
    seen = sorted((d, s + i) for d, s, r in zip(doc.tolist(), start.tolist(), run.tolist(), strict=True) for i in range(r))
    assert seen == [(d, s) for d, t in enumerate(texts) for s in range(len(t) - 99)]
    assert ((gap - run + 1 >= 0) & (gap < 77)).all()


def test_cut_texts():
    texts, none = [b"x" * 300, b"", b"short", b"y" * 100, b"z" * 250], np.zeros(0, np.int64)
    offsets = np.cumsum([0, *map(len, texts)])
    uses = (np.array([0, 305, 405, 505]), np.array([201, 1, 1, 40]))
    removed, spans, kept = cut_texts(np.frombuffer(b"".join(texts), np.uint8), offsets, uses, (np.array([0, 505]), np.array([1, 39])))
    # Windows that touch at the end of a text and the start of the next are two runs.
    assert removed.tolist() == [299, 0, 0, 100, 200] and spans.tolist() == [1, 0, 0, 1, 2] and kept == [b"x", b"", b"short", b"", b"z" * 50]
    assert cut_texts(np.zeros(0, np.uint8), np.array([0, 0]), (none, none), (none, none))[2] == [b""]
