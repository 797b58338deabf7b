import random
import zlib

import numpy as np

from millrace.llm import textarrays as ta
from millrace.llm.toxicity import features, fit_logistic, toxicity

DOCS = "doc_id long, text string, toxic int, score double"
LABELS = "doc_id long, quality int, toxic int"


def made(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        bad = i % 5 == 0
        if bad:
            text.insert(rng.randrange(len(text)), "zorquin" + rng.choice(["", "s", "ed"]))
        docs.append((i, " ".join(text).capitalize(), 0, 0.0))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out_accuracy_and_cases(spark):
    docs, labels = made(1200)
    extra = [(None, "zorquin", 0, 0.0), (5000, None, 0, 0.0), (5001, "", 0, 0.0), (5002, "ß zorquins " + "é a " * 100_000, 0, 0.0), (5001, "", 0, 0.0)]
    labels += [(7000, 1, None), (None, 1, 1), (3, 0, 7)]
    got = toxicity(spark.createDataFrame(docs + extra, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs) + len(extra)
    truth = {i: y for i, _, y in labels[:1200]}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    empty = {r.score for r in got if r.doc_id in (5000, 5001)}
    assert len(empty) == 1


def test_labels_of_held_out_rows_are_never_used(spark):
    docs, labels = made(300)
    flipped = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, q, y in labels]
    df = spark.createDataFrame(docs, DOCS)
    one, two = ({r.doc_id: r.score for r in toxicity(df, spark.createDataFrame(x, LABELS)).collect()} for x in (labels, flipped))
    assert one == two


def test_no_labels_and_no_rows(spark):
    docs, labels = made(20)
    none = spark.createDataFrame([], LABELS)
    assert {r.predicted for r in toxicity(spark.createDataFrame(docs, DOCS), none).collect()} == {0}
    assert toxicity(spark.createDataFrame([], DOCS), none).count() == 0
    assert toxicity(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS)).count() == 0


def test_features_do_not_cross_documents():
    texts = ["abcdéf", "", "éfgh", "ab"]
    import pyarrow as pa

    found, cuts = features(*ta.flat(pa.array(texts)))
    for i, text in enumerate(texts):
        alone, _ = features(*ta.flat(pa.array([text])))
        assert found[cuts[i] : cuts[i + 1]].tolist() == alone.tolist()
        assert len(alone) == sum(max(0, len(text) - n + 1) for n in (3, 4, 5))


def test_fit_separates():
    found, cuts = np.array([0, 1, 0, 2], np.int32), np.array([0, 2, 4])
    model = fit_logistic(found, cuts, np.array([1, 0]), np.ones(2), np.array([0.0, 2.0, -2.0]), penalty=1e-3)
    assert model.weights[1] > 0 > model.weights[2] and model.weights[0] == 0


def plain_scores(docs, labels, penalty=0.002):
    """The same model from sets of n-grams as strings, fitted by plain gradient steps with momentum."""

    def bucket(gram):
        h = 0
        for n, c in enumerate(gram):
            code = int.from_bytes(c.encode(), "little")
            h = code if n == 0 else (h * 0x9E3779B97F4A7C15 + code) % 2**64
        return ((h + len(gram)) * 0xD1B54A32D192ED03) % 2**64 >> 46

    def grams(text):
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return sorted({bucket(text[i : i + n]) for n in (3, 4, 5) for i in range(len(text) - n + 1)})

    sets = {i: grams(t) for i, t, *_ in docs}
    marked = {i: y for i, _, y in labels if i in sets and zlib.crc32(str(i).encode()) % 4 != 2}
    used = sorted({g for s in sets.values() for g in s})
    at = {g: k for k, g in enumerate(used)}
    x = np.zeros((len(sets), len(used)))
    for row, i in enumerate(sets):
        x[row, [at[g] for g in sets[i]]] = 1
    train = np.array([row for row, i in enumerate(sets) if i in marked])
    y = np.array([marked[i] for i in sets if i in marked], float)
    ones, zeros = x[train][y == 1], x[train][y == 0]
    ratio = np.log((ones.sum(axis=0) + 1) / (len(ones) + 2)) - np.log((zeros.sum(axis=0) + 1) / (len(zeros) + 2))
    ratio[ones.sum(axis=0) + zeros.sum(axis=0) == 0] = 0
    z = np.hstack([x[train] * ratio, np.ones((len(train), 1))])
    decay = np.append(np.full(len(used), penalty), 0)
    step = 1 / (0.25 * np.linalg.norm(z, 2) ** 2 / len(train) + penalty)
    theta = ahead = np.zeros(len(used) + 1)
    for t in range(6000):
        pull = 1 / (1 + np.exp(-z @ ahead)) - y
        after = ahead - step * (z.T @ pull / len(train) + decay * ahead)
        ahead, theta = after + t / (t + 3) * (after - theta), after
    margin = (x * ratio) @ theta[:-1] + theta[-1]
    return dict(zip(sets, 1 / (1 + np.exp(-margin)), strict=True))


def test_query_against_brute_force(spark):
    docs, labels = made(160)
    docs += [(900, "", 0, 0.0), (901, "Ünter zorquin é", 0, 0.0)]
    want = plain_scores(docs, labels)
    got = toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    # Both fits stop near the one optimum.
    assert len(got) == len(docs) and max(abs(r.score - want[r.doc_id]) for r in got) < 0.02
    assert all(r.predicted == int(want[r.doc_id] >= 0.3) for r in got if abs(want[r.doc_id] - 0.3) > 0.02)
