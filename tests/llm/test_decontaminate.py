import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate
from millrace.llm.decontaminate import contamination, simhash, without_contaminated

DOCS = "doc_id long, text string, kid long, m int, words string"
ITEMS = "item_id long, text string, part int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def runs(w):
    return Counter([tuple(w)] if len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute(doc, items):
    w, found = words(doc), {}
    for item, text in items:
        v = words(text)
        if not v or not w:
            continue
        best = 0.0
        for s in range(max(1, len(w) - len(v) + 1)):
            a, b = runs(w[s : s + len(v)]), runs(v)
            best = max(best, sum((a & b).values()) / sum((a | b).values()))
        if best >= 0.8:
            found[item] = best
    return found


@pytest.fixture(scope="module")
def world():
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(200)] + ["é", "ünt"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 15, 40, 60])))) for i in range(25)]
    items += [(90, ""), (91, None), (92, items[1][1])]
    docs = []
    for i in range(120):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 150))]
        if i % 3 == 0:
            leak = words(items[rng.randrange(25)][1])
            for _ in range(rng.choice([0, 0, 1, 2])):
                leak[rng.randrange(len(leak))] = rng.choice(vocabulary)
            at = rng.randint(0, len(text))
            text[at:at] = leak[rng.choice([0, 0, 2]) :]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(text).replace("v1", "V1")))
    docs += [(500, None), (501, ""), (502, "..."), (None, items[1][1]), (0, docs[0][1]), (503, items[1][1] * 300)]
    return docs, items


def test_against_brute_force(spark, world):
    docs, items = world
    df = spark.createDataFrame([(i, t, 1, 1, "") for i, t in docs], DOCS)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    got = contamination(df, bench).collect()
    assert len(got) == len(docs)
    texts = {i: brute(t, items) for i, t in docs}
    for r in got:
        want = texts[r.doc_id]
        assert (r.contaminated, r.n_items) == (bool(want), len(want)), (r, want)
        if want:
            best = max(want.values())
            assert r.item_id == min(k for k, v in want.items() if v == best) and abs(r.similarity - best) < 1e-12
    clean = without_contaminated(df, bench)
    assert clean.columns == df.columns
    assert clean.count() == sum(not r.contaminated for r in got)


def test_empty_sides(spark, world):
    docs, items = world
    df = spark.createDataFrame([(i, t, 1, 1, "") for i, t in docs], DOCS)
    assert contamination(df, spark.createDataFrame([], ITEMS)).where("contaminated").count() == 0
    assert contamination(df.limit(0), spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)).count() == 0


def test_simhash_bits(spark):
    got = simhash(spark.createDataFrame([(1, ["a", "b", "c", "a", "é"])], "k int, words array<string>"), ["k"], "words").first().fp
    hashes = [r.h & (2**64 - 1) for r in spark.createDataFrame([("a",), ("b",), ("c",), ("a",), ("é",)], "w string").select(F.xxhash64("w").alias("h")).collect()]
    assert got & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 5)


def test_windows_just_over_the_threshold_are_all_found(spark):
    """Recall where fingerprints are furthest apart: words at both ends replaced until 0.8 is only just reached."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    items, docs = [], []
    for i in range(400):
        item = [rng.choice(vocabulary) for _ in range(rng.choice([13, 23, 40, 94, 150]))]
        lost = (len(item) - 4) // 9
        left = rng.randint(0, lost)
        leak = [rng.choice("xyz") + str(j) for j in range(left)] + item[left : len(item) - lost + left] + [rng.choice("xyz") + str(j) for j in range(lost - left)]
        items.append((i, " ".join(item), 0))
        docs.append((i, " ".join([*rng.choices(vocabulary, k=5), *leak, *rng.choices(vocabulary, k=5)]), 0, 0, ""))
    got = contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert all(r.contaminated and r.item_id == r.doc_id for r in got), [r for r in got if not r.contaminated]


def test_an_item_of_many_words_is_judged_whole(spark):
    rng = random.Random(12)
    words_ = [f"w{rng.randrange(10**6)}" for _ in range(66_000)]
    half = " ".join(words_[:33_000])
    got = contamination(spark.createDataFrame([(1, half, 0, 0, ""), (2, " ".join(words_), 0, 0, "")], DOCS), spark.createDataFrame([(1, " ".join(words_), 0)], ITEMS)).collect()
    assert {r.doc_id: r.contaminated for r in got} == {1: False, 2: True}


def test_driver_plans_stay_small_and_its_heap_is_collected(spark, monkeypatch):
    """The 64 terms of a fingerprint stand in no plan after the one that writes it; the heap is collected between plans."""
    plans, calls = {}, []

    class Spy(decontaminate.Table):
        def __init__(self, spark, df, tag):
            plans[tag] = df._jdf.queryExecution().optimizedPlan().toString()
            calls.append(tag)
            super().__init__(spark, df, tag)

    monkeypatch.setattr(decontaminate, "Table", Spy)
    monkeypatch.setattr(decontaminate, "release", lambda spark: calls.append("release"), raising=False)
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"zero {text} more"), (2, "nothing of it")], "doc_id long, text string")
    items = spark.createDataFrame([(7, text)], "item_id long, text string")
    assert [(r.doc_id, r.contaminated) for r in decontaminate.contamination(docs, items).orderBy("doc_id").collect()] == [(1, True), (2, False)]
    assert "lane" in plans["window-fingerprints"] and "lane" not in plans["candidates"]
    assert calls.count("release") >= 4 and calls[calls.index("candidates") - 1] == "release"
