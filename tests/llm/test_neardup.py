import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import textarrays as ta
from millrace.llm.components import components
from millrace.llm.neardup import link_node, near_duplicates

SCHEMA = "doc_id long, text string, node string, class int, n_shingles int"


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} - {()} if len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, percent=80):
    sets = [shingles(t, k) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    out = []
    for i, (doc, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((doc, len(sets[i]), least if sets[i] else doc, doc == (least if sets[i] else doc)))
    return sorted(out, key=str)


def corpus(seed, groups=12):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 60, 120]))]
        for _ in range(rng.choice([1, 2, 9, 40 if g < 2 else 3])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows) * 7 % 1009, rng.choice([" ", "\n"]).join(text).replace("w1", "W1"), "x", 1, 0))
    rows += [(2000, "", "x", 1, 0), (2001, None, "x", 1, 0), (2002, " \t ", None, 1, 0), (2003, "", "x", 1, 0), (None, "", "x", 1, 0), (None, rows[0][1], "x", 1, 0), (None, "only here once", "x", 1, 0), rows[5], rows[5], (2004, "É ü", "x", 1, 0), (2005, "É ü", "x", 1, 0), (2006, "word " * 50_000, "x", 1, 0)]
    return rows


@pytest.mark.parametrize("sizes", [(16, 1024), (2, 5)])
def test_against_brute_force(spark, sizes):
    rows = corpus(3)
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), 4, small_node=sizes[0], large_node=sizes[1]).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == brute(rows, 4)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 3), (500, 500)]
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).df.collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 140)}}


def test_link_node_joins_all_that_is_linked():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 60, 100)
    sets = [np.unique(np.concatenate([base[: 100 - i % 30], rng.integers(0, 1 << 60, i % 30)])) for i in range(80)]
    got = link_node(np.arange(80), np.arange(80), sets, 80)
    root = list(range(80))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in got:
        assert 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))
        root[find(a)] = find(b)
    for a, b in combinations(range(80), 2):
        if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b])):
            assert find(a) == find(b)


def test_shingle_sets_match_words():
    texts = ["A b  c d e", "", "x", "a b c d e a b c d e", "é b c d e f", " ".join("q" * (i % 5 + 1) for i in range(500))]
    for k in (4, 5):
        h, cuts = ta.shingle_sets(*[ta.lower(x) if i == 0 else x for i, x in enumerate(ta.flat(pa.array(texts)))], k)
        assert np.diff(cuts).tolist() == [len(shingles(t, k)) for t in texts]


def test_large_template_group_loses_no_link(spark):
    # All share 170 words, each has 40 of its own; of each planted pair the second has 18 of the first's own words.
    rng = random.Random(5)
    rows, pairs = [], []
    for i in range(1800):
        own = [f"o{i}x{j}" for j in range(40)]
        if i % 3 == 1:
            own[:18] = rows[-1][1].split(" ")[170:188]
            pairs.append((i - 1, i))
        rows.append((i, " ".join([f"t{j}" for j in range(170)] + own), "x", 1, 0))
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), 1, large_node=128).collect()}
    assert sum(got[a] != got[b] for a, b in pairs) == 0
    assert len(set(got.values())) == len(rows) - len(pairs)
