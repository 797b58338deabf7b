import math
from collections import Counter
from fractions import Fraction

import pytest

from millrace.llm.mixing import mix_sources, one_period, plan, whole_shares

SCHEMA = "doc_id long, source string, block int, text string"


@pytest.mark.parametrize("shares", [{"a": 1, "b": 1}, {"a": 7, "b": 2, "c": 1}, {"a": 333, "b": 400, "c": 1, "d": 290}])
def test_lag_stays_below_one_block(shares):
    period = sum(shares.values())
    order = {t: s for s, ts in one_period(shares).items() for t in ts}
    assert sorted(order) == list(range(period))
    done = Counter()
    for t in range(period):
        done[order[t]] += 1
        assert all(abs(done[s] * period - (t + 1) * w) < period for s, w in shares.items())


def test_whole_shares_sum():
    share = whole_shares({"a": 1e-9, "b": 1.0, "c": 2.0}, 100)
    assert sum(share.values()) == 100 and share["a"] == 1


def test_plan_places_every_block_once():
    rows = {"a": 1000, "b": 33, "c": 1, None: 64}
    found = plan(rows, {"a": 5, "b": 1, "c": 3, None: 1}, 32, 8)
    assert sorted(x for _, _, slots, _ in found for x in slots) == list(range(sum(-(-n // 32) for n in rows.values())))
    assert Counter(s for s, *_ in found) == {"a": 4, "b": 1, "c": 1, None: 1}


def brute_places(rows, block):
    """Slot and first position of every block by exact fractions, one slot at a time; weights are rows ** 0.5."""
    left, done, out, at, slot = {s: -(-n // block) for s, n in rows.items()}, Counter(), {}, 0, 0
    while left:
        total = sum(rows[s] ** 0.5 for s in left)
        w = {s: Fraction(rows[s] ** 0.5) / Fraction(total) for s in left}
        ran, t = Counter(), 0
        while all(left.values()):
            due = [(math.ceil((ran[s] + 1) / w[s]), str(s), s) for s in left if math.floor(ran[s] / w[s]) <= t]
            s = min(due, key=lambda x: x[:2])[2]
            out[s, done[s]] = (slot, at)
            at += min(block, rows[s] - done[s] * block)
            done[s], ran[s], left[s], t, slot = done[s] + 1, ran[s] + 1, left[s] - 1, t + 1, slot + 1
        left = {s: n for s, n in left.items() if n}
    return out


def test_query_against_brute_force(spark):
    sizes = {"a": 700, "b": 301, "c": 97, None: 40}
    rows = [(i, s, 1, "") for s, n in sizes.items() for i in range(n)]
    got = mix_sources(spark.createDataFrame(rows, SCHEMA).repartition(3), bucket_rows=64).collect()
    want = brute_places(sizes, 32)
    assert {(r.source, r.block): (r.slot, r.position - r.place) for r in got} == want
    assert sorted(r.position for r in got) == list(range(len(rows))) and {(r.source, r.block, r.place) for r in got} == {(s, k // 32, k % 32) for s, n in sizes.items() for k in range(n)}


def test_rows(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", 1, None) for i in range(2000)] + [(None, None, 1, "x"), (7, "hot", 1, ""), (7, "hot", 1, "")]
    got = mix_sources(spark.createDataFrame(rows, SCHEMA), block_rows=8, bucket_rows=100, carry=("text",)).collect()
    assert sorted(r.position for r in got) == list(range(len(rows)))
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[1]) for r in rows)
    # Within a slot rows are of one source and stand together.
    got.sort(key=lambda r: r.position)
    slots = [r.slot for r in got]
    assert slots == sorted(slots) and len({(r.slot, r.source) for r in got}) == len(set(slots))


def test_target_weights_hold_in_every_prefix(spark):
    rows = [(i, "abc"[i % 3], 1, "") for i in range(3000)]
    got = sorted(mix_sources(spark.createDataFrame(rows, SCHEMA), {"a": 0.5, "b": 0.25, "c": 0.25}, block_rows=10).collect(), key=lambda r: r.position)
    done = Counter()
    for r in got[:1900]:
        done[r.source] += 1
        n = sum(done.values())
        if n % 10 == 0:
            assert all(abs(done[s] - n * w) < 10 for s, w in {"a": 0.5, "b": 0.25, "c": 0.25}.items())


def test_empty_and_bad_weights(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        mix_sources(spark.createDataFrame([(1, "a", 1, "")], SCHEMA), {"b": 1})


def test_irrational_weights_hold_over_many_blocks():
    rows = {s: n * 40 for s, n in zip("abcdef", (1_156_000, 400_000, 256_000, 144_000, 100_000, 64_000), strict=True)}
    weights = {s: n**0.5 for s, n in rows.items()} | {"g": 1e-3}
    rows["g"] = 3200
    order = {}
    for s, chunk, slots, starts in plan(rows, weights, 320, 1024):
        assert 0 < len(slots) == len(starts) <= 1024 and chunk >= 0
        order |= dict.fromkeys(slots, s)
    assert sorted(order) == list(range(sum(-(-n // 320) for n in rows.values())))
    total, done = sum(weights.values()), Counter()
    for t in range(len(order)):
        done[order[t]] += 1
        # "g" weighs far less than one in 1,024; it runs out long after "f".
        assert all(abs(done[s] - (t + 1) * w / total) < 1 + 1e-6 for s, w in weights.items()), t
        if any(done[s] * 320 >= rows[s] for s in rows):
            break
    assert t > 90_000


def test_more_sources_than_a_thousand(spark):
    rows = [(i, f"s{i % 1500}", 1, "") for i in range(3000)]
    got = mix_sources(spark.createDataFrame(rows, SCHEMA), dict.fromkeys({r[1] for r in rows}, 1.0)).collect()
    assert sorted(r.position for r in got) == list(range(3000))


def test_many_rows_of_one_id(spark):
    rows = [(None, "a", 1, f"t{i}") for i in range(900)] + [(7, None, 1, "same")] * 300 + [(i, "b", 1, "") for i in range(100, 400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = mix_sources(df, bucket_rows=50, carry=("text",)).collect()
    assert sorted(r.position for r in got) == list(range(1500))
    assert Counter((r.doc_id, r.source, r.text) for r in got) == Counter((i, s, t) for i, s, _, t in rows)
    assert {(r.source, r.block * 32 + r.place) for r in got} == {(s, k) for s, n in (("a", 900), (None, 300), ("b", 300)) for k in range(n)}
