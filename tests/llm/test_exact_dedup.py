import hashlib
import re
from collections import defaultdict

import pytest

from millrace.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, digest string, row int"


def brute(rows):
    groups = defaultdict(list)
    for i, (doc, text, *_) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, i))
    out = []
    for bare, members in groups.items():
        best = min(members, key=lambda m: m[:3])
        for m in members:
            out.append((rows[m[3]][0], rows[best[3]][0], len(members), hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("run_rows", [100_000, 4])
def test_against_brute_force(spark, monkeypatch, run_rows):
    monkeypatch.setattr("millrace.llm.exact_dedup.RUN_ROWS", run_rows)
    rows = [(1, "a b", "x", 1), (2, "ab", "x", 1), (3, "a  b", None, 1), (4, None, "x", None), (5, "", "", 1), (6, " \t", "", 1), (None, "a\x0bb ", "", 1), (7, "é b", "", 1), (8, "éb", "", 1), (9, "x" * 100_000, "", 1), (10, "x" * 100_000, "", 1), (9, "x" * 100_000, "", 1), (11, "a b", "", 1)]
    rows += [(100 + i, "copy of the same", "", 1) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(20 if run_rows > 4 else 1)
    got = exact_dedup(df, fan_in=3).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
