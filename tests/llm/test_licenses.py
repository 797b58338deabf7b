import random
import re

import pytest

from millrace.llm import licenses
from millrace.llm.licenses import PHRASES, fuzzy_notices, license_scan, scan_text

SCHEMA = "doc_id long, text string, labels int"


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(places), min((p[0] for p in places), default=None), max((p[0] for p in places), default=None), ",".join(sorted({p[1] for p in places}))


def test_base_columns(spark):
    texts = ["", None, "Released under the MIT License.", "x under\nthe - MIT, license cc-by-nc; CC BY NC by nc", "Apache License, Version 2.0 apache license version 2", "ünder the mit license under the mit licenses", "a" * 200_000 + " cc by nc", "under the mit license " * 50, "Éé cc by nc\x00cc by nc", "cc by nc"]
    got = license_scan(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "cc by nc", 0)] * 2, SCHEMA)).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = "cc by nc" if r.doc_id is None else texts[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_empty(spark):
    assert license_scan(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("notice", list(licenses.NOTICES))
def test_pieces_guarantee_a_seed(notice):
    parts = licenses.pieces(notice)
    assert "".join(p for _, p in parts) == notice and len(parts) == licenses.edits_allowed(notice) + 1
    assert all(len(p) >= 4 for _, p in parts)


def test_edits_are_found_and_bounded():
    clean = "some words permission is hereby granted free of charge to any person obtaining a copy and more"
    assert [x[:2] for x in fuzzy_notices(clean)[0]] == [("mit", 0)]
    assert [x[:2] for x in fuzzy_notices(clean.replace("hereby", "herby").replace("charge", "chargee"))[0]] == [("mit", 2)]
    assert not fuzzy_notices(clean.replace("hereby granted free", "thereupon refused at"))[0]
    label, edits, start, end = fuzzy_notices("a gnu generel public licence b")[0][0]
    assert (label, edits) == ("gpl", 2) and "a gnu generel public licence b"[start:end] == "gnu generel public licence"


def test_score():
    assert scan_text(b"nothing here")["score"] == 0 and scan_text(b"cc by nc")["score"] == 1
    assert 0.8 < scan_text(b"gnu generel public license")["score"] < 1


def distances(notice, text, start):
    """Edit distance of the notice to text[start:end], for every end."""
    row = list(range(len(notice) + 1))
    out = {start: row[-1]}
    for end in range(start, min(len(text), start + len(notice) + 4)):
        new = [row[0] + 1]
        for j, c in enumerate(notice):
            new.append(min(row[j] + (c != text[end]), row[j + 1] + 1, new[j] + 1))
        row = new
        out[end + 1] = row[-1]
    return out


def brute_fuzzy(text):
    """Per notice: all stretches of whole words within the allowed edits, fewest edits first, those that overlap left out."""
    out = []
    begins = [i for i in range(len(text)) if i == 0 or text[i - 1] == " "]
    for notice, label in licenses.NOTICES.items():
        found = [(d, a, b) for a in begins for b, d in distances(notice, text, a).items() if d <= licenses.edits_allowed(notice) and (b == len(text) or text[b] == " ")]
        taken = []
        for d, a, b in sorted(found):
            if all(b <= x or y <= a for _, x, y in taken):
                taken.append((d, a, b))
        out += [(label, notice, *x) for x in taken]
    return out


def test_labels_spans_and_score_against_an_edit_distance_search():
    rng = random.Random(4)
    filler = ["the", "gnu", "license", "public", "by", "nc", "mit", "under", "a", "x", "version", "apache", "ünd"]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 6)):
            parts += [rng.choice(filler) for _ in range(rng.randint(0, 4))]
            notice = list(rng.choice(list(licenses.NOTICES)))
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
                at = rng.randrange(len(notice))
                notice[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "e"])
            parts.append("".join(notice))
        text = " ".join(" ".join(parts).split())
        want, got = brute_fuzzy(text), fuzzy_notices(text)[0]
        # Stretches with equally few edits may end differently, and the longest counts; labels, edits and how many there are do not.
        assert sorted((x[0], x[2]) for x in want) == sorted(x[:2] for x in got), text
        result = scan_text(text.encode())
        base = brute(text)
        assert result["labels"] == {x[0] for x in want} | set(filter(None, base[4].split(",")))
        best = max([1.0] * bool(base[1]) + [1 - d / (b - a) for _, _, d, a, b in want], default=0.0)
        assert best - 1e-9 < result["score"] <= best + 0.02


def test_a_worse_match_before_a_better_one_is_reported():
    assert [x[1:3] for x in fuzzy_notices("under the mit licence under the mit license")[0]] == [(1, 0), (0, 22)]
    assert [x[:2] for x in fuzzy_notices("gnu generl public license gnu general public license")[0]] == [("gpl", 1), ("gpl", 0)]
