"""Licence scans: fuzzy search for short notices.

A notice may occur with up to e edits. Cut into e + 1 pieces, at least one piece of any such occurrence is intact
(pigeonhole), so an Aho-Corasick automaton over all pieces finds every place worth looking at; around each the ``regex``
library matches the whole notice with bounded errors, and the match gives edits and span.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from . import textarrays as ta

# Phrases of the base search and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notices of the fuzzy search, in words as they are compared, and their labels.
NOTICES = {
    "under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "apache license version 2": "apache-2",
    "licensed under the apache license": "apache-2",
    "cc by nc": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
MAX_EDITS = 3
LETTERS_PER_EDIT = 8
_BREAK = np.ones(256, bool)
_BREAK[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def edits_allowed(notice: str) -> int:
    """One edit for every 8 letters, 3 at most, so that each intact piece still has 4 letters or more."""
    return min(MAX_EDITS, len(notice) // LETTERS_PER_EDIT)


def pieces(notice: str) -> list[tuple[int, str]]:
    n, k = len(notice), edits_allowed(notice) + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(1)
def _automaton() -> tuple:
    found: dict[str, list] = {}
    for number, notice in enumerate(NOTICES):
        for at, piece in pieces(notice):
            found.setdefault(piece, []).append((number, at))
    seeds = ahocorasick.Automaton()
    for piece, uses in found.items():
        seeds.add_word(piece, (len(piece), uses))
    seeds.make_automaton()
    exprs = [regex.compile(rf"(?:{regex.escape(n, literal_spaces=True)}){{e<={edits_allowed(n)}}}", regex.BESTMATCH) for n in NOTICES]
    return seeds, exprs, list(NOTICES.items())


def _matches(expr: regex.Pattern, sentence: str, first: int, last: int, notice: str, edits: int) -> Iterator[tuple[int, int, int]]:
    """Edits, start and end of all stretches of whole words that start between two places and match the notice."""
    n = len(sentence)
    for start in range(max(0, first), min(n, last) + 1):
        if start and sentence[start - 1] != " ":
            continue
        for end in range(max(start, start + len(notice) - edits), min(n, start + len(notice) + edits) + 1):
            if (end == n or sentence[end] == " ") and (m := expr.fullmatch(sentence, start, end)):
                yield sum(m.fuzzy_counts), start, end


def fuzzy_notices(sentence: str) -> tuple[list[tuple[str, int, int, int]], float]:
    """Notices in a text of lower-case words joined by single spaces: label, edits, start and end character; the score.

    Every seed says where its notice would begin; places within the same few characters are looked at together. The
    score is 1 minus edits per character of the best match, 0 without any. Of matches of one notice that overlap, the
    one with fewer edits is reported, the earlier one among equals.
    """
    seeds, exprs, notices = _automaton()
    near: dict[int, set[int]] = {}
    for end, (length, uses) in seeds.iter(sentence):
        for number, at in uses:
            near.setdefault(number, set()).add(end + 1 - length - at)
    out, score = [], 0.0
    for number, begins in near.items():
        notice, label = notices[number]
        edits = edits_allowed(notice)
        groups: list[list[int]] = []
        for begin in sorted(begins):
            if groups and begin - groups[-1][0] <= edits:
                groups[-1][1] = begin
            else:
                groups.append([begin, begin])
        found = {m for a, b in groups for m in _matches(exprs[number], sentence, a - edits, b + edits, notice, edits)}
        starts: list[int] = []
        ends: list[int] = []
        for cost, start, end in sorted(found):
            score = max(score, 1 - cost / (end - start))
            at = bisect.bisect(starts, start)
            if (at == 0 or ends[at - 1] <= start) and (at == len(starts) or end <= starts[at]):
                starts.insert(at, start)
                ends.insert(at, end)
                out.append((label, cost, start, end))
    return sorted(out, key=lambda x: x[2:]), score


def scan_text(text: bytes) -> dict:
    """Counts, labels and spans of one whole lower-cased text (UTF-8)."""
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = ta.words(data, np.array([0, len(data)]), _BREAK)
    kept = np.where(_BREAK[data], 0x20, data).astype(np.uint8)
    inside = ~_BREAK[data]
    # Runs of break characters shrink to one space, so words stand as in the notices.
    keep = inside.copy()
    if len(ends):
        keep[ends[:-1]] = True
    sentence = kept[keep].tobytes().decode("utf-8", "replace")
    padded, base, places = f" {sentence} ", set(), []
    for phrase, label in PHRASES.items():
        at, seen, before = padded.find(f" {phrase} "), 0, 0
        while at >= 0:
            before += padded.count(" ", seen, at)
            seen = at
            places.append(before)
            base.add(label)
            at = padded.find(f" {phrase} ", at + 1)
    found, score = fuzzy_notices(sentence)
    return {"n_words": len(starts), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": base, "labels": base | {x[0] for x in found}, "score": 1.0 if places else score, "spans": found}


SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,edits:int,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("edits", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def scan_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in ta.slices(batches, "text"):
        data, offsets = ta.flat(batch.column("text"))
        data = ta.lower(data)
        rows = [scan_text(data[a:b].tobytes()) for a, b in zip(offsets, offsets[1:], strict=False)]
        columns = [batch.column("doc_id")]
        columns += [pa.array([r[k] for r in rows], pa.int64()) for k in ("n_words", "n_base", "first_word", "last_word")]
        columns += [pa.array([",".join(sorted(r[k])) for r in rows], pa.string()) for k in ("base_labels", "labels")]
        columns += [pa.array([r["score"] for r in rows], pa.float64()), pa.array([[dict(zip(("label", "edits", "start", "end"), s, strict=True)) for s in r["spans"]] for r in rows], _SPANS)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with word counts, exact places, labels, score and the spans of fuzzy matches.

    Span offsets count characters of the text after lower-casing A-Z and shrinking runs of break characters to one
    space. A null or empty text has no words and no labels, score 0. A null id stays null, repeated rows each get a row,
    and other columns are not read. The score is 1 for an exact phrase, else 1 minus edits per matched character of the
    best notice, 0 without any. Memory: one slice of at most 2 MB of text, or one longer text, at a time.
    """
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan_batches, SCAN)
