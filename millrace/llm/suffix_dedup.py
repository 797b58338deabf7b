"""Removal of repeated passages: every byte covered by a 100-byte string that also starts earlier in the corpus.

Windows of 100 bytes are dealt out by their minimizer (the least hash among the 24-byte strings inside): neighbouring
windows mostly share it, so a text is cut into stretches of windows, and equal windows always carry the same anchor at
the same offset. Anchors that occur once in the corpus settle all their windows; of equal stretches (by a digest of 128
bits, verified by a second hash of 64 bits and the length, not byte by byte) only the first goes on. Stretches that share
an anchor but differ are suffix-sorted: a mergesort whose comparisons find the common
extension of two suffixes by binary search over prefix polynomial hashes, so each takes a logarithmic number of steps;
what the hashes call equal is verified byte by byte. Of each class of equal windows the first start stays.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import textarrays as ta
from .storage import Table, release, shuffle_width

WINDOW = 100
ANCHOR = 24
SPAN = WINDOW - ANCHOR + 1  # anchors inside a window
BUCKET_STRETCHES = 8192
HOT_STRETCHES = 4096
STRETCHES = "anchor long, doc_id long, text_key long, start int, shape int"
_KEYS = ["doc_id", "text_key"]


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours: running minima forwards and backwards in blocks (van Herk)."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """For flat texts: document, first window (from the document's start), number of windows, gap to the anchor, anchor hash."""
    empty = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    if len(data) < WINDOW:
        return empty
    sums = ta.prefix_hashes(data)
    n = len(data) - ANCHOR + 1
    grams = ta.mix((sums[ANCHOR:] - sums[:n]) * ta.powers(n, inverse=True))
    # 32 bits of hash above 32 bits of place: the least value names the leftmost of the least hashes.
    place = sliding_argmin((grams >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64), SPAN) & np.uint64(0xFFFFFFFF)
    counts = np.maximum(np.diff(offsets) - WINDOW + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(offsets[:-1], counts)
    if not len(start):
        return empty
    place = place[start].astype(np.int64)
    first = np.ones(len(start), bool)
    first[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    return doc[at], start[at] - offsets[doc[at]], np.diff(np.append(at, len(start))), place[at] - start[at], grams[place[at]]


def _emit(batches):
    for batch in ta.slices(batches, "text"):
        data, offsets = ta.flat(batch.column("text"))
        doc, start, run, gap, anchor = stretches(data, offsets)
        columns = [pa.array(anchor.view(np.int64)), batch.column("doc_id").take(pa.array(doc)), batch.column("text_key").take(pa.array(doc))]
        for a in range(0, len(doc), 50_000):
            b = slice(a, a + 50_000)
            yield pa.RecordBatch.from_arrays([*[c[b] for c in columns], pa.array(start[b].astype(np.int32)), pa.array((run[b] << 8 | gap[b]).astype(np.int32))], names=["anchor", "doc_id", "text_key", "start", "shape"])


DIGESTS = STRETCHES + ", digest binary, check long"
CONTENTS = STRETCHES + ", bucket long, blocks long, content binary"


def _cut_out(batch, extra: list[str]):
    """The stretches that ``uses`` lists for each text, in parts: their columns, and their bytes."""
    data, offsets = ta.flat(batch.column("text"))
    blob, uses = data.tobytes(), batch.column("uses")
    items, cuts = uses.flatten(), np.concatenate([[0], np.cumsum([len(u) for u in uses])])
    fields = {n: items.field(n) for n in ["anchor", "start", "shape", *extra]}
    doc = np.repeat(np.arange(len(uses)), np.diff(cuts))
    begin = offsets[doc] + fields["start"].to_numpy()
    end = begin + (fields["shape"].to_numpy() >> 8) + WINDOW - 1
    for a in range(0, len(doc), 20_000):
        b = slice(a, a + 20_000)
        picked = pa.array(doc[b])
        columns = [fields["anchor"][b], batch.column("doc_id").take(picked), batch.column("text_key").take(picked), fields["start"][b], fields["shape"][b], *[fields[n][b] for n in extra]]
        yield columns, [blob[x:y] for x, y in zip(begin[b].tolist(), end[b].tolist(), strict=True)]


def _digests(batches):
    for batch in ta.slices(batches, "text"):
        for columns, content in _cut_out(batch, []):
            made = pa.array([hashlib.blake2b(c, digest_size=16).digest() for c in content], pa.binary())
            check = pa.array(np.array([xxhash.xxh3_64_intdigest(c) for c in content], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*columns, made, check], names=["anchor", "doc_id", "text_key", "start", "shape", "digest", "check"])


def _contents(batches):
    for batch in ta.slices(batches, "text"):
        for columns, content in _cut_out(batch, ["bucket", "blocks"]):
            yield pa.RecordBatch.from_arrays([*columns, pa.array(content, pa.binary())], names=["anchor", "doc_id", "text_key", "start", "shape", "bucket", "blocks", "content"])


class Extensions:
    """Common extensions of suffixes of one buffer, up to ``limit`` bytes, by prefix hashes."""

    def __init__(self, data: np.ndarray, limit: int = WINDOW):
        self.data, self.limit = data, limit
        self.sums, self.inverse = ta.prefix_hashes(data), ta.powers(len(data) + 1, inverse=True)
        # The first eight bytes of every suffix as one number.
        self.heads = np.zeros(len(data), np.uint64)
        for k in range(8):
            self.heads[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(56 - 8 * k)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes i and j (both at least ``limit`` bytes long)."""
        si, sj, pi, pj = self.sums[i], self.sums[j], self.inverse[i], self.inverse[j]
        low, high = np.zeros(len(i), np.int64), np.full(len(i), self.limit)
        for _ in range(self.limit.bit_length()):
            mid = (low + high + 1) >> 1
            equal = (self.sums[i + mid] - si) * pi == (self.sums[j + mid] - sj) * pj
            low, high = np.where(equal, mid, low), np.where(equal, high, mid - 1)
            high = np.maximum(low, high)
        return low

    def compare(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as suffix i is before, equal to or behind suffix j within ``limit`` bytes."""
        at = self.common(i, j)
        inside = np.minimum(at, self.limit - 1)
        a, b = self.data[i + inside].astype(np.int16), self.data[j + inside].astype(np.int16)
        if ((a == b) & (at < self.limit)).any():
            raise ArithmeticError("hash collision")
        return np.where(at >= self.limit, 0, np.sign(a - b))

    def verified_equal(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the hashes call the two equal, checked byte by byte."""
        end = self.limit
        same = (self.sums[i + end] - self.sums[i]) * self.inverse[i] == (self.sums[j + end] - self.sums[j]) * self.inverse[j]
        view = np.lib.stride_tricks.sliding_window_view(self.data, self.limit)
        where = np.flatnonzero(same)
        for a in range(0, len(where), 1 << 15):
            part = where[a : a + (1 << 15)]
            if not (view[i[part]] == view[j[part]]).all():
                raise ArithmeticError("hash collision")
        return same


def merge_sort(extensions: Extensions, starts: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Order of the suffixes: by segment, then by content. All merges of a level run at once, by rank in the other run."""
    order = np.argsort(segment, kind="stable")
    seg = segment[order]
    head = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]])) if len(seg) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(seg)))
    width = 1
    while len(size) and width < size.max():
        live = np.flatnonzero(np.repeat(size > width, size))
        begin, length = np.repeat(head, size)[live], np.repeat(size, size)[live]
        local = live - begin
        run = local // width
        left = run % 2 == 0
        other = begin + (run ^ 1) * width
        low = np.zeros(len(live), np.int64)
        high = np.clip(begin + length - other, 0, width)
        mine = starts[order[live]]
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) >> 1
            theirs = starts[order[other[open_] + mid]]
            sign = extensions.compare(theirs, mine[open_])
            # Runs on the left come first among equals.
            forward = np.where(left[open_], sign < 0, sign <= 0)
            low[open_] = np.where(forward, mid + 1, low[open_])
            high[open_] = np.where(forward, high[open_], mid)
        target = begin + (run & ~1) * width + local % width + low
        moved = order.copy()
        moved[target] = order[live]
        order = moved
        width *= 2
    return order


def window_classes(data: np.ndarray, starts: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """A class number for each window: equal within a segment means equal content."""
    try:
        extensions = Extensions(data)
        # Suffixes with different first bytes are ordered by these; the others are merged.
        heads = extensions.heads[starts]
        order = np.lexsort((heads, segment))
        change = np.ones(len(order), bool)
        change[1:] = (segment[order][1:] != segment[order][:-1]) | (heads[order][1:] != heads[order][:-1])
        segment = segment.copy()
        segment[order] = np.cumsum(change)
        order = merge_sort(extensions, starts, segment)
        fresh = np.ones(len(order), bool)
        same_segment = np.flatnonzero(segment[order][1:] == segment[order][:-1]) + 1
        fresh[same_segment] = ~extensions.verified_equal(starts[order[same_segment - 1]], starts[order[same_segment]])
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(fresh) - 1
        return out
    except ArithmeticError:
        # Two different strings met with one hash: compare this bucket by its bytes.
        view = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
        seen: dict = {}
        return np.array([seen.setdefault((s, view[i].tobytes()), len(seen)) for s, i in zip(segment.tolist(), starts.tolist(), strict=True)])


FIRSTS = "doc_id long, text_key long, start int, run int, window binary"


def _resolve(table):
    """Of the stretches of one bucket: the windows that come first, as runs; for hot anchors with their digests."""
    content = table["content"].combine_chunks()
    data, offsets = ta.flat_binary(content)
    shape, gap = table["shape"].to_numpy() >> 8, table["shape"].to_numpy() & 255
    owner = np.repeat(np.arange(len(shape)), shape)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(shape) - shape, shape)
    anchor = table["anchor"].to_numpy()[owner]
    _, segment = np.unique(anchor, return_inverse=True)
    segment = segment * 256 + gap[owner] - step
    classes = window_classes(data, offsets[owner] + step, segment)
    missing = table["doc_id"].is_null().to_numpy()
    doc, key = table["doc_id"].fill_null(0).to_numpy(), table["text_key"].to_numpy()
    start = table["start"].to_numpy()[owner] + step
    order = np.lexsort((start, key[owner], doc[owner], missing[owner], classes))
    head = np.ones(len(order), bool)
    head[1:] = classes[order][1:] != classes[order][:-1]
    first = np.zeros(len(order), bool)
    first[order[head]] = True
    hot = table["blocks"].to_numpy()[owner] > 1
    plain = np.flatnonzero(first & ~hot)
    fresh = np.ones(len(plain), bool)
    fresh[1:] = (np.diff(plain) != 1) | (owner[plain][1:] != owner[plain][:-1])
    begins = plain[fresh]
    runs = np.diff(np.append(np.flatnonzero(fresh), len(plain)))
    heads = np.concatenate([begins, np.flatnonzero(first & hot)])
    runs = np.concatenate([runs, np.ones(len(heads) - len(begins), np.int64)])
    at, blob = offsets[owner] + step, data.tobytes()
    digests = [None] * len(begins) + [hashlib.blake2b(blob[x : x + WINDOW], digest_size=16).digest() for x in at[heads[len(begins) :]].tolist()]
    picked = pa.array(owner[heads])
    return pa.table({"doc_id": table["doc_id"].take(picked), "text_key": table["text_key"].take(picked), "start": pa.array(start[heads].astype(np.int32)), "run": pa.array(runs.astype(np.int32)), "window": pa.array(digests, pa.binary())})


CUT = "doc_id long, text_key long, n_removed long, n_spans long, kept_sha256 string, kept_text binary"


def _spread(n: int, begin: np.ndarray, width) -> np.ndarray:
    """Which of n places lie in one of the stretches."""
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, begin, 1)
    np.add.at(edges, begin + width, -1)
    return np.cumsum(edges[:-1]) > 0


def cut_texts(data: np.ndarray, offsets: np.ndarray, uses: tuple[np.ndarray, np.ndarray], firsts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of each flat text the removed bytes, the removed runs and what is left.

    ``uses`` are stretches (begin in the flat bytes, number) of windows that may repeat, ``firsts`` of those that come first.
    """
    n = len(data)
    windows = np.flatnonzero(_spread(n, *uses) & ~_spread(n, *firsts))
    covered = _spread(n, windows, WINDOW)
    fresh = covered.copy()
    fresh[1:] &= ~covered[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    fresh[heads] = covered[heads]
    removed, spans = (np.diff(np.concatenate([[0], np.cumsum(x)])[offsets]) for x in (covered, fresh))
    blob, kept = data[~covered].tobytes(), offsets - np.concatenate([[0], np.cumsum(covered)])[offsets]
    return removed, spans, [blob[a:b] for a, b in zip(kept, kept[1:], strict=False)]


def _flat_stretches(column: pa.Array, offsets: np.ndarray, width: str) -> tuple[np.ndarray, np.ndarray]:
    items, counts = column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(offsets[:-1], counts) + items.field("start").to_numpy(), items.field(width).to_numpy()


def _cut(with_text: bool):
    def run(batches):
        for batch in ta.slices(batches, "text"):
            data, offsets = ta.flat(batch.column("text"))
            begin, shape = _flat_stretches(batch.column("uses"), offsets, "shape")
            removed, spans, kept = cut_texts(data, offsets, (begin, shape >> 8), _flat_stretches(batch.column("firsts"), offsets, "run"))
            digests = [hashlib.sha256(k).hexdigest() for k in kept]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(removed.astype(np.int64)), pa.array(spans.astype(np.int64)), pa.array(digests), pa.array(kept if with_text else [None] * len(kept), pa.binary())], names=["doc_id", "text_key", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return run


def _same(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on doc_id (null equals null) and text_key."""
    named = right.withColumnsRenamed({k: f"__{k}" for k in _KEYS})
    return left.join(named, F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("text_key") == F.col("__text_key")), how).drop("__doc_id", "__text_key")


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, hot_stretches: int = HOT_STRETCHES, bucket_stretches: int = BUCKET_STRETCHES) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text, the remaining bytes).

    Documents are ordered by id, a null id last; different texts of one id by a hash of the text. Rows that agree in
    id and text count as one document, are read as one, and share its result. A null text counts as empty; texts of less than 100 bytes
    lose nothing. Other columns are not read.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"))
    every = Table(spark, docs.select(*_KEYS, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole_sha256")), "whole")
    repeated = Table(spark, every.df.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "repeated")
    if repeated.df.head(1):
        # Copies of a row meet in an aggregate, which starts before the shuffle, so any number of them is one row per task.
        docs = _same(docs, repeated.df, "left_anti").union(_same(docs, repeated.df, "left_semi").dropDuplicates(_KEYS))
    emitted = Table(spark, docs.where(F.octet_length("text") >= WINDOW).mapInArrow(_emit, STRETCHES), "stretches")
    shared = Table(spark, emitted.df.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")
    release(spark)
    uses = F.collect_list(F.struct("anchor", "start", "shape")).alias("uses")
    lists = Table(spark, emitted.df.join(shared.df, "anchor").groupBy(*_KEYS).agg(uses), "lists")
    shared.drop()
    emitted.drop()
    release(spark)
    # Equal stretches: the first stands for all.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "start")
    # Written by itself: the sorts of the join, Python and the sort of the aggregate would share a task's memory.
    digests = Table(spark, _same(docs.select(*_KEYS, "text"), lists.df).mapInArrow(_digests, DIGESTS), "digests")
    release(spark)
    same = (F.min("check") == F.max("check")) & (F.min("shape") == F.max("shape"))
    found = digests.df.groupBy("anchor", "digest").agg(F.min(order).alias("o"), F.min("shape").alias("shape"), same.alias("same"))
    verified = F.when(F.col("same"), F.col("shape")).otherwise(F.raise_error(F.lit("two different stretches share a digest")).cast("int"))
    firsts = Table(spark, found.select("anchor", "digest", "o.doc_id", "o.text_key", "o.start", verified.alias("shape")), "firsts")
    digests.drop()
    release(spark)
    several = Table(spark, firsts.df.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "several")
    total = several.df.agg(F.sum("n")).first()[0] or 0
    buckets = max(shuffle_width(spark), math.ceil(total / bucket_stretches))
    # A hot anchor is cut into blocks; what comes first in its block meets the others by digest below.
    blocks = F.ceil(F.col("n") / hot_stretches)
    block = F.pmod(F.xxhash64("digest"), blocks)
    left = firsts.df.join(several.df, "anchor").select("anchor", *_KEYS, "start", "shape", F.pmod(F.xxhash64("anchor", block), F.lit(buckets)).alias("bucket"), blocks.alias("blocks"))
    asked = Table(spark, left.groupBy(*_KEYS).agg(F.collect_list(F.struct("anchor", "start", "shape", "bucket", "blocks")).alias("uses")), "asked")
    release(spark)
    dealt = _same(docs.select(*_KEYS, "text"), asked.df).mapInArrow(_contents, CONTENTS)
    resolved = Table(spark, dealt.groupBy("bucket").applyInArrow(_resolve, FIRSTS), "resolved")
    asked.drop()
    release(spark)
    alone = firsts.df.join(several.df, "anchor", "left_anti").select(*_KEYS, "start", F.shiftright("shape", 8).alias("run"))
    hot = resolved.df.where("window is not null").groupBy("window").agg(F.min(order).alias("o")).select("o.doc_id", "o.text_key", "o.start", F.lit(1).alias("run"))
    parts = [alone, resolved.df.where("window is null").select(*_KEYS, "start", "run"), hot]
    first_runs = Table(spark, reduce(DataFrame.union, parts).groupBy(*_KEYS).agg(F.collect_list(F.struct("start", "run")).alias("firsts")), "first-runs")
    for used in (firsts, several, resolved):
        used.drop()
    slim = lists.df.select(*_KEYS, F.transform("uses", lambda u: F.struct(u["start"].alias("start"), u["shape"].alias("shape"))).alias("uses"))
    release(spark)
    cut = Table(spark, _same(docs.select(*_KEYS, "text"), _same(slim, first_runs.df, "left")).mapInArrow(_cut(with_text), CUT), "cut")
    for used in (lists, first_runs, repeated):
        used.drop()
    release(spark)
    done = _same(every.df, cut.df, "left")
    columns = [F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256")]
    return done.select("doc_id", "n_bytes", *columns, *(["kept_text"] if with_text else []))
