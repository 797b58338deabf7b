"""Language-model scores by logistic context mixing over bits, and the unigram base.

A text is modelled as its lower-cased words, joined by spaces and closed by an end byte. Each byte is predicted bit by
bit from the counts that the contexts of 0 to 6 preceding bytes have gathered over all training documents; every
context gives a log-odds, a set of weights chosen by a gate (bit position, longest context seen and how often) adds
them up, and an adaptive table refines the result. Weights and table learn online, in passes over the training bytes
with each byte's own occurrence taken out of the counts.

A context is hashed digit by digit, the nearest bytes on top, so the keys of all longer contexts lie inside the range of
a shorter one. Documents are dealt into blocks of bounded size; each block asks once for its distinct keys. The key
space is cut into slabs of about equal load at quantiles of a sample of training documents, on whole contexts; a slab
gathers the requests of all blocks, adds them up, scores its contexts and answers each block. Where a cut falls into a
context of 2 to 5 bytes, the parts count as contexts of their own, so nothing has to be known outside a slab but
the counts of single bytes and byte pairs. What is gathered grows with the corpus, and every request and every answer
is moved once; cuts, weights and tables depend on training documents only.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import textarrays as ta
from .storage import Table

BLOCK_BYTES = 6 << 20
SLAB_BYTES = 8 << 20
#: Training text that is looked at for the cuts between slabs: so much, and so much more for each slab.
CUT_BYTES, CUT_BYTES_PER_SLAB = 4 << 20, 8 << 10
ORDERS = 7  # contexts of 0 to 6 bytes
#: A key from its top: bytes 1 and 2 back (permuted), 3, 4 (exact), 5, 6 (hashed to 7 bits each), the predicted byte.
SHIFTS = {2: 38, 3: 30, 4: 22, 5: 15, 6: 8}
GATES = 8 * ORDERS * 3
BINS = 49
DELTA = 0.35
BATCH = 2048
EPOCHS = 2
RATE = 0.02
END = 0x0A
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(1)
def _coder() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(values: np.ndarray) -> bytes:
    """In byte planes, which compress better."""
    return _coder()[0].compress(np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T).tobytes())


def _unpack(blob: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(_coder()[1].decompress(blob), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(width, len(planes) // width).T).reshape(-1).view(dtype)


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=keys.dtype.type(0)))


def _unpack_sorted(blob: bytes, dtype=np.uint64) -> np.ndarray:
    return np.cumsum(_unpack(blob, dtype), dtype=dtype)


def tokens_stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The modelled bytes of a batch and their offsets; the word hashes and their offsets."""
    data, offsets = ta.flat(column)
    blob = data.tobytes()
    closed = ta.lower(np.frombuffer(b"\n".join([blob[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]) + b"\n", np.uint8))
    ends = offsets[1:] + np.arange(len(offsets) - 1)  # where each document's closing byte stands
    inside = ~_SPACES[closed]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    begins = np.append(0, ends[:-1] + 1)
    word_starts, word_ends, first = ta.words(closed, np.append(begins, len(closed)))
    count = np.diff(first)
    keep[ends[count == 0]] = True
    last = np.where(count > 0, word_ends[np.maximum(first[1:] - 1, 0)] if len(word_ends) else 0, ends)
    stream = np.where(inside, closed, 0x20).astype(np.uint8)
    stream[last] = END
    before = np.concatenate([[0], np.cumsum(keep)])
    return stream[keep], before[np.append(begins, len(closed))], ta.span_hashes(closed, word_starts, word_ends) if len(word_starts) else np.zeros(0, np.uint64), first


_ODD = 0x9E3B
_PAIRS = (((np.arange(1 << 16, dtype=np.uint64) * np.uint64(_ODD)) & np.uint64(0xFFFF)) << np.uint64(38)).astype(np.uint64)  # odd factor: one to one
_UNDO = pow(_ODD, -1, 1 << 16)
_SEVEN = ta.mix(np.arange(256, dtype=np.uint64) + np.uint64(5)) >> np.uint64(57)
_DIGITS = {3: np.arange(256, dtype=np.uint64) << np.uint64(30), 4: np.arange(256, dtype=np.uint64) << np.uint64(22), 5: _SEVEN << np.uint64(15), 6: _SEVEN << np.uint64(8)}


def context_keys(stream: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the digits of its six predecessors (zero before the start) above itself."""
    starts, ends, back = offsets[:-1], offsets[1:], []
    for k in range(1, 7):
        part = np.zeros(len(stream), np.uint8)
        part[k:] = stream[:-k]
        for j in range(k):
            at = starts + j
            part[at[at < ends]] = 0
        back.append(part)
    key = _PAIRS[back[0].astype(np.uint16) << np.uint16(8) | back[1]]
    for k, table in _DIGITS.items():
        key |= table[back[k - 1]]
    key |= stream
    return key


def nearest(keys: np.ndarray) -> np.ndarray:
    """The byte before the predicted one."""
    return ((keys >> np.uint64(38)) * np.uint64(_UNDO) & np.uint64(0xFFFF)).astype(np.int64) >> 8


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how many of them are training ones."""
    keys = np.sort(keys << np.uint64(1) | train.astype(np.uint64))
    bare = keys >> np.uint64(1)
    head = np.flatnonzero(np.concatenate([[True], bare[1:] != bare[:-1]])) if len(bare) else np.zeros(0, np.int64)
    return bare[head], np.add.reduceat((keys & np.uint64(1)).astype(np.int64), head) if len(head) else np.zeros(0, np.int64)


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted; a plain sort is several times as fast as ``np.unique`` here."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = distinct(np.concatenate([p[0] for p in parts]))
    counts = np.zeros(len(keys), np.int64)
    for k, c in parts:
        counts[np.searchsorted(keys, k)] += c
    return keys, counts


def _block_keys(table: pa.Table):
    """Of all documents of a block: per batch the stream keys and word keys with their offsets."""
    for batch in ta.slices(table.combine_chunks().to_batches(), "text", 1 << 20):
        stream, offsets, words, first = tokens_stream(batch.column("text"))
        yield batch, context_keys(stream, offsets), offsets, words >> np.uint64(1), first


def _sample_keys(batches):
    """One in eight of the distinct contexts of each slice, by a hash."""
    for batch in ta.slices(batches, "text", 1 << 20):
        stream, offsets, _, _ = tokens_stream(batch.column("text"))
        contexts = distinct(context_keys(stream, offsets) >> np.uint64(8))
        yield pa.RecordBatch.from_arrays([pa.array([_pack_sorted(contexts[ta.mix(contexts) & np.uint64(7) == 0])], pa.binary())], names=["contexts"])


def slab_cuts(docs: DataFrame, train_bytes: int, slab_bytes: int) -> np.ndarray:
    """First keys of all slabs but the first, from quantiles of the contexts of sampled training documents."""
    n = math.ceil(train_bytes / slab_bytes)
    if n <= 1:
        return np.zeros(0, np.uint64)
    share = min(1.0, (CUT_BYTES + CUT_BYTES_PER_SLAB * n) / train_bytes)
    picked = F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), F.lit(1 << 30)) < share * (1 << 30)
    found = docs.where(F.col("train") & picked).select("text").mapInArrow(_sample_keys, "contexts binary").collect()
    contexts = distinct(np.concatenate([np.zeros(0, np.uint64), *[_unpack_sorted(r.contexts) for r in found]]))
    return distinct(contexts[np.arange(1, n) * len(contexts) // n]) << np.uint64(8) if len(contexts) else contexts


def _word_cuts(n: int) -> np.ndarray:
    return np.array([(s << 63) // n for s in range(1, n)], np.uint64)


def _requests(cuts: np.ndarray, word_slabs: int):
    def run(key, table):
        bytes_, words = [], []
        for batch, stream_keys, offsets, word_keys, first in _block_keys(table):
            train = batch.column("train").to_numpy(zero_copy_only=False)
            bytes_.append((stream_keys, np.repeat(train, np.diff(offsets))))
            words.append((word_keys, np.repeat(train, np.diff(first))))
        rows = []
        for base, parts, at in ((0, bytes_, cuts), (len(cuts) + 1, words, _word_cuts(word_slabs))):
            keys, counts = _counted(*map(np.concatenate, zip(*parts, strict=True)))
            edges = np.concatenate([[0], np.searchsorted(keys, at), [len(keys)]])
            for s in np.flatnonzero(np.diff(edges)):
                part = slice(edges[s], edges[s + 1])
                rows.append((base + int(s), key[0].as_py(), _pack_sorted(keys[part]), _pack(counts[part])))
        return pa.table({"slab": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.int64()), "keys": pa.array([r[2] for r in rows], pa.binary()), "counts": pa.array([r[3] for r in rows], pa.binary())})

    return run


REQUEST = "slab int, block long, keys binary, counts binary"
SLAB = "slab int, keys binary, counts binary, blocks array<long>, asked array<binary>"


def _gather(table):
    """One row for a slab: its distinct keys with their counts, and for every block the places of those it asks for."""
    parts = [(_unpack_sorted(k.as_py()), _unpack(c.as_py(), np.int64)) for k, c in zip(table["keys"], table["counts"], strict=True)]
    keys, counts = _added(parts)
    asked = [_pack_sorted(np.searchsorted(keys, k).astype(np.uint32)) for k, _ in parts]
    return pa.table({"slab": table["slab"][:1], "keys": pa.array([_pack_sorted(keys)], pa.binary()), "counts": pa.array([_pack(counts)], pa.binary()), "blocks": pa.array([table["block"].to_pylist()], pa.list_(pa.int64())), "asked": pa.array([asked], pa.list_(pa.binary()))})


def _slabs_of(batches):
    for batch in batches:
        for i, (slab, k, c) in enumerate(zip(batch.column("slab").to_pylist(), batch.column("keys"), batch.column("counts"), strict=True)):
            yield batch, i, slab, _unpack_sorted(k.as_py()), _unpack(c.as_py(), np.int64)


def _short_counts(slabs: int):
    """Per slab: training counts of (preceding byte, byte), and of words the tokens and the distinct ones."""

    def run(batches):
        for _, _, slab, keys, counts in _slabs_of(batches):
            if slab >= slabs:
                rows = [(-1, int(counts.sum())), (-2, int((counts > 0).sum()))]
            else:
                pairs = np.bincount(nearest(keys) << 8 | (keys & np.uint64(255)).astype(np.int64), counts, 1 << 16)
                rows = [(int(i), int(pairs[i])) for i in np.flatnonzero(pairs)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())], names=["cell", "n"])

    return run


def prefix_counts(context: np.ndarray, symbol: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each (context, symbol): how often the context was followed by a symbol with the same first b bits, b = 0..8."""
    joint = context << np.uint64(8) | symbol.astype(np.uint64)
    values, inverse = np.unique(joint, return_inverse=True)
    sums = np.bincount(inverse, counts, len(values))
    running = np.concatenate([[0], np.cumsum(sums)])
    out = np.empty((len(context), 9), np.float64)
    for b in range(9):
        node = values >> np.uint64(8 - b)
        head = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
        group = np.searchsorted(head, np.arange(len(values)), "right") - 1
        total = running[np.append(head[1:], len(values))] - running[head]
        out[:, b] = total[group][inverse]
    return out


class Evidence:
    """Counts of all contexts of a slab's keys, and from them log-odds towards the bits that did occur."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray):
        self.keys = keys
        symbol, before = (keys & np.uint64(255)).astype(np.int64), nearest(keys)
        grid = pairs.reshape(256, 256)
        self.counts = np.empty((ORDERS, len(keys), 9), np.float32)
        for b in range(9):
            width = 1 << (8 - b)
            chunks = grid.reshape(256, 256 // width, width).sum(axis=2)
            self.counts[1, :, b] = chunks[before, symbol // width]
            self.counts[0, :, b] = chunks.sum(axis=0)[symbol // width]
        for order in range(2, ORDERS):
            self.counts[order] = prefix_counts(keys >> np.uint64(SHIFTS[order]), symbol, counts)

    def inputs(self, pick: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds (orders, keys, 8) and gates (keys, 8) of some keys, ``own`` occurrences taken out."""
        node = np.maximum(self.counts[:, pick, :8] - own, 0)
        child = np.maximum(self.counts[:, pick, 1:] - own, 0)
        odds = np.log((child + DELTA) / (node - child + DELTA))
        seen = node > 0
        longest = (seen * np.arange(ORDERS)[:, None, None]).max(axis=0)
        weight = np.take_along_axis(node, longest[None], axis=0)[0]
        level = (weight > 2).astype(np.int64) + (weight > 20)
        gate = (np.arange(8)[None, :] * ORDERS + longest) * 3 + level
        return np.where(seen, odds, 0.0), gate


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def first_weights() -> np.ndarray:
    return np.repeat(np.array([[0.05, 0.1, 0.15, 0.2, 0.3, 0.35, 0.4]]), GATES, axis=0)


def learn(evidence: Evidence, counts: np.ndarray, weights: np.ndarray, rate: float = RATE) -> tuple[np.ndarray, np.ndarray]:
    """Online passes over a slab's training bytes in batches, in the order of a hash; returns weights and the refinement's hits and misses."""
    weights = weights.copy()
    known = np.flatnonzero(counts > 0)
    # An order that held-out texts, which ask for keys of their own, can't change.
    known = known[np.argsort(ta.mix(evidence.keys[known]), kind="stable")]
    table = np.zeros((8, BINS))
    for epoch in range(EPOCHS):
        for a in range(0, len(known), BATCH):
            pick = known[a : a + BATCH]
            odds, gate = evidence.inputs(pick, 1)
            chosen = weights[gate]
            logit = np.einsum("okb,kbo->kb", odds, chosen)
            pull = (1 - squash(logit)) * np.log1p(counts[pick])[:, None]
            mass = np.bincount(gate.reshape(-1), np.broadcast_to(np.log1p(counts[pick])[:, None], gate.shape).reshape(-1), GATES)
            scale = rate * np.sqrt(np.maximum(mass, 1)) / np.maximum(mass, 1)
            for order in range(ORDERS):
                weights[:, order] += scale * np.bincount(gate.reshape(-1), (pull * odds[order]).reshape(-1), GATES)
            if epoch == EPOCHS - 1:
                table += hits(logit, counts[pick])
    return weights, table


def hits(logit: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weight of the true bits in bins of their log-odds, by bit position."""
    where = np.clip(np.rint(logit * 2) + BINS // 2, 0, BINS - 1).astype(np.int64)
    out = np.zeros((8, BINS))
    for b in range(8):
        out[b] = np.bincount(where[:, b], counts, BINS)
    return out


def refine(logit: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Probability of the true bits: the mean of the mixer's and the refinement's, which is symmetric in the two bits."""
    centre = squash((np.arange(BINS) - BINS // 2) / 2)
    right, wrong = table, table[:, ::-1]
    adapted = (right + 20 * centre) / (right + wrong + 20)
    place = np.clip(logit * 2 + BINS // 2, 0, BINS - 1)
    low = np.minimum(place.astype(np.int64), BINS - 2)
    part = place - low
    bit = np.arange(logit.shape[1])[None, :]
    second = adapted[bit, low] * (1 - part) + adapted[bit, low + 1] * part
    return np.clip((squash(logit) + second) / 2, 1e-7, 1 - 1e-7)


def log10_probability(evidence: Evidence, n: int, weights: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.empty(n, np.float32)
    for a in range(0, n, 8 * BATCH):
        pick = np.arange(a, min(n, a + 8 * BATCH))
        odds, gate = evidence.inputs(pick, 0)
        logit = np.einsum("okb,kbo->kb", odds, weights[gate])
        out[pick] = np.log10(refine(logit, table)).sum(axis=1)
    return out


def _learned(pairs: np.ndarray, slabs: int):
    def run(batches):
        for _, _, slab, keys, counts in _slabs_of(batches):
            if slab < slabs:
                weights, table = learn(Evidence(keys, counts, pairs), counts, first_weights())
                mass = float(counts.sum())
                values = np.concatenate([weights.reshape(-1) * mass, table.reshape(-1)])
                yield pa.RecordBatch.from_arrays([pa.array([mass]), pa.array([values.tolist()], pa.list_(pa.float64()))], names=["mass", "values"])

    return run


def average(learned: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weights of all slabs, averaged by their training bytes, and the sum of their tables.

    Sums are of whole multiples of 2 ** -20, so they don't depend on the order of the slabs.
    """
    whole = (F.col("value") * (1 << 20)).cast("decimal(38,0)")
    cells = learned.where("mass > 0").select("mass", F.posexplode("values").alias("at", "value")).groupBy("at").agg(F.sum(whole).alias("value"), F.sum(F.col("mass").cast("decimal(38,0)")).alias("mass")).collect()
    if not cells:
        return first_weights(), np.zeros((8, BINS))
    sums, mass = np.zeros(len(cells)), float(cells[0]["mass"])
    for r in cells:
        sums[r["at"]] = float(r["value"]) / (1 << 20)
    return (sums[: GATES * ORDERS] / mass).reshape(GATES, ORDERS), sums[GATES * ORDERS :].reshape(8, BINS)


def _answers(pairs: np.ndarray, weights: np.ndarray, table: np.ndarray, slabs: int):
    """For each block the values of the keys it asks a slab for: log10 probabilities of bytes, training counts of words."""

    def run(batches):
        for batch, i, slab, keys, counts in _slabs_of(batches):
            values = counts if slab >= slabs else log10_probability(Evidence(keys, counts, pairs), len(keys), weights, table).astype(np.float16)
            blocks, asked = batch.column("blocks")[i].as_py(), batch.column("asked")[i].values
            for a in range(0, len(blocks), 256):
                out = [_pack(values[_unpack_sorted(p.as_py(), np.uint32)]) for p in asked[a : a + 256]]
                yield pa.RecordBatch.from_arrays([pa.array(blocks[a : a + 256], pa.int64()), pa.array([slab] * len(out), pa.int32()), pa.array(out, pa.binary())], names=["block", "slab", "values"])

    return run


def _places(parts: list[np.ndarray]) -> list[np.ndarray]:
    """For each key its place among the sorted distinct keys of all parts."""
    keys = np.concatenate([np.zeros(0, np.uint64), *parts])
    order = np.argsort(keys)
    ranked = keys[order]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]])) if len(keys) else place
    ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
    return [place[e - len(p) : e] for e, p in zip(ends, parts, strict=True)]


def _totals(slabs: int, tokens: int, distinct: int, n_train_docs: int):
    total, kinds = tokens + n_train_docs, distinct + (n_train_docs > 0)
    floor = total + 0.1 * (kinds + 1)

    def run(key, docs, answers):
        order = np.argsort(answers["slab"].to_numpy(), kind="stable")
        slab = answers["slab"].to_numpy()[order]
        blobs = [answers["values"][int(i)].as_py() for i in order]
        have = [np.concatenate([np.zeros(0), *[_unpack(b, np.int64 if kind else np.float16) for s, b in zip(slab, blobs, strict=True) if (s >= slabs) == kind]]) for kind in (False, True)]
        batches = list(_block_keys(docs))
        at = [_places([b[i] for b in batches]) for i in (1, 3)]
        parts = []
        for (batch, _, offsets, _, first), byte_at, word_at in zip(batches, *at, strict=True):
            c = have[1][word_at]
            doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
            base = np.bincount(doc, np.log10((c + 0.1) / floor), batch.num_rows) + math.log10((n_train_docs + 0.1) / floor)
            score = np.add.reduceat(have[0][byte_at], offsets[:-1])
            size = np.diff(offsets)
            parts.append(
                pa.table(
                    {
                        "doc_id": batch.column("doc_id"),
                        "held_out": batch.column("held_out"),
                        "n_tokens": pa.array(np.diff(first) + 1),
                        "n_known": pa.array((np.bincount(doc, c > 0, batch.num_rows) + (n_train_docs > 0)).astype(np.int64)),
                        "train_tokens": pa.array(np.full(batch.num_rows, total, np.int64)),
                        "base_score": pa.array(base),
                        "score": pa.array(score),
                        "bits_per_byte": pa.array(-score / math.log10(2) / size),
                    }
                )
            )
        return pa.concat_tables(parts)

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def lm_scores(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Rows whose crc32 of the id (as text) leaves 0 on division by 10 are held out: they are scored, never learned from.
    A null id is held out too. A null text counts as empty and consists of the end alone; repeated rows count and are
    scored each; other columns are not read; an empty table gives an empty result. Words are told apart by 63-bit
    hashes, log probabilities of bytes are kept in half precision. Without training documents every byte gets even odds.

    Memory of a task: a block of about ``block_bytes``, or one longer text, or a slab, for ``slab_bytes`` of training
    text. Requests are blocks times slabs in number; beyond some TB both sizes should be raised with the input's root.
    """
    spark = df.sparkSession
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(10)) == 0, F.lit(True))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held.alias("held_out"), (~held).alias("train"))
    length = F.octet_length("text") + 1
    size = docs.agg(F.sum(length).alias("bytes"), F.sum(F.when(F.col("train"), length)).alias("train_bytes"), F.sum(F.col("train").cast("long")).alias("train")).first()
    n_blocks = max(1, math.ceil((size["bytes"] or 0) / block_bytes))
    cuts = slab_cuts(docs, size["train_bytes"] or 0, slab_bytes)
    slabs = len(cuts) + 1
    word_slabs = slabs // 4 + 1
    place = F.xxhash64("doc_id", "text")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), length.alias("bytes"))
    hot = keyed.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(F.count(F.lit(1)).alias("__many"), F.sum("bytes").alias("__bytes")).where((F.col("__many") > 1) & (F.col("__bytes") > block_bytes))
    if hot.head(1):
        # Copies of one row that fill a block are told apart by a number, which holds for a written table only.
        docs = Table(spark, docs.withColumn("__row", F.monotonically_increasing_id()), "documents").df
        docs = docs.join(hot, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key")), "left")
        place = F.when(F.col("__many").isNull(), place).otherwise(F.xxhash64("doc_id", "text", "__row"))
    blocked = docs.withColumn("block", F.pmod(place, F.lit(n_blocks))).select("doc_id", "text", "held_out", "train", "block")
    asked = blocked.groupBy("block").applyInArrow(_requests(cuts, word_slabs), REQUEST)
    # As many partitions as slabs: the work on a slab is large beside its bytes.
    model = Table(spark, asked.repartition(slabs + word_slabs, "slab").groupBy("slab").applyInArrow(_gather, SLAB), "slabs")
    bare = model.df.select("slab", "keys", "counts")
    cells = {r["cell"]: r["n"] for r in bare.mapInArrow(_short_counts(slabs), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    pairs = np.zeros(1 << 16)
    for cell, n in cells.items():
        if cell >= 0:
            pairs[cell] = n
    weights, table = average(bare.mapInArrow(_learned(pairs, slabs), "mass double, values array<double>"))
    found = Table(spark, model.df.mapInArrow(_answers(pairs, weights, table, slabs), "block long, slab int, values binary"), "answers")
    model.drop()
    return blocked.groupBy("block").cogroup(found.df.groupBy("block")).applyInArrow(_totals(slabs, cells.get(-1, 0), cells.get(-2, 0), size["train"] or 0), SCORES)
