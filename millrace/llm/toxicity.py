"""Toxicity scores: a linear classifier on character n-grams, their features scaled by naive Bayes log-count ratios.

A document's features are the distinct character 3-, 4- and 5-grams of its whole text (A-Z lower-cased), hashed into
2**18 buckets. Over all labelled training documents the executors count in how many documents of either class each
bucket occurs; r = log of the ratio of the two smoothed rates scales the features, and a logistic regression on the
scaled features is fitted on a bounded sample (after Wang and Manning, 2012). The documents are scored in one scan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from . import textarrays as ta
from .storage import Table

BITS = 18
ORDERS = (3, 4, 5)
CHUNKS = 64
THRESHOLD = 0.3
SLICE = 1 << 18
_A, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def char_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One number per UTF-8 character, and the character offsets of the documents."""
    leads = np.flatnonzero((data & 0xC0) != 0x80)
    if len(leads) == len(data):
        return data.astype(np.uint64), offsets
    codes, after = data[leads].astype(np.uint64), np.append(leads[1:], len(data))
    for k in (1, 2, 3):
        more = np.flatnonzero(leads + k < after)
        codes[more] |= data[leads[more] + k].astype(np.uint64) << np.uint64(8 * k)
    return codes, np.searchsorted(leads, offsets)


def features(data: np.ndarray, offsets: np.ndarray, orders=ORDERS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each document, back to back, and their len+1 offsets."""
    codes, at = char_codes(ta.lower(data), offsets)
    gram, buckets = codes, {}
    for n in range(2, max(orders) + 1):
        gram = gram[:-1] * _A + codes[n - 1 :]
        if n in orders:
            buckets[n] = (((gram + np.uint64(n)) * _SPREAD) >> np.uint64(64 - bits)).astype(np.int32)
    last, count = np.empty(1 << bits, np.int32), np.arange(len(orders) * int(np.diff(at).max(initial=0)), dtype=np.int32)
    found, cuts = [], np.zeros(len(at), np.int64)
    for d, (a, b) in enumerate(zip(at.tolist(), at.tolist()[1:], strict=False)):
        mine = np.concatenate([g[a : max(a, b - n + 1)] for n, g in buckets.items()])
        # Every bucket remembers its last use, so one use of each is kept, in linear time.
        places = count[: len(mine)]
        last[mine] = places
        mine = mine[last[mine] == places]
        found.append(mine)
        cuts[d + 1] = cuts[d] + len(mine)
    return np.concatenate(found) if found else np.zeros(0, np.int32), cuts


def _evidence(bits: int):
    """Per task: bucket counts of either class in chunks, and the features of sampled documents."""
    size = 1 << bits

    def run(batches):
        counts, seen = np.zeros((2, size), np.int64), np.zeros(2, np.int64)
        for batch in ta.slices(batches, "text", SLICE):
            found, cuts = features(*ta.flat(batch.column("text")), bits=bits)
            label = batch.column("toxic").to_numpy()
            for y in (0, 1):
                counts[y] += np.bincount(found[np.repeat(label == y, np.diff(cuts))], minlength=size)
                seen[y] += int((label == y).sum())
            picked = np.flatnonzero(batch.column("sampled").to_numpy(zero_copy_only=False))
            if len(picked):
                blobs = [found[cuts[i] : cuts[i + 1]].tobytes() for i in picked]
                yield pa.RecordBatch.from_arrays([pa.array([-1] * len(picked), pa.int32()), pa.array(label[picked], pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "label", "blob"])
        if seen.any():
            width = size // CHUNKS
            blobs = [counts[:, c * width : (c + 1) * width].tobytes() for c in range(CHUNKS)] + [seen.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS + 1), pa.int32()), pa.array([0] * (CHUNKS + 1), pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "label", "blob"])

    return run


def _summed(batches):
    """Add up the chunk vectors of one task."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob"), strict=True):
            vector = np.frombuffer(blob.as_buffer(), np.int64)
            total[chunk] = total[chunk] + vector if chunk in total else vector.copy()
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([0] * len(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["chunk", "label", "blob"])


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def fit_logistic(found: np.ndarray, cuts: np.ndarray, label: np.ndarray, importance: np.ndarray, ratio: np.ndarray, penalty: float = 0.002, steps: int = 80) -> Model:
    """Weighted logistic regression on presence times ``ratio``: limited-memory BFGS with backtracking."""
    mass = importance / importance.sum()
    # Blocks of documents with about a million entries each bound what a step holds beside the features themselves.
    edges = np.unique(np.searchsorted(cuts, np.append(np.arange(0, cuts[-1], 1 << 20), cuts[-1])))
    blocks = [(a, b) for a, b in zip(np.append(0, edges), np.append(edges, len(label)), strict=True) if a < b]

    def loss(theta):
        scaled, margin = theta[:-1] * ratio, np.empty(len(label))
        for a, b in blocks:
            doc = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(cuts[a : b + 1]))
            margin[a:b] = np.bincount(doc, scaled[found[cuts[a] : cuts[b]]], b - a) + theta[-1]
        signed = np.where(label == 1, margin, -margin)
        value = float(mass @ np.logaddexp(0, -signed)) + 0.5 * penalty * float(theta[:-1] @ theta[:-1])
        pull = mass * (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - label)
        grad = np.append(penalty * theta[:-1], pull.sum())
        for a, b in blocks:
            pulls = np.repeat(pull[a:b], np.diff(cuts[a : b + 1]))
            grad[:-1] += np.bincount(found[cuts[a] : cuts[b]], pulls, len(theta) - 1) * ratio
        return value, grad

    theta = np.zeros(len(ratio) + 1)
    rate = float(np.clip(mass @ label, 1e-6, 1 - 1e-6))
    theta[-1] = np.log(rate / (1 - rate))
    value, grad = loss(theta)
    memory: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        step, trail = -grad, []
        for s, y, rho in reversed(memory):
            trail.append(rho * (s @ step))
            step = step - trail[-1] * y
        if memory:
            s, y, _ = memory[-1]
            step = step * ((s @ y) / (y @ y))
        else:
            step = step / max(1.0, float(np.linalg.norm(grad)))
        for (s, y, rho), a in zip(memory, reversed(trail), strict=True):
            step = step + s * (a - rho * (y @ step))
        size, slope = 1.0, float(grad @ step)
        while size > 1e-6:
            new_value, new_grad = loss(theta + size * step)
            if new_value <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = size * step, new_grad - grad
        if s @ y > 1e-12:
            memory = [*memory[-7:], (s, y, 1 / float(s @ y))]
        theta, done = theta + s, value - new_value < 1e-6
        value, grad = new_value, new_grad
        if done:
            break
    return Model((theta[:-1] * ratio).astype(np.float32), float(theta[-1]))


def train(df: DataFrame, labels: DataFrame, sample_docs: int = 600, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on the rows of ``df`` that ``labels`` marks 0 or 1; conflicting labels of an id count as 1.

    The counts behind the ratios cover all labelled rows; the regression takes about ``sample_docs`` documents of each
    class at most, chosen by a hash of the id, weighted back to the true class sizes. Without documents of both classes
    the model is constant: high if all are toxic, else low.
    """
    spark = df.sparkSession
    marked = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    known = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, sample_docs / max(1, known.get(1, 0)))).otherwise(min(1.0, sample_docs / max(1, known.get(0, 0))))
    joined = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(marked.hint("merge"), "id")
    picked = F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(1 << 30)) < share * (1 << 30)
    seen = Table(spark, joined.select("text", "toxic", picked.alias("sampled")).mapInArrow(_evidence(bits), "chunk int, label int, blob binary"), "toxicity")
    vectors = {r.chunk: np.frombuffer(r.blob, np.int64) for r in seen.df.where("chunk >= 0").repartition(CHUNKS + 1, "chunk").mapInArrow(_summed, seen.df.schema).collect()}
    sample = seen.df.where("chunk = -1").select("label", "blob").collect()
    seen.drop()
    docs = vectors.get(CHUNKS, np.zeros(2, np.int64))
    if not docs.all():
        return Model(np.zeros(1 << bits, np.float32), 4.0 if docs[1] else -4.0)
    counts = np.concatenate([vectors[c].reshape(2, -1) for c in range(CHUNKS)], axis=1)
    ratio = np.log((counts[1] + 1) / (docs[1] + 2)) - np.log((counts[0] + 1) / (docs[0] + 2))
    ratio[counts.sum(axis=0) == 0] = 0
    sample.sort(key=lambda r: (r.label, bytes(r.blob)))
    label = np.array([r.label for r in sample])
    parts = [np.frombuffer(r.blob, np.int32) for r in sample]
    cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    importance = np.where(label == 1, docs[1] / max(1, (label == 1).sum()), docs[0] / max(1, (label == 0).sum()))
    if len(np.unique(label)) < 2:
        return Model(ratio.astype(np.float32), float(np.log(docs[1] / docs[0])))
    return fit_logistic(np.concatenate(parts), cuts, label, importance, ratio)


def scores(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    found, cuts = features(data, offsets, bits=int(len(model.weights)).bit_length() - 1)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(cuts))
    margin = np.bincount(doc, model.weights[found], len(offsets) - 1) + model.bias
    return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def with_scores(df: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` with one more double column: the probability that a text is toxic. Null and empty texts get the bias alone.

    ``text_col`` may be a field of a struct column, as in "row.text".
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    holder, *field = text_col.split(".")
    place = df.columns.index(holder)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = pc.struct_field(batch.column(place), field) if field else batch.column(place)
            done = [scores(*ta.flat(part.column(0)), model) for part in ta.slices([pa.RecordBatch.from_arrays([texts], names=["text"])], "text", SLICE)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(done))], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def toxicity(df: DataFrame, labels: DataFrame, sample_docs: int = 600) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Labels of ids whose crc32 (as text) leaves 2 on division by 4 are never looked at. A null id has no label and is
    not held out, repeated rows are scored alike, other columns are not read, and an empty table gives an empty result.
    """
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = train(df.where(rest != 2), labels.where(rest != 2), sample_docs)
    rows = with_scores(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return rows.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
