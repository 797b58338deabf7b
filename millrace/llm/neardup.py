"""Near-duplicates by a chosen-path set similarity join (after Christiani, Pagh and Sivertsen, 2018).

A document is its set of word shingles; documents with equal sets form one class and only a representative goes on. In
each of a number of independent trees a representative walks down a path of its own minwise tokens: two sets of
similarity J share a node at depth d with probability J ** d, so trees are repeated until the chance to miss a pair at
the threshold in all of them is small. What meets in a node is compared on full sets:

* first every member with the node's least member, which settles most of a large group of near copies with as many
  comparisons as it has members;
* then, in nodes that still hold several components, all pairs across components: small nodes give pairs (each
  compared once, whatever the number of trees), larger ones gather the sets of their members in one bounded task, and
  nodes beyond that bound are cut into blocks, each pair of blocks being one bounded task. Members of the node's largest
  component are compared with the others only, so a group of near copies is not squared; members that stay apart are.

Only links that join components are kept.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textarrays as ta
from .components import components
from .storage import Table, release

COORDINATES = 64
MISS = 2e-6
FIRST_DEPTH = 4
SMALL_NODE = 16
LARGE_NODE = 1024
SIGNED = "doc_id long, text_key long, row long, n_shingles long, class binary, signature array<int>"
_rng = np.random.Generator(np.random.PCG64(9))
_FACTORS = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)


def trees_for(similarity: float, depth: int = FIRST_DEPTH, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log1p(-(similarity**depth)))


def signatures(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over each (non-empty) set."""
    out = np.empty((len(cuts) - 1, COORDINATES), np.int32)
    for c in range(COORDINATES):
        out[:, c] = np.minimum.reduceat((((hashes ^ _SHIFTS[c]) * _FACTORS[c]) >> np.uint64(32)).astype(np.uint32), cuts[:-1]).view(np.int32)
    return out


def _sign(k: int):
    def run(batches):
        for batch in ta.slices(batches, "text"):
            data, offsets = ta.flat(batch.column("text"))
            hashes, cuts = ta.shingle_sets(ta.lower(data), offsets, k)
            size = np.diff(cuts)
            full = np.flatnonzero(size)
            sig = signatures(hashes, np.append(cuts[full], len(hashes))) if len(full) else np.zeros((0, COORDINATES), np.int32)
            flat = pa.array(sig.reshape(-1), pa.int32())
            places = np.zeros(len(size) + 1, np.int32)
            places[1:] = np.cumsum(size > 0) * COORDINATES
            classes = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), batch.column("row"), pa.array(size.astype(np.int64)), pa.array(classes, pa.binary()), pa.ListArray.from_arrays(pa.array(places), flat)],
                names=["doc_id", "text_key", "row", "n_shingles", "class", "signature"],
            )

    return run


def _sets(k: int):
    def run(batches):
        for batch in ta.slices(batches, "text"):
            data, offsets = ta.flat(batch.column("text"))
            hashes, cuts = ta.shingle_sets(ta.lower(data), offsets, k)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(hashes.view(np.int64)))], names=["rid", "shingles"])

    return run


def link_node(ids: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], percent: int, parts: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Exhaustive comparison across the components of one node: links that join all that belong together.

    With ``parts`` of two values only pairs across them are compared.
    """
    sizes = np.array([len(s) for s in sets])
    token, member = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, token, df = np.unique(token, return_inverse=True, return_counts=True)
    shared = df[token] > 1
    column = np.cumsum(df > 1) - 1
    token, member = column[token[shared]], member[shared]
    _, comp = np.unique(comps, return_inverse=True)
    outer, inner = np.flatnonzero(comp != np.bincount(comp).argmax()), np.arange(len(sets))
    if parts is not None and parts.min() < parts.max():
        outer, inner = np.flatnonzero(parts == parts.min()), np.flatnonzero(parts != parts.min())
    common = np.zeros((len(outer), len(inner)), np.float32)
    order = np.argsort(token, kind="stable")
    token, member = token[order], member[order]
    width = 2048
    for first in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        a, b = np.searchsorted(token, (first, first + width))
        block = np.zeros((len(sets), width), np.float32)
        block[member[a:b], token[a:b] - first] = 1
        common += block[outer] @ block[inner].T
    common = np.rint(common).astype(np.int64)
    union = sizes[outer][:, None] + sizes[inner][None, :] - common
    left, right = np.nonzero((100 * common >= percent * union) & (comp[outer][:, None] != comp[inner][None, :]))
    root = list(range(comp.max() + 1))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(outer[left], inner[right], strict=True):
        a, b = find(comp[i]), find(comp[j])
        if a != b:
            root[a] = b
            out.append((int(ids[i]), int(ids[j])))
    return out


def _compare_nodes(percent: int):
    def run(table):
        ids, comps = table["rid"].to_numpy(), table["comp"].to_numpy()
        column = table["shingles"].combine_chunks()
        values, cuts = column.values.to_numpy(), column.offsets.to_numpy()
        found = link_node(ids, comps, [values[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], percent, table["part"].to_numpy() if "part" in table.column_names else None)
        return pa.table({"u": pa.array([x[0] for x in found], pa.int64()), "v": pa.array([x[1] for x in found], pa.int64())})

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (u, v) those whose full sets reach the threshold."""
    a = sets.select(F.col("rid").alias("u"), F.col("shingles").alias("su"))
    b = sets.select(F.col("rid").alias("v"), F.col("shingles").alias("sv"))
    common = F.size(F.array_intersect("su", "sv"))
    return pairs.join(a, "u").join(b, "v").where(100 * common >= percent * (F.size("su") + F.size("sv") - common)).select("u", "v")


def _blocks(spark, huge: DataFrame, block: int) -> tuple[DataFrame, Table]:
    """Members of nodes (node, rid, comp) in blocks of about ``block``: node, first, second, part, rid, comp.

    Each pair of blocks (first, second) of a node that can hold a new link has the members of both, ``part`` being the
    member's own. The node's largest component has the last blocks, which meet the blocks of other members only. With
    it comes the table that it reads.
    """
    counts = huge.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("size"))
    whole = counts.groupBy("node").agg(F.sum("size").alias("all"), F.max(F.struct("size", "comp")).alias("main"))
    outer_parts, main_parts = F.ceil((F.col("all") - F.col("main.size")) / block), F.ceil(F.col("main.size") / block)
    shape = Table(spark, whole.select("node", F.col("main.comp").alias("main"), outer_parts.alias("outer_parts"), main_parts.alias("main_parts")), "shape")
    is_main, place = F.col("comp") == F.col("main"), F.xxhash64(F.lit(3), "rid")
    part = F.when(is_main, F.col("outer_parts") + F.pmod(place, "main_parts")).otherwise(F.pmod(place, "outer_parts"))
    met = F.col("outer_parts") + F.when(is_main, 0).otherwise(F.col("main_parts")) - 1
    cut = huge.join(shape.df, "node").select("node", "rid", "comp", part.alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), met)).alias("other"))
    return cut.select("node", F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second"), "part", "rid", "comp"), shape


def near_duplicates(
    df: DataFrame,
    k: int = 5,
    percent: int = 80,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    first_depth: int = FIRST_DEPTH,
    small_node: int = SMALL_NODE,
    large_node: int = LARGE_NODE,
) -> DataFrame:
    """One row per input row: doc_id, text_key, n_shingles, component_id, kept.

    Rows are linked when their sets of k-word shingles (A-Z lower-cased, words split at ASCII whitespace) have a Jaccard
    similarity of ``percent`` per cent or more; ``component_id`` is the least doc_id that is reachable. A text of fewer
    than k words has its whole word sequence as its one shingle; an empty, blank or null text has none and is linked
    with nothing. Null ids are ignored when a component has another id, else component_id is null; ``kept`` marks the
    rows whose id (null equals null) is the component's. Repeated rows are equal and so share all columns. ``text_key``
    is xxhash64 of the text, to find the row again. Other columns are not read.
    """
    spark, trees = df.sparkSession, trees_for(percent / 100, first_depth)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    signed = Table(spark, docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_sign(k), SIGNED), "signed")
    some = signed.df.where("n_shingles > 0")
    pick = F.min_by(F.struct("doc_id", "text_key", "signature"), "row")
    reps = Table(
        spark,
        some.groupBy("class").agg(F.min("row").alias("rid"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), pick.alias("p")).select("class", "rid", "least", "n", "p.*"),
        "representatives",
    )
    orders = [np.random.Generator(np.random.PCG64((9, t))).permutation(COORDINATES).tolist() for t in range(trees)]

    def nodes(source: DataFrame, depth: int, *extra: str) -> DataFrame:
        per_tree = [F.xxhash64(F.lit(t), *[F.col("signature")[c] for c in orders[t][:depth]]) for t in range(trees)]
        return source.select("rid", "n", *extra, F.explode(F.array(*per_tree)).alias("node"))

    # Nodes of one member are of no interest; the others by their least member.
    first = nodes(reps.df.select("rid", "n", "signature"), first_depth)
    # The heads are written before they are joined: one row per node, so the members of a hot node can be split.
    heads = Table(spark, first.groupBy("node").agg(F.min("rid").alias("head"), F.min_by("n", "rid").alias("head_n"), F.count(F.lit(1)).alias("members")).where("members > 1"), "heads")
    met = Table(spark, first.join(heads.df, "node").select("node", "rid", "n", "head", "head_n"), "nodes")
    fits = 100 * F.least("n", "head_n") >= percent * F.greatest("n", "head_n")
    star = Table(spark, met.df.where((F.col("rid") != F.col("head")) & fits).select(F.col("rid").alias("u"), F.col("head").alias("v")).distinct(), "star")
    wanted = Table(spark, met.df.select("rid").distinct(), "wanted")
    chosen = reps.df.join(wanted.df, "rid").select("rid", F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key"))
    # Equal (id, text) pairs stand for the same set, so any one of repeated rows will do.
    texts = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_key") == F.col("w_key"))).select("rid", "text")
    sets = Table(spark, texts.mapInArrow(_sets(k), "rid long, shingles array<long>"), "sets")
    if sets.df.count() > wanted.df.count():
        every, sets = sets, Table(spark, sets.df.dropDuplicates(["rid"]), "sets")
        every.drop()
    release(spark)
    links = [Table(spark, _verified(star.df, sets.df, percent), "links")]
    settled = components(links[0].df)
    release(spark)

    here = met.df.select("node", "rid", "n")
    marked = here.join(settled.df.select(F.col("u").alias("rid"), F.col("v").alias("c")), "rid", "left").select("node", "rid", "n", F.coalesce("c", "rid").alias("comp"))
    marked = Table(spark, marked, "marked")
    mixed = Table(spark, marked.df.groupBy("node").agg(F.count(F.lit(1)).alias("members"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("node", "members"), "mixed")
    open_ = Table(spark, marked.df.join(mixed.df, "node"), "open")
    small = open_.df.where(F.col("members") <= small_node)
    other = small.select("node", F.col("rid").alias("v"), F.col("n").alias("m"), F.col("comp").alias("other"))
    pairs = small.withColumnRenamed("rid", "u").join(other, "node").where((F.col("u") > F.col("v")) & (F.col("comp") != F.col("other")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m")))
    fresh = Table(spark, pairs.select("u", "v").distinct().join(star.df, ["u", "v"], "left_anti"), "pairs")
    links.append(Table(spark, _verified(fresh.df, sets.df, percent), "links"))
    fresh.drop()
    middle = open_.df.where((F.col("members") > small_node) & (F.col("members") <= large_node))
    huge = open_.df.where(F.col("members") > large_node)
    compared, shapes = [], []
    if middle.head(1):
        # One task per node: at most `large_node` sets.
        compared.append(middle.select("node", "rid", "comp").join(sets.df, "rid").groupBy("node").applyInArrow(_compare_nodes(percent), "u long, v long"))
    if huge.head(1):
        cut, shape = _blocks(spark, huge, max(1, large_node // 2))
        shapes.append(shape)
        compared.append(cut.join(sets.df, "rid").groupBy("node", "first", "second").applyInArrow(_compare_nodes(percent), "u long, v long"))
    for found in compared:
        links.append(Table(spark, found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"))
    release(spark)
    final = components(_union([x.df for x in links]))
    member = reps.df.join(final.df, reps.df.rid == final.df.u, "left").select("class", "least", F.coalesce("v", "rid").alias("comp"))
    member = Table(spark, member, "members")
    for used in (reps, heads, met, star, wanted, sets, settled, marked, mixed, open_, *shapes, *links, final):
        used.drop()
    release(spark)
    lowest = Table(spark, member.df.groupBy("comp").agg(F.min("least").alias("component_id")), "lowest")
    # One row per component, then one row per class: the other sides can be split where they are hot.
    classes = member.df.join(lowest.df, "comp").select("class", "component_id")
    done = signed.df.select("doc_id", "text_key", "n_shingles", "class").join(classes, "class", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return done.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
