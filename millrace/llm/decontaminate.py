"""Benchmark decontamination in DataFrame operations only: SimHash of item-sized windows, multi-index Hamming search,
exact weighted-shingle verification.

A document is contaminated by an item of m words if one of its windows of m words (the whole document, if shorter) has a
weighted Jaccard similarity of 0.8 or more to it on 5-word shingles (weights are counts). Such a window shares a
shingle with the item, so only windows over a shared shingle are fingerprinted; the fingerprint is a 64-bit SimHash
of the window's words. At similarity 0.8 at most a ninth of the words differ and two fingerprints differ in about 10 bits
(standard deviation 3), so a radius of 23 loses one such window in a million; others differ in about 32 bits. Cut into 24
blocks of 2 or 3 bits, two fingerprints within the radius agree in one block at least, so joining on (item, block, value)
finds every such pair. Pairs within the radius are verified on the shingles themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import Table, release

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
#: First bit and width of the blocks, one more than the radius: 16 of three bits, 8 of two.
BLOCKS = [(3 * b, 3) for b in range(16)] + [(48 + 2 * b, 2) for b in range(8)]
LANES = 32
BROADCAST_BYTES = 16 << 20
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: as a lambda variable it can't be copied into inner lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def words_of(text: Column) -> Column:
    """Lower-case words: runs of digits, letters and non-ASCII characters."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _BREAKS), lambda w: w != "")


def shingles_of(words: Column, k: int) -> Column:
    """Hashes of all runs of k words."""
    last = F.size(words) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def _runs(words: Column) -> Column:
    """The shingles themselves, as strings; a run of fewer than 5 words is one shingle."""
    return F.when(F.size(words) < SHINGLE, F.array(F.concat_ws(" ", words))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(SHINGLE)]))
    )


def _lanes() -> list[Column]:
    """32 sums; each holds, in 32-bit fields, how many of the words have bit 2j and 2j + 1 of their hash set."""
    out = []
    for j in range(LANES):
        low, high = (F.shiftrightunsigned("hash", 2 * j + b).bitwiseAND(F.lit(1).cast("long")) for b in range(2))
        out.append(F.sum(F.shiftleft(high, 32).bitwiseOR(low)).alias(f"lane{j}"))
    return out


def _fingerprint(n: Column) -> Column:
    bits = []
    for j in range(LANES):
        for b in range(2):
            count = F.shiftrightunsigned(f"lane{j}", 32 * b).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
            bits.append(F.shiftleft((2 * count > n).cast("long"), 2 * j + b))
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def simhash(rows: DataFrame, keys: list[str], words: str) -> DataFrame:
    """Fingerprints of word lists: ``keys`` and fp."""
    exploded = rows.select(*keys, F.explode(words).alias("word")).select(*keys, F.xxhash64("word").alias("hash"))
    return exploded.groupBy(*keys).agg(*_lanes(), F.count(F.lit(1)).alias("n")).select(*keys, _fingerprint(F.col("n")).alias("fp"))


def _value(fp: Column, b: int) -> Column:
    first, width = BLOCKS[b]
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _blocks(fp: Column) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(b).alias("block"), _value(fp, b).alias("value")) for b in range(len(BLOCKS))]))


def _first_agreement(x: Column) -> Column:
    return F.coalesce(*[F.when(_value(x, b) == 0, b) for b in range(len(BLOCKS))])


def _small(df: DataFrame, text: str | None = None, bound: int = BROADCAST_BYTES) -> DataFrame:
    """Marked for broadcast if it takes at most ``bound`` bytes, otherwise left to a shuffled join.

    Its columns are numbers but for ``text``; it should read a written table, as it is read once to be measured.
    """
    rows, chars = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(text)) if text else F.lit(0)).first()
    return F.broadcast(df) if rows * 16 * len(df.columns) + (chars or 0) <= bound else df


def benchmark_items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, part (a number of the row), m, words: items without words are left out."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    return rows.select(F.monotonically_increasing_id().alias("part"), "item", F.size("words").alias("m"), "words")


def window_starts(hits: DataFrame) -> DataFrame:
    """Of shared shingles (kid, n, part, m, q, pos) all windows over one: kid, part, m, start; each once.

    A shingle adds the starts that reach it and lie behind those of the shingle before it.
    """
    low, top = F.greatest(F.lit(0), F.col("pos") + F.col("q") - F.col("m")), F.greatest(F.lit(0), F.least(F.col("pos"), F.col("n") - F.col("m")))
    ranged = hits.withColumn("top", top).withColumn("low", F.least(low, top))
    before = F.lag("top").over(Window.partitionBy("kid", "part").orderBy("pos"))
    first = F.greatest("low", F.coalesce(before + 1, "low"))
    return ranged.withColumn("first", first).where("first <= top").select("kid", "part", "m", F.explode(F.sequence("first", "top")).alias("start"))


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> Table:
    """Table (text_md5, n_items, item_id, similarity) of the distinct contaminated texts; item_id is the least of the most similar items."""
    spark = docs.sparkSession
    parts = Table(spark, benchmark_items(benchmark, item_col, item_text_col), "benchmark")
    lengths = sorted(r["q"] for r in parts.df.select(F.least("m", F.lit(SHINGLE)).alias("q")).distinct().collect())

    def hashes(words: Column) -> Column:
        return F.concat(F.array().cast("array<bigint>"), *[shingles_of(words, q) for q in lengths])

    def of_part() -> Column:
        return F.coalesce(*[F.when(F.least("m", F.lit(SHINGLE)) == q, shingles_of(F.col("words"), q)) for q in lengths], F.array().cast("array<bigint>"))

    known = Table(spark, parts.df.select("part", "m", F.explode(of_part()).alias("shingle")).distinct(), "benchmark-shingles")
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("text_md5"))
    # 1. Texts that share a shingle with the benchmark; copies count once.
    seen = named.select("doc_id", "text_md5", F.explode(_let(words_of(F.col("text")), hashes)).alias("shingle"))
    sharing = Table(spark, seen.join(_small(known.df.select("shingle").distinct()), "shingle", "left_semi").groupBy("text_md5").agg(F.min("doc_id").alias("first_id")), "sharing")
    chosen = sharing.df.select(F.col("text_md5").alias("md5"), "first_id")
    texts = named.join(chosen, (F.col("text_md5") == F.col("md5")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).dropDuplicates(["text_md5"])
    found = Table(spark, texts.select(F.monotonically_increasing_id().alias("kid"), "text_md5", words_of(F.col("text")).alias("words")), "shared-texts")
    release(spark)
    # 2. Item-sized windows over a shingle shared with the item.
    n = F.size("words")
    hit = []
    for q in lengths:
        placed = found.df.select("kid", n.alias("n"), F.posexplode(shingles_of(F.col("words"), q)).alias("pos", "shingle"))
        hit.append(placed.join(_small(known.df.where(F.least("m", F.lit(SHINGLE)) == q)), "shingle").withColumn("q", F.lit(q)))
    if not hit:
        return Table(spark, found.df.select("text_md5", F.lit(0).cast("long").alias("n_items"), F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("similarity")).limit(0), "contaminated")
    starts = Table(spark, window_starts(reduce(DataFrame.union, hit)), "windows")
    release(spark)
    windows = starts.df.select("kid", "m", "start").distinct().join(found.df.select("kid", "words"), "kid").select("kid", "m", "start", F.slice("words", F.col("start") + 1, F.col("m")).alias("words"))
    # 3. Fingerprints, and all pairs within the radius by agreeing blocks. They are written, as their 64 terms would
    # otherwise stand in the plan of the pairs too. The driver's heap is collected between the plans, before it grows.
    prints = Table(spark, simhash(windows, ["kid", "m", "start"], "words"), "window-fingerprints")
    items = Table(spark, simhash(parts.df, ["part"], "words").select("part", F.col("fp").alias("item_fp"), _blocks(F.col("fp")).alias("b")).select("part", "item_fp", "b.*"), "fingerprints")
    release(spark)
    paired = starts.df.join(prints.df, ["kid", "m", "start"])
    probes = paired.select("kid", "start", F.col("part").alias("p_part"), "fp", _blocks(F.col("fp")).alias("b")).select("kid", "start", "p_part", "fp", F.col("b.block").alias("p_block"), F.col("b.value").alias("p_value"))
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    meet = (F.col("p_part") == F.col("part")) & (F.col("p_block") == F.col("block")) & (F.col("p_value") == F.col("value"))
    near = probes.join(_small(items.df), meet).where((_first_agreement(apart) == F.col("block")) & (F.bit_count(apart) <= RADIUS))
    candidates = Table(spark, near.join(_small(parts.df.select("part", "m")), "part").select("kid", "m", "start", "part"), "candidates")
    release(spark)
    # 4. Exact weighted similarity.
    runs = candidates.df.join(found.df.select("kid", "words"), "kid").select("kid", "start", "part", F.explode(_let(F.slice("words", F.col("start") + 1, F.col("m")), _runs)).alias("run"))
    weighed = runs.groupBy("kid", "start", "part", "run").agg(F.count(F.lit(1)).alias("a"))
    weights = Table(spark, parts.df.select("part", F.explode(_runs(F.col("words"))).alias("run")).groupBy("part", "run").agg(F.count(F.lit(1)).alias("b")), "weights")
    common = weighed.join(_small(weights.df, "run"), ["part", "run"], "left").groupBy("kid", "start", "part").agg(F.sum(F.least("a", F.coalesce("b", F.lit(0)))).alias("both"), F.sum("a").alias("own"))
    sized = parts.df.select("part", "item", F.greatest(F.lit(1), F.col("m") - SHINGLE + 1).alias("full"))
    similar = common.join(_small(sized), "part").withColumn("similarity", F.col("both") / (F.col("own") + F.col("full") - F.col("both"))).where(F.col("similarity") >= SIMILARITY)
    by_item = similar.groupBy("kid", "item").agg(F.max("similarity").alias("similarity"))
    best = by_item.groupBy("kid").agg(F.count(F.lit(1)).alias("n_items"), F.max(F.struct("similarity", (-F.col("item")).alias("minus"))).alias("b"))
    named_again = best.join(found.df.select("kid", "text_md5"), "kid")
    out = Table(spark, named_again.select("text_md5", "n_items", (-F.col("b.minus")).alias("item_id"), F.col("b.similarity").alias("similarity")), "contaminated")
    for used in (sharing, found, candidates, parts, known, starts, prints, items, weights):
        used.drop()
    release(spark)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """One row per input row: doc_id, contaminated, n_items, item_id, similarity.

    Null, empty and wordless texts are clean; items without words are ignored. Repeated rows and copies share their
    result, a null id stays null, other columns are not read, and an empty table on either side gives no contamination.
    """
    bad = contaminated_texts(docs, benchmark, **names)
    keyed = docs.select(F.col(names.get("id_col", "doc_id")).cast("long").alias("doc_id"), F.unhex(F.md5(F.col(names.get("text_col", "text")).cast("binary"))).alias("text_md5"))
    # One row per text on the right, so a hot text on the left can be split.
    joined = keyed.join(bad.df, "text_md5", "left")
    return joined.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), "item_id", "similarity")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not contaminated."""
    bad = contaminated_texts(docs, benchmark, **names)
    key = F.unhex(F.md5(F.col(names.get("text_col", "text")).cast("binary")))
    return docs.withColumn("__md5", key).join(_small(bad.df.select(F.col("text_md5").alias("__md5"))), "__md5", "left_anti").drop("__md5")
