"""From raw documents to mixed, sharded training data: five stages, each one operator over all that the stage before kept.

Every stage takes (spark, docs, sf_dir), is written as Parquet and read again by the next; all but the last return the
columns of ``docs``.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.llm.decontaminate import without_contaminated
from millrace.llm.mixing import mix_sources
from millrace.llm.neardup import near_duplicates
from millrace.llm.sharding import shard_documents
from millrace.llm.storage import Table, release
from millrace.llm.toxicity import THRESHOLD, train, with_scores


def whole_row(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("__row")


def whole_rows(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns and all columns as one, so that names of documents never meet those of the operators."""
    return docs.select(*names, whole_row(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of the toxicity model; labels of held-out ids are not used.

    Null and empty texts show nothing toxic and stay.
    """
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs.where(rest != 2), labels.where(rest != 2))
    scored = with_scores(whole_rows(docs), model, "__row.text")
    silent = F.coalesce(F.octet_length("__row.text"), F.lit(0)) == 0
    return scored.where((F.col("score") < THRESHOLD) | silent).select("__row.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with 5-word shingle similarity 0.8 or more: the one with the least doc_id.

    Documents without words (null, empty, blank) are linked with nothing and all stay; of rows that agree in id and text
    one stays.
    """
    found = near_duplicates(docs, k=5, percent=80)
    kept = found.where((F.col("n_shingles") == 0) | F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    keyed = whole_rows(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("__text_key"), "__row")
    joined = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key")))
    # A second row with the same id and text differs in nothing that counts.
    return joined.dropDuplicates(["doc_id", "__text_key"]).select("__row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that is similar to an item of the benchmark; null and empty texts and repeated rows stay."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, range-partitioned and sorted into the order of the mixture.

    Read in file order, every prefix holds the sources at their target weights (rows ** 0.5) to within a block, until
    a source runs out. A null source is a source of its own; repeated rows and null texts stay.
    """
    return mix_sources(whole_rows(docs, "doc_id", "source"), carry=("__row",)).orderBy("position").select("__row.*")


def in_order(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, Column, Table | None]:
    """Rows, their number from 0 in the order of ``docs``, and the table written for it, if any.

    A Parquet table is taken in the order of its part files; readers deal these out by size, so a row's number is what
    the files before its own hold, plus its place there. The driver gets a row per file. Other plans are written first.
    """
    plan, made = docs._jdf.queryExecution().analyzed(), None
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().toString() != "parquet":
        made = Table(spark, docs, "ordered")
        docs = made.df
    file, place = docs.metadataColumn("_metadata")["file_path"], docs.metadataColumn("_metadata")["row_index"]
    counts = {r[0]: r[1] for r in docs.select(file.alias("file")).groupBy("file").count().collect()}

    def key(path: str) -> tuple:
        part = re.search(r"/part-(\d+)-[^/]*?(?:-c(\d+))?\.[^/]*$", path)
        return (0, int(part[1]), int(part[2] or 0), path) if part else (1, 0, 0, path)

    files = sorted(counts, key=key)
    starts = spark.createDataFrame(list(zip(files, itertools.accumulate((counts[f] for f in files), initial=0), strict=False)), "__file string, __start long")
    numbered = docs.join(F.broadcast(starts), file == F.col("__file"))
    return numbered, F.col("__start") + place, made


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their size, text_crc32, law, shard (0 to 7) and slot.

    Documents are dealt to the shards in the order that the mixing stage has left in ``docs`` (its files, if it is a
    table), so each shard read by slot holds the sources at their target weights. A null text counts as empty. A column
    of the documents that has the name of one of these five is returned as document_<name>.
    """
    rows, number, written = in_order(spark, docs)
    mixed = rows.select("doc_id", "text", whole_row(docs), number.alias("position"))
    placed = shard_documents(mixed, 8, order_col="position", carry=("__row",))
    if written:
        written.drop()
    made = ("size", "text_crc32", "law", "shard", "slot")
    old = [placed["__row"].getField(c).alias(f"document_{c}" if c.lower() in made else c) for c in docs.columns]
    return placed.select(*old, *made)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]

#: The toxicity model, the similarity join and the propagation can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; an empty table gives an empty result."""
    docs, table = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        before, table = table, Table(spark, out, name)
        docs = table.df
        if before:
            before.drop()
        release(spark)
    return docs
