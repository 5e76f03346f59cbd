"""Exact dedup by a tree-merge of sorted digest runs.

Each scan partition makes one run: its digests in order, each with its smallest identifier and a count (the
map side of a sort-based aggregation). Runs are numbered, and in binomial rounds run r goes to run r >> BITS:
2**BITS runs meet, are merged by digest, and of equal digests the smallest identifier stays. An entry of a run
carries SHA-256 of the normalised text with its length and a second, unrelated hash; entries merge only if all
three agree, so every level verifies what it keeps. Within a round entries are dealt by (run, digest), so that
the last merge is spread like the first. Whole rows never move: only digests do.

Edge cases: a null text counts as empty; texts that differ only in the length or kind of white space runs are
equal; a null doc_id sorts after all others; of several rows with the smallest doc_id exactly one is kept;
an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, one_row_each, stage, table

#: Runs at the leaves of the tree, and runs that meet in a round (2 ** BITS).
LEAVES, BITS = 64, 3
KEY = ["digest", "length", "check"]


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, uid (a row's own number), digest, length, check; staged, so that uid is fixed."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), normalised().alias("t"))
    return stage(rows.select(
        "doc_id", "uid", F.unhex(F.sha2("t", 256)).alias("digest"), F.length("t").alias("length"),
        F.xxhash64("t").alias("check")), "digests")


def tree_merge(rows: DataFrame, leaves: int = LEAVES, bits: int = BITS) -> DataFrame:
    """One row for each text: KEY, best (struct: is_null, doc_id, uid of the row that stays), group_size."""
    runs = rows.select(
        (F.spark_partition_id() % leaves).alias("run"), *KEY,
        F.struct(F.col("doc_id").isNull().alias("is_null"), "doc_id", "uid").alias("best"), F.lit(1).cast("long").alias("group_size"))
    left = leaves
    while left > 1:
        left = -(-left >> bits) if left >= 1 << bits else 1
        runs = runs.groupBy(F.shiftright("run", bits).alias("run"), *KEY).agg(
            F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
    return runs.drop("run")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row for each row of docs."""
    rows = digests(docs)
    groups = stage(tree_merge(rows).select(*KEY, "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("keep_uid")), "digest-groups")
    return attach(rows, groups, KEY, "group_size", rows.count()).select(
        "doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with docs' columns. The texts move once, for the join with the decisions."""
    found = stage(exact_dedup(docs).select("doc_id", "text_sha256", "kept", "keep_id"), "exact-dedup")
    mine, sha = ["__id", "__sha"], F.sha2(normalised(), 256)
    name = lambda d: d.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    # A null doc_id can't be joined on; its text can.
    fill = lambda d: d.withColumn("__id", F.coalesce(F.col("__id").cast("string"), F.lit("null")))
    rows = fill(docs.withColumn("__id", F.col("doc_id")).withColumn("__sha", sha))
    repeated = fill(name(found.where(~F.col("kept") & F.col("doc_id").eqNullSafe(F.col("keep_id"))))).distinct()
    stay = rows.join(fill(name(found.where("kept"))), mine, "left_semi")
    return one_row_each(stay, mine, repeated).select(*docs.columns)


def op5_tree_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
h AS (SELECT doc_id, sha256(t) AS text_sha256 FROM d)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM h
"""
