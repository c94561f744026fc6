"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its content says so. Each chunk gets a short identifier (hash and length), and a dictionary of
distinct chunks verifies by SHA-256 that no identifier stands for two contents; a document that holds a chunk of an
identifier that does is told apart by those chunks' digests as well. Two texts are equal when their ordered identifier lists
are. Long texts are read once, where they lie, and never shuffled: only recipes of some 50 bytes a kilobyte move.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

#: A chunk ends after the first sentence or line end past its minimum; where none comes, at its maximum.
CHUNK = r"(?s).{256,4096}?[.!?;\n]|.{1,4096}"


def recipe(text: Column, identifier: Callable[[Column], Column] = F.xxhash64) -> Column:
    """Ordered list of (h, n, digest) of the chunks of a text; empty for an empty text."""
    chunks = F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))
    return F.transform(chunks, lambda c: F.struct(identifier(c).alias("h"), F.octet_length(c).alias("n"), F.unhex(F.sha2(c, 256)).alias("digest")))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", identifier: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the largest id stays (keep_id, kept);
    rows that repeat both id and text all bear kept, a null id is never the one that stays unless its group has no other
    (then keep_id is null and kept true for all). An empty table gives no rows. Other columns are not read.
    ``identifier`` makes a chunk's number; that two contents share one costs a join, not the result.
    Groups are counted before they are shuffled, and the join back may be split where a group is large.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = df.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("text_sha256"), recipe(text, identifier).alias("chunks"))
    docs = materialize(found, "recipes").withColumn("ids", F.transform("chunks", lambda c: F.struct(c["h"], c["n"])))
    chunks = docs.select("id", "text_sha256", F.posexplode("chunks").alias("at", "c")).select("id", "text_sha256", "at", "c.*")
    unsure = chunks.groupBy("h", "n").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where(F.col("lo") != F.col("hi"))
    unsure = materialize(unsure.select("h", "n"), "unsure")
    none = F.array().cast("array<struct<at:int,digest:binary>>")
    if unsure.isEmpty():  # as a rule: no identifier stands for two contents, and chunks need not meet
        docs = docs.select("id", "text_sha256", "ids", none.alias("told"))
    else:
        # by (id, text): the chunks whose identifiers do not tell contents apart, with their digests (no such chunk: no row)
        told = (
            chunks.join(unsure, ["h", "n"])
            .groupBy(F.col("id").alias("told_id"), F.col("text_sha256").alias("told_sha"))
            .agg(F.array_sort(F.collect_set(F.struct("at", "digest"))).alias("told"))
        )
        docs = docs.join(told, F.col("id").eqNullSafe(F.col("told_id")) & (F.col("text_sha256") == F.col("told_sha")), "left")
        docs = docs.select("id", "text_sha256", "ids", F.coalesce("told", none).alias("told"))
    groups = docs.groupBy("ids", "told").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return docs.join(groups, ["ids", "told"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.size("ids").alias("n_chunks")
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, whose text no row with a larger id repeats; repeated rows leave one."""
    groups = exact_groups(df, id_col, text_col)
    gone = groups.where(~F.col("kept")).select(F.col(id_col).alias("gone_id"), F.col("text_sha256").alias("gone_sha")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])  # as one column, so that no name can clash
    held = df.select(row.alias("row"), F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("sha"))
    held = held.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("sha") == F.col("gone_sha")), "left_anti")
    return held.dropDuplicates(["id", "sha"]).select("row.*")


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
