"""Exact deduplication of texts, DataFrame operations only.

Texts are equal when they are identical after their white space is deleted.  Equal texts meet in three steps, and every
step groups by digest *and* by the whole normalised text, so that a digest never decides alone:

1. local: the partial aggregation keeps one row for each text and map task;
2. salted: what the tasks kept is merged by (digest, text, salt), the salt being the map task modulo ``salts``; a text
   with copies in every task is thus spread over ``salts`` reducers;
3. global: the at most ``salts`` winners of a text are combined.

Documents then take their verdict by digest, which names one text, unless the global step has seen two texts under one
digest; only then does the join compare texts as well.

Nulls: a null text counts as empty; all texts without a word are equal.  A null doc_id stays only if no copy has one.
Repeated rows of one document (same doc_id and text) share its verdict; ``dedup`` keeps one of them.  An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.llm.kit import SPACE, cut, keep_rows, text_hash

SALTS = 16


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, "")


def text_classes(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row for each different text: text_sha256, content, keep_id, keep_hash, group_size."""
    rows = docs.select(
        "doc_id",
        text_hash().alias("text_hash"),
        F.char_length(F.coalesce("text", F.lit(""))).alias("points"),
        normalised().alias("content"),
    ).select(
        F.sha2("content", 256).alias("text_sha256"),
        "content",
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"),
        # greatest first: most code points, then an id at all, then the smallest id; the hash only settles repeats
        F.struct(
            "points", F.col("doc_id").isNotNull().alias("has_id"), F.negative("doc_id").alias("minus_id"), "text_hash"
        ).alias("rank"),
    )
    salted = rows.groupBy("text_sha256", "content", "salt").agg(
        F.max("rank").alias("rank"), F.count(F.lit(1)).alias("group_size")
    )
    return (
        salted.groupBy("text_sha256", "content")
        .agg(F.max("rank").alias("rank"), F.sum("group_size").alias("group_size"))
        .select(
            "text_sha256", "content", F.negative("rank.minus_id").alias("keep_id"),
            F.col("rank.text_hash").alias("keep_hash"), "group_size",
        )
    )


def exact_duplicates(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, keep_id, group_size, kept, text_sha256, text_hash."""
    classes = text_classes(docs, salts)
    # the texts stay behind here; that a digest names one text has been found by comparing them
    narrow = cut(classes.drop("content"))
    shared = narrow.groupBy("text_sha256").count().where("count > 1").select("text_sha256")
    rows = docs.select("doc_id", text_hash().alias("text_hash"), F.sha2(normalised(), 256).alias("text_sha256"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_hash") == F.col("keep_hash"))
    columns = ["doc_id", "keep_id", "group_size", stays.alias("kept"), "text_sha256", "text_hash"]
    if shared.isEmpty():
        return rows.join(narrow, "text_sha256").select(*columns)
    # some digest names several texts: the join compares the texts themselves
    whole = docs.select(
        "doc_id", text_hash().alias("text_hash"), F.sha2(normalised(), 256).alias("text_sha256"), normalised().alias("content")
    )
    return whole.join(classes, ["text_sha256", "content"]).select(*columns)


def dedup(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The documents that stay, one row for each different text, with all columns."""
    kept = text_classes(docs, salts).select(F.col("keep_id").alias("doc_id"), F.col("keep_hash").alias("text_hash"))
    return keep_rows(docs, kept)
