"""Helpers that several operators share: words, row keys, cut lineage, distributed ranks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the data contract: white space, and words between it.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
_OWN: dict[str, str] = {}  # temporary folders of local applications


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Only a local master may go without it;
    it then gets a temporary folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        application = spark.sparkContext.applicationId
        if application not in _OWN:
            _OWN[application] = tempfile.mkdtemp(prefix="leadlens-llm-")
        folder = _OWN[application]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def run_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; the writer creates it."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage with a reliable checkpoint, which outlives lost executors.  Spark removes the
    files when the frame is garbage (``spark.cleaner.referenceTracking.cleanCheckpoints``)."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def text_hash(text: str = "text") -> Column:
    """Tells rows that repeat a doc_id apart; never used to decide that two texts are equal."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text hash) stands in ``kept(doc_id, text_hash)``: one row for each, whole and
    with all its columns.  The texts are shuffled once: repeated rows go, and the kept ones are found, under one key."""
    name = fresh(docs, "kept")
    key = {f"{name}_id": F.coalesce("doc_id", F.lit(0)), f"{name}_none": F.col("doc_id").isNull()}
    left = docs.withColumns({**key, f"{name}_hash": text_hash()})
    columns = [*key, f"{name}_hash"]
    number = F.row_number().over(Window.partitionBy(*columns).orderBy(F.lit(0)))
    once = left.withColumn(f"{name}_n", number).where(F.col(f"{name}_n") == 1)
    right = kept.select(*[c.alias(n) for n, c in key.items()], F.col("text_hash").alias(f"{name}_hash")).distinct()
    return once.join(right, columns, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if the frame has such a column."""
    taken = {c.lower() for c in df.columns}
    while any(c.startswith(name) for c in taken):
        name = f"_{name}"
    return name


def ranked(df: DataFrame, within: list[str], order: list[Column | str], name: str) -> DataFrame:
    """Adds the rank (from 0) of each row among the rows of its key, without bringing a key into one task: rows are
    range-sorted by key and order, numbered inside their partition, and moved on by the counts of the partitions before.

    ``order`` must tell rows apart as far as it matters; rows equal in it get any order.  The result is independent
    of the partition bounds.
    """
    keys = [F.col(c) for c in within]
    slot = Window.partitionBy(*within).orderBy("part_") if within else Window.orderBy("part_")
    rows = cut(
        df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
        .withColumn("at_", F.monotonically_increasing_id())
        .withColumn("part_", F.shiftright("at_", 33))
    )
    # one row for each key and partition: at most two partly filled partitions a key, besides those it fills alone
    starts = (
        rows.groupBy("part_", *within).agg(F.min("at_").alias("first_"), F.count(F.lit(1)).alias("rows_"))
        .withColumn("before_", F.coalesce(F.sum("rows_").over(slot.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select(F.col("part_").alias("start_part_"), *[F.col(c).alias(f"{c}_start_") for c in within], "first_", "before_")
    )
    same = rows["part_"] == starts["start_part_"]
    for c in within:
        same = same & rows[c].eqNullSafe(starts[f"{c}_start_"])
    return (
        rows.join(starts, same)
        .withColumn(name, F.col("at_") - F.col("first_") + F.col("before_"))
        .select(*[c for c in df.columns if c != name], name)
    )
