"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected target / source size times in the mix.  The expected copies are prefix-summed
along the source, one offset between 0 and 1 is added, and a document is emitted once for each whole number that the
running sum crosses at it.  The source is run through in order of size, so that every stretch of sizes is sampled at the
same rate: the words taken differ from the target by less than about one document.  The sum needs ranks within a source;
they come from a range sort with partition offsets, so that a source with most of the rows is no single task.

The offset is a hash of the source's name and ``seed``: runs agree whatever the partitions.

Nulls: a null text has size 0, a null source is a source of its own (the last), a null doc_id is sorted first.  Documents
without words take no words; a source without words takes no copies.  Repeated rows count each.  Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.llm.kit import WORD, cut, fresh, ranked, text_hash

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CEILING = 2
SEED = "mix-1"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING
) -> DataFrame:
    """source, source_size, target for ``sizes(source, size)``.

    The weights go round the sources in code point order.  All sources share ``share`` times the total by weight; what a
    source would get above ``ceiling`` times its own size is shared anew among the others, until none is above.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = ranked(
        sources.withColumn("null_source", F.col("source").isNull()), [], ["null_source", "source"], "place"
    )
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = cut(
        sources.withColumn("weight", weight).withColumn("most", ceiling * F.col("source_size"))
        .select("source", "source_size", "weight", "most")
    )
    budget = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, full = None, F.lit(False)  # words for one unit of weight; sources at their ceiling
    while True:
        row = sources.agg(F.sum(F.when(full, F.col("most"))).alias("fixed"), F.sum(F.when(~full, F.col("weight"))).alias("free")).first()
        new = (budget - (row["fixed"] or 0)) / row["free"] if row["free"] else 0.0
        if new == level or not row["free"]:
            break
        level, full = new, F.col("weight") * F.lit(new) > F.col("most")
    share_of = F.when(full, F.col("most").cast("double")).otherwise(F.col("weight") * F.lit(float(level or 0.0)))
    return sources.select("source", "source_size", F.least(share_of, F.col("most").cast("double")).alias("target"))


def offset_of(source: str, seed: str = SEED) -> Column:
    """Between 0 and 1, from 32 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(source), F.lit("\x00"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def mix_copies(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING, seed: str = SEED
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, text_hash, size, source_size, target, copies, taken."""
    rows = docs.select("doc_id", "source", text_hash().alias("text_hash"), word_count().alias("size"))
    # cut first, else the range sort's sampling would read and count all words again
    rows = ranked(cut(rows), ["source"], ["size", "doc_id", "text_hash"], "place")
    rows = cut(rows)
    targets = source_targets(rows, weights, share, ceiling).withColumnRenamed("source", "target_source")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = offset_of("source", seed) + F.col("place") * F.col("expected")
    after = offset_of("source", seed) + (F.col("place") + 1) * F.col("expected")
    return (
        rows.join(targets, rows["source"].eqNullSafe(targets["target_source"]))
        .withColumn("expected", expected)
        .withColumn("copies", F.floor(after) - F.floor(start))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("doc_id", "source", "text_hash", "size", "source_size", "target", "copies", "taken")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs`` with all columns, each as often as it is taken.  Rows that repeat doc_id, source
    and text are copies of one document and share their copies."""
    names = [fresh(docs, n) for n in ("mix_id", "mix_source", "mix_hash", "mix_copies", "mix_own")]
    copies = (
        mix_copies(docs, **options).where("copies > 0").groupBy("doc_id", "source", "text_hash")
        .agg(F.sum("copies").alias("copies")).toDF(*names[:4])
    )
    left = docs.withColumn(names[4], text_hash())
    same = (
        left["doc_id"].eqNullSafe(copies[names[0]]) & left["source"].eqNullSafe(copies[names[1]])
        & (left[names[4]] == copies[names[2]])
    )
    once = left.join(copies, same).dropDuplicates([names[0], names[1], names[2]])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return once.withColumn(names[4], F.explode(F.sequence(F.lit(1).cast("long"), F.col(names[3])))).select(*columns)
