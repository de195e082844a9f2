"""Lead time between our sources and the aggregators, and the scoreboards built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens import lexicon as lx
from leadlens.functions.score import lead_hours, round_steady


def lead_metrics(signals: DataFrame, aggregators=lx.AGGREGATOR_SOURCES, key: str = "offer_id") -> DataFrame:
    """First time per offer on each side and the lead between them."""
    is_agg = F.col("source").isin(*aggregators)
    firsts = signals.groupBy(key).agg(
        F.min(F.when(~is_agg, F.col("observed_at"))).alias("first_seen_by_us"),
        F.min(F.when(is_agg, F.col("observed_at"))).alias("first_seen_in_aggregator"),
    )
    return firsts.withColumn("lead_hours", lead_hours(F.col("first_seen_by_us"), F.col("first_seen_in_aggregator")))


def first_source(signals: DataFrame, key: str = "offer_id") -> DataFrame:
    """Source and URL of the earliest signal per offer, both from the same row."""
    earliest = F.min_by(F.struct("source", "source_url"), F.struct("observed_at", "signal_id"))
    return signals.groupBy(key).agg(earliest.alias("first")).select(key, "first.source", "first.source_url")


def value_counts(values: DataFrame, column: str, *more: Column) -> DataFrame:
    """Rows per distinct value (columns v, n and the aggregates ``more``), NULL left out."""
    return values.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"), *more)


def exact_median(counts: DataFrame, cells: int = 1024, rounds: int = 2) -> DataFrame:
    """Exact median of counted values (v, n) as a one-row frame (column ``median``).

    Selection by histograms: a round divides the range that holds the middle ranks into ``cells`` equal cells, counts them, and
    goes on with the range of the cell with these ranks.  A round is one aggregation to at most ``cells`` rows; no task
    sees the values themselves, and nothing runs before the result is asked for.  What the last round leaves, values
    closer to each other than the range over ``cells ** rounds``, is sorted.
    """
    total = F.sum("n")
    state = counts.agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.floor((total + 1) / 2).alias("r1"), F.floor((total + 2) / 2).alias("r2"),
        F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
    )
    v, s = F.col("v"), F.col("s")
    for last in [False] * rounds + [True]:
        # one row, so that this join is a filter by the range
        inside = counts.join(F.broadcast(state.select(F.struct("*").alias("s"))), (v >= s["lo"]) & (v <= s["hi"]))
        width = s["hi"] - s["lo"]
        place = F.when(width > 0, F.least(F.floor((v - s["lo"]) / width * cells), F.lit(cells - 1))).otherwise(F.lit(0))
        steps = inside.groupBy((v if last else place).alias("step")).agg(
            F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("s").alias("s")
        )
        ordered = steps.agg(F.array_sort(F.collect_list(F.struct("step", "n", "lo", "hi"))).alias("steps"), F.max("s").alias("s"))
        state = ordered.select(_holding("steps", s).alias("f"), "s").select(*_descended(F.col("f"), s))
    return state.select(((F.col("low") + F.col("high")) / 2).alias("median"))


_HELD = "struct<lo:double,hi:double,before:bigint>"


def _holding(steps: str, s: Column) -> Column:
    """The steps with the ranks r1 and r2, and the rows before them: struct(a, b)."""
    none = F.lit(None).cast(_HELD)

    def walk(acc: Column, step: Column) -> Column:
        upto = acc["upto"] + step["n"]
        here = F.struct(step["lo"], step["hi"], acc["upto"]).cast(_HELD)
        take = lambda old, rank: F.when(old.isNull() & (upto >= rank), here).otherwise(old)
        return F.struct(upto.alias("upto"), take(acc["a"], s["r1"]).alias("a"), take(acc["b"], s["r2"]).alias("b"))

    start = F.struct(F.lit(0).cast("bigint").alias("upto"), none.alias("a"), none.alias("b"))
    return F.aggregate(steps, start, walk)


def _descended(f: Column, s: Column) -> list[Column]:
    """The range of the step with both ranks; where two steps hold them, the ranks are its ends and so are known."""
    a, b = f["a"], f["b"]
    one = (a["lo"] == a["hi"]) & (b["lo"] == b["hi"])
    apart = (a["before"] < b["before"]) | one
    return [
        a["lo"].alias("lo"), b["hi"].alias("hi"), (s["r1"] - a["before"]).alias("r1"), (s["r2"] - a["before"]).alias("r2"),
        F.coalesce(s["low"], F.when(apart, a["hi"])).alias("low"), F.coalesce(s["high"], F.when(apart, b["lo"])).alias("high"),
    ]


def one_row(*parts: DataFrame) -> DataFrame:
    """Combine one-row frames with different columns into one row (union and max; no cross join)."""
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part, allowMissingColumns=True)
    return total.agg(*[F.max(c).alias(c) for c in total.columns])


def lead_summary(metrics: DataFrame, variant: str = "api") -> DataFrame:
    """Average, exact median, offers ahead and offers compared.

    ``api`` averages all leads and rounds both figures; ``edge`` averages only the positive ones and leaves
    the median as it is.
    """
    counts = value_counts(metrics, "lead_hours")
    ahead = F.col("v") > 0
    in_average = F.lit(True) if variant == "api" else ahead
    weight = F.sum(F.when(in_average, F.col("n")))
    scalars = counts.agg(
        round_steady(F.sum(F.when(in_average, F.col("v") * F.col("n"))) / weight, 2).alias("avg_hours"),
        F.coalesce(F.sum(F.when(ahead, F.col("n"))), F.lit(0)).alias("count_ahead"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("count_total"),
    )
    median = round_steady(F.col("median"), 2) if variant == "api" else F.col("median")
    return one_row(scalars, exact_median(counts).select(median.alias("median_hours")))


def _floor_percent(part: Column, total: Column) -> Column:
    return F.floor(100 * part / total)


def lead_scoreboard(metrics: DataFrame, offers: DataFrame, services: DataFrame) -> DataFrame:
    """Ahead, behind and tied counts with floor percentages, average, median and the best domain."""
    v, n, ahead = F.col("v"), F.col("n"), F.col("v") > 0
    counts = value_counts(scored_leads(metrics, offers, services), "lead_hours", F.min_by("canonical_domain", "offer_id").alias("domain"))
    rows = lambda condition: F.coalesce(F.sum(F.when(condition, n)), F.lit(0))
    counted = counts.agg(
        rows(F.lit(True)).alias("tracked"),
        rows(ahead).alias("ahead"),
        rows(v < 0).alias("behind"),
        rows(v == 0).alias("tied"),
        round_steady(F.sum(v * n) / F.sum(n), 1).alias("avg_lead"),
        F.max(F.when(ahead, v)).alias("best_lead"),
        F.max_by("domain", F.when(ahead, v)).alias("best_domain"),
    )
    both = one_row(counted, exact_median(counts).select(round_steady(F.col("median"), 1).alias("median_lead")))
    return both.withColumns(
        {
            "ahead_pct": _floor_percent(F.col("ahead"), F.col("tracked")),
            "behind_pct": _floor_percent(F.col("behind"), F.col("tracked")),
        }
    )


def scored_leads(metrics: DataFrame, offers: DataFrame, services: DataFrame) -> DataFrame:
    """Lead metrics with the domain of their offer's service (three-way inner join)."""
    return (
        metrics.where(F.col("lead_hours").isNotNull())
        .join(offers.select(F.col("id").alias("offer_id"), "service_id"), "offer_id")
        .join(services.select(F.col("id").alias("service_id"), F.col("canonical_domain")), "service_id")
    )


def top_leads(metrics: DataFrame, offers: DataFrame, services: DataFrame, limit: int = 10) -> DataFrame:
    return (
        scored_leads(metrics, offers, services)
        .select("offer_id", "canonical_domain", "lead_hours", "first_seen_by_us")
        .orderBy(F.desc("lead_hours"), "offer_id")
        .limit(limit)
    )


def source_leaderboard(metrics: DataFrame, signals: DataFrame) -> DataFrame:
    """Which first source gives offers the biggest lead over the aggregators."""
    leads = metrics.where(F.col("lead_hours").isNotNull()).select("offer_id", "lead_hours")
    return (
        leads.join(first_source(signals).select("offer_id", "source"), "offer_id", "left")
        .where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(
            round_steady(F.avg("lead_hours"), 2).alias("avg_lead_hours"),
            F.count("*").alias("count_total"),
            F.count_if(F.col("lead_hours") > 0).alias("count_ahead"),
        )
        .orderBy(F.desc("avg_lead_hours"), "source")
    )


def source_leaderboard_single_pass(signals: DataFrame, aggregators=lx.AGGREGATOR_SOURCES) -> DataFrame:
    """Same leaderboard from the raw signals: lead and first source come from one aggregation per offer, so the
    signals are read and shuffled once."""
    is_agg = F.col("source").isin(*aggregators)
    per_offer = signals.groupBy("offer_id").agg(
        F.min(F.when(~is_agg, F.col("observed_at"))).alias("us"),
        F.min(F.when(is_agg, F.col("observed_at"))).alias("agg"),
        F.min_by("source", F.struct("observed_at", "signal_id")).alias("source"),
    )
    return (
        per_offer.withColumn("lead_hours", lead_hours(F.col("us"), F.col("agg")))
        .where(F.col("lead_hours").isNotNull() & F.col("source").isNotNull())
        .groupBy("source")
        .agg(
            round_steady(F.avg("lead_hours"), 2).alias("avg_lead_hours"),
            F.count("*").alias("count_total"),
            F.count_if(F.col("lead_hours") > 0).alias("count_ahead"),
        )
        .orderBy(F.desc("avg_lead_hours"), "source")
    )
