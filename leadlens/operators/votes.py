"""Votes: last event per visitor and offer, totals, and a visitor's own vote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_votes(events: DataFrame) -> DataFrame:
    """Upsert semantics over vote events (offer_id, fingerprint, vote, created_at, event_id): the last event
    per key holds, and a last vote of 0 removes it."""
    last = events.groupBy("offer_id", "fingerprint").agg(
        F.max_by(F.struct("vote", "created_at"), F.struct("created_at", "event_id")).alias("last")
    )
    return last.select("offer_id", "fingerprint", "last.vote", "last.created_at").where("vote <> 0")


def vote_totals(votes: DataFrame) -> DataFrame:
    return votes.groupBy("offer_id").agg(
        F.count_if(F.col("vote") == 1).alias("likes"), F.count_if(F.col("vote") == -1).alias("dislikes")
    )


def my_votes(offers: DataFrame, votes: DataFrame, fingerprint: str) -> DataFrame:
    """A visitor's vote on each offer, 0 where there is none."""
    mine = votes.where(F.col("fingerprint") == fingerprint).select(F.col("offer_id").alias("id"), "vote")
    return offers.select("id").join(mine, "id", "left").select(
        F.col("id").alias("offer_id"), F.coalesce("vote", F.lit(0)).alias("my_vote")
    )
