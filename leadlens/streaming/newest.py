"""The newest signals of each service, kept as state: a service's list is bounded, and a batch hands on the lists it changes."""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator
from itertools import chain

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FIELDS = {"observed_at": "bigint", "signal_id": "bigint", "source": "string", "source_url": "string", "raw_text": "string"}
SIGNAL = "struct<" + ", ".join(f"{name} {kind}" for name, kind in FIELDS.items()) + ">"
NEWEST = f"service_id bigint, newest array<{SIGNAL}>"
SHOWN = 1200  # characters of a text that are shown


class Newest(StatefulProcessor):
    """Keeps the ``n`` newest rows of a service: latest first, then the greatest id."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle):
        self.kept = handle.getValueState("kept", f"rows array<{SIGNAL}>")

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
        old = [tuple(r) for r in self.kept.get()[0]] if self.kept.exists() else []
        arrived = (tuple(r[name] for name in FIELDS) for r in rows)
        new = heapq.nlargest(self.n, chain(old, arrived), key=_age)
        if new != old:
            self.kept.update((new,))
            yield Row(service_id=key[0], newest=[dict(zip(FIELDS, r)) for r in new])

    def close(self) -> None:
        pass


def _age(row: tuple) -> tuple:
    return tuple((v is not None, v or 0) for v in row[:2])


def newest_signals(signals: DataFrame, n: int = 20) -> DataFrame:
    """Stream of (service_id, newest), one row for each service that a batch changes.  Repeats of a stored signal must be
    gone already."""
    rows = signals.where(F.col("service_id").isNotNull()).select(
        "service_id", "signal_id", "source", "source_url", F.substring(F.coalesce("raw_text", F.lit("")), 1, SHOWN).alias("raw_text"),
        F.unix_micros(F.col("observed_at").cast("timestamp")).alias("observed_at"),
    )
    return rows.groupBy("service_id").transformWithState(Newest(n), NEWEST, "Append", "None")


def as_rows(newest: DataFrame) -> DataFrame:
    """The lists as rows with their ``position`` from 1."""
    rows = newest.select("service_id", F.posexplode("newest").alias("place", "s"))
    return rows.select("service_id", (F.col("place") + 1).alias("position"), "s.*").withColumn("observed_at", F.timestamp_micros("observed_at"))
