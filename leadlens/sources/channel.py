"""Channel messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.functions.words import truthy_number, truthy_text
from leadlens.sources.common import empty_if_null, meta
from leadlens.schemas import with_schema

# A landed message; the forward origin is a chat (name or title), a person's name, or a bare header.
MESSAGE_TYPE = (
    "struct<channel:string,chat_id:bigint,msg_id:bigint,date:timestamp,text:string,"
    "forward:struct<username:string,title:string,from_name:string>,fwd_from:struct<from_name:string>,"
    "reply_to:struct<top_id:bigint,msg_id:bigint>>"
)


def forward_origin(forward: Column, header: Column) -> Column:
    """User name, else chat title, else the forwarded-from name."""
    names = [forward["username"], forward["title"], forward["from_name"], header["from_name"]]
    return F.coalesce(*[truthy_text(n) for n in names])


def on_topic(messages: DataFrame, config: DataFrame) -> DataFrame:
    """Keep a channel's rows only if they belong to its configured topic; channels without one keep all."""
    wanted = config.select("channel", truthy_number(F.col("topic_id")).alias("_topic"))
    topic = F.coalesce(truthy_number(F.col("reply_to.top_id")), F.col("reply_to.msg_id"))
    joined = messages.join(wanted, "channel", "left")
    return joined.where(F.col("_topic").isNull() | F.coalesce(topic == F.col("_topic"), F.lit(False))).drop("_topic")


def message_signals(messages: DataFrame) -> DataFrame:
    """Messages as signals: whole text and the permalink of the message.

    Arrival order is the message time, then chat and message number; works on batches and streams.
    """
    channel = F.coalesce(truthy_text(F.col("channel")), F.col("chat_id").cast("string"))
    link = F.concat(F.lit("https://t.me/"), channel, F.lit("/"), F.col("msg_id").cast("string"))
    rows = messages.select(
        F.lit("telegram").alias("source"),
        empty_if_null(F.col("text")).alias("raw_text"),
        link.alias("source_url"),
        F.col("date").alias("observed_at"),
        F.unix_micros(F.col("date").cast("timestamp")).alias("ingest_seq"),
        F.array(F.col("chat_id").cast("bigint"), F.col("msg_id").cast("bigint")).alias("place"),
        meta(channel=channel, forward_from=forward_origin(F.col("forward"), F.col("fwd_from"))).alias("meta"),
    )
    return with_schema(rows, "signals_in")


def parse_messages(payloads: DataFrame) -> DataFrame:
    """Landed messages (one JSON message per body) as signals."""
    return message_signals(payloads.select(F.from_json("body", MESSAGE_TYPE).alias("_m")).where("_m is not null").select("_m.*"))


def upstream_channels(signals: DataFrame) -> DataFrame:
    """Distinct origins seen in forwards, for review."""
    origin = truthy_text(F.col("meta.forward_from"))
    return signals.where(origin.isNotNull()).select(origin.alias("channel")).distinct().orderBy("channel")
