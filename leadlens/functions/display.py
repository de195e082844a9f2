"""Presentation columns: channel labels, claim steps, money, lead and age texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlens.functions.words import truthy_number, truthy_text

_JUST_NOW, _MIN, _HOUR, _DAY = "только что", " мин назад", " ч назад", " дн назад"  # fixed values


def _channel_segment(url: Column) -> Column:
    return truthy_text(F.regexp_extract(url, r"(?s)t\.me/([^/]*)", 1))


def channel_label(source_url: Column) -> Column:
    """``@name`` of a channel link, ``Telegram`` for invite links, NULL for other URLs."""
    name = _channel_segment(source_url)
    return F.when(
        F.contains(source_url, F.lit("t.me/")),
        F.when(name.isNotNull() & ~F.startswith(name, F.lit("+")), F.concat(F.lit("@"), name)).otherwise("Telegram"),
    )


def channel_raw(source_url: Column) -> Column:
    """Raw channel segment, NULL when there is none."""
    return F.when(F.contains(source_url, F.lit("t.me/")), _channel_segment(source_url))


def claim_steps(text: Column) -> Column:
    """Steps of a free-text instruction: split at newlines, numbered items and bullets; short pieces dropped."""
    pieces = F.split(text, r"\n|(?=\d+[.)]\s)|●|•|▪")
    trimmed = F.transform(pieces, lambda p: F.btrim(F.regexp_replace(p, r"^\s*\d+[.)]\s*", ""), F.lit(" \t\r\n")))
    return F.filter(trimmed, lambda p: F.length(p) > 2)


def _plain_number(amount: Column) -> Column:
    """Whole amounts without a fraction, others rounded to a whole number."""
    return F.round(amount).cast("bigint").cast("string")


def _symbol(currency: Column) -> Column:
    return F.when(F.coalesce(truthy_text(currency), F.lit("USD")) == "USD", "$").otherwise(
        F.concat(currency, F.lit(" "))
    )


def amount_label(amount: Column, currency: Column) -> Column:
    return F.when(truthy_number(amount).isNull(), "").otherwise(F.concat(_symbol(currency), _plain_number(amount)))


def value_label(amount: Column, unit: Column, currency: Column) -> Column:
    """Amount with its unit; credits are grouped by thousands."""
    exact = F.when(amount % 1 == 0, amount.cast("bigint").cast("string")).otherwise(amount.cast("string"))
    grouped = F.regexp_replace(F.format_number(amount, 3), r"\.?0+$", "")
    grouped = F.when(amount % 1 == 0, F.format_number(amount, 0)).otherwise(grouped)
    return (
        F.when(truthy_number(amount).isNull(), "")
        .when(unit == "credits", F.concat(grouped, F.lit("cr")))
        .when(unit == "days", F.concat(exact, F.lit("d trial")))
        .when(unit == "months", F.concat(exact, F.lit("mo")))
        .otherwise(F.concat(_symbol(currency), _plain_number(amount)))
    )


def lead_label(hours: Column) -> Column:
    whole = lambda c: F.round(c).cast("bigint").cast("string")
    return F.when(hours.isNull() | (hours <= 0), F.lit(None).cast("string")).when(
        hours < 24, F.concat(F.lit("+"), whole(hours), F.lit("h ahead"))
    ).otherwise(F.concat(F.lit("+"), whole(hours / 24), F.lit("d ahead")))


def age_label(ts: Column, as_of: Column) -> Column:
    """Relative age in Russian, in minutes, hours or days."""
    sec = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 1e6)
    unit = lambda n: F.floor(sec / n).cast("string")
    return (
        F.when(ts.isNull(), "—")
        .when(sec < 60, _JUST_NOW)
        .when(sec < 3600, F.concat(unit(60), F.lit(_MIN)))
        .when(sec < 86400, F.concat(unit(3600), F.lit(_HOUR)))
        .otherwise(F.concat(unit(86400), F.lit(_DAY)))
    )


def is_within_hours(ts: Column, as_of: Column, hours: float) -> Column:
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    return F.coalesce(micros < int(hours * 3.6e9), F.lit(False))


def score_percent(score: Column) -> Column:
    return F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)) * 100).cast("int")


def hours_label(hours: Column) -> Column:
    """``Xh Ym`` of an absolute number of hours."""
    size = F.abs(hours)
    whole = F.floor(size)
    minutes = F.round((size - whole) * 60).cast("bigint")
    return F.concat(whole.cast("string"), F.lit("h "), minutes.cast("string"), F.lit("m"))


def fingerprint(client_ip: Column, forwarded_for: Column, user_agent: Column) -> Column:
    """SHA-256 of ``ip|agent``; the address is the client IP, else the first forwarded one."""
    forwarded = F.btrim(F.substring_index(forwarded_for, ",", 1), F.lit(" \t\r\n"))
    ip = F.coalesce(client_ip, forwarded, F.lit("unknown"))
    return F.sha2(F.concat(ip, F.lit("|"), F.coalesce(user_agent, F.lit("unknown"))), 256)


def sql_literal(value: Column, data_type: str) -> Column:
    """SQL text of a value: NULL, 0/1, number, or a quoted string with quotes doubled."""
    if data_type == "boolean":
        text = F.when(value, "1").otherwise("0")
    elif data_type in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        text = value.cast("string")
    else:
        quoted = F.replace(value.cast("string"), F.lit("'"), F.lit("''"))
        text = F.concat(F.lit("'"), quoted, F.lit("'"))
    return F.when(value.isNull(), "NULL").otherwise(text)
