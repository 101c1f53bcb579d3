"""Time spellings and date parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_text_millis(text: Column) -> Column:
    """Epoch milliseconds of a text holding seconds, with or without a fraction; NULL for other texts."""
    return F.floor(text.try_cast("decimal(28,9)") * 1000).cast("bigint")


def iso_millis(text: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(text))


def is_number(json_value: Column) -> Column:
    """A JSON scalar as spelled in the document: quoted values are text."""
    return ~F.startswith(F.trim(json_value), F.lit('"'))


def instant_millis(spelling: Column, as_of: Column) -> Column:
    """Epoch milliseconds of one JSON scalar *as spelled* (quotes kept).

    Quoted numbers are seconds (fraction allowed), other quoted texts are ISO instants, bare numbers are
    milliseconds, a missing value is ``as_of``. Anything else gives NULL, which callers reject.
    """
    raw = F.trim(spelling)
    text = F.regexp_replace(raw, '^"|"$', "")
    return (
        F.when(raw.isNull() | (raw == "null"), F.unix_millis(as_of))
        .when(F.startswith(raw, F.lit('"')), F.coalesce(seconds_text_millis(text), iso_millis(text)))
        .otherwise(F.floor(raw.try_cast("decimal(28,9)")).cast("bigint"))
    )


def eta_millis(spelling: Column) -> Column:
    """Like :func:`instant_millis`, but a quoted integer is milliseconds and a missing value stays NULL."""
    raw = F.trim(spelling)
    text = F.regexp_replace(raw, '^"|"$', "")
    return F.when(
        raw.isNotNull() & (raw != "null"),
        F.when(F.startswith(raw, F.lit('"')), F.coalesce(text.try_cast("bigint"), iso_millis(text))).otherwise(
            F.floor(raw.try_cast("decimal(28,9)")).cast("bigint")
        ),
    )


def weather_millis(text: Column, as_of: Column) -> Column:
    """Weather instants are ISO texts; everything else counts as ``as_of``."""
    return F.coalesce(iso_millis(text), F.unix_millis(as_of))


def feed_millis(text: Column, as_of: Column) -> Column:
    """Raw feed: epoch-millisecond text, else ISO text, else ``as_of``."""
    return F.when(text.isNull(), F.unix_millis(as_of)).otherwise(
        F.coalesce(text.try_cast("bigint"), iso_millis(text))
    )


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMM")


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def hour_start(ts: Column) -> Column:
    return F.date_trunc("hour", ts)
