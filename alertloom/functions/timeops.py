"""Time rules as Column expressions. Session time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from alertloom import constants as K


def as_of_column(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def parse_ts(text: Column) -> Column:
    """ISO text (offset, Z or none = UTC) or epoch seconds; anything else null."""
    t = F.trim(text)
    epoch = F.timestamp_seconds(F.when(t.rlike(r"^\d{9,11}(?:\.\d+)?$"), t).cast("double"))
    iso = F.try_to_timestamp(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ].*)?$"), t))
    return F.coalesce(epoch, iso)


def effective_ts(*candidates: Column) -> Column:
    """First timestamp that is set; callers never pass updated_at."""
    return F.coalesce(*candidates)


def window_bounds(as_of, days: float = K.WINDOW_DAYS, hours: float | None = None,
                  skew_minutes: int = K.SKEW_MINUTES) -> tuple[Column, Column]:
    now = as_of_column(as_of)
    seconds = int(round(hours * 3600 if hours is not None else days * 86400))
    return now - F.expr(f"INTERVAL {seconds} SECONDS"), now + F.expr(f"INTERVAL {skew_minutes} MINUTES")


def pkt(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, K.PKT_ZONE)


def pkt_short(ts: Column) -> Column:
    return F.date_format(pkt(ts), "d MMM yyyy, hh:mm a")


def pkt_label(ts: Column) -> Column:
    return F.coalesce(F.concat(pkt_short(ts), F.lit(" PKT")), F.lit(""))


def pkt_stamp(ts: Column) -> Column:
    return F.coalesce(F.concat(F.date_format(pkt(ts), "yyyy-MM-dd HH:mm:ss"), F.lit(" PKT")), F.lit("N/A"))


def window_label(start: Column, end: Column) -> Column:
    return F.concat(pkt_short(start), F.lit(" to "), pkt_label(end))


def _js_round(x: Column) -> Column:
    return F.floor(x + 0.5)


def relative_time(ts: Column, now: Column) -> tuple[Column, Column]:
    """(amount, unit): rounded days, else hours, else minutes from now."""
    seconds = (F.unix_micros(ts) - F.unix_micros(now)) / F.lit(1e6)
    days, hours, minutes = (_js_round(seconds / n) for n in (86400.0, 3600.0, 60.0))
    amount = F.when(F.abs(days) >= 1, days).when(F.abs(hours) >= 1, hours).otherwise(minutes)
    unit = F.when(F.abs(days) >= 1, "day").when(F.abs(hours) >= 1, "hour").otherwise("minute")
    return amount, F.when(ts.isNotNull(), unit)


def relative_phrase(amount: Column, unit: Column) -> Column:
    plural = F.when(F.abs(amount) == 1, "").otherwise("s")
    far = F.concat(F.abs(amount).cast("string"), F.lit(" "), unit, plural)
    return (
        F.when(unit.isNull(), "Not provided")
        .when((unit == "day") & (amount == 1), "tomorrow")
        .when((unit == "day") & (amount == -1), "yesterday")
        .when((unit == "minute") & (amount == 0), "this minute")
        .when(amount > 0, F.concat(F.lit("in "), far))
        .otherwise(F.concat(far, F.lit(" ago")))
    )
